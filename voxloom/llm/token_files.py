"""Token ids in files: an adaptive context-mixing range coder over independent blocks.

For each id two predictions are made, by the last id seen after the two ids
before it (order 2) and after the one before it (order 1), each with a count of
how often it held. The order-0 prediction is the file's own distribution of ids.
The three are mixed with weights that adapt to how each state of the two counts
has fared so far, and the mixture drives a range coder. Blocks start from
nothing and carry a checksum of their ids, so any block can be read alone. All
blocks of a file are coded in step, one lane of a numpy array each.

File: magic, a JSON header (its length first), the documents' keys and lengths,
the order-0 table, the blocks' table (ids, words, crc32), then the blocks' 32-bit
words. A null text is an empty one and has its end id alone; repeated keys keep
their rows, by text; an empty table writes no file.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import batches_of, long_array, parts_for, range_of, ranged, settled, texts_of, work_folder
from voxloom.llm.encoders import encoder

MAGIC = b"VXIDS1\n"
BLOCK = 4096
LANES = 1024
END = 0
TABLE_BITS = 12
RATE = 4
SCALE0 = 18  # bits of the order-0 distribution
WIDEST0 = 20  # its bits in a file of more ids than SCALE0 has room for; beyond, the range of 32 bits is used up
ONE = 4096
_A, _B = np.uint32(2654435761), np.uint32(2246822519)


def order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, and frequencies of at least 1 that add up to 2 ** SCALE0,
    or to 2 ** WIDEST0 where they are more than half as many as that has room for."""
    found, counts = np.unique(ids, return_counts=True)
    scale = SCALE0 if 2 * len(found) <= 1 << SCALE0 else WIDEST0
    total = (1 << scale) - len(found)
    if total < 0:
        raise ValueError(f"a file of {len(found)} distinct ids; at most {1 << scale} can be coded")
    share = 1 + (counts * total) // max(1, int(counts.sum()))
    share[int(np.argmax(share))] += (1 << scale) - int(share.sum())
    return found.astype(np.uint32), share.astype(np.uint32)


class Model:
    """The predictions of all lanes, each on its own; encoder and decoder move it alike."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.base = np.arange(lanes, dtype=np.int64) << TABLE_BITS
        self.two = np.zeros(lanes << TABLE_BITS, np.int64)  # id << 2 | held
        self.one = np.zeros(lanes << TABLE_BITS, np.int64)
        self.hit2 = np.full(lanes * 16, ONE // 4, np.int64)
        self.hit1 = np.full(lanes * 16, ONE // 4, np.int64)
        self.states = np.arange(lanes, dtype=np.int64) * 16
        self.p1 = np.zeros(lanes, np.uint32)
        self.p2 = np.zeros(lanes, np.uint32)

    def predict(self, n: int) -> None:
        """Of the first n lanes: the ids predicted, and the widths of both."""
        shift = np.uint32(32 - TABLE_BITS)
        h1 = self.p1[:n] * _A
        self.at2 = self.base[:n] + (((h1 ^ self.p2[:n]) * _B) >> shift)
        self.at1 = self.base[:n] + (h1 >> shift)
        c2, c1 = self.two[self.at2], self.one[self.at1]
        self.id2, self.id1 = c2 >> 2, c1 >> 2
        self.n2, self.n1 = c2 & 3, c1 & 3
        self.state = self.states[:n] + (self.n2 << 2) + self.n1
        w2 = self.hit2[self.state]
        self.w2 = np.clip(w2, 1, ONE - 3)
        rest = ONE - self.w2
        self.w1 = np.clip((rest * self.hit1[self.state]) >> 12, 1, rest - 2)

    def update(self, ids: np.ndarray, kind: np.ndarray) -> None:
        """`kind`: 0 where the order-2 prediction held, 1 where only that of order 1 did, 2 elsewhere."""
        n = len(ids)
        held2 = kind == 0
        self.hit2[self.state] += ((held2 << 12) - self.hit2[self.state]) >> RATE
        miss = np.flatnonzero(~held2)
        state = self.state[miss]
        self.hit1[state] += (((kind[miss] == 1) << 12) - self.hit1[state]) >> RATE
        keep1 = self.id1 == ids
        self.two[self.at2] = np.where(held2, (ids << 2) + np.minimum(self.n2 + 1, 3), np.where(self.n2 > 1, (self.id2 << 2) + self.n2 - 1, ids << 2))
        self.one[self.at1] = np.where(keep1, (ids << 2) + np.minimum(self.n1 + 1, 3), np.where(self.n1 > 1, (self.id1 << 2) + self.n1 - 1, ids << 2))
        self.p2[:n] = self.p1[:n]
        self.p1[:n] = ids



def scale_of(share: np.ndarray) -> int:
    """Bits of the order-0 distribution whose frequencies these are."""
    return max(SCALE0, int(share.sum(dtype=np.int64)).bit_length() - 1)


LOW32 = np.uint64(0xFFFFFFFF)
S32 = np.uint64(32)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _spans(lengths: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(from, to, lanes) steps in which the same lanes go on; lengths descend."""
    at = 0
    for step in sorted(set(lengths.tolist())):
        lanes = int((lengths >= step).sum())
        if step > at:
            yield at, step, lanes
            at = step


def encode_blocks(blocks: np.ndarray, lengths: np.ndarray, found: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    """32-bit words of each block; blocks is (lanes, longest), lengths descend."""
    lanes, longest = blocks.shape
    scale = scale_of(share)
    total = np.uint64(12 + scale)
    place = np.searchsorted(found, blocks.T)  # steps by lanes
    starts = np.cumsum(share.astype(np.int64)) - share
    columns = np.ascontiguousarray(blocks.T).astype(np.int64)
    model = Model(lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, FULL)
    out, filled = np.zeros((lanes, longest + 4), np.uint32), np.zeros(lanes, np.int64)
    with np.errstate(over="ignore"):
        for begin, end, n in _spans(lengths):
            for t in range(begin, end):
                model.predict(n)
                ids = columns[t, :n]
                kind = np.where(model.id2 == ids, 0, np.where(model.id1 == ids, 1, 2))
                w2, w1 = model.w2, model.w1
                w0 = ONE - w2 - w1
                at = place[t, :n]
                start = np.where(kind == 0, 0, np.where(kind == 1, w2, w2 + w1)) << scale
                size = np.where(kind == 0, w2, w1) << scale
                escape = kind == 2
                start = np.where(escape, start + w0 * starts[at], start)
                size = np.where(escape, w0 * share[at].astype(np.int64), size)
                unit = width[:n] >> total
                low[:n] += unit * start.astype(np.uint64)
                width[:n] = unit * size.astype(np.uint64)
                _settle(low, width, n, out, filled)
                model.update(ids, kind)
            done = np.flatnonzero(lengths[:n] == end)
            for lane in done:
                out[lane, filled[lane]] = low[lane] >> S32
                out[lane, filled[lane] + 1] = low[lane] & LOW32
                filled[lane] += 2
    return [out[i, : filled[i]] for i in range(lanes)]


def _settle(low: np.ndarray, width: np.ndarray, n: int, out: np.ndarray | None, filled: np.ndarray) -> np.ndarray:
    """Shifts out the upper word of lanes whose width is under 32 bits; a width
    that straddles a word's border is cut to it, so no carry is left open."""
    move = np.flatnonzero(width[:n] < (np.uint64(1) << S32))
    if len(move):
        a, w = low[move], width[move]
        straddles = ((a ^ (a + (w - np.uint64(1)))) >> S32) != 0
        w = np.where(straddles, (np.uint64(1) << S32) - (a & LOW32), w)
        if out is not None:
            out[move, filled[move]] = (a >> S32).astype(np.uint32)
            filled[move] += 1
        low[move], width[move] = a << S32, w << S32
    return move


def decode_blocks(words: list[np.ndarray], lengths: np.ndarray, found: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The ids of blocks whose lengths descend, as (lanes, longest)."""
    lanes, longest = len(words), int(lengths[0]) if len(lengths) else 0
    held = np.zeros((lanes, max(map(len, words), default=0) + 4), np.uint32)
    for i, w in enumerate(words):
        held[i, : len(w)] = w
    scale = scale_of(share)
    total = np.uint64(12 + scale)
    wide = share.astype(np.int64)
    starts = np.cumsum(wide) - wide
    slot = np.repeat(np.arange(len(found)), wide)
    ids_of = found.astype(np.int64)
    model = Model(lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, FULL)
    code = held[:, 0].astype(np.uint64) << S32 | held[:, 1].astype(np.uint64)
    read = np.full(lanes, 2, np.int64)
    out = np.zeros((longest, lanes), np.uint32)
    with np.errstate(over="ignore"):
        for begin, end, n in _spans(lengths):
            for t in range(begin, end):
                model.predict(n)
                w2, w1 = model.w2, model.w1
                w0 = ONE - w2 - w1
                unit = width[:n] >> total
                value = np.minimum((code[:n] - low[:n]) // unit, (np.uint64(1) << total) - np.uint64(1)).astype(np.int64)
                upper = value >> scale
                kind = np.where(upper < w2, 0, np.where(upper < w2 + w1, 1, 2))
                start = np.where(kind == 0, 0, np.where(kind == 1, w2, w2 + w1)) << scale
                size = np.where(kind == 0, w2, w1) << scale
                escape = kind == 2
                at = slot[np.where(escape, (value - start) // w0, 0)]
                start = np.where(escape, start + w0 * starts[at], start)
                size = np.where(escape, w0 * wide[at], size)
                ids = np.where(kind == 0, model.id2, np.where(kind == 1, model.id1, ids_of[at]))
                low[:n] += unit * start.astype(np.uint64)
                width[:n] = unit * size.astype(np.uint64)
                move = _settle(low, width, n, None, read)
                if len(move):
                    code[move] = code[move] << S32 | held[move, read[move]].astype(np.uint64)
                    read[move] += 1
                model.update(ids, kind)
                out[t, :n] = ids
    return out.T


def pack_file(keys: list, lengths: np.ndarray, ids: np.ndarray, meta: dict) -> bytes:
    found, share = order0(ids)
    n = -(-len(ids) // BLOCK)
    sizes = np.minimum(BLOCK, len(ids) - np.arange(n) * BLOCK)
    blocks = np.zeros((n, int(sizes[0])), np.uint32)
    blocks.ravel()[: len(ids)] = ids
    words = encode_blocks(blocks, sizes, found, share)
    table = np.array([(s, len(w), zlib.crc32(ids[i * BLOCK : i * BLOCK + s].astype("<u4"))) for i, (s, w) in enumerate(zip(sizes, words, strict=True))], "<u4").reshape(n, 3)
    index = zlib.compress(json.dumps(keys).encode()), zlib.compress(lengths.astype("<u4").tobytes()), zlib.compress(np.r_[np.diff(found, prepend=np.uint32(0)), share].astype("<u4").tobytes()), table.tobytes()
    head = json.dumps(meta | {"documents": len(keys), "ids": len(ids), "symbols": len(found), "blocks": n, "parts": [len(x) for x in index]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *index, *(w.astype("<u4").tobytes() for w in words)])


def unpack_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Keys, lengths and ids; a block that does not have its checksum is refused."""
    if not data.startswith(MAGIC):
        raise ValueError("not a file of token ids")
    at = len(MAGIC) + 4
    size = int.from_bytes(data[at - 4 : at], "little")
    head = json.loads(data[at : at + size])
    at += size
    parts = []
    for n in head["parts"]:
        parts.append(data[at : at + n])
        at += n
    keys, lengths = json.loads(zlib.decompress(parts[0])), np.frombuffer(zlib.decompress(parts[1]), "<u4").astype(np.int64)
    both = np.frombuffer(zlib.decompress(parts[2]), "<u4")
    found, share = np.cumsum(both[: head["symbols"]], dtype=np.uint32), both[head["symbols"] :]
    table = np.frombuffer(parts[3], "<u4").reshape(head["blocks"], 3).astype(np.int64)
    words = np.frombuffer(data, "<u4", offset=0, count=0) if at == len(data) else np.frombuffer(data[at:], "<u4")
    ends = np.cumsum(table[:, 1])
    blocks = decode_blocks([words[e - n : e] for e, n in zip(ends, table[:, 1], strict=True)], table[:, 0], found, share)
    for i, (s, _, crc) in enumerate(table):
        if zlib.crc32(np.ascontiguousarray(blocks[i, :s]).astype("<u4")) != crc:
            raise ValueError(f"block {i} does not have its checksum")
    return keys, lengths, blocks.ravel()[: head["ids"]] if len(table) else np.empty(0, np.uint32)


def write_files(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", end: int = END) -> DataFrame:
    """_range, file, path, n_docs, n_ids of files that hold all documents in
    ascending order of the key; a file ends after LANES full blocks or its range."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tail = encoder(tokenizer), np.array([end], np.uint32)
        at, number, keys, held, size = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            store, path = fs.FileSystem.from_uri(folder)
            store.create_dir(path, recursive=True)
            name = f"{at:06d}-{number:06d}-{uuid.uuid4().hex}.ids"
            data = pack_file(keys, np.array([len(x) for x in held], np.int64), np.concatenate(held), {"range": at, "file": number, "tokenizer": tokenizer})
            with store.open_output_stream(f"{path}/{name}", compression=None) as sink:
                sink.write(data)
            return pa.record_batch(
                [pa.array([at], pa.int32()), pa.array([number], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(keys)], pa.int64()), pa.array([size], pa.int64())],
                ["_range", "file", "path", "n_docs", "n_ids"],
            )

        for batch in batches_of(batches, "_t", 1 << 20):
            for k, r, t in zip(batch.column("_k").to_pylist(), batch.column("_range").to_pylist(), texts_of(batch.column("_t")), strict=True):
                if keys and (r != at or size >= BLOCK * LANES):
                    yield flush()
                    number, keys, held, size = (number + 1 if r == at else 0), [], [], 0
                at = r
                ids = np.concatenate([own.ids(t), tail])
                keys.append(k)
                held.append(ids)
                size += len(ids)
        if keys:
            yield flush()

    rows = df.select(F.col(key).cast("bigint").alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_o", F.coalesce("_k", F.lit(-(1 << 63))))
    dealt, _ = ranged(rows, "_o", 2 * parts_for(df))
    ready = dealt.repartition(parts_for(df), "_range").sortWithinPartitions("_range", "_o", "_t")
    return settled(ready.mapInArrow(write, "_range int, file int, path string, n_docs bigint, n_ids bigint"))


def read_files(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32, ids of each document, from the files alone."""
    # a number for each range passes the driver
    sums = sorted((r["_range"], r["n"]) for r in files.groupBy("_range").agg(F.sum("n_ids").alias("n")).collect())
    firsts = np.cumsum([0, *(n for _, n in sums)]).tolist()
    base = F.coalesce(F.get(long_array(firsts), range_of(F.col("_range"), [r for r, _ in sums])), F.lit(0))
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("_range").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("path", (base + before).alias("base")).repartition(parts_for(files), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_stream(inner, compression=None) as source:
                    keys, lengths, ids = unpack_file(source.read())
                ends = np.cumsum(lengths)
                for low in range(0, len(keys), 1024):
                    span = range(low, min(low + 1024, len(keys)))
                    parts = [np.ascontiguousarray(ids[ends[i] - lengths[i] : ends[i]]).astype("<u4") for i in span]
                    yield pa.record_batch(
                        [pa.array([keys[i] for i in span], pa.int64()), pa.array([first + int(ends[i] - lengths[i]) for i in span], pa.int64()), pa.array([len(p) for p in parts], pa.int64()),
                         pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())],
                        ["_k", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    return placed.mapInArrow(read, "_k bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary").withColumnRenamed("_k", key)


def through_files(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", end: int = END) -> DataFrame:
    return read_files(write_files(df, work_folder(df.sparkSession, "token-files"), key, text, tokenizer, end), key)
