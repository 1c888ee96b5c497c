"""Token counts of whole texts; huge texts are counted in overlapping chunks that are spliced.

A chunk is encoded with offsets. Two neighbours are spliced at a position in
their overlap where both begin a token and where the library must begin a word
whatever stands to the left: a single space between two characters that are not
white space. From there on both encodings are that of the whole text. A text
with a pair of chunks that shares no such position is encoded again with
overlaps twice as wide, until all align or a chunk is the whole text.

Nulls and empty texts count 0. Repeated rows and equal ids are counted each by
itself. Other columns of the input are left out of the work and of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import parts_for, settled, texts_of
from voxloom.llm.encoders import encoder

CHUNK = 32_768
OVERLAP = 256

COUNTED = T.StructType([T.StructField("key", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
CHUNKED = T.StructType(
    [
        T.StructField("key", T.StringType()), T.StructField("chunk", T.IntegerType()), T.StructField("chunks", T.IntegerType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("head_at", T.ArrayType(T.LongType())), T.StructField("head_before", T.ArrayType(T.LongType())),
        T.StructField("tail_at", T.ArrayType(T.LongType())), T.StructField("tail_before", T.ArrayType(T.LongType())),
    ]
)


def boundaries(text: str, starts: list[int], low: int, high: int, base: int) -> tuple[list[int], list[int]]:
    """Stable token starts of a chunk in [low, high), as places in the whole text, and the tokens before each."""
    at, before = [], []
    last = None
    for i, s in enumerate(starts):
        if s != last and low <= s < high and 0 < s < len(text) - 1 and text[s] == " " and not text[s - 1].isspace() and not text[s + 1].isspace():
            at.append(base + s)
            before.append(i)
        last = s
    return at, before


def encoded(text: str, name: str) -> list[int]:
    return [a for a, _ in encoder(name).library.encode(text, add_special_tokens=False).offsets]


def spliced(text: str, name: str, size: int, overlap: int) -> int:
    """The count of one text by chunks, overlaps doubled until every neighbour aligns."""
    while overlap < len(text):
        total, taken, aligned, at = 0, 0, True, 0
        while True:
            chunk = text[at : at + size + overlap]
            starts = encoded(chunk, name)
            if at + size + overlap >= len(text):
                return total + len(starts) - taken
            here = dict(zip(*boundaries(chunk, starts, size, size + overlap, at), strict=True))
            following = text[at + size : at + 2 * size + overlap]
            there = dict(zip(*boundaries(following, encoded(following, name), 0, overlap, at + size), strict=True))
            common = here.keys() & there.keys()
            if not common:
                aligned = False
                break
            cut = min(common)
            total += here[cut] - taken
            taken, at = there[cut], at + size
        if not aligned:
            overlap *= 2
            size = max(size, overlap)
    return encoder(name).count(text)


def count_tokens(
    df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """key, n_bytes, n_tokens of every row's whole text. Texts of over `chunk`
    code points are cut in the executors into chunks that tasks share evenly."""
    rows = df.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    kind = rows.schema["_k"].dataType
    packed = rows.select(F.to_json(F.struct(F.col("_k"))).alias("key"), F.col("_t"))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            texts = texts_of(batch.column("_t"))
            yield pa.record_batch(
                [batch.column("key"), pc.cast(pc.binary_length(batch.column("_t")), pa.int64()), pa.array([own.count(t) for t in texts], pa.int64())],
                ["key", "n_bytes", "n_tokens"],
            )

    def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                starts = encoded(row["part"], tokenizer)
                base = row["chunk"] * chunk
                head = boundaries(row["part"], starts, 0, overlap, base) if row["chunk"] else ([], [])
                tail = boundaries(row["part"], starts, chunk, chunk + overlap, base)
                out.append({"key": row["key"], "chunk": row["chunk"], "chunks": row["chunks"], "n_bytes": row["n_bytes"], "n_tokens": len(starts),
                            "head_at": head[0], "head_before": head[1], "tail_at": tail[0], "tail_before": tail[1]})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(CHUNKED))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("_t"))
            yield pa.record_batch(
                [batch.column("key"), pc.cast(pc.binary_length(batch.column("_t")), pa.int64()), pa.array([spliced(t, tokenizer, chunk, 2 * overlap) for t in texts], pa.int64())],
                ["key", "n_bytes", "n_tokens"],
            )

    long = F.char_length("_t") > chunk + overlap
    short = packed.where(~long).mapInArrow(plain, COUNTED)
    # A row is named by its key and a digest of its text, so that rows with one key stay apart.
    huge = packed.where(long).withColumn("_d", F.sha2("_t", 256))
    chunks = F.ceil((F.char_length("_t") - overlap) / chunk).cast("int")
    cut = (
        huge.select(F.to_json(F.struct("key", "_d")).alias("key"), F.octet_length("_t").cast("bigint").alias("n_bytes"), chunks.alias("chunks"), "_t")
        .select("key", "n_bytes", "chunks", "_t", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        .select("key", "n_bytes", "chunks", "chunk", F.substring(F.col("_t"), F.col("chunk") * chunk + 1, F.lit(chunk + overlap)).alias("part"))
    )
    parts = settled(cut.repartition(parts_for(df), "key", "chunk").mapInArrow(by_chunk, CHUNKED)).distinct()
    left = parts.select("key", "chunks", "n_bytes", "chunk", "n_tokens", F.arrays_zip("tail_at", "tail_before").alias("tail"))
    right = parts.select("key", (F.col("chunk") - 1).alias("chunk"), F.map_from_arrays("head_at", "head_before").alias("head"))
    cuts = left.join(right, ["key", "chunk"], "left").withColumn(
        "cut", F.array_min(F.transform(F.filter("tail", lambda b: F.map_contains_key("head", b["tail_at"])), lambda b: b["tail_at"]))
    )
    before = F.get(F.filter("tail", lambda b: b["tail_at"] == F.col("cut")), F.lit(0))["tail_before"]
    last = F.col("chunk") == F.col("chunks") - 1
    sums = (
        cuts.select("key", "chunks", "n_bytes", (~last & F.col("cut").isNull()).alias("bad"), F.when(last, F.col("n_tokens")).otherwise(before - F.col("head")[F.col("cut")]).alias("share"))
        .groupBy("key")
        .agg(F.max("n_bytes").alias("n_bytes"), F.sum("share").alias("n_tokens"), F.max("bad").alias("bad"))
    )
    named = F.from_json("key", "key string, _d string")
    good = huge.select("key", "_d").join(
        sums.where(~F.col("bad")).select(named["key"].alias("key"), named["_d"].alias("_d"), "n_bytes", "n_tokens"), ["key", "_d"]
    ).select("key", "n_bytes", "n_tokens")
    failed = sums.where("bad").select(named["key"].alias("key"), named["_d"].alias("_d"))
    widened = huge.join(failed, ["key", "_d"], "left_semi").select("key", "_t").mapInArrow(again, COUNTED)
    found = F.from_json("key", T.StructType([T.StructField("_k", kind)]))["_k"]
    return short.unionByName(good).unionByName(widened).select(found.alias(key), "n_bytes", "n_tokens")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
