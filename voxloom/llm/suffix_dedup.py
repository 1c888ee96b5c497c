"""Exact substring deduplication by suffix arrays: bytes covered by a long string that an earlier document holds too.

Every string of `least` bytes is owned by one anchor, the `GRAM` bytes within
it whose hash is the smallest, so equal strings have equal anchors at equal
places, and an anchor with the bytes within reach (its context) decides about
all strings it owns. Anchors of distinct texts are dealt by hash; those whose
whole context stands in an earlier document are settled at once, first within a
slice of texts, before the shuffle. A context is known by all 64 bits of its
digest, and an anchor by its bucket and 32 bits of its hash: two anchors that
agree in those only ask for their bytes. Only anchors that several documents
share with differing contexts need bytes. Their contexts are sorted by suffix arrays
over both directions from the anchor, and strings of the anchor are equal where
the common prefixes to the right and to the left are long enough together.

The suffix arrays come from a linear grouping construction: suffixes start in
groups by first symbol; groups are processed in descending order, and each
moves the positions that its members' previous-smaller pointers name behind the
rest of their groups, so that in the end a group holds one Lyndon prefix; a
second pass emits the order group by group along the same pointers. Symbols are
ranks of thirteen bytes, which keeps the order of the bytes.

Anchors with more than `crowd` differing contexts are settled string by string:
each string is dealt by its own hash, and of equal strings of a slice of texts
only the earliest is sent, so no group is bound to one task.

A null or short text keeps all its bytes; copies of an earlier text of at least
`least` bytes lose all of theirs; a null id comes before all others; rows that
share an id never remove from one another, and repeated rows are treated alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import apart, batches_of, lean, parts_for, written

LEAST = 50
GRAM = 16
CROWD = 4_000
ROWS = 20_000  # contexts sorted together, unless a group has more
BUCKETS = 4  # of anchors, to a partition: a task holds one at a time

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes in ascending order; the last symbol is smaller than all others and occurs once."""
    n = len(symbols)
    order = np.argsort(np.array(symbols), kind="stable")
    held = order.tolist()
    sorted_symbols = np.array(symbols)[order]
    opens = np.flatnonzero(np.r_[True, sorted_symbols[1:] != sorted_symbols[:-1]])
    sizes = np.diff(np.r_[opens, n])
    group = np.empty(n, np.int64)
    group[order] = np.repeat(opens, sizes)
    group = group.tolist()  # a group is named by the first place it takes
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    size = [0] * n
    for a, b in zip(opens.tolist(), sizes.tolist(), strict=True):
        size[a] = b
    smaller = [-1] * n

    def behind(first: int, moved: list[int]) -> None:
        """Makes `moved` a group of its own at the end of the group at `first`."""
        count = size[first]
        rest = count - len(moved)
        if not rest:
            return
        at = first + count
        for p in moved:
            at -= 1
            here, other = place[p], held[at]
            held[here], held[at] = other, p
            place[other], place[p] = here, at
        size[first], size[at] = rest, len(moved)
        for p in moved:
            group[p] = at

    end = n - 1
    while end >= 0:
        first = group[held[end]]
        if first == end:
            s = held[end]
            p = s - 1
            while p >= 0 and group[p] >= first:
                p = smaller[p]
            smaller[s] = p
            if p >= 0 and size[group[p]] > 1:
                behind(group[p], [p])
        else:
            times: dict[int, int] = {}
            for s in sorted(held[first : end + 1]):
                p = s - 1
                while p >= 0 and group[p] >= first:
                    p = smaller[p]
                smaller[s] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            by_times: dict[int, dict[int, list[int]]] = {}
            for p, k in times.items():
                by_times.setdefault(k, {}).setdefault(group[p], []).append(p)
            for k in sorted(by_times, reverse=True):
                for where, moved in by_times[k].items():
                    behind(where, moved)
        end = first - 1
    free = list(range(n))
    out, done = [0] * n, bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = smaller[s]
    return out


SYMBOL = 13


def sorted_rows(rows: list[np.ndarray]) -> list[np.ndarray]:
    """For each matrix of distinct byte rows, of widths in SYMBOL bytes, the order of its rows, from one suffix array."""
    cut = np.concatenate([r.reshape(-1, SYMBOL) for r in rows])
    upper = np.ascontiguousarray(cut[:, :8]).view(">u8").ravel().astype(np.uint64)
    lower = np.zeros((len(cut), 8), np.uint8)
    lower[:, 3:] = cut[:, 8:]
    lower = lower.view(">u8").ravel().astype(np.uint64)
    by = np.lexsort((lower, upper))
    new = np.r_[True, (upper[by][1:] != upper[by][:-1]) | (lower[by][1:] != lower[by][:-1])]
    ranks = np.empty(len(cut), np.int64)
    ranks[by] = np.cumsum(new)
    array = np.array(suffix_array([*ranks.tolist(), 0]), np.int64)
    out, base = [], 0
    for r in rows:
        width, size = r.shape[1] // SYMBOL, r.size // SYMBOL
        own = array[(array >= base) & (array < base + size)] - base
        out.append(own[own % width == 0] // width)
        base += size
    return out


def _common(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row begins with in common with the one before; -1 for the first."""
    differ = rows[1:] != rows[:-1]
    return np.r_[-1, np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])]


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, first, number = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return first, number.ravel()


def earlier_strings(group: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, after: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """For anchors with contexts: the largest and least number of bytes before the
    anchor with which a string of it begins that an earlier document has; -1 if none.

    `before` holds the bytes before the anchor, nearest first, of which `left`
    count; `after` those from its start, of which `right` count."""
    n, reach = len(group), before.shape[1]
    gram = least - reach
    most, fewest = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    # anchors are equal by their bytes, not by their hash alone
    head = np.zeros((n, 4), np.uint8)
    _, group = _distinct(np.hstack([group.astype(">u4")[:, None].view(np.uint8), after[:, :gram]]))
    head[:] = group.astype(">u4")[:, None].view(np.uint8)
    width = -(-(4 + reach) // SYMBOL) * SYMBOL
    sides = []
    for side in (after[:, gram:], before):
        m = np.zeros((n, width), np.uint8)
        m[:, :4], m[:, 4 : 4 + reach] = head, side
        sides.append(m)
    # a string has at least half of its other bytes on one side, so an anchor that shares them with none is done
    half = 4 + reach // 2
    shared = np.zeros(n, bool)
    for m in sides:
        _, number = _distinct(m[:, :half])
        shared |= np.bincount(number)[number] > 1
    use = np.flatnonzero(shared)
    if not len(use):
        return most, fewest
    numbers, distinct, commons = [], [], []
    for m in sides:
        first, number = _distinct(m[use])
        distinct.append(m[use][first])
        numbers.append(number)
    for i, order in enumerate(sorted_rows(distinct)):
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        numbers[i] = rank[numbers[i]]
        commons.append(_common(distinct[i][order]))
    for o in range(reach + 1):
        at = np.flatnonzero((left[use] >= o) & (right[use] >= least - o))
        if not len(at):
            continue
        ahead = np.cumsum(commons[0] < 4 + reach - o)[numbers[0][at]]
        back = np.cumsum(commons[1] < 4 + o)[numbers[1][at]]
        docs = doc[use[at]]
        key = back * np.int64(len(commons[0]) + 1) + ahead
        by = np.lexsort((docs, key))
        opens = np.r_[True, np.diff(key[by]) != 0]
        first = docs[by][np.maximum.accumulate(np.where(opens, np.arange(len(by)), 0))]
        hit = use[at[by[docs[by] > first]]]
        most[hit] = o
        fewest[hit] = np.where(fewest[hit] < 0, o, fewest[hit])
    return most, fewest


AT_ONCE = 1 << 18  # string starts looked at together


def anchors(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor of texts that lie one after another in `flat`, and its text's number."""
    n = int(ends[-1]) if len(ends) else 0
    hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for low in range(0, n - least + 1, AT_ONCE):
        part = flat[low : min(n, low + AT_ONCE + least - 1)]
        h, at = _lowest(part, least, gram)
        text = np.searchsorted(ends, low + np.arange(len(at)), side="right")
        # strings that run on into the next text are none
        found = np.unique(at[ends[text] - low - np.arange(len(at)) >= least])
        hashes.append(h[found])
        places.append(low + found)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], at, np.searchsorted(ends, at, side="right")


def _lowest(flat: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the gram at each place, and for each string the place of its lowest, the first of equals."""
    count = len(flat) - gram + 1
    words = np.lib.stride_tricks.sliding_window_view(flat, 8).copy().view(np.uint64).ravel()
    with np.errstate(over="ignore"):
        h = words[:count] * _M[0]
        h ^= h >> np.uint64(29)
        h += words[gram - 8 : gram - 8 + count]
        h *= _M[1]
        h ^= h >> np.uint64(32)
        h *= _M[2]
    lowest = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(count, dtype=np.uint64)
    window, done = least - gram + 1, 1
    while done * 2 <= window:
        lowest = np.minimum(lowest[:-done], lowest[done:])
        done *= 2
    if done < window:
        lowest = np.minimum(lowest[: len(lowest) - (window - done)], lowest[window - done :])
    return h, (lowest & np.uint64(0xFFFFFFFF)).astype(np.int64)


def context_digests(flat: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, least: int = LEAST, gram: int = GRAM) -> np.ndarray:
    """Hashes of the `left` bytes before each anchor and the `right` from its start, and of both numbers."""
    reach = least - gram
    size = -(-(reach + least) // 8) * 8
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(reach, np.uint8), flat, np.zeros(size, np.uint8)]), size)
    out = (left * 64 + right).astype(np.uint64)
    for low in range(0, len(at), 20_000):
        span = slice(low, low + 20_000)
        whole = around[at[span]]
        whole[:, reach + least :] = 0
        # bytes of the neighbouring texts count for nothing
        for rows, cut in ((np.flatnonzero(left[span] < reach), True), (np.flatnonzero(right[span] < least), False)):
            columns = np.arange(size)
            whole[rows] *= (columns >= reach - left[span][rows, None]) if cut else (columns < reach + right[span][rows, None])
        part = out[span]
        with np.errstate(over="ignore"):
            for column in whole.view(np.uint64).T:
                part = (part ^ column) * _M[3]
                part ^= part >> np.uint64(31)
        out[span] = part
    return out


def _later(h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by anchor, context and document, and for each row in it whether an earlier document has its context."""
    order = np.lexsort((doc, c, h))
    hs, cs, ds = h[order], c[order], doc[order]
    opens = np.r_[True, (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])] if len(order) else np.empty(0, bool)
    first = ds[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))] if len(order) else ds
    return order, ds > first


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping spans of a row made one."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    new = np.r_[True, row[1:] != row[:-1]]
    number = np.cumsum(new) - 1
    wide = np.int64(1) << 40
    furthest = np.maximum.accumulate(end + number * wide) - number * wide
    opens = np.r_[True, new[1:] | (start[1:] > furthest[:-1])]
    first = np.flatnonzero(opens)
    return row[first], start[first], np.maximum.reduceat(end, first)


FOUND = "row bigint, doc bigint, start bigint, until bigint, anchor bigint, crowded boolean"


def _spans(row, start, end) -> pa.RecordBatch:
    n = len(row)
    return pa.record_batch(
        [pa.array(row, pa.int64()), pa.nulls(n, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())],
        ["row", "doc", "start", "until", "anchor", "crowded"],
    )


def repeated_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """row, start, until: bytes of docs(row, doc, data) that strings of earlier documents cover. Spans may overlap."""
    parts = parts_for(docs)
    buckets = BUCKETS * parts
    reach = least - gram

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "data", 3 << 20):
            texts = batch.column("data").to_pylist()
            rows, order = batch.column("row").to_numpy(), batch.column("doc").to_numpy()
            lengths = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(lengths)
            flat = np.frombuffer(b"".join(texts), np.uint8)
            h, at, text = anchors(flat, ends - lengths, ends, least, gram)
            if not len(h):
                continue
            low = (ends - lengths)[text]
            left, right = np.minimum(at - low, reach), np.minimum(ends[text] - at, least)
            c = context_digests(flat, at, left, right, least, gram)
            row, doc, pos = rows[text], order[text], at - low
            by, later = _later(h, c, doc)
            known = by[later]
            spans = np.stack(_merged(row[known], (pos - left)[known], (pos + right)[known]))
            rest = np.sort(by[~later])
            # the upper half of an anchor's hash deals it, the lower half names it in its bucket
            bucket = (h[rest] >> np.uint64(32)) % np.uint64(buckets)
            deal_by = np.argsort(bucket, kind="stable")
            rest = rest[deal_by]
            cut = np.searchsorted(bucket[deal_by], np.arange(buckets + 1).astype(np.uint64))
            out = {"bucket": [], "h": [], "c": [], "text": [], "row": [], "doc": [], "pos": [], "reach": [], "spans": []}
            for b in np.flatnonzero(np.diff(cut)):
                own = rest[cut[b] : cut[b + 1]]
                out["bucket"].append(int(b))
                out["h"].append(h[own].astype(np.uint32).tobytes())
                out["c"].append(c[own].tobytes())
                # texts are named once, and places by their distance, which compress well
                which, number = np.unique(text[own], return_inverse=True)
                out["text"].append(number.astype(np.uint32).tobytes())
                own_rows = rows[which]
                out["row"].append(b"" if np.array_equal(own_rows, order[which]) else own_rows.tobytes())
                out["doc"].append(order[which].tobytes())
                out["pos"].append(np.diff(pos[own], prepend=0).astype(np.int32).tobytes())
                out["reach"].append((left[own] * 64 + right[own]).astype(np.uint16).tobytes())
                out["spans"].append(b"")
            if out["spans"]:
                out["spans"][0] = spans.astype(np.int64).tobytes()
            elif spans.size:
                for name, value in zip(out, (0, b"", b"", b"", b"", b"", b"", b"", spans.astype(np.int64).tobytes()), strict=True):
                    out[name].append(value)
            yield pa.record_batch([pa.array(out["bucket"], pa.int32()), *[pa.array(out[x], pa.binary()) for x in list(out)[1:]]], list(out))

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {x: [] for x in ("h", "c", "row", "doc", "pos", "reach")}  # arrays
        at = None

        def settle() -> Iterator[pa.RecordBatch]:
            h, c, row, doc, pos, ends = (np.concatenate(held[k]) for k in held)
            left, right = (ends >> 6).astype(np.int64), (ends & 63).astype(np.int64)
            by, later = _later(h, c, doc)
            done = by[later]
            if len(done):
                yield _spans(*_merged(row[done], pos[done] - left[done], pos[done] + right[done]))
            rest = by[~later]  # in order of anchor and context
            if not len(rest):
                return
            hs, cs, ds = h[rest], c[rest], doc[rest]
            opens = np.r_[True, hs[1:] != hs[:-1]]
            first = np.flatnonzero(opens)
            several = np.minimum.reduceat(ds, first) < np.maximum.reduceat(ds, first)
            differ = np.add.reduceat((opens | np.r_[True, cs[1:] != cs[:-1]]).astype(np.int64), first)
            sizes = np.diff(np.r_[first, len(rest)])
            ask = np.repeat(several, sizes)
            own = rest[ask]
            if len(own):
                crowded = np.repeat(differ > crowd, sizes)[ask]
                yield pa.record_batch(
                    [pa.array(row[own]), pa.array(doc[own]), pa.array(pos[own]), pa.nulls(len(own), pa.int64()), pa.array(np.int64(at) << 32 | h[own].astype(np.int64)), pa.array(crowded)],
                    ["row", "doc", "start", "until", "anchor", "crowded"],
                )

        for batch in batches_of(batches, "h", 2 << 20):
            for r in batch.to_pylist():
                if r["bucket"] != at and held["h"]:
                    yield from settle()
                    held = {k: [] for k in held}
                at = r["bucket"]
                if r["spans"]:
                    yield _spans(*np.frombuffer(r["spans"], np.int64).reshape(3, -1))
                if r["h"]:
                    number = np.frombuffer(r["text"], np.uint32)
                    for k, x in (
                        ("h", np.frombuffer(r["h"], np.uint32)), ("c", np.frombuffer(r["c"], np.uint64)), ("row", np.frombuffer(r["row"] or r["doc"], np.int64)[number]),
                        ("doc", np.frombuffer(r["doc"], np.int64)[number]), ("pos", np.cumsum(np.frombuffer(r["pos"], np.int32), dtype=np.int64)), ("reach", np.frombuffer(r["reach"], np.uint16)),
                    ):
                        held[k].append(x)
        if held["h"]:
            yield from settle()

    dealt = docs.mapInArrow(deal, "bucket int, h binary, c binary, text binary, row binary, doc binary, pos binary, reach binary, spans binary")
    found = written(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, FOUND), "anchors")
    asked = found.where("anchor IS NOT NULL").groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "crowded")).alias("asked"))

    @lean
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "data", 2 << 20):
            out = {"anchor": [], "row": [], "doc": [], "pos": [], "until": [], "before": [], "after": []}

            def add(*values) -> None:
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)

            earliest: dict[bytes, int] = {}
            for r in sorted(batch.to_pylist(), key=lambda r: r["doc"]):
                data = r["data"]
                for a in r["asked"]:
                    p = a["start"]
                    low, high = max(0, p - reach), min(len(data), p + least)
                    if not a["crowded"]:
                        add(a["anchor"], r["row"], r["doc"], p, None, data[low:p], data[p:high])
                        continue
                    for i in range(low, min(p, high - least) + 1):
                        string = data[i : i + least]
                        if earliest.setdefault(string, r["doc"]) < r["doc"]:
                            add(r["row"], r["row"], r["doc"], i, i + least, None, None)
                        else:
                            add(xxhash.xxh64_intdigest(string) - (1 << 63), r["row"], r["doc"], i, None, b"", string)
            yield pa.record_batch([*[pa.array(out[x], pa.int64()) for x in ("anchor", "row", "doc", "pos", "until")], *[pa.array(out[x], pa.binary()) for x in ("before", "after")]], list(out))

    seen = docs.join(asked, "row").select("row", "doc", "data", "asked").mapInArrow(look, "anchor bigint, row bigint, doc bigint, pos bigint, until bigint, before binary, after binary")

    @lean
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, last = [], 0, None

        def settle() -> Iterator[pa.RecordBatch]:
            anchor, row, doc, pos = (np.array([x[i] for x in held], np.int64) for i in range(4))
            left, right = (np.array([len(x[i]) for x in held], np.int64) for i in (4, 5))
            before = np.frombuffer(b"".join(x[4][::-1].ljust(reach, b"\0") for x in held), np.uint8).reshape(-1, reach)
            after = np.frombuffer(b"".join(x[5].ljust(least, b"\0") for x in held), np.uint8).reshape(-1, least)
            _, group = np.unique(anchor, return_inverse=True)
            most, fewest = earlier_strings(group.ravel(), doc, left, right, before, after, least)
            hit = np.flatnonzero(most >= 0)
            if len(hit):
                yield pa.record_batch([pa.array(row[hit]), pa.array(pos[hit] - most[hit]), pa.array(pos[hit] - fewest[hit] + least)], ["row", "start", "until"])

        for batch in batches:
            known = batch.filter(pc.is_valid(batch.column("until")))
            if known.num_rows:
                yield pa.record_batch([known.column("row"), known.column("pos"), known.column("until")], ["row", "start", "until"])
            batch = batch.filter(pc.is_null(batch.column("until")))
            for x in zip(*(batch.column(n).to_pylist() for n in ("anchor", "row", "doc", "pos", "before", "after")), strict=True):
                if x[0] != last and len(held) >= ROWS:
                    yield from settle()
                    held = []
                last = x[0]
                held.append(x)
        if held:
            yield from settle()

    judged = seen.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(judge, "row bigint, start bigint, until bigint")
    return found.where("anchor IS NULL").select("row", "start", "until").unionByName(judged)


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, crowd: int = CROWD, as_text: bool = False) -> DataFrame:
    """The columns of df and _kept, _bytes, _removed, _spans of each row. _kept are
    the bytes left, or with `as_text` a text, from which a character goes as a
    whole if it lost some of its bytes. More underscores stand before these names
    where df has names that begin with one."""
    p = apart(df)
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    # a row is named by its id, or where ids repeat by a hash of its id and text
    repeats = bool(df.groupBy(key).count().where("count > 1").limit(1).count())
    order = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)))
    rows = df.withColumns({f"{p}data": data, f"{p}doc": order, f"{p}null": F.col(text).isNull()}).withColumn(f"{p}row", F.xxhash64(f"{p}doc", f"{p}data") if repeats else F.col(f"{p}doc"))
    named = rows.select(F.col(f"{p}row").alias("row"), F.col(f"{p}doc").alias("doc"), F.col(f"{p}data").alias("data")).where(F.octet_length("data") >= least)
    long = named.select("row", "doc", F.sha2("data", 256).alias("digest"))
    first = long.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").drop("last")
    copies = written(long.join(first, "digest").where("doc > first").select("row").distinct(), "copies")
    # written, so that the texts' two shuffles are not held at once
    spans = written(repeated_spans(named.join(copies, "row", "left_anti"), least, gram, crowd).groupBy("row").agg(F.collect_list(F.struct("start", "until")).alias("cut")), "spans")
    none = F.array().cast("array<struct<start:bigint,until:bigint>>")
    known = spans.withColumn("copy", F.lit(False)).unionByName(copies.select("row", none.alias("cut"), F.lit(True).alias("copy")))
    # the text is shuffled once, as its bytes
    joined = rows.drop(text).join(known.select(F.col("row").alias(f"{p}row"), F.col("cut").alias(f"{p}cut"), F.col("copy").alias(f"{p}copy")), f"{p}row", "left").withColumn(text, F.when(~F.col(f"{p}null"), F.decode(f"{p}data", "UTF-8")))

    @lean
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, f"{p}data"):
            kept, removed, counts, sizes = [], [], [], []
            for body, cut, copy in zip(*(batch.column(f"{p}{x}").to_pylist() for x in ("data", "cut", "copy")), strict=True):
                sizes.append(len(body))
                if copy:
                    kept.append(b"")
                    removed.append(len(body))
                    counts.append(1)
                    continue
                parts, at, gone, n = [], 0, 0, 0
                for start, until in union(cut or []):
                    parts.append(body[at:start])
                    gone, n, at = gone + until - start, n + 1, until
                parts.append(body[at:])
                kept.append(b"".join(parts))
                removed.append(gone)
                counts.append(n)
            texts = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            new = [texts, *(pa.array(x, pa.int64()) for x in (sizes, removed, counts))]
            yield pa.record_batch([*batch.columns[:-3], *new], [*batch.schema.names[:-3], *(p + x for x in ("kept", "bytes", "removed", "spans"))])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{p}kept {'string' if as_text else 'binary'}", *(f"{p}{x} bigint" for x in ("bytes", "removed", "spans"))])
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), f"{p}data", f"{p}cut", f"{p}copy").mapInArrow(keep, fields)


def union(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, until in sorted((s["start"], s["until"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], until)
        else:
            out.append([start, until])
    return [(a, b) for a, b in out]
