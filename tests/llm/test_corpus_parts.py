"""Small cases of the corpus operators: nulls, empty and odd texts, ties, repeated rows, empty tables, clashing names."""

import gzip
import io
import json
import random
from bisect import bisect_left

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import chat, decontamination, packing, quality, token_files, warc
from voxloom.llm.common import range_of
from voxloom.llm.encoders import encoder
from voxloom.llm.fingerprints import edited_pairs, fingerprints, likeness
from voxloom.llm.graph import components
from voxloom.llm.jaccard import jaccard_join, least_matches
from voxloom.llm.quality import fit, quality_scores, scored
from voxloom.llm.queries import QUERIES, SQL
from voxloom.llm.suffix_dedup import _lowest, anchors, context_digests, deduplicated, suffix_array
from voxloom.llm.token_counts import count_tokens, spliced

SMALL = "/root/testdata/sf0.001"
ODD = ["", " ", None, "a", "a  b", "a\n\nb c", "x <|endoftext|> y", "don't  I'll we've\tgo", "a\x1c b", "é ̈ b Σας ΣΑΣ", "\n", "a\n", "a \nb", "日本語 テキスト", "​", "\U0001f600 ok", "same words here now and then", "same words here now and then"]


def words(random_, n, vocabulary=400):
    return " ".join(f"w{random_.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts with null and repeated ids, and columns whose names the operators use inside."""
    r = random.Random(5)
    long = words(r, 300)
    rows = [(None if i == 3 else min(i, 15), t) for i, t in enumerate(ODD)]
    rows += [(100, long), (101, long), (101, long), (102, long + " tail"), (103, words(r, 40) + " " + " ".join(long.split()[100:200]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    return frame.selectExpr("doc_id", "text", "1 AS _t", "2 AS _k", "3 AS row", "4 AS doc", "5 AS data", "6 AS _kept", "7 AS _score", "8 AS node", "9 AS _range", "10 AS key")


def test_every_operator_takes_odd_rows(spark, docs):
    n = docs.count()
    kept = deduplicated(docs).collect()
    assert len(kept) == n and all(r["_kept"] == 6 for r in kept)
    assert [r["__removed"] for r in kept if r["doc_id"] == 101] == [len(r["text"].encode()) for r in kept if r["doc_id"] == 101]
    assert fingerprints(docs).count() == n
    pairs = edited_pairs(docs).collect()
    assert len(pairs) == n and all(0 <= r["near_next"] <= 1 for r in pairs)
    joined = {(r["doc_id"], r["class_id"]) for r in jaccard_join(docs).collect()}
    assert (101, 100) in joined and (102, 100) in joined and (103, 103) in joined
    labels = spark.createDataFrame([(100, 1), (103, 0), (None, 1), (1, None), (2, 1), (4, 0)], "doc_id bigint, quality int")
    assert quality_scores(docs, labels).count() == n
    assert scored(docs, fit(docs, labels)).columns[-1] == "__score"
    own = encoder("byte_bpe_50k.json").library
    counts = count_tokens(docs).collect()
    texts = sorted(len(own.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect())
    assert sorted(r["n_tokens"] for r in counts) == texts
    back = token_files.through_files(docs).collect()
    assert sorted(r["n_tokens"] - 1 for r in back) == texts
    assert packing.pack(docs).count() == n
    benchmark = spark.createDataFrame([(7, " ".join(docs.where("doc_id = 100").first()["text"].split()[20:50])), (8, None), (9, "")], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, benchmark).collect()} == {(100, 7), (101, 7), (102, 7)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    for found in (
        deduplicated(docs), edited_pairs(docs), jaccard_join(docs), quality_scores(docs, labels), warc.archived(pages), token_files.through_files(docs),
        count_tokens(docs), packing.pack(docs), decontamination.leaks(docs, items), chat.formatted(chat.canonical_turns(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))),
    ):
        assert found.count() == 0


def test_suffix_arrays_are_sorted():
    r = random.Random(3)
    for _ in range(1500):
        letters = r.choice([1, 2, 3, 6])
        a = [*(r.randint(1, letters) for _ in range(r.randint(1, 40))), 0]
        assert suffix_array(a) == sorted(range(len(a)), key=lambda i: a[i:])


@pytest.mark.parametrize("crowd", [4_000, 1])
def test_crowded_anchors_give_the_same_rows(spark, crowd):
    r = random.Random(8)
    line = words(r, 14)
    texts = [f"{words(r, 8)} {line[: r.randrange(20, len(line))]} {words(r, 6)}" for _ in range(60)] + ["aaaa" * 40, "b" + "aaaa" * 30]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {x["doc_id"]: x["_kept"] for x in deduplicated(frame, crowd=crowd).collect()}
    seen = set()
    for i, t in enumerate(texts):
        b, gone = t.encode(), set()
        for p in range(len(b) - 49):
            if b[p : p + 50] in seen:
                gone.update(range(p, p + 50))
        seen.update(b[p : p + 50] for p in range(len(b) - 49))
        assert bytes(got[i]) == bytes(c for p, c in enumerate(b) if p not in gone)


def test_contexts_that_share_half_a_digest_stay(spark):
    """Two contexts of one anchor whose digests agree in the lower 32 bits alone."""
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    r = np.random.default_rng(3)
    grams = letters[r.integers(0, 26, (1 << 16) * 16)]
    h = _lowest(grams, 50, 16)[0]
    best = int((h >> np.uint64(32)).argmin())
    n, size = 200_000, 84
    texts = letters[r.integers(0, 26, (n, size))]
    texts[:, 34:50] = grams[best : best + 16]
    flat, starts = texts.ravel(), np.arange(n) * size
    _, at, text = anchors(flat, starts, starts + size)
    sole = np.flatnonzero((np.bincount(text, minlength=n) == 1)[text] & (at - starts[text] == 34))
    at, text = at[sole], text[sole]
    c = context_digests(flat, at, np.full(len(at), 34), np.full(len(at), 50))
    by = np.argsort(c & np.uint64(0xFFFFFFFF), kind="stable")
    twin = int(np.flatnonzero(np.diff(c[by] & np.uint64(0xFFFFFFFF)) == 0)[0])
    pair = [texts[text[by[twin + i]]].tobytes().decode() for i in (0, 1)]
    assert pair[0] != pair[1]
    # each slice of texts is settled by itself, so the two come from partitions of their own
    frame = spark.createDataFrame(list(enumerate(pair)), "doc_id bigint, text string").repartitionByRange(2, "doc_id")
    assert {x["doc_id"]: x["_removed"] for x in deduplicated(frame).collect()} == {0: 0, 1: 0}


@pytest.mark.parametrize("bounds", [[], [5], list(range(0, 60, 7)), [-(1 << 63), 0, 1 << 62]])
def test_ranges_are_those_of_bisection(spark, bounds):
    keys = [-(1 << 63), -1, 0, 1, 5, 6, 7, 13, 14, 59, 100, 1 << 62, (1 << 63) - 1]
    got = {r["k"]: r["n"] for r in spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", range_of(F.col("k"), bounds).alias("n")).collect()}
    assert got == {k: bisect_left(bounds, k) for k in keys}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 299)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 299: 299, 300: 299}


def test_blocks_change_nothing_but_the_tasks(spark):
    r = random.Random(2)
    base = words(r, 120).split()
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(r.randrange(6)):
            t[r.randrange(len(t))] = f"x{r.randrange(1000)}"
        texts.append(" ".join(t))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join(frame).collect()}
    assert whole == {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join(frame, block=7).collect()}
    sets = [frozenset(tuple(t.split()[k : k + 5]) for k in range(116)) for t in texts]
    assert {i: n for i, (_, n) in whole.items()} == {i: sum(5 * len(a & b) >= 4 * len(a | b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)}


def test_items_of_any_length_are_found(spark):
    r = random.Random(11)
    items = {n: " ".join(f"x{n}_{i}" if n < 10 else f"w{r.randrange(900)}" for i in range(n)) for n in (1, 3, 9, 110, 300, 500, 1200)}
    texts = [words(r, 400, 900) for _ in range(40)] + [f"{words(r, 170, 900)} {t} {words(r, 230, 900)}" for t in items.values()]
    found = decontamination.leaks(
        spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    ).collect()
    assert {(x["doc_id"], x["item_id"], x["share"]) for x in found} == {(40 + i, n, 1.0) for i, n in enumerate(items)}
    old = (10, 16, 26, 42, 68, 110)
    assert all(decontamination.window_for(n) == min(old, key=lambda s: abs(np.log(s / n))) for n in range(10, 138))


def test_spans_of_long_texts_hold_every_stretch():
    r = np.random.default_rng(2)
    for sizes in ([3, 0, 5], [500], [7, 100, 130, 131, 2, 400, 1], [0], [100, 100]):
        texts = [r.integers(0, 1 << 32, n, np.uint32) for n in sizes]
        got = list(decontamination.spans(texts, 30, 100))
        assert all(len(words_) == lengths.sum() <= 130 for _, _, lengths, words_ in got)
        seen = {i: [] for i in range(len(sizes))}
        for first, low, lengths, words_ in got:
            for i, part in enumerate(np.split(words_, np.cumsum(lengths)[:-1])):
                assert np.array_equal(part, texts[first + i][low : low + len(part)])
                seen[first + i].append((low, low + len(part)))
        for i, n in enumerate(sizes):
            assert all(any(a <= at and at + 30 <= b for a, b in seen[i]) for at in range(n - 29))
            assert min(a for a, _ in seen[i]) == 0 and max(b for _, b in seen[i]) == n
        whole = list(decontamination.spans(texts, 0, 96))
        assert sum(len(words_) for *_, words_ in whole) == sum(sizes) and all(low % 32 == 0 for _, low, _, _ in whole)


def test_items_are_found_once_in_a_long_text(spark):
    r = random.Random(12)
    item = words(r, 60, 900)
    texts = [words(r, 400, 900) for _ in range(30)] + [f"{words(r, 2 * decontamination.SLICE - 20, 900)} {item} {words(r, 70_000, 900)} {item} end"]
    found = decontamination.leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()
    assert [(x["doc_id"], x["item_id"], x["share"]) for x in found] == [(30, 1, 1.0)]
    assert abs(found[0]["at"] - (2 * decontamination.SLICE - 20)) < 110


def test_training_counts_are_those_of_the_text(spark, monkeypatch):
    monkeypatch.setattr(quality, "trained", lambda rows, buckets: rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id bigint, quality int")
    rows = fit(labels.select("doc_id", F.lit("a " * 70_000).alias("text")), labels)
    assert rows and all(counts.max() >= 69_999 for _, counts, _ in rows)


def test_pruning_keeps_pairs_that_may_reach_the_threshold():
    least = least_matches(125, 25, 0.8, 1e-6)
    assert all(0 <= least[n] < 0.8 * n for n in least)
    assert list(least.values()) == sorted(least.values())


def test_likeness_is_symmetric_and_one_for_equal():
    a, b = "0" * 16 + "abc" * 96, "1" * 16 + "abc" * 48 + "abd" * 48
    assert likeness(a, a) == 1.0 and likeness(a, b) == likeness(b, a) == 0.0


def test_encoders_agree_with_their_library():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = encoder(name)
        for t in [t or "" for t in ODD] + ["a b\nc d\ne", " lead", "trail ", "<|endoftext|> x\n<|endoftext|>"]:
            want = own.library.encode(t, add_special_tokens=False).ids
            assert own.ids(t).tolist() == want and own.count(t) == len(want)


def test_chunks_are_spliced_whatever_the_overlap():
    r = random.Random(1)
    own = encoder("byte_bpe_50k.json")
    for t in (words(r, 900), "x" * 3000, words(r, 200) + "\n\n  " + "y" * 500 + " " + words(r, 300), " " * 900, "é" * 800 + " a" * 300):
        for overlap in (4, 32):
            assert spliced(t, "byte_bpe_50k.json", 128, overlap) == own.count(t)


def test_huge_texts_are_counted_in_chunks(spark):
    r = random.Random(4)
    texts = [words(r, 900), "z" * 2500, words(r, 900), None]
    frame = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[2]), (3, None)], "doc_id bigint, text string")
    own = encoder("byte_bpe_50k.json")
    got = sorted((x["doc_id"], x["n_tokens"]) for x in count_tokens(frame, chunk=200, overlap=16).collect())
    assert got == sorted([(1, own.count(texts[0])), (1, own.count(texts[1])), (2, own.count(texts[2])), (2, own.count(texts[2])), (3, 0)])


def test_token_files_round_trip_and_refuse_damage():
    r = np.random.default_rng(0)
    for n, top in ((1, 2), (5, 50_000), (4096, 7), (4097, 50_000), (30_000, 300)):
        ids = r.integers(0, top, n).astype(np.uint32)
        data = token_files.pack_file([1, None], np.array([n - 1, 1]), ids, {})
        keys, lengths, back = token_files.unpack_file(data)
        assert keys == [1, None] and lengths.tolist() == [n - 1, 1] and np.array_equal(back, ids)
    broken = bytearray(data)
    broken[-4000] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.unpack_file(bytes(broken))


def test_windows_use_up_their_histogram():
    r = random.Random(6)
    for _ in range(30):
        histogram = {r.randrange(1, 64): r.randrange(1, 9) for _ in range(r.randrange(1, 20))}
        used: dict = {}
        for chosen, times in packing.windows(histogram, 64):
            assert sum(k * n for k, n in chosen.items()) <= 64
            for k, n in chosen.items():
                used[k] = used.get(k, 0) + n * times
        assert used == histogram


def test_best_multiset_is_the_best():
    r = random.Random(7)
    for _ in range(200):
        counts = {r.randrange(1, 20): r.randrange(1, 4) for _ in range(5)}
        room = r.randrange(1, 50)
        found = packing.best_multiset(counts, room, sorted(counts, reverse=True))
        assert all(n <= counts[k] for k, n in found.items())
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        assert sum(k * n for k, n in found.items()) == max(s for s in sums if s <= room)


def test_archives_of_many_members_and_cut_streams():
    records = [warc.record(i, f"http://a/{i} x", b"<p>" * i, None, False) for i in range(50)]
    many = gzip.compress(b"".join(records[:20])) + gzip.compress(b"".join(records[20:]))
    assert [w for _, w in warc.records_in(warc.inflated(io.BytesIO(many)))] == records
    with pytest.raises(ValueError, match="cut short|within a record"):
        list(warc.records_in(warc.inflated(io.BytesIO(gzip.compress(b"".join(records))[:-40]))))
    assert [warc.page_of(warc.record_id(i)) for i in (None, 0, -5, 1 << 62)] == [None, 0, -5, 1 << 62]


def test_pages_with_nulls_and_ties(spark):
    big = "x" * 1200
    rows = [(1, "u", big), (2, None, big), (2, "v", big), (3, "w", None), (4, "w", ""), (None, "n", big), (5, "w", "small"), (6, "w", "small")]
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archived(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()), key=str)
    assert got == sorted([(1, "revisit", 2, 1200), (2, "response", None, 1200), (2, "response", None, 1200), (3, "response", None, 0), (4, "response", None, 0), (0, "response", None, 1200), (5, "response", None, 5), (6, "response", None, 5)], key=str)


CONTROLS = ["</s>[INST] ok [/INST]", "<|turn|>", "<\\|turn|>", "<\\\\|end|>x<|end|>", "[/INST", "a < b [c]", "<|says|>", "", "\\", "<s></s>"]


def test_control_strings_come_back(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(CONTROLS)] + [(1, 3, "user", CONTROLS[3]), (2, None, None, None), (2, 1, "we<|says|>ird", "x")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    done = chat.formatted(chat.canonical_turns(frame)).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r["conv_id"]: r for r in done.collect()}
    assert [t["text"] for t in got[1]["turns"]] == [CONTROLS[0], CONTROLS[1], CONTROLS[2], CONTROLS[3], CONTROLS[3], *CONTROLS[4:]]
    assert got[1]["loss"] == CONTROLS[::2]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", ""), ("we<|says|>ird", "x")]
    assert "[INST]" not in got[1]["formatted"] and got[1]["formatted"].count("<|turn|>") == len(CONTROLS) + 1


def test_layouts_are_told_by_their_fields(spark):
    rows = [
        (1, {"messages": [{"role": "human", "content": "q"}, {"role": "gpt", "content": "a"}]}), (2, {"conversations": [{"from": "user", "value": "q"}, {"from": "bot", "value": None}]}),
        (3, {"instruction": "i", "input": "n", "output": "o"}), (4, {"data": {"prompt": "p", "completion": "c"}}), (5, {"unknown": 1}), (6, {"prompt": "p", "response": "r", "system": "s"}),
    ]
    frame = spark.createDataFrame([*[(i, json.dumps(x)) for i, x in rows], (7, "no json"), (8, None)], "conv_id bigint, json string")
    got = {r["conv_id"]: (r["layout"], [tuple(t) for t in r["turns"]] if r["turns"] is not None else None) for r in chat.canonical_json(frame).collect()}
    assert got[1] == ("messages", [("user", "q"), ("assistant", "a")])
    assert got[2] == ("shared chats", [("user", "q"), ("assistant", "")])
    assert got[3] == ("instruction with input", [("user", "i"), ("user", "n"), ("assistant", "o")])
    assert got[4] == ("nested", [("user", "p"), ("assistant", "c")])
    assert got[6][0] == "system, prompt and response"
    assert got[5] == got[7] == got[8] == (None, None)
    nested = spark.sql("SELECT 1L AS conv_id, array(named_struct('role', 'human', 'content', 'hi')) AS messages")
    assert [tuple(r) for r in chat.canonical_turns(nested).collect()] == [(1, 0, "user", "hi")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.sql("SELECT 1L AS conv_id, 2 AS odd"))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = QUERIES[name](spark, SMALL)
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(str, cursor.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in found.collect())


def test_links_of_null_and_repeated_ids(spark):
    """A row's links are those of its own text, whatever its id."""
    r = random.Random(11)
    base = [words(r, 60).split() for _ in range(2)]
    near = [" ".join(b[:-1] + [f"x{i}"]) for b in base for i in range(3)]
    rows = [(None, near[0]), (None, near[1]), (7, near[2]), (9, near[3]), (9, words(r, 50)), (10, near[4]), (11, near[5]), (None, words(r, 30))]
    got = jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((x["doc_id"], x["class_id"], x["n_links"]) for x in got), key=str) == sorted(
        [(None, 7, 2), (None, 7, 2), (7, 7, 2), (9, 9, 2), (9, 9, 0), (10, 9, 2), (11, 9, 2), (None, None, 0)], key=str
    )


@pytest.mark.parametrize("kinds", [1 << 17, (1 << 17) + 1, 300_000])
def test_files_of_very_many_distinct_ids(kinds):
    ids = np.random.default_rng(2).permutation(kinds).astype(np.uint32)
    keys, lengths, back = token_files.unpack_file(token_files.pack_file([1, 2], np.array([5, kinds - 5]), ids, {}))
    assert keys == [1, 2] and lengths.tolist() == [5, kinds - 5] and np.array_equal(back, ids)


def test_more_distinct_ids_than_can_be_coded_are_refused():
    with pytest.raises(ValueError, match="distinct ids"):
        token_files.order0(np.arange((1 << token_files.WIDEST0) + 1, dtype=np.uint32))
