"""Lexical search, whitening and language identification: brute force, exact sums and held-out documents; odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import language, search, whitening
from voxloom.llm.common import table
from voxloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    """docs: (id, text) rows; the contract's integers, document by document."""
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n_all, total, df = len(held), sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = [(t, math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1)))) for t in terms(text) if t in df]
        scores = []
        for i, c, n in held:
            m = 25 + 75 * n * n_all // total
            if s := sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in asked if t in c):
                scores.append((-s, i is None, i))
        scores.sort(key=lambda h: h[:2] if h[1] else h)
        out += [(item, rank, h[2], -h[0]) for rank, h in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=repr)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(300)]
    rows = []
    for i in range(900):
        words = [r.choice(common) if r.random() < 0.6 else r.choice(rare) for _ in range(r.randrange(1, 40))]
        rows.append((i, r.choice([" ", ", ", "\n"]).join(w.upper() if r.random() < 0.2 else w for w in words)))
    rows += [(5, "c1 r7 r7"), (5, "c1 r7 r7"), (None, "r9 Öl Ωmega"), (None, "r9"), (7000, None), (7001, ""), (7002, " \t--"), (7003, "r5 " * 200_000)]
    items = [(1, "r1 r2 C1 c2, c0"), (2, "Öl ωmega R9 r9"), (3, None), (4, ""), (4, "r7 c1"), (None, "c3 c3 c4 r5"), (6, "nothing that stands anywhere"), (7, " ".join(common))]
    items += [(i, " ".join(r.sample(rare, 8) + r.sample(common, 3))) for i in range(10, 30)]
    return rows, items


@pytest.mark.parametrize("span, short, block", [(128, 16, 4 << 20), (7, 2, 300), (16, 10**9, 4 << 20), (16, 0, 1000)])
def test_search_is_that_of_every_document_scored(spark, texts, monkeypatch, span, short, block):
    """Whether lists are long or short, spans narrow or items in many blocks."""
    for name, value in (("SPAN", span), ("SHORT", short), ("SHARD_BYTES", 4000)):
        monkeypatch.setattr(search, name, value)
    rows, items = texts
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS _k", "2 AS _t", "3 AS score", "4 AS item_id").repartition(3)
    asked = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS _q", "2 AS _at", "3 AS rank")
    assert found(search.ranked_search(docs, asked, block_bytes=block)) == brute_search(rows, items)


def test_blocks_of_documents_are_skipped(spark, monkeypatch):
    """A shard's later blocks cannot reach the bar, so their long lists are not read."""
    n = 2000
    docs = np.arange(n, dtype=np.int32)
    row = {
        "ids": list(range(n)), "sizes": np.r_[np.full(20, 1), np.full(n - 20, 500)].astype(np.int64).tobytes(), "terms": [0], "lengths": [n],
        "docs": docs.tobytes(), "tfs": np.ones(n, np.int64).tobytes(),
    }
    shard, best, offers = search.Shard(row, n, 500 * n, 1), search.Best(10), []
    monkeypatch.setattr(best, "offer", lambda ids, d, s, f=best.offer: (offers.append(len(d)), f(ids, d, s)))
    search.search_shard(shard, search.Query(1, np.array([0]), np.array([5])), best)
    assert len(offers) == 1 and [h[2] for h in best.held] == list(range(10))


def test_search_of_empty_tables(spark, texts):
    rows, items = texts
    docs, asked = spark.createDataFrame(rows[:9], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert found(search.ranked_search(docs.limit(0), asked)) == []
    assert found(search.ranked_search(docs, asked.limit(0))) == []
    assert found(search.ranked_search(docs.selectExpr("doc_id", "CAST(NULL AS string) AS text"), asked)) == []


def vectors_of(rows):
    """Rows that stay, by the docstring's rules, as whole numbers."""
    lengths = Counter(len(v) for _, v in rows if v)
    dims = max(lengths, key=lambda n: (lengths[n], n))
    return [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]


def check_whitened(got, rows, components=32):
    kept = vectors_of(rows)
    x = np.array([v for _, v in kept], object)
    n, total = len(kept), x.sum(axis=0)
    v = np.array([[float((n * int((a * b).sum()) - int(a.sum()) * int(b.sum()))) / (n * n) for b in x.T] for a in x.T])
    values, vectors = np.linalg.eigh(v)
    keep = [k for k in np.argsort(-values) if values[k] > 1e-11 * values.max()][:components]
    assert sorted({r["component"] for r in got}) == list(range(1, len(keep) + 1))
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == sorted((str(i), sum((n * c - s) ** 2 for c, s in zip(row, total, strict=True))) for i, row in kept)
    assert all(r["n"] == n and r["identity_error"] < 1e-9 for r in got)
    for c, k in enumerate(keep, 1):
        own = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c}
        want = {i: float(sum((Fraction_(a, n, s)) * u for a, s, u in zip(row, total, vectors[:, k], strict=True))) / math.sqrt(values[k]) for i, row in kept}
        sign = np.sign(sum(own[i] * want[i] for i in own))
        assert max(abs(own[i] - sign * want[i]) for i in own) < 1e-7
        assert all(abs(r["explained"] - values[k] / np.trace(v)) < 1e-9 for r in got if r["component"] == c)


def Fraction_(a, n, s):
    """a - s / n, from whole numbers."""
    return (a * n - s) / n


def test_whitened_vectors_are_those_of_a_dense_solver(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, SMALL, "embeddings").limit(150).collect()]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)).collect()
    check_whitened(got, rows)


def test_whitening_of_odd_rows(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(900, 3), r.gauss(-5, 1), r.gauss(0, 0.5), 7.25]) for i in range(60)]
    odd = [(60, None), (61, []), (62, [1.0, None, 2.0, 3.0]), (63, [math.nan, 1.0, 1.0, 1.0]), (64, [math.inf, 0.0, 0.0, 0.0]), (65, [1.0, 2.0]), (66, [1e300, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS _k", "2 AS _v", "3 AS component", "4 AS n")
    got = whitening.whitened(frame).collect()
    assert {x["vec_id"] for x in got} == set(range(60))
    check_whitened(got, rows)  # the last entry is constant, so there are three components
    for nothing in (frame.limit(0), frame.where("vec_id >= 60 AND vec_id <> 65"), frame.where("vec_id = 3"), frame.where("vec_id IN (3, 3)")):
        assert whitening.whitened(nothing).count() == 0
    twice = frame.where("vec_id < 20").unionByName(frame.where("vec_id < 20")).withColumn("vec_id", F.lit(None).cast("bigint"))
    assert whitening.whitened(twice).where("n = 40 AND vec_id IS NULL").count() == 120


def test_large_entries_are_summed_exactly(spark):
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate([(2**50, 3), (2**50 + 4, -2**52), (-(2**51), 2**40 + 1), (17, 2**33)])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1, 2}
    assert all(r["deviation"] is None for r in got)  # beyond 64 bits
    assert max(r["identity_error"] for r in got) < 1e-9


@pytest.mark.parametrize("spectrum", [
    [5.0] * 12 + [1.0] * 12, [1.0 + k * 1e-12 for k in range(20)], [2.0**-k for k in range(40)], [10.0, 9.0, 0.0, 0.0], [3.0], [1.0 + k for k in range(60)], [0.0, 0.0],
])
def test_components_of_a_known_spectrum(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((len(spectrum),) * 2))
    a = (q * np.array(spectrum)) @ q.T
    a = (a + a.T) / 2
    for shift in (-1.0, 0.5, 1.5, 4.0, 9.5, 100.0):
        assert whitening.eigenvalues_above(a, shift) == sum(e > shift for e in spectrum)
    values, vectors = whitening.feast(a, 32)
    want = [e for e in sorted(spectrum, reverse=True) if e > 1e-12 * max(spectrum)][:32]
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-9, atol=1e-13 * max(spectrum))
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max(initial=0) < 1e-12
    assert np.abs(a @ vectors - vectors * values).max(initial=0) < 1e-12 * max(1, max(spectrum))


def greedy(text, sample):
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_phrases_are_the_longest_ones_of_the_sample():
    r = random.Random(4)
    for alphabet in ("ab", "abcdé", "abcdefghij "):
        sample = "".join(r.choice(alphabet) for _ in range(300))
        start = language.suffix_automaton(sample)
        for _ in range(60):
            text = "".join(r.choice(alphabet + "z") for _ in range(r.randrange(60)))
            assert language.phrases(text, start) == greedy(text, sample)


def test_held_out_languages(spark):
    truth = {r["doc_id"]: r["lang"] for r in table(spark, SMALL, "documents").collect()}
    got = QUERIES["op13_language"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    told = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"] and truth[r["doc_id"]]]
    assert len(told) > 20 and np.mean(told) > 0.95


def test_languages_of_odd_rows(spark):
    rows = [(i, ("der hund und die katze " if i % 2 else "le chien avec la chatte ") * (1 + i % 3), "de" if i % 2 else "fr") for i in range(40)]
    rows += [(40, None, "de"), (41, "", "fr"), (42, " 12 -- 7", "de"), (43, "der hund", None), (None, "la chatte", "xx"), (44, "der hund " * 100_000, None), (44, "字字字", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS _k", "2 AS _t", "3 AS _two", "4 AS score", "5 AS held_out")
    got = language.language_id(docs).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["lang_pred"]) for r in got}
    assert {(40, "und"), (41, "und"), (42, "und"), (43, "de"), (None, "fr"), (44, "de")} <= by
    assert all((r["doc_id"], lang) in by for r in got if r["doc_id"] is not None for lang in ["de" if r["doc_id"] % 2 else "fr"] if r["doc_id"] < 40)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [None]
    samples = language.learned(docs)
    assert set(samples) == {"de", "fr"}
    one_by_one = language.languages(docs, samples, together=1).collect()
    assert sorted(map(str, one_by_one)) == sorted(str(r) for r in language.languages(docs, samples).collect())
    assert {r["lang_pred"] for r in language.languages(docs, {}).collect()} == {"und"}
    assert language.language_id(docs.limit(0)).count() == 0
    assert {r["score"] for r in language.languages(docs.where("doc_id < 40"), {"de": samples["de"]}).collect()} == {1.0}
