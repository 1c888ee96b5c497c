"""The registered corpus queries against brute force over the smallest tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from voxloom.llm.common import table
from voxloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SMALL, "documents").collect()}


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, SMALL).collect()]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_strings_of_earlier_documents_are_removed(spark, texts):
    seen, want = set(), {}
    for i in sorted(texts):
        body = texts[i].encode()
        own = [body[p : p + 50] for p in range(len(body) - 49)]
        gone = np.zeros(len(body), bool)
        for p, s in enumerate(own):
            if s in seen:
                gone[p : p + 50] = True
        seen.update(own)
        kept = bytes(np.frombuffer(body, np.uint8)[~gone])
        runs = int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum())
        want[i] = (len(body), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(spark, "op1_suffix_dedup")}
    assert got == want
    assert any(n for _, n, _, _ in want.values())


def test_edited_texts_and_likeness(spark, texts):
    order = sorted(texts)
    got = {r["doc_id"]: r for r in rows(spark, "op2_fingerprints")}
    assert set(got) == set(texts)
    for i, k in enumerate(order):
        t, following = texts[k], texts[order[(i + 1) % len(order)]]
        q = len(t) // 4
        assert got[k]["n_chars"] == len(t)
        assert got[k]["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + following[:q]).encode()).hexdigest()
    by_text = defaultdict(set)
    for k in order:
        by_text[texts[k]].add(got[k]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.9


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_links_and_classes_are_those_of_all_pairs(spark, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    links, least = Counter(), {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in sets:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    assert pairs
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows(spark, "op3_jaccard")} == {i: (least[i], links[i]) for i in sets}


def test_held_out_documents_are_told_apart(spark, texts):
    truth = {r["doc_id"]: r["quality"] for r in table(spark, SMALL, "labels").collect()}
    got = rows(spark, "op4_quality")
    assert {r["doc_id"] for r in got} == set(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    told = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in told]) > 0.85


def test_ids_come_back_from_their_files(spark, texts):
    own, at, want = library("byte_bpe_50k.json"), 0, {}
    for i in sorted(texts):
        ids = np.array([*own.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(spark, "op6_token_files")} == want


def test_token_counts_are_the_librarys(spark, texts):
    own = library("byte_bpe_50k.json")
    want = {i: (len(t.encode()), len(own.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows(spark, "op7_token_counts")} == want


def check_packing(got, texts):
    own, pieces, sequences = library("word_bpe_49k.json"), defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in texts.items():
        ids, at = np.array([*own.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    filled = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        filled.append(at)
    return filled


def test_every_id_is_packed_once(spark, texts):
    filled = check_packing(rows(spark, "op8_packing"), texts)
    assert sum(4096 - n for n in filled if n & (n - 1)) < 4096


def test_benchmark_passages_are_found(spark, texts):
    items = {r["item_id"]: r["text"] for r in table(spark, SMALL, "benchmark").collect()}
    verbatim = {(d, i) for d, t in texts.items() for i, item in items.items() if " ".join(item.split()) in " ".join(t.split())}
    got = {(r["doc_id"], r["item_id"]): r["share"] for r in rows(spark, "op9_decontamination")}
    assert verbatim and verbatim <= set(got)
    assert all(s >= 0.6 for s in got.values())


def test_stages_take_effect_on_what_the_last_one_kept(spark, texts):
    docs = table(spark, SMALL, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), "stage")
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    for a, b in zip(names[:-2], names[1:-1], strict=True):
        assert set(kept[b]) <= set(kept[a])
    assert len(kept[names[0]]) < len(texts)
    left = [shingles(t) for t in kept[names[1]].values()]
    assert not any(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(left) for b in left[:i] if a)
    packed = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()]
    check_packing(packed, kept[names[-2]])
