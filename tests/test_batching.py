"""Batches packed by ordinals, and models called once for each."""

import random

import pytest
from pyspark.sql import functions as F

from voxloom.operators import batching


def _packed(lengths, rows, padded, size):
    """By the definition: one loop over the arrivals, anew at each slice."""
    out, batch = [], []
    for i, n in enumerate(lengths):
        fits = batch and i % size and len(batch) < rows and (len(batch) + 1) * max(*batch, n) <= padded
        if not i % size:
            number = i - 1
        if not fits:
            number, batch = number + 1, []
        batch.append(n)
        out.append(number)
    return out


@pytest.mark.parametrize("size", [1, 7, 1024])
def test_slices_of_a_hot_model(spark, size):
    rng = random.Random(size)
    jobs = {("hot", 0): 900, ("cold", 0): 5, ("cold", 1): 1, (None, None): 20}
    rows, expected = [], {}
    for (model, shard), count in jobs.items():
        ords = sorted(rng.sample(range(10**6), count))
        lengths = [rng.choice([1, 5, 30, 200]) for _ in ords]
        rows += [(model, shard, at, n, "x") for at, n in zip(ords, lengths)]
        expected |= {(model, shard, at): b for at, b in zip(ords, _packed(lengths, 4, 120, size))}
    rng.shuffle(rows)
    pieces = spark.createDataFrame(rows, "model string, shard int, ord bigint, n int, batch string")
    got = batching.pack_batches(pieces, max_padded=120, slice_rows=size).collect()
    assert {(r.model, r.shard, r.ord): r.batch for r in got} == expected and len(got) == len(rows)


def test_equal_ordinals_and_null_lengths_keep_their_rows(spark):
    pieces = spark.createDataFrame([("m", 0, 1, None), ("m", 0, 1, 4), ("m", 0, None, 4), ("m", 0, 1, 4)], "model string, shard int, ord int, n int")
    got = batching.pack_batches(pieces, max_rows=2).collect()
    assert sorted((r.batch, r.ord is None) for r in got) == [(0, False), (0, True), (1, False), (1, False)]
    assert batching.pack_batches(pieces.where("false")).count() == 0


def test_a_call_for_each_batch_across_frames(spark):
    """Frames of three rows: most batches lie in two."""
    rows = [("a" if i % 2 else None, None if i % 3 else 1, i, i % 50 // 10, f"t{i}") for i in range(200)]
    packed = spark.createDataFrame(rows, "model string, shard int, ord int, batch int, x string")
    groups = {}
    for model, shard, at, batch, text in rows:
        groups.setdefault((model, shard, batch), []).append((at, text))

    def load(name):
        def model(texts):
            if "t7" in texts:
                raise KeyError("lost")
            return [{"said": f"{name} {i} of {len(texts)}: {text}"} for i, text in enumerate(texts)]

        return model

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = batching.score_batches(packed, load, payload="x", schema="said string", keys="ord int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = {}
    for (model, _shard, _batch), members in groups.items():
        for i, (at, text) in enumerate(members):
            lost = any(t == "t7" for _at, t in members)
            expected[at] = (None, "KeyError: 'lost'") if lost else (f"{model} {i} of {len(members)}: {text}", None)
    assert {r.ord: (r.said, r.error) for r in got} == expected and len(got) == 200


def test_a_model_that_cannot_be_loaded_fails_its_own_batches(spark):
    def load(name):
        if name == "bad":
            raise OSError("no such model")
        return lambda texts: [{"n": len(t)} for t in texts]

    packed = spark.createDataFrame([("bad", 0, 0, 0, "a"), ("good", 0, 0, 0, "abc")], "model string, shard int, ord int, batch int, x string")
    got = batching.score_batches(packed, load, payload="x", schema="n int", keys="model string").collect()
    assert {r.model: (r.n, r.error) for r in got} == {"bad": (None, "OSError: no such model"), "good": (3, None)}
    none = batching.score_batches(packed.where(F.lit(False)), load, payload="x", schema="n int", keys="model string")
    assert none.count() == 0
