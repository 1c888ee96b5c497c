"""The whole job: resumed after it was killed, and files that the model fails on."""

import pytest

from voxloom.plans import bulk
from voxloom.queries import bulk_queries

WORD = bulk_queries.WORD


class Killed(Exception):
    pass


def corpus(spark, texts):
    """Files of words, as the query's corpus is made, with no silence."""
    words = {f: t.split() for f, t in texts.items()}
    sizes = spark.createDataFrame([(f, len(w) * WORD) for f, w in words.items()], "file string, total long")
    speech = spark.createDataFrame([(f, 0, len(w) * WORD) for f, w in words.items() if w], "file string, s long, e long")
    blocks = spark.createDataFrame([(f, b, w[b * 8 : b * 8 + 8]) for f, w in words.items() for b in range(-(-len(w) // 8))], "file string, block long, x array<string>")
    return sizes, speech, bulk.Signal(blocks, 8, WORD)


def recogniser(refuse):
    """One that hears every word, and fails on an input with a refused one."""

    def load():
        def recognise(inputs):
            if any(w in refuse for x in inputs for w in x):
                raise RuntimeError("refused")
            return [{"tokens": ["▁" + w for w in x], "timestamps": [k * 0.8 for k in range(len(x))]} for x in inputs]

        return recognise

    return load


TEXTS = {f"f{n}": " ".join(f"w{n}x{k}" for k in range(3 + 11 * n)) for n in range(4)} | {"silent": ""}


def rows(df):
    return {r.file: (r.text, [w.word for w in r.words or []], r.pieces) for r in df.collect()}


def test_a_killed_job_goes_on_where_it_was(spark, tmp_path):
    sizes, speech, signal = corpus(spark, TEXTS)
    folder, waves = f"file://{tmp_path}/job", []

    def kill(wave):
        waves.append(wave)
        if len(waves) == 2:  # its transcripts are written, its manifest rows are not
            raise Killed

    small = {"wave_samples": 40 * WORD}
    with pytest.raises(Killed):
        bulk.bulk_transcribe(sizes, speech, signal, recogniser(()), bulk_queries.BOUNDS, folder, before_commit=kill, **small)
    manifest = bulk.Manifest(spark, folder, "string")
    done = {r.file for r in manifest.rows().collect()}
    assert 0 < len(done) < len(TEXTS) and waves[-1] not in {r.wave for r in manifest.rows().collect()}
    # the second run's model fails on any word of a file that is done
    refused = {w for f in done for w in TEXTS[f].split()}
    got = rows(bulk.bulk_transcribe(sizes, speech, signal, recogniser(refused), bulk_queries.BOUNDS, folder, **small))
    assert {f: t for f, (t, _w, _p) in got.items()} == TEXTS
    assert all(" ".join(w) == TEXTS[f] for f, (_t, w, _p) in got.items())
    assert got["f3"][2] > 1 and got["silent"][:2] == ("", [])
    every = manifest.rows().collect()
    assert sorted(r.file for r in every) == sorted(TEXTS) and all((r.state, r.attempt) == ("done", 1) for r in every)


def test_a_file_that_fails_is_tried_again_and_named(spark, tmp_path):
    sizes, speech, signal = corpus(spark, {"good": "a b c", "bad": "a poison c"})
    folder = f"file://{tmp_path}/job"
    got = rows(bulk.bulk_transcribe(sizes, speech, signal, recogniser({"poison"}), bulk_queries.BOUNDS, folder, attempts=2))
    assert set(got) <= {"good"}
    tried = sorted((r.file, r.attempt, r.state, r.error) for r in bulk.Manifest(spark, folder, "string").rows().collect() if r.file == "bad")
    assert tried == [("bad", n, "failed", "RuntimeError: refused") for n in (1, 2)]
