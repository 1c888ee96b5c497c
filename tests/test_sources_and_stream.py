"""Readers on small files, and a stream of pieces run to its end."""

import json
import time

from voxloom.sources import readers
from voxloom.streaming.micro_batch import micro_batch_stream


def test_audio_files_are_routed_by_size(spark, tmp_path):
    for name, size in (("a.wav", 10), ("c.wav", 100)):
        (tmp_path / name).write_bytes(b"x" * size)
    rows = {r.path.split("/")[-1]: r for r in readers.scan_audio_files(spark, str(tmp_path), max_bytes=50).collect()}
    assert rows["a.wav"].reject is None and len(rows["a.wav"].content) == 10
    assert rows["c.wav"].reject == "file too large" and rows["c.wav"].content is None


def test_vocab_may_hold_a_space(spark, tmp_path):
    (tmp_path / "tokens.txt").write_text("<s> 0\n  4\n\na 5\n")
    assert {(r.token, r.id) for r in readers.scan_vocab(spark, str(tmp_path / "tokens.txt")).collect()} == {("<s>", 0), (" ", 4), ("a", 5)}
    (tmp_path / "vocab.json").write_text(json.dumps({"a": 1, "|": 2}, indent=1))
    assert {(r.token, r.id) for r in readers.scan_vocab_json(spark, str(tmp_path / "vocab.json")).collect()} == {("a", 1), ("|", 2)}


def test_catalogue_files_default_by_type(spark, tmp_path):
    entry = {
        "name": "m", "family": "timed", "entry_type": "tdt", "languages": ["en"], "chunk_target_sec": 60, "chunk_max_sec": 75,
        "quantizations": {"fp32": {"repo": "r", "revision": "1"}, "int8": {"repo": "r", "revision": "1", "files": {"model": "m8"}}},
    }
    (tmp_path / "c.json").write_text(json.dumps(entry))
    rows = {r.quantization: r.files for r in readers.scan_catalogue(spark, str(tmp_path / "c.json"), {"tdt": {"model": "m", "vocab": "v"}}).collect()}
    assert rows == {"fp32": {"model": "m", "vocab": "v"}, "int8": {"model": "m8", "vocab": "v"}}


def test_stream_keeps_every_piece_within_the_caps(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    source, out = tmp_path / "in", tmp_path / "out"
    pieces = [("m", 0, i, 50 if i % 7 == 0 else 10) for i in range(22)] + [("k", 1, i, 10) for i in range(3)]
    spark.createDataFrame(pieces, "model string, shard long, ord long, n long").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("model string, shard long, ord long, n long").parquet(str(source))
    query = (
        micro_batch_stream(stream, max_rows=4, max_padded=120, window_ms=200)
        .writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).start()
    )
    try:
        rows, limit = [], time.time() + 90
        while len(rows) < len(pieces) and time.time() < limit:
            time.sleep(2)
            try:
                rows = spark.read.parquet(str(out)).collect()
            except Exception:  # nothing written yet
                rows = []
    finally:
        query.stop()
    assert sorted((r.model, r.ord) for r in rows) == sorted((p[0], p[2]) for p in pieces)
    batches = {}
    for r in rows:
        batches.setdefault((r.model, r.shard, r.batch), []).append(r.n)
    assert all(len(b) <= 4 and (len(b) == 1 or len(b) * max(b) <= 120) for b in batches.values())
