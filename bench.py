"""Headline queries timed on local[$BENCH_CPUS] over $BENCH_SF_DIR; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from voxloom.queries.registry import REGISTRY  # noqa: E402
from voxloom.session import build_session  # noqa: E402

HEADLINE = (
    "word_bounds", "stitch_transcript", "sink_srt", "runs", "normalise_intervals", "overlap_sum", "frame_signal", "span_power",
    "trim_overlaps", "accept_redo", "log_softmax_frames", "ctc_align", "spoken_token_ids", "cardinal_words", "pack_batches",
    "runtime_summary", "resolve_model", "enforce_limits", "plan_chunks",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "voxloom-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not any query's time
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    line = {
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
