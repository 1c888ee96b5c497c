"""All registered queries, by operator name."""

from __future__ import annotations

import importlib

from voxloom.queries.base import Query

SECTIONS = (
    "interval_queries",
    "word_queries",
    "request_queries",
    "report_queries",
    "signal_queries",
    "seam_queries",
    "align_queries",
    "number_queries",
    "planning_queries",
    "letter_queries",
    "redo_queries",
    "bulk_queries",
    "relisten_queries",
    "cut_queries",
)

REGISTRY: dict[str, Query] = {}
for section in SECTIONS:
    for query in importlib.import_module(f"voxloom.queries.{section}").QUERIES:
        if query.name in REGISTRY:
            raise ValueError(f"query {query.name} registered twice")
        REGISTRY[query.name] = query
