"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from cueforge.plans import cue_queries, quality_queries, report_queries, state_queries, stream_queries, text_queries

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (cue_queries, quality_queries, report_queries, state_queries, stream_queries, text_queries):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE


def flagship(spark, sf_dir):
    return QUERIES["min_slice"](spark, sf_dir)
