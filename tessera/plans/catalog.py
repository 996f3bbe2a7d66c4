"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import graphs, matching, paths, reports, retrieval, rules, search, texts

FLAGSHIP = "bm25_topk"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**retrieval.QUERIES, **graphs.QUERIES, **texts.QUERIES, **rules.QUERIES, **search.QUERIES, **reports.QUERIES, **paths.QUERIES, **matching.QUERIES}
ORACLES: dict[str, str] = {**retrieval.ORACLES, **graphs.ORACLES, **texts.ORACLES, **rules.ORACLES, **search.ORACLES, **reports.ORACLES, **paths.ORACLES, **matching.ORACLES}
