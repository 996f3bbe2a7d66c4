"""Every query against its oracle, as multisets of rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import catalog


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, np.bool_):
        return bool(v)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, pd.Timestamp):
        return str(v)
    return v


def rows(frame: pd.DataFrame) -> Counter:
    names = sorted(frame.columns)
    return Counter(tuple(map(plain, r)) for r in frame[names].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_oracle(spark, duck, sf, name):
    ours, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_queries_without_an_oracle_are_tested_otherwise():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"semantic_chunks", "evidence_matches"}


def test_grounded_triples_counts(spark, sf):
    n = {r.reason: r.n for r in catalog.QUERIES["grounded_triples"](spark, sf).collect()}
    assert sum(n.values()) <= 3 * 200 and n["entity_not_grounded_in_passage"] >= 190 and n["clean"] >= 190


def test_semantic_chunks_cover_all_sentences(spark, sf):
    chunks = catalog.QUERIES["semantic_chunks"](spark, sf).toPandas().sort_values(["doc_id", "chunk_no"])
    counts = catalog.QUERIES["sentence_split"](spark, sf).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    for doc, group in chunks.groupby("doc_id"):
        assert group["sentence_start"].tolist() == [0, *(group["sentence_end"].iloc[:-1] + 1)]
        assert group["sentence_end"].iloc[-1] == counts[doc] - 1
    assert set(chunks["doc_id"]) == set(counts.index)
