"""The jobs: growing input, reruns, interrupted runs, command line, edge cases, and their queries against SQL."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest
from test_queries import duck, rows  # noqa: F401

from jobs import common, lexical_index, queries, retrieval_report
from tessera.operators import lexical

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, source string, extra int"


def files(folder) -> dict[str, int]:
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def deliver(spark, folder, delivered) -> None:
    """One more file of documents."""
    spark.createDataFrame([(*r, 1) for r in delivered], DOCS).coalesce(1).write.mode("append").parquet(str(folder))


def whole(frame) -> list:
    return sorted((tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_query_matches_oracle(spark, duck, sf, name):  # noqa: F811
    ours, theirs = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


def test_index_takes_only_what_is_new(spark, sf, tmp_path):
    table = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    paths = [str(tmp_path / x) for x in ("documents", "index", "checkpoint")]
    deliver(spark, paths[0], table[:120])
    first = lexical_index.run(spark, *paths)
    assert first["documents read"] == first["documents written"] == 120
    held = files(paths[1])

    again = lexical_index.run(spark, *paths)
    assert set(again.values()) == {0} and files(paths[1]) == held

    deliver(spark, paths[0], [*table[120:], (table[0][0], "another text under a known id", "new")])
    second = lexical_index.run(spark, *paths)
    assert second["documents read"] == len(table) - 120 + 1 and second["documents written"] == len(table) - 120
    assert {k: v for k, v in files(paths[1]).items() if k in held} == held  # what was there wasn't touched

    once = [f"{sf}/documents.parquet", str(tmp_path / "whole"), str(tmp_path / "other")]
    lexical_index.run(spark, *once)
    for part in ("postings", "documents"):
        assert whole(lexical_index.read_part(spark, paths[1], part).drop("batch")) == whole(lexical_index.read_part(spark, once[1], part).drop("batch"))
    assert whole(lexical_index.statistics(spark, paths[1])) == whole(lexical_index.statistics(spark, once[1]))

    asked = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id AS query_id", "text").limit(8)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    direct = lexical.top_k(lexical.bm25_scores(docs, asked), 10).select("query_id", "rank", "doc_id", "score")
    assert whole(lexical_index.search(spark, paths[1], asked)) == whole(direct)


def test_an_interrupted_batch_is_done_again(spark, tmp_path, monkeypatch):
    paths = [str(tmp_path / x) for x in ("documents", "index", "checkpoint")]
    deliver(spark, paths[0], [(i, f"common word{i} word{i % 3}", "s") for i in range(20)])
    lexical_index.run(spark, *paths)
    deliver(spark, paths[0], [(i, f"common later{i}", "s") for i in range(15, 40)])
    write = lexical_index._write

    def dies(rows, path):
        if "vocabulary" in path:
            raise RuntimeError("lost")
        write(rows, path)

    monkeypatch.setattr(lexical_index, "_write", dies)
    with pytest.raises(Exception, match="lost"):
        lexical_index.run(spark, *paths)
    monkeypatch.setattr(lexical_index, "_write", write)
    assert lexical_index.run(spark, *paths)["documents written"] == 20
    postings = lexical_index.read_part(spark, paths[1], "postings")
    assert postings.where("token = 'common'").count() == 40 == postings.where("token = 'common'").select("doc_id").distinct().count()
    assert lexical_index.statistics(spark, paths[1]).where("token = 'common'").first().df == 40
    assert postings.where("token LIKE 'later%'").count() == 20  # ids 15 to 19 were known


def test_files_come_in_batches_and_rows_may_be_odd(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("documents", "index", "checkpoint")]
    for k in range(3):
        deliver(spark, paths[0], [(k, f"text {k}", None), (k, f"text {k}", None), (10 + k, None, "s"), (20 + k, "", "s"), (None, "no id", "s"), (30, f"a{k}", "s")])
    counts = lexical_index.run(spark, *paths, settings=lexical_index.Settings(buckets=3, files_at_a_time=1))
    documents = lexical_index.read_part(spark, paths[1], "documents")
    assert counts["documents read"] == 18 and documents.count() == 3 + 3 + 3 + 1 and documents.select("batch").distinct().count() == 3
    assert documents.where("dl = 0").count() == 6
    assert sorted(r.tf for r in lexical_index.read_part(spark, paths[1], "postings").where("token = 'text'").collect()) == [1, 1, 1]
    assert lexical_index.read_part(spark, paths[1], "postings").select("bucket").distinct().count() <= 3
    empty = [str(tmp_path / x) for x in ("none", "empty", "mark")]
    deliver(spark, empty[0], [])
    lexical_index.run(spark, *empty)
    assert lexical_index.read(spark, empty[1]).count() == 0
    asked = spark.createDataFrame([(1, "text")], "query_id long, text string")
    assert lexical_index.search(spark, empty[1], asked).count() == 0


def test_report_reruns_safely(spark, tmp_path):
    docs, asked, out = (str(tmp_path / x) for x in ("documents", "questions", "report"))
    deliver(spark, docs, [(1, "alpha beta gamma", "s"), (2, "gamma delta", "s"), (3, None, "s"), (4, "", "s"), (5, "xx alpha beta gamma yy", "s")])
    spark.createDataFrame([(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, "zeta eta theta"), (3, ""), (None, "alpha")], "item_id long, text string").write.parquet(asked)
    first = retrieval_report.run(spark, docs, asked, out)
    before = whole(retrieval_report.read(spark, out))
    assert retrieval_report.run(spark, docs, asked, out) == first and whole(retrieval_report.read(spark, out)) == before
    hits = {(r.method, r.query_id, r.rank): (r.doc_id, r.relevant) for r in retrieval_report.read_part(spark, out, "hits").collect()}
    assert hits["bm25", 1, 1] == (1, True) and hits["bm25", 1, 2] == (5, True) and hits["bm25", 1, 3] == (2, False) and not [k for k in hits if k[1] != 1]
    found = {(r.method, r.query_id, r.k): r for r in retrieval_report.read_part(spark, out, "metrics").collect()}
    assert len(found) == 3 * 3 * 3 and found["rrf", 1, 5].recall == 1.0 and found["rrf", 2, 5].recall is None and found["overlap", 3, 1].hit == 0

    spark.createDataFrame([(7, "nothing known")], "item_id long, text string").write.mode("overwrite").parquet(asked)
    retrieval_report.run(spark, docs, asked, out, retrieval_report.Settings(methods=("bm25",), ks=(2,)))
    parts = retrieval_report.read(spark, out)
    assert parts.where("method = 'bm25' AND part = 'hits'").count() == 0 and [r.k for r in parts.where("method = 'bm25' AND part = 'metrics'").collect()] == [2]
    assert whole(parts.where("method <> 'bm25'")) == [r for r in before if "bm25" not in r]
    with pytest.raises(ValueError):
        retrieval_report.Settings(methods=("other",))


def test_report_of_empty_tables(spark, tmp_path):
    docs, asked, out = (str(tmp_path / x) for x in ("documents", "questions", "report"))
    deliver(spark, docs, [])
    spark.createDataFrame([], "item_id long, text string").write.parquet(asked)
    retrieval_report.run(spark, docs, asked, out)
    assert retrieval_report.read(spark, out).count() == 0


def test_settings_come_from_a_file(spark, tmp_path):
    assert common.settings(spark, retrieval_report.Settings, str(ROOT / "jobs/retrieval_report.json")) == retrieval_report.Settings()
    assert common.settings(spark, lexical_index.Settings, str(ROOT / "jobs/lexical_index.json")) == lexical_index.Settings()
    (tmp_path / "odd.json").write_text('{"bucket": 3}')
    with pytest.raises(ValueError, match="bucket"):
        common.settings(spark, lexical_index.Settings, str(tmp_path / "odd.json"))


def test_command_line(sf, tmp_path):
    (tmp_path / "config.json").write_text('{"buckets": 2}')
    command = [sys.executable, "-m", "jobs.lexical_index", "--documents", f"{sf}/documents.parquet", "--output", f"{tmp_path}/index", "--checkpoint", f"{tmp_path}/checkpoint", "--config", f"{tmp_path}/config.json"]
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_MASTER": "local[2]", "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
    done = subprocess.run(command, env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 200 documents" in done.stderr and "wrote 200 rows" in done.stderr
    assert {p.name for p in (tmp_path / "index/postings/batch=0").glob("bucket=*")} == {"bucket=0", "bucket=1"}
