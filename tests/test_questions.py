"""Questions, units and evidence matching on small fixtures."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tessera.operators import qrels, vector
from tessera.operators import questions as Q


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cover_fields(spark):
    text = "For the fiscal year ended March 31, 2024 Commission File Number: 001-36743 (408) 996-1010 Common Stock, $0.01 AAPL The Nasdaq Stock Market LLC"
    got = spark.range(1).select(*Q.cover_fields(F.lit(text))).first()
    assert (got.period, got.report_date, got.commission, got.phone, got.exchange) == ("March 31, 2024", None, "001-36743", "(408) 996-1010", "The Nasdaq Stock Market LLC")


def test_types_and_units(spark):
    for answer, want in {"12%": "percentage", "2024-01-31": "date", "1,234": "number", "FY 24": "text", "none": "text"}.items():
        assert one(spark, Q.answer_type(F.lit(answer))) == want
    assert one(spark, Q.unit_for(F.lit("12%"), F.lit("x"))) == "%"
    assert one(spark, Q.unit_for(F.lit("5"), F.lit("$ in millions"))) == "million"
    assert one(spark, Q.unit_for(F.lit("5"), F.lit("in thousands"))) == "thousand"


def test_questions(spark):
    ask = lambda q, e="", a="1": one(spark, Q.natural_question(F.lit(q), F.lit("Apple"), F.lit(e), F.lit(a)))
    assert ask("What value does AAPL report for Mac under 2023?", "Table context: Net sales by product. HTML table row: x") == "What was Apple's Mac net sales for 2023?"
    assert ask("For AAPL's filing period ended May 1, 2023, what value is reported for Total under Q1?") == "For the period ended May 1, 2023, what was Apple's Total for Q1?"
    assert ask("Who?") == "Who?"
    assert one(spark, Q.unnatural(F.lit("Up $5 billion?"))) and one(spark, Q.text_question(F.lit("Nothing"), F.lit("A"))) is None
    assert one(spark, Q.text_question(F.lit("Net sales increased"), F.lit("A"))) == "What does A say drove the change in net sales?"
    assert one(spark, Q.checked_box(F.lit("☒ ANNUAL REPORT"))) == "Annual report"


def test_evidence(spark):
    chunks = spark.createDataFrame([("c1", "d", "Net sales rose to 5 in May", 2, None), ("c2", "d", "Other words entirely", 3, 4), ("c3", "e", "Sales of nets rose in May", 1, 1)], "chunk_id string, doc string, text string, page_start int, page_end int")
    ev = spark.createDataFrame([(1, "d", "net sales ROSE", 0), (2, "d", "sales in june rose to 5 net", 0), (3, "d", "qqq", 2), (4, "?", "sales of nets", 0), (5, "d", "zzz", 8)], "evidence_id long, doc string, text string, page int")
    got = {(r.evidence_id, r.chunk_id, r.method) for r in Q.match_evidence(ev, chunks).collect()}
    assert {g for g in got if g[0] in (1, 3, 4, 5)} == {(1, "c1", "exact_text"), (3, "c2", "page_fallback"), (4, "c3", "exact_text")}
    assert (2, "c1", "fuzzy_text") in got
    pages = spark.createDataFrame([("d", 1, "x"), ("d", 2, "Total net sales 1,200"), ("d", 3, "total net sales 1200")], "doc string, page int, text string")
    labels = spark.createDataFrame([(1, "d", "Total net sales", "$1,200"), (2, "d", "Costs", "7")], "id long, doc string, label string, value string")
    assert [(r.id, r.page) for r in Q.evidence_page(pages, labels).collect()] == [(1, 2)]
    m = Q.multimodal(spark.createDataFrame([("q", "t1", "s"), ("p", "t2", "z")], "query_id string, chunk_id string, source string"), spark.createDataFrame([("x2", "s", "text", 2), ("x1", "s", "text", 1), ("i", "s", "image", 3)], "chunk_id string, source string, modality string, ord int"))
    assert [tuple(r.chunk_ids) for r in m.collect()] == [("x1", "t1", "i")]


def unfiltered(evidence, chunks):
    """The matches without bounds, candidates or joins: every pair in full."""
    norm = lambda t: re.sub(r"[^a-z0-9$%.()\-]+", " ", (t or "").lower()).strip()
    docs = {d for _, d, *_ in chunks if d is not None}
    out = set()
    for eid, doc, text, page in evidence:
        needle, own = norm(text), [c for c in chunks if doc not in docs or c[1] == doc]
        exact = [(eid, c[0], "exact_text", 1.0) for c in own if needle and needle in norm(c[2])]
        fuzzy = []
        for c in own if needle and not exact else []:
            hay = norm(c[2])
            recall = len(set(needle.split()) & set(hay.split())) / len(set(needle.split()))
            ratio = Q._ratio(needle, hay)
            if recall >= 0.6 or ratio >= 0.18:
                fuzzy.append((-round(0.75 * recall + 0.25 * ratio, 6), c[0]))
        fuzzy = [(eid, i, "fuzzy_text", -s) for s, i in sorted(fuzzy)[:5]]
        pages = [(eid, c[0], "page_fallback", 1.0) for c in own if page is not None and c[3] is not None and c[3] <= page + 1 <= (c[3] if c[4] is None else c[4])]
        out |= set(exact or fuzzy or pages)
    return out


def test_evidence_matches_are_those_without_bounds(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("net", "sale", "cost", "total", "cash", "item") for b in ("", "s", "ing", "1", "$2")]
    text = lambda n: " ".join(rng.choices(words, k=n))
    chunks = [(i, rng.choice(["a", "b", "c", None]), text(rng.choice([3, 20, 60, 400])), rng.randrange(1, 6), rng.choice([None, 7])) for i in range(120)]
    chunks += [(200, "a", "long " * 4000 + "needle in the end", 1, 1), (201, "b", None, None, None), (202, "b", "", 9, 9), (203, "c", "?!", 2, 2)]
    evidence = [(0, "a", None, 3), (1, "b", "", 8), (2, "zz", "?!", 1), (3, None, "qqqq xxxx", 4), (4, "zz", "netting", None), (5, "a", "the needle long in end", 0)]
    for i in range(10, 50):
        source = rng.choice([c for c in chunks if c[0] < 120])[2].split()
        at = rng.randrange(max(1, len(source) - 6))
        part = source[at : at + rng.choice([2, 5, 12])]
        rng.random() < 0.6 and rng.shuffle(part)
        evidence.append((i, rng.choice(["a", "b", "zz", None]), " ".join([*part, *rng.choices(["zzz", "net"], k=rng.randrange(3))]), rng.randrange(5)))
    frames = spark.createDataFrame(evidence, "evidence_id long, doc string, text string, page int"), spark.createDataFrame(chunks, "chunk_id long, doc string, text string, page_start int, page_end int")
    got = {tuple(r) for r in Q.match_evidence(*frames).collect()}
    want = unfiltered(evidence, chunks)
    assert got == want and {m for _, _, m, _ in want} == {"exact_text", "fuzzy_text", "page_fallback"}
    assert Q.match_evidence(frames[0].limit(0), frames[1]).count() == 0 == Q.match_evidence(frames[0], frames[1].limit(0)).count()


def test_short_queries_are_looked_for_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha w{i} beta") for i in range(30)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"w{i}") for i in range(30)] + [(40, "alpha w3"), (41, "nothing")], "query_id long, text string")
    monkeypatch.setattr(vector, "BLOCK_BYTES", 400)
    assert {tuple(r) for r in qrels.exact_matches(asked, docs).collect()} == {(i, j) for i in range(30) for j in range(30) if f"w{i}" in f"w{j} "} | {(40, j) for j in range(30) if str(j).startswith("3")}
