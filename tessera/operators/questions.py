"""Questions with known answers from reports, and evidence matched to chunks for external benchmarks."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import clean_text, normalize_evidence
from tessera.operators.qrels import exact_matches
from tessera.operators.vector import BLOCK_BYTES, query_blocks
from tessera.session import written

#: Fields of a cover page and how they are captured (fixed patterns).
COVER = {
    "period": [r"(?i)For the (?:quarterly )?period ended\s+([A-Z][a-z]+ \d{1,2}, \d{4})", r"(?i)For the fiscal year ended\s+([A-Z][a-z]+ \d{1,2}, \d{4})"],
    "report_date": [r"(?i)Date of Report .*?\):\s*([A-Za-z]+ \d{1,2}, \d{4})"],
    "commission": [r"(?i)Commission File Number[: ]+([0-9-]+)"],
    "phone": [r"(\([0-9]{3}\) [0-9]{3}-[0-9]{4})"],
    "exchange": [r"(?i)Common Stock.*?\b[A-Z]{1,5}\b\s+(The [A-Za-z ]+ Stock Market LLC|New York Stock Exchange)"],
}
#: What a table's context adds to a row's name: the context's words, unless the row has them (fixed values, in order).
SUFFIXES = [("gross margin", "gross margin"), ("net sales", "net sales"), ("revenue", "revenue"), ("cash flow", "cash flow")]
#: Gates and weights of the fuzzy match (fixed values).
RECALL_GATE, RATIO_GATE, RECALL_WEIGHT, RATIO_WEIGHT, MOST_FUZZY, WINDOW_CHARS = 0.6, 0.18, 0.75, 0.25, 5, 12_000


def first_capture(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches, cleaned; else null."""
    return F.coalesce(*(F.nullif(clean_text(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns))


def cover_fields(text: Column) -> list[Column]:
    """A column for each field of COVER."""
    return [first_capture(text, p).alias(name) for name, p in COVER.items()]


def answer_type(answer: Column) -> Column:
    whole = lambda p: answer.rlike(f"^(?:{p})$")
    digit = answer.rlike("[0-9]")
    return (
        F.when(answer.rlike("[A-Za-z]") & digit & ~whole(r"[$()%,.\d\s-]+"), "text").when(whole(r"\d{4}-\d{2}-\d{2}"), "date")
        .when(answer.contains("%") | F.lower(answer).contains("percent"), "percentage").when(digit, "number").otherwise("text")
    )


def unit_for(answer: Column, evidence: Column) -> Column:
    low, percent = F.lower(evidence), answer.contains("%")
    plain = ~answer.contains(",") & F.trim(answer).rlike(r"^\(?-?\d+(?:\.\d+)?%?\)?$")
    return (
        F.when((percent | low.contains("percent")) & plain, "%").when(low.contains("shares") & ~low.contains("number of shares"), "shares")
        .when(evidence.contains("$") | low.contains("million"), "million").when(low.contains("in thousands"), "thousand")
        .when(percent, "%").when(answer_type(answer) == "date", "date").otherwise("")
    )


def natural_metric(row: Column, context: Column, answer: Column) -> Column:
    """A row's name with what its table's context says it measures."""
    r, low, name = clean_text(row), F.lower(clean_text(row)), F.lower(context)
    rules = [(answer.contains("%") & name.contains("gross margin percentage") & ~low.contains("percentage"), F.concat(r, F.lit(" gross margin percentage")))]
    rules += [(name.contains(word) & ~low.contains(word), F.concat(r, F.lit(f" {added}"))) for word, added in SUFFIXES]
    rules += [(name.contains("balance sheet") & ~low.isin("assets", "liabilities"), r), (name.contains("fees billed") & ~low.contains("fees"), F.concat(r, F.lit(" fees")))]
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), r)


def natural_question(question: Column, company: Column, evidence: Column, answer: Column) -> Column:
    """A generated question about a table cell in plain words; other questions as they are."""
    q = clean_text(question)
    context = F.regexp_extract(evidence, r"(?i)Table context:\s*(.*?)\.\s*HTML table row:", 1)
    dated, short = r"(?i)For (.*?)'s filing period ended (.*?), what value is reported for (.*?) under (.*?)\?$", r"(?i)what value does (.*?) report for (.*?) under (.*?)\?$"
    part = lambda p, i: clean_text(F.regexp_extract(q, p, i))
    a = F.concat(F.lit("What was "), company, F.lit("'s "), natural_metric(part(short, 2), context, answer), F.lit(" for "), part(short, 3), F.lit("?"))
    b = F.concat(F.lit("For the period ended "), part(dated, 2), F.lit(", what was "), company, F.lit("'s "), natural_metric(part(dated, 3), context, answer), F.lit(" for "), part(dated, 4), F.lit("?"))
    return F.when(q.rlike(short), a).when(q.rlike(dated), b).otherwise(q)


def unnatural(question: Column) -> Column:
    """Mechanical fragments that make no question."""
    return question.rlike(r"(?i)\$\d|\bbillion\b|compared to|fiscal 20\d{2}")


def text_question(text: Column, company: Column) -> Column:
    """The question that a passage answers, by ordered topics; null if it has none."""
    low = F.lower(clean_text(text))
    has = low.contains
    moved = has("increased") | has("decreased")
    ask = lambda before, after: F.concat(F.lit(before), company, F.lit(after))
    return (
        F.when(has("net sales") & moved, ask("What does ", " say drove the change in net sales?"))
        .when(has("revenue") & moved, ask("What does ", " say about revenue performance in this filing?"))
        .when(has("gross margin"), ask("What does ", " explain about gross margin in this filing?"))
        .when(low.rlike(r"\b(liquidity|cash|cash equivalents)\b"), ask("What does ", " disclose about cash or liquidity?"))
        .when(has("risk") & (F.size(F.split(low, " ")) > 100), ask("What risk factor does ", " discuss in this section?"))
        .when(has("segment") & (has("sales") | has("operating")), ask("What does ", " disclose about segment performance?"))
    )


def checked_box(text: Column) -> Column:
    """Which report box is ticked on a cover page, or null."""
    return F.when(text.contains("☒ QUARTERLY REPORT"), "Quarterly report").when(text.contains("☒ ANNUAL REPORT"), "Annual report")


def evidence_page(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, page): the first page of a label's document that has its value and its first two words.

    pages: (doc, page, text); labels: (id, doc, label, value).
    """
    bare = lambda c: F.regexp_replace(c, "[,$()]", "")
    words = F.slice(F.transform(F.regexp_extract_all("label", F.lit("[A-Za-z][A-Za-z]+"), F.lit(0)), lambda w: F.lower(w)), 1, 2)
    joined = labels.select("id", "doc", words.alias("w"), bare(F.col("value")).alias("v")).join(pages, "doc")
    ok = ((F.col("v") == "") | bare(F.col("text")).contains(F.col("v"))) & (F.size("w") > 0) & F.forall("w", lambda w: F.lower("text").contains(w))
    return joined.where(ok).groupBy("id").agg(F.min("page").alias("page"))


def multimodal(table_queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_ids): each table question with its chunk and its source's first text and first image chunk.

    table_queries: (query_id, chunk_id, source); chunks: (chunk_id, source, modality, ord). Sources that lack one go.
    """
    first = chunks.where(F.col("modality").isin("text", "image")).groupBy("source", "modality").agg(F.min_by("chunk_id", "ord").alias("c"))
    text, image = (first.where(F.col("modality") == m).select("source", F.col("c").alias(m)) for m in ("text", "image"))
    return table_queries.join(text, "source").join(image, "source").select("query_id", F.array("text", "chunk_id", "image").alias("chunk_ids"))


def _ratio(needle: str, hay: str) -> float:
    if not needle or not hay:
        return 0.0
    if len(hay) > WINDOW_CHARS:
        tokens = sorted(set(needle.split()), key=len, reverse=True)
        at = next((p for t in tokens if (p := hay.find(t)) >= 0), 0)
        start = max(0, at - WINDOW_CHARS // 3)
        hay = hay[start : start + WINDOW_CHARS]
    return SequenceMatcher(None, needle, hay).ratio()


def with_ratio(rows: DataFrame, needle: str, hay: str, out: str = "ratio") -> DataFrame:
    """Adds the similarity ratio of two normalised texts, the second one in a window around the first's longest token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[out] = [_ratio(a or "", b or "") for a, b in zip(batch[needle], batch[hay], strict=True)]
            yield batch

    return rows.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"{out} double"]))


#: Characters of normalised texts.
_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789$%.()- "


def _sized(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds what the bounds need of a normalised text: its length, how often it has each character, its distinct words."""
    counts = F.array(*(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in _CHARACTERS))
    return rows.withColumns({f"{name}_chars": F.length(text), f"{name}_counts": counts, f"{name}_words": F.array_distinct(F.split(text, " "))})


def _bounds() -> tuple[Column, Column]:
    """Of a pair of sized needle and hay: the token recall, and what the similarity ratio can't exceed.

    No more characters can match than both have; a window of a long hay holds at least a third of WINDOW_CHARS.
    """
    recall = F.size(F.array_intersect("needle_words", "hay_words")) / F.size("needle_words")
    common = F.aggregate(F.zip_with("needle_counts", "hay_counts", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    least = F.when(F.col("hay_chars") > WINDOW_CHARS, F.lit(WINDOW_CHARS // 3)).otherwise(F.col("hay_chars"))
    most = F.least(F.lit(1.0), 2 * common / (F.col("needle_chars") + least))
    return recall, most


def _scored(pairs: DataFrame) -> DataFrame:
    """(evidence_id, chunk_id, score) of sized pairs that pass a gate; only those that may pass are compared in full."""
    recall, most = _bounds()
    open_ = pairs.where("needle <> ''").withColumns({"recall": recall, "most": most}).where((F.col("recall") >= RECALL_GATE) | (F.col("most") >= RATIO_GATE))
    scored = with_ratio(open_.select("evidence_id", "chunk_id", "needle", "hay", "recall"), "needle", "hay")
    scored = scored.where((F.col("recall") >= RECALL_GATE) | (F.col("ratio") >= RATIO_GATE))
    return scored.select("evidence_id", "chunk_id", F.round(RECALL_WEIGHT * F.col("recall") + RATIO_WEIGHT * F.col("ratio"), 6).alias("score"))


def _best(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("evidence_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= MOST_FUZZY)


def _anywhere(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """The best fuzzy matches of sized evidence among all sized chunks.

    Chunks with enough of the words share one of the evidence's rarest ones (all but as many as may be missing, and one).
    If those give enough matches that score above what a chunk with fewer words can reach, they are the answer. The other
    evidence is held against all chunks, in blocks that are broadcast, by the bounds first.
    """
    words = written(chunks.select("chunk_id", F.explode("hay_words").alias("word")).join(evidence.select(F.explode("needle_words").alias("word")).distinct(), "word", "left_semi"), "words")
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    own = evidence.select("evidence_id", F.size("needle_words").alias("n"), F.explode("needle_words").alias("word")).join(df, "word", "left")
    order = Window.partitionBy("evidence_id").orderBy(F.coalesce("df", F.lit(0)), "word")
    rare = own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * RECALL_GATE) + 1)
    pairs = rare.select("evidence_id", "word").join(words, "word").select("evidence_id", "chunk_id").distinct()
    many = pairs.join(evidence, "evidence_id").join(chunks, "chunk_id").where(_bounds()[0] >= RECALL_GATE)
    first = written(_best(_scored(many)), "likely")
    enough = first.where((F.col("r") == MOST_FUZZY) & (F.col("score") >= RECALL_WEIGHT * RECALL_GATE + RATIO_WEIGHT)).select("evidence_id")
    out = first.join(enough, "evidence_id", "left_semi")
    left = written(evidence.join(enough, "evidence_id", "left_anti"), "open")
    recall, most = _bounds()
    for block in query_blocks(left, ["evidence_id"], "needle_counts", BLOCK_BYTES // 16):
        met = chunks.join(F.broadcast(block), (recall >= RECALL_GATE) | (most >= RATIO_GATE))
        out = out.union(_best(_scored(met)).select(out.columns))
    return out


def match_evidence(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(evidence_id, chunk_id, method, score): exact matches, else the five best fuzzy ones, else those on the page.

    evidence: (evidence_id, doc, text, page from 0); chunks: (chunk_id, doc, text, page_start, page_end). Evidence of a
    document that has no chunks, or of none, is held against all chunks. Fuzzy matches have RECALL_GATE of the evidence's
    words or a similarity ratio of RATIO_GATE; ties go to the smaller chunk id. Texts without letters, digits or the marks
    that are kept match by page alone; nulls in pages match nothing. ids tell rows apart.
    """
    known = chunks.select("doc").where("doc IS NOT NULL").distinct().withColumn("known", F.lit(True))
    e = evidence.join(known, "doc", "left").select("evidence_id", "doc", "known", (F.col("page") + 1).cast("int").alias("page"), normalize_evidence(F.col("text"), comma=False).alias("needle"))
    e = written(_sized(e, "needle", "needle"), "evidence")
    c = chunks.select("chunk_id", F.col("doc").alias("cdoc"), normalize_evidence(F.col("text"), comma=False).alias("hay"), F.col("page_start").try_cast("int").alias("a"), F.col("page_end").try_cast("int").alias("b"))
    c = written(_sized(c, "hay", "hay"), "chunks")
    within = e.where("known").join(c, F.col("doc") == F.col("cdoc"))
    lost = e.where("known IS NULL")

    texts = lost.where("needle <> ''").select(F.col("evidence_id").alias("query_id"), F.col("needle").alias("text"))
    held = exact_matches(texts, c.select(F.col("chunk_id").alias("doc_id"), F.col("hay").alias("text"))).toDF("evidence_id", "chunk_id")
    exact = written(within.where((F.col("needle") != "") & F.col("hay").contains(F.col("needle"))).select("evidence_id", "chunk_id").union(held), "exact")
    done = exact.select("evidence_id").distinct()
    fuzzy = _best(_scored(within.join(done, "evidence_id", "left_anti"))).select("evidence_id", "chunk_id", "score")
    open_ = written(lost.where("needle <> ''").join(done, "evidence_id", "left_anti"), "open")
    if not open_.isEmpty():
        fuzzy = fuzzy.union(_anywhere(open_, c).select("evidence_id", "chunk_id", "score"))
    fuzzy = written(fuzzy, "fuzzy")
    rest = e.join(done.union(fuzzy.select("evidence_id")).distinct(), "evidence_id", "left_anti").where("page IS NOT NULL").select("evidence_id", "doc", "known", "page")
    pages = c.where("a IS NOT NULL").select("chunk_id", "cdoc", F.explode(F.when(F.coalesce("b", "a") >= F.col("a"), F.sequence("a", F.coalesce("b", "a")))).alias("page"))
    page = rest.join(pages, "page").where("known IS NULL OR doc = cdoc").select("evidence_id", "chunk_id", F.lit("page_fallback").alias("method"), F.lit(1.0).alias("score"))
    return exact.select("evidence_id", "chunk_id", F.lit("exact_text").alias("method"), F.lit(1.0).alias("score")).union(fuzzy.select("evidence_id", "chunk_id", F.lit("fuzzy_text").alias("method"), "score")).union(page)
