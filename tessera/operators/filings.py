"""Rules for report chunks: roles, evidence types, topics, table quality, context lines, tables in HTML, weighted tag scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import basename, clean_text, years
from tessera.operators.tags import find_labels

#: Labels and their patterns, case-insensitive (fixed values).
METRICS = {
    "revenue": r"\brevenue\b", "net sales": r"\bnet sales\b", "operating income": r"\boperating income\b", "net income": r"\bnet income\b",
    "gross profit": r"\bgross profit\b", "gross margin": r"\bgross margin\b",
    "capital expenditure": r"\bcap(?:ital)? ex(?:penditure)?\b|\bcapital expenditures?\b|\bpurchases of property, plant and equipment\b",
    "property plant and equipment": r"\bproperty,?\s+plant\s+and\s+equipment\b|\bpp&e\b|\bppe\b",
    "total assets": r"\btotal assets\b", "liabilities": r"\bliabilities\b", "cash flow": r"\bcash flows?\b|\bcash flow statement\b",
    "free cash flow": r"\bfree cash flow\b", "dividend": r"\bdividends?\b", "eps": r"\beps\b|\bearnings per share\b",
}
SECTIONS = {
    "income statement": r"\bincome statement\b|\bstatement of operations\b", "balance sheet": r"\bbalance sheets?\b|\bfinancial position\b",
    "cash flow statement": r"\bcash flows?\b|\bcash flow statement\b", "legal proceedings": r"\blegal proceedings?\b",
    "md&a": r"\bmanagement'?s discussion and analysis\b|\bmd&a\b", "market risk": r"\bmarket risk\b", "financial statements": r"\bfinancial statements?\b",
    "corporate governance": r"\bcorporate governance\b", "forward-looking statements": r"\bforward-looking statements?\b", "risk factors": r"\brisk factors?\b",
    "part ii": r"\bpart ii\b", "part iii": r"\bpart iii\b", "part iv": r"\bpart iv\b", "segments": r"\bsegments?\b|\bsegment information\b",
}
TOPICS = {
    "capital investment": r"\bcapital expenditures?\b|\bpurchases of property, plant and equipment\b|\bcapital investment\b",
    "liquidity": r"\bliquidity\b|\bcash flows?\b|\bworking capital\b",
    "profitability": r"\boperating income\b|\bnet income\b|\bgross margin\b|\bgross profit\b",
    "sales performance": r"\brevenue\b|\bnet sales\b", "shareholder returns": r"\bdividends?\b|\bshare repurchases?\b|\bbuybacks?\b",
}
RISKS = {
    "market risk": r"\bmarket risk\b", "credit risk": r"\bcredit risk\b", "liquidity risk": r"\bliquidity risk\b",
    "cybersecurity risk": r"\bcybersecurity\b|\bcyber security\b", "legal risk": r"\blegal proceedings?\b|\blitigation\b",
}
BAD_TABLE = ("table of contents", "commission file", "exact name of registrant", "large accelerated filer", "securities registered pursuant", "state or other jurisdiction", "telephone number")
#: What tells front matter on the first three pages (fixed values).
FIRST_PAGES = ("table of contents", "commission file", "registrant")
GOOD_TABLE = ("net sales", "revenue", "gross margin", "operating", "income", "cash", "assets", "liabilities", "share", "tax", "expense", "balance sheet", "statements of operations", "cash flow")
#: Weights of the tag score's overlaps (fixed values): query field, chunk field, weight.
WEIGHTS = [("financial_metrics", "financial_metrics", 0.28), ("business_topics", "business_topics", 0.18), ("risk_topics", "risk_topics", 0.15), ("expected_sections", "section_tags", 0.18), ("retrieval_keywords", "retrieval_keywords", 0.12)]
METADATA_ROLES = ("cover_page", "table_of_contents", "signature", "exhibit_list", "metadata")
EVIDENCE_ROLES = ("section_content", "financial_statement", "footnote", "risk_factor", "mdna")


def _insensitive(patterns: dict[str, str]) -> dict[str, str]:
    return {k: f"(?i){p}" for k, p in patterns.items()}


#: Phrases and patterns by which a chunk's role is told (fixed patterns).
ROLE_PHRASES = {
    "signature": "signatures", "exhibits": "exhibit index", "contents": "table of contents", "form": "form 10-k", "file": "commission file number",
    "commission": "securities and exchange commission", "symbol": "trading symbol", "exchange": "nasdaq",
}
ROLE_PATTERNS = {
    "item": r"\bitem\s+\d+[a-z]?\b", "exhibit": r"\bexhibit\b", "part": r"\bpart\s+(?:i|ii|iii|iv)\b",
    "statement": r"\b(consolidated statement|balance sheet|statement of cash flows|statement of operations)\b", "risk": r"\brisk factors?\b",
    "note": r"\bnotes to consolidated financial statements\b|\bnote \d+\b",
}
#: Patterns by which the type of evidence is told (fixed patterns).
EVIDENCE_PATTERNS = {
    "number": r"[-(]?\$?\d[\d,]*(?:\.\d+)?%?\)?",
    "cue": r"\b(years ended|three months ended|six months ended|in millions|in thousands|assets|liabilities|net sales|total revenue)\b",
    "statement": r"\b(consolidated statement|balance sheet|cash flow statement|statement of cash flows)\b", "figure": r"\b(figure|chart|graph)\b",
}
#: Patterns of intents, in the order in which they are tried; a question about a metric comes before the last (fixed patterns).
INTENTS = {
    "calculate": r"\b(calculate|compute|how much|difference|change|growth|margin)\b", "compare": r"\b(compare|versus|vs\.?|between)\b",
    "explain": r"\b(explain|why|describe)\b", "summarize": r"\b(summarize|summary)\b", "extract_value": r"\b(what|which|show|find)\b",
}


def chunk_role(text: Column, page: Column) -> Column:
    """A chunk's role by ordered rules; page is a text and counts only where it is a number."""
    low, first = F.lower(F.coalesce(text, F.lit(""))), F.coalesce(page.try_cast("int") == 1, F.lit(False))
    hits = lambda p: F.regexp_count(low, F.lit(p))
    has = {name: low.contains(phrase) for name, phrase in ROLE_PHRASES.items()}
    items = hits(ROLE_PATTERNS["item"])
    rules = [
        (has["signature"], "signature"),
        (has["exhibits"] | (hits(ROLE_PATTERNS["exhibit"]) >= 4), "exhibit_list"),
        (has["contents"] | ((items >= 5) & (hits(ROLE_PATTERNS["part"]) >= 2)), "table_of_contents"),
        (first & has["form"] & has["file"], "cover_page"),
        (first & has["commission"] & (has["symbol"] | has["exchange"]), "cover_page"),
        (low.rlike(ROLE_PATTERNS["statement"]), "financial_statement"),
        (low.rlike(ROLE_PATTERNS["risk"]) & (items < 3), "risk_factor"),
        (low.rlike(SECTIONS["md&a"]), "mdna"),
        (low.rlike(ROLE_PATTERNS["note"]), "footnote"),
        (F.trim(low) != "", "section_content"),
    ]
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit("unknown"))


def evidence_type(text: Column, modality: Column, section: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    both = F.lower(F.concat_ws(" ", F.coalesce(section, F.lit("")), t))
    numbers = F.regexp_count(t, F.lit(EVIDENCE_PATTERNS["number"]))
    lines = F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""))
    cues = both.rlike(EVIDENCE_PATTERNS["cue"])
    return (
        F.when(F.lower(modality) == "table", "table").when(F.lower(modality) == "image", "figure")
        .when(both.rlike(EVIDENCE_PATTERNS["statement"]), "table")
        .when(cues & (numbers >= 8) & (lines >= 3), "table").when(both.rlike(EVIDENCE_PATTERNS["figure"]), "figure")
        .when(F.trim(t) != "", "text").otherwise("unknown")
    )


def intent(question: Column) -> Column:
    low = F.lower(question)
    rules = {name: low.rlike(pattern) for name, pattern in INTENTS.items()}
    rules["extract_value"] = low.rlike("|".join(METRICS.values())) | rules["extract_value"]
    return reduce(lambda rest, rule: F.when(rule[1], rule[0]).otherwise(rest), reversed(rules.items()), F.lit("unknown"))


def chunk_tags(chunks: DataFrame) -> DataFrame:
    """Adds chunk_role, flags, years, metrics, topics, risks, sections and evidence_type to chunks (text, page, modality, section)."""
    t = F.coalesce("text", F.lit(""))
    rows = chunks.withColumn("chunk_role", chunk_role(t, F.col("page").cast("string")))
    meta, nav = F.col("chunk_role").isin(*METADATA_ROLES), F.col("chunk_role").isin("table_of_contents", "exhibit_list")
    none = F.array().cast("array<string>")
    keep = lambda c: F.when(meta, none).otherwise(c)
    return rows.withColumns({
        "is_navigation_only": nav, "is_front_matter": F.col("chunk_role").isin("cover_page", "table_of_contents", "signature", "metadata"),
        "years": F.when(F.col("chunk_role") == "cover_page", none).otherwise(years(t)), "financial_metrics": keep(find_labels(t, _insensitive(METRICS))),
        "business_topics": keep(find_labels(t, _insensitive(TOPICS))), "risk_topics": keep(find_labels(t, _insensitive(RISKS))),
        "section_tags": find_labels(t, _insensitive(SECTIONS)), "evidence_type": F.when(meta, "metadata").otherwise(evidence_type(t, F.col("modality"), F.col("section"))),
    })


def tag_score(query: str, chunk: str) -> Column:
    """The weighted score of two structs of tags, 0 to 1; chunks of metadata roles have 0."""

    def share(a: str, b: str) -> Column:
        norm = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
        q, c = norm(F.col(f"{query}.{a}")), norm(F.col(f"{chunk}.{b}"))
        return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, c)) / F.greatest(F.size(q), F.lit(1)))

    role, kind, need = F.lower(f"{chunk}.chunk_role"), F.lower(f"{chunk}.evidence_type"), F.lower(f"{query}.evidence_type_needed")
    score = reduce(lambda a, b: a + b, (w * share(q, c) for q, c, w in WEIGHTS))
    bonus = lambda when, x: F.when(when, x).otherwise(0.0)
    score = score + bonus(share("companies", "companies") > 0, 0.08) + bonus(share("years", "years") > 0, 0.06)
    score = score + F.when((need == kind) & (need != "unknown"), 0.08).when((need == "table") & (kind == "mixed"), 0.06).otherwise(0.0)
    values = F.lower(f"{query}.intent").isin("calculate", "extract_value")
    score = score + bonus(values & kind.isin("table", "mixed"), 0.08) + bonus(values & (share("financial_metrics", "financial_metrics") > 0), 0.08) + bonus(role.isin(*EVIDENCE_ROLES), 0.05)
    score = score * F.when(F.col(f"{chunk}.is_navigation_only"), 0.25).otherwise(1.0)
    return F.when(role.isin(*METADATA_ROLES), 0.0).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def bad_table(summary: Column, page: Column | None = None) -> Column:
    """Front matter: one of the phrases anywhere, or one of those of the first three pages there."""
    low = F.lower(clean_text(F.coalesce(summary, F.lit(""))))
    has = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    early = F.lit(False) if page is None else F.coalesce(page.isin(1, 2, 3), F.lit(False))
    return (early & has(FIRST_PAGES)) | has(BAD_TABLE)


def good_table(summary: Column, modality: Column, page: Column | None = None) -> Column:
    low = F.lower(clean_text(F.coalesce(summary, F.lit(""))))
    return (modality == "table") & ~bad_table(summary, page) & reduce(lambda a, b: a | b, (low.contains(w) for w in GOOD_TABLE))


def meaningful_table(text: Column) -> Column:
    """At least 20 digits and 20 words."""
    return (F.regexp_count(text, F.lit("[0-9]")) >= 20) & (F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")) >= 20)


def reasonable_image(width: Column, height: Column, scanned: bool = False) -> Column:
    w, h, area = (80, 60, 8_000) if scanned else (200, 120, 100_000)
    return (width >= w) & (height >= h) & (width * height >= area)


def visual_kind(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.contains("bar chart"), "bar chart").when(low.rlike("line chart|line graph|multiple lines"), "line chart").when(low.contains("pie chart"), "pie chart")
        .when(low.contains("table"), "table-like chart").when(low.contains("chart"), "chart").when(low.contains("logo"), "logo").otherwise("image")
    )


def embed_text(companies: dict[str, str] | None = None) -> Column:
    """Context lines and content of a chunk (source_pdf, page, modality, text, summary, table_markdown, key_values), by modality."""
    name = basename(F.col("source_pdf"))
    ticker = F.split_part(name, F.lit("_"), F.lit(1))
    form = F.when(F.split_part(name, F.lit("_"), F.lit(2)) == "DEF", "DEF 14A proxy statement").otherwise(F.split_part(name, F.lit("_"), F.lit(2)))
    company = F.coalesce(F.create_map(*(F.lit(x) for kv in companies.items() for x in kv))[ticker], ticker) if companies else ticker
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    head = [line("Company", company), line("Ticker", ticker), line("Filing type", form), line("Source filing", name), line("Page", F.col("page").cast("string")), line("Modality", F.col("modality"))]
    summary = clean_text(F.coalesce(filled("summary"), filled("text"), F.lit("")))
    table = [F.concat(F.lit("Table summary: "), clean_text(F.coalesce("summary", F.lit("")))), line("Table markdown", clean_text(F.col("table_markdown")))]
    image = [line("Visual type", visual_kind(summary)), line("Visible labels and values", F.array_join("key_values", ", ")), F.concat(F.lit("Image summary: "), summary)]
    text = [F.concat(F.lit("Passage: "), clean_text(F.coalesce(filled("text"), filled("summary"), F.lit(""))))]
    return F.when(F.col("modality") == "table", F.concat_ws("\n", *head, *table)).when(F.col("modality") == "image", F.concat_ws("\n", *head, *image)).otherwise(F.concat_ws("\n", *head, *text))


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.depth, self.cell = 0, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.depth += 1
            self.tables.append([])
        elif self.depth and tag == "tr":
            self.tables[-1].append([])
        elif self.depth and tag in ("td", "th"):
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
        elif tag in ("td", "th") and self.cell is not None:
            text = " ".join("".join(self.cell).split())
            if text and text not in ("$", "(", ")"):
                self.tables[-1][-1].append(text)
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def html_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, table_index, row_index, cells) of every table row with cells; blanks, $ and single brackets are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch[html], strict=True):
                parser = _Tables()
                parser.feed(text or "")
                out += [(k, t, r, cells) for t, table in enumerate(parser.tables) for r, cells in enumerate(table) if cells]
            yield pd.DataFrame(out, columns=[key, "table_index", "row_index", "cells"])

    return pages.select(key, html).where(F.lower(html).contains("<table")).mapInPandas(run, f"{key} long, table_index int, row_index int, cells array<string>")


def table_values(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, table_index, label, column, value): a row's label with its first number, under the header at its right-aligned place.

    The header is a table's first row without numbers in all but its first cell.
    """
    number = r"^[-(]?\$?\s*[0-9][0-9,]*(\.[0-9]+)?%?\)?$"
    numeric = F.filter(F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))), lambda c: c.rlike(number))
    marked = rows.withColumn("numbers", numeric)
    header = marked.where("size(numbers) = 0 AND size(cells) > 0").groupBy(key, "table_index").agg(F.min_by("cells", "row_index").alias("header"))
    body = marked.where("size(numbers) > 0").join(header, [key, "table_index"], "left")
    at = F.size("header") - F.size("numbers") + 1
    return body.select(key, "table_index", F.element_at("cells", 1).alias("label"), F.when(at >= 1, F.try_element_at("header", F.greatest(at, F.lit(1)))).alias("column"), F.element_at("numbers", 1).alias("value"))
