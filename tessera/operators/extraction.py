"""Triples from passages: canonical relations, grounding, focus passages, change sentences, negatives."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WS = r"[ \t\n\r\f\x0B]+"

#: Relation names as written and as they are kept (fixed values).
CANONICAL = {
    "located in": "located_in", "is located in": "located_in", "headquartered in": "located_in",
    "has trading symbol": "has_ticker", "trading symbol": "has_ticker", "ticker": "has_ticker",
    "is listed on": "listed_on", "listed on": "listed_on", "is registered with": "listed_on", "registered with": "listed_on",
    "files": "files_report", "filed": "files_report", "filed form": "files_report",
    "has address": "has_address", "address": "has_address", "has phone": "has_phone",
    "offers": "offers", "owns": "owns", "acquired": "acquired", "partnered with": "partnered_with", "partners with": "partnered_with",
    "is": "is", "registered": "listed_on",
    "has_a_telephone_number": "has_phone", "has_telephone_number": "has_phone",
    "has_a_principal_executive_office_at": "has_address", "principal_executive_office": "has_address",
    "has_filed_all_reports": "files_report", "has_submitted_electronically_every_interactive_data_file": "files_report",
    "has_filed_a_report_on_and_attestation_to_its_managements_assessment_of_the_effectiveness_of_its_internal_control_over_financial_reporting": "files_report",
    "is_a_large_accelerated_filer": "filer_status", "is_a_shell_company": "shell_company_status",
    "increased": "increased", "increase": "increased", "grew": "increased", "rose": "increased", "expanded": "increased",
    "decreased": "decreased", "decrease": "decreased", "declined": "decreased", "fell": "decreased", "reduced": "decreased", "dropped": "decreased",
    "improved": "improved", "worsened": "worsened", "reported": "reported", "recorded": "reported", "generated": "generated", "incurred": "incurred",
    "guidance_for": "guidance_for", "expects": "expects", "projects": "projects",
    "filed_form": "files_report", "filed_with": "files_report", "merged_with": "merged_with", "invested_in": "invested_in",
}
#: Substring rules for other names, the first that fits (fixed values, in their order).
CONTAINS = [
    (("telephone", "phone"), "has_phone"), (("address", "office"), "has_address"), (("filed", "report"), "files_report"),
    (("registered", "listed", "exchange"), "listed_on"), (("increase", "grew", "rose", "expanded"), "increased"),
    (("decrease", "declined", "fell", "reduced", "dropped"), "decreased"), (("improved",), "improved"), (("worsened",), "worsened"),
    (("reported", "recorded"), "reported"), (("guidance",), "guidance_for"), (("expects", "expect"), "expects"), (("projects", "projected"), "projects"),
]
#: Relations that edges may have by default (fixed values).
WHITELIST = [
    "is_mentioned_in", "equivalent", "has_ticker", "listed_on", "files_report", "located_in", "has_address", "has_phone", "acquired",
    "partnered_with", "offers", "owns", "is", "increased", "decreased", "improved", "worsened", "reported", "generated", "incurred",
    "guidance_for", "expects", "projects", "merged_with", "invested_in",
]
#: Words of change and the relation they state, in the order they are looked for (fixed values).
CHANGES = {
    "increased": "increased", "increase": "increased", "grew": "increased", "rose": "increased", "expanded": "increased",
    "decreased": "decreased", "decrease": "decreased", "declined": "decreased", "fell": "decreased", "reduced": "decreased", "dropped": "decreased",
    "improved": "improved", "worsened": "worsened",
}
#: Longest canonical name; longer ones become related_to (fixed value).
LONGEST = 36


def canonical_relation(name: Column) -> Column:
    """The kept name of a relation: by table, else by substring, else its words joined by underscores."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), _WS, " "), r"(?U)[^\w\s_]", "")
    bare = F.when(bare.startswith("has_"), F.replace(bare, F.lit("_"), F.lit(" "))).otherwise(bare)
    table = F.create_map(*map(F.lit, chain.from_iterable(CANONICAL.items())))

    def kept(b: Column) -> Column:
        joined = F.replace(b, F.lit(" "), F.lit("_"))
        fallback = F.when((F.length(joined) > LONGEST) | (joined == ""), "related_to").otherwise(joined)
        by_part = reduce(lambda rest, rule: F.when(reduce(lambda x, y: x | y, (b.contains(w) for w in rule[0])), rule[1]).otherwise(rest), reversed(CONTAINS), fallback)
        return F.coalesce(table[b], by_part)

    # as a lambda's variable the cleaned name is computed once and not copied into every rule
    return F.element_at(F.transform(F.array(bare), kept), 1)


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), _WS, " ")


def in_passage(phrase: Column, passage: Column) -> Column:
    """Whether the passage has the phrase, as it is or with punctuation dropped from both; an empty phrase: no."""
    p, low = squeezed(phrase), F.lower(passage)
    bare = lambda c: F.regexp_replace(c, r"(?U)[^\w\s]", "")
    return (p != "") & (low.contains(p) | bare(low).contains(bare(p)))


def grounded(rows: DataFrame, triples: str = "triples", entities: str = "entities", passage: str = "passage", key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(clean, noisy) triples of rows: clean (key, ord, s, r, o), the first of each; noisy (key, ord, triple, reason)."""
    names = F.transform(F.col(entities), squeezed)
    each = rows.select(key, F.col(passage).alias("p"), names.alias("names"), F.posexplode(triples).alias("ord", "triple"))
    part = lambda i: F.trim(F.try_element_at("triple", F.lit(i)))
    each = each.withColumns({"s": part(1), "raw": part(2), "o": part(3)})
    each = each.withColumn("r", canonical_relation(F.col("raw")))
    reason = (
        F.when(F.size("triple") != 3, "invalid_triple_shape")
        .when((F.col("s") == "") | (F.col("raw") == "") | (F.col("o") == ""), "empty_element")
        .when(~(in_passage(F.col("s"), F.col("p")) & in_passage(F.col("o"), F.col("p"))), "entity_not_grounded_in_passage")
        .when(~(F.array_contains("names", squeezed(F.col("s"))) | F.array_contains("names", squeezed(F.col("o")))), "neither_subject_nor_object_in_ner_entities")
    )
    each = each.withColumn("reason", reason)
    first = Window.partitionBy(key, squeezed(F.col("s")), "r", squeezed(F.col("o"))).orderBy("ord")
    clean = each.where("reason IS NULL").withColumn("k", F.row_number().over(first)).where("k = 1").select(key, "ord", "s", "r", "o")
    return clean, each.where("reason IS NOT NULL").select(key, "ord", "triple", "reason")


def focus_passage(text: Column, keywords: list[str], most: int = 6000, lead: int = 12) -> Column:
    """A long text's sentences with a keyword and their neighbours (overlaps repeat), else its first `lead`, cut to `most`.

    Texts are split once: the sentences are the variable of a lambda, as an expression within one is evaluated again for each
    of its elements.
    """
    once = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    hit = lambda x: F.lower(x).rlike("|".join(keywords))

    def picked(s: Column) -> Column:
        around = lambda i: F.array_join(F.slice(s, F.greatest(i, F.lit(1)).cast("int"), (F.lit(3) - F.when(i == 0, 1).otherwise(0)).cast("int")), " ")
        blocks = F.filter(F.transform(s, lambda x, i: F.when(hit(x), around(i))), lambda b: b.isNotNull())
        return once(blocks, lambda found: F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(F.array_join(F.slice(s, 1, lead), " ")))

    def cut(raw: Column) -> Column:
        long_ = once(F.split(raw, r"(?<=[.!?]) +"), lambda s: F.when(F.size(s) <= 1, raw).otherwise(picked(s)))
        return F.when(F.length(raw) <= most, raw).otherwise(F.substring(long_, 1, most))

    return once(F.trim(F.regexp_replace(text, _WS, " ")), cut)


def change_triples(rows: DataFrame, key: str = "chunk_id", passage: str = "passage", entities: str = "entities") -> DataFrame:
    """(key, ord, s, r, o): a triple for each sentence with a word of change; its longest entity, else the row's longest."""
    raw = F.trim(F.regexp_replace(F.col(passage), _WS, " "))
    names = F.filter(F.transform(entities, lambda e: F.trim(e)), lambda e: e != "")
    order = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(F.when(F.array_position("names", a) < F.array_position("names", b), -1).otherwise(1))
    rows = rows.select(key, names.alias("names"), F.posexplode(F.split(raw, r"(?<=[.!?]) +")).alias("ord", "sentence"))
    rows = rows.withColumn("sorted", F.array_sort("names", order))
    low = F.lower("sentence")
    relation = reduce(lambda rest, w: F.when(low.rlike(rf"\b{w}\b"), CHANGES[w]).otherwise(rest), reversed(list(CHANGES)), F.lit(None).cast("string"))
    subject = F.coalesce(F.try_element_at(F.filter("sorted", lambda e: low.contains(F.lower(e))), F.lit(1)), F.try_element_at(F.col("sorted"), F.lit(1)))
    cut = F.when(F.length("sentence") > 240, F.concat(F.substring("sentence", 1, 237), F.lit("..."))).otherwise(F.col("sentence"))
    return rows.select(key, "ord", subject.alias("s"), relation.alias("r"), cut.alias("o")).where("r IS NOT NULL AND s IS NOT NULL")


def mostly_numeric(text: Column) -> Column:
    """At least 60 % digits once spaces and the signs of amounts are gone."""
    bare = F.regexp_replace(text, r"[\s,.$()%:-]", "")
    return (F.length(bare) > 0) & (F.length(F.regexp_replace(bare, "[^0-9]", "")) >= 0.6 * F.length(bare))


def negatives(edges: DataFrame, nodes: DataFrame, per_edge: int, seed: int) -> DataFrame:
    """(u, v, r, nu, nv): per_edge corrupted edges for each edge, tails for the first half and heads for the rest.

    Nodes have dense ids 0 .. n-1. A draw is a hash of the edge, its number and the seed, so it needs no shuffle; draws
    that are edges themselves go, by an anti-join.
    """
    n = nodes.count()
    half = per_edge // 2
    each = edges.select("u", "v", "r", F.explode(F.sequence(F.lit(0), F.lit(per_edge - 1))).alias("k"))
    drawn = F.pmod(F.xxhash64("u", "v", "r", "k", F.lit(seed)), F.lit(n))
    each = each.select("u", "v", "r", F.when(F.col("k") < half, F.col("u")).otherwise(drawn).alias("nu"), F.when(F.col("k") < half, drawn).otherwise(F.col("v")).alias("nv"))
    known = edges.select(F.col("u").alias("nu"), F.col("v").alias("nv"), "r").distinct()
    return each.join(known, ["nu", "nv", "r"], "left_anti").select("u", "v", "r", "nu", "nv")
