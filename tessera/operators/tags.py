"""Semantic tags: rule taggers, overlap, normalisation and audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import tag_key

#: The tag fields, in order (fixed values).
FIELDS = ["named_entities", "dates", "industries", "domains", "sectors", "organizations", "partnerships", "partners", "dividends", "products", "locations"]
#: Fields by which rows are filtered (fixed values).
FILTER_FIELDS = ["named_entities", "dates", "organizations", "products", "locations"]

DATE_LIKE = r"(?i)\b(19|20)\d{2}\b|\b(january|february|march|april|may|june|july|august|september|october|november|december)\b"
FORM_LIKE = r"(?i)\b(10-k|10-q|8-k|form|act of)\b"
ORG_LIKE = r"(?i)\b(inc|corp|ltd|llc|company)\b"


def keys_of(tags: Column) -> Column:
    """Normalised keys of a tag array, without empty ones."""
    return F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), tag_key), lambda k: k != "")


def overlap(query: Column, chunk: Column) -> Column:
    """The query's tags, as written there, of which the chunk has the key."""
    have = keys_of(chunk)
    return F.filter(F.coalesce(query, F.array().cast("array<string>")), lambda t: (tag_key(t) != "") & F.array_contains(have, tag_key(t)))


def overlap_count(pairs: list[tuple[Column, Column]]) -> Column:
    """Shared keys summed over (query, chunk) tag arrays."""
    return reduce(lambda a, b: a + b, (F.size(F.array_intersect(keys_of(q), keys_of(c))) for q, c in pairs))


def find_labels(text: Column, patterns: dict[str, str]) -> Column:
    """The labels whose pattern the text has, in order."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(label)) for label, p in patterns.items())), lambda x: x.isNotNull())


def first_label(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first rule whose pattern the text has."""
    out = F.lit(default)
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def cleaned(tags: Column) -> Column:
    """Trimmed tags, the first of each lower-cased form, without placeholders."""
    t = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & ~F.lower(x).isin("", "n/a", "none", "null", "unknown"))
    lower = F.transform(t, lambda x: F.lower(x))
    return F.transform(F.filter(F.arrays_zip(t.alias("t"), F.transform(lower, lambda x: F.array_position(lower, x)).alias("p"), F.sequence(F.lit(1), F.greatest(F.size(t), F.lit(1))).alias("i")), lambda s: s["t"].isNotNull() & (s["p"] == s["i"])), lambda s: s["t"])


def long_form(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, tags): a row for each field."""
    return rows.select(key, F.explode(F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f))))).alias("field", "tags"))


def suspicious(field: Column, tag: Column) -> Column:
    """Why a tag looks misplaced, or null."""
    return (
        F.when((field != "dates") & tag.rlike(DATE_LIKE), "date_outside_dates")
        .when(field.isin("organizations") & tag.rlike(FORM_LIKE), "form_in_organizations")
        .when(~field.isin("organizations", "named_entities", "partners", "partnerships") & tag.rlike(ORG_LIKE), "organization_outside")
    )


def audit(rows: DataFrame, key: str, fields: list[str], top: int = 25) -> tuple[DataFrame, DataFrame]:
    """(rates, values): per field the share of rows with tags, tags, and suspicious ones; and its most common values."""
    from pyspark.sql import Window

    long_ = long_form(rows, key, fields)
    items = long_.select(key, "field", F.explode_outer("tags").alias("tag"))
    rates = items.groupBy("field").agg(F.count_distinct(key).alias("rows"), F.count_distinct(F.when(F.col("tag").isNotNull(), F.col(key))).alias("filled"), F.count("tag").alias("tags"), F.count_if(suspicious(F.col("field"), F.col("tag")).isNotNull()).alias("suspicious"))
    rates = rates.withColumn("rate", F.col("filled") / F.col("rows"))
    counts = items.where("tag IS NOT NULL").groupBy("field", "tag").agg(F.count("*").alias("n"))
    order = Window.partitionBy("field").orderBy(F.desc("n"), "tag")
    return rates, counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def status(missing: Column, clean: Column, empty: Column, suspicious_: Column) -> Column:
    """PASS, WARN or FAIL by the fixed thresholds: FAIL from 10 % missing or under 80 % clean; WARN under 95 % clean, over
    30 % empty, or with anything suspicious."""
    return F.when((missing > 0.1) | (clean < 0.8), "FAIL").when((clean < 0.95) | (empty > 0.3) | (suspicious_ > 0), "WARN").otherwise("PASS")


def schema_issues(tags: Column) -> Column:
    """Missing and extra fields of a map of tags, as missing:x and extra:x, sorted."""
    want, have = F.array(*map(F.lit, FIELDS)), F.map_keys(tags)
    return F.array_sort(F.concat(F.transform(F.array_except(want, have), lambda x: F.concat(F.lit("missing:"), x)), F.transform(F.array_except(have, want), lambda x: F.concat(F.lit("extra:"), x))))
