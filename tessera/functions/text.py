"""Text functions as Column expressions; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The lexical token pattern (fixed value).
TOKEN_PATTERN = r"[a-z0-9][a-z0-9._%$-]*"
#: Abbreviations after which a sentence does not end (fixed values).
ABBREVIATIONS = ("U.S.", "Inc.", "Corp.", "Co.", "No.", "vs.")


def first_text(*columns: str | Column) -> Column:
    """The first column that is neither null nor empty; the empty string if none is."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit(""))


def joined_text(*columns: str) -> Column:
    """All non-empty columns, a line each."""
    return F.concat_ws("\n", *(F.nullif(F.trim(c), F.lit("")) for c in columns))


def clean_text(text: Column) -> Column:
    """No-break spaces and long dashes made plain, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, " −—", " --"), r"[ \t\n\r\f\x0B]+", " "))


def normalize_evidence(text: Column, comma: bool = True) -> Column:
    """Lower case, everything but letters, digits and $%.()- (and commas) a single space."""
    kept = r"[^a-z0-9$%.,()\-]+" if comma else r"[^a-z0-9$%.()\-]+"
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), kept, " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def token_recall(needle: Column, hay: Column) -> Column:
    """Share of the distinct tokens of needle that hay has; 0 without tokens. Both are token arrays."""
    n = F.size(F.array_distinct(needle))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(needle, hay)) / n)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def preview(text: Column, limit: int = 350) -> Column:
    """Collapsed text; where it is longer than limit, cut and ended with three dots within it."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+", " "))
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))).otherwise(t)


def entity_key(name: Column) -> Column:
    """An entity's normalised name: one space between words, lower case, only word characters, spaces, & . and -."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, r"[ \t\n\r\f\x0B]+", " "))), r"(?U)[^\w\s&.-]", "")


def phrase_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "))


def tag_key(tag: Column) -> Column:
    """Lower case, & as and, company suffixes dropped, other signs as single spaces."""
    t = F.replace(F.lower(tag), F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(t, r"\b(inc|incorporated|corp|corporation|company|co|ltd|plc|llc)\b\.?", " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def stable_id(*parts: Column | str, length: int = 16) -> Column:
    """SHA-1 of the parts joined by a double pipe, cut."""
    return F.substring(F.sha1(F.concat_ws("||", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))), 1, length)


def entity_id(name: Column) -> Column:
    return F.concat(F.lit("entity:"), F.substring(F.md5(entity_key(name)), 1, 12))


def edge_id(source: Column, relation: Column, target: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", source, relation, target)), 1, 16)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_")


def years(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b20\d{2}\b"), F.lit(0)))


def sentences(text: Column, least: int = 25) -> Column:
    """Sentences of at least `least` characters with a letter; they end at . ! ? before a capital, a digit or $."""
    protected = text
    for i, a in enumerate(ABBREVIATIONS):
        protected = F.replace(protected, F.lit(a), F.lit(f"\u0001{i}\u0001"))
    parts = F.split(protected, r"(?<=[.!?])[ \t\n\r\f\x0B]+(?=[A-Z0-9$])")

    def restore(part: Column) -> Column:
        for i, a in enumerate(ABBREVIATIONS):
            part = F.replace(part, F.lit(f"\u0001{i}\u0001"), F.lit(a))
        return F.trim(F.regexp_replace(part, r"[ \t\n\r\f\x0B]+", " "))

    return F.filter(F.transform(parts, restore), lambda s: (F.length(s) >= least) & s.rlike("[A-Za-z]"))


def parsed_json(text: Column) -> Column:
    """A VARIANT of the text's JSON, with code fences stripped, else of its outermost braces, else null."""
    bare = F.trim(F.regexp_replace(text, r"(?i)```(?:json)?", ""))
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))))


def attributes_map(text: Column) -> Column:
    """A string map of a JSON object; other text under the key raw; null and empty text an empty map."""
    parsed = F.from_json(text, "map<string,string>")
    ok = text.rlike(r"(?s)^\s*\{.*\}\s*$") & parsed.isNotNull()
    return F.when(F.coalesce(text, F.lit("")) == "", F.create_map().cast("map<string,string>")).when(ok, parsed).otherwise(F.create_map(F.lit("raw"), text))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
