"""Rules over records: look-ups by aliases, overrides, fallbacks, numbering, presence, scores of candidates."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import basename, clean_text, entity_key
from tessera.operators.ranking import dense_ids
from tessera.operators.tags import long_form

#: Keys by which a chunk may be known, in order (fixed values).
ALIASES = ("chunk_id", "id", "node_id", "chunk_uid", "source_id", "uid")
#: Companies by ticker, names in the order they are tried (fixed values).
TICKERS = {"AAPL": ["Apple", "Apple Inc.", "Apple Inc"], "HD": ["Home Depot", "The Home Depot"], "INTU": ["Intuit", "Intuit Inc."], "MS": ["Morgan Stanley"], "NVDA": ["NVIDIA", "NVIDIA Corporation"]}
#: Texts and tags that are no metadata (fixed values).
TEXT_COLUMNS = ("text", "embed_text", "summary", "semantic_tags", "tags")
#: Words that are no entities of a question (fixed values).
NO_ENTITIES = ("risk", "risks", "tariff", "tariffs")
#: Phrases that are keywords by themselves (fixed values).
KEY_PHRASES = r"(?i)\b(?:net sales|operating income|net income|gross profit|cash flow|total assets|earnings per share)\b"
#: A candidate's words and numbers (fixed value).
EVIDENCE_TOKENS = r"[a-zA-Z][a-zA-Z]+|\d[\d,%.()$-]*"


def metadata(records: DataFrame) -> DataFrame:
    """The records without their texts and tags."""
    return records.drop(*TEXT_COLUMNS)


def override(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """base, with the whole row of new (the same columns) where it has the key; keys of new alone are left out."""
    columns = [c for c in base.columns if c != key]
    both = base.select(key, F.struct(*columns).alias("__old")).join(new.select(key, F.struct(*columns).alias("__new")), key, "left")
    return both.select(key, F.coalesce("__new", "__old").alias("__row")).select(key, "__row.*")


def by_alias(records: DataFrame, order: str, aliases: tuple[str, ...] = ALIASES) -> DataFrame:
    """(key, order): for each name under which a record may be looked up, the first record that has it.

    Blank names are none; chunk:x is a name of the record with chunk_id (or id) x too.
    """
    known = [F.trim(F.col(a).cast("string")) for a in aliases if a in records.columns]
    main = F.coalesce(*(F.col(a).cast("string") for a in ("chunk_id", "id") if a in records.columns))
    keys = F.array(*known, F.concat(F.lit("chunk:"), main))
    named = records.select(order, F.explode(keys).alias("key")).where("key IS NOT NULL AND key <> ''")
    return named.groupBy("key").agg(F.min(order).alias(order))


def with_company(rows: DataFrame, source: str, uids: str, names: DataFrame, tickers: dict[str, list[str]] | None = None) -> DataFrame:
    """rows; where the array of uids is empty, those of the company that the file name's ticker stands for, by exact names.

    names: (name, uid). The names to try are few and fixed, so they are matched first and joined as one small table.
    """
    tried = [(t, k, n) for t, some in (tickers or TICKERS).items() for k, n in enumerate(some)]
    known = rows.sparkSession.createDataFrame(tried, "__ticker string, k int, name string").join(names, "name").groupBy("__ticker").agg(F.array_sort(F.collect_list(F.struct("k", "uid"))).alias("__found"))
    ticker = F.upper(F.split_part(basename(F.col(source)), F.lit("_"), F.lit(1)))
    found = F.transform(F.coalesce("__found", F.array().cast("array<struct<k:int,uid:string>>")), lambda x: x["uid"])
    return rows.withColumn("__ticker", ticker).join(known, "__ticker", "left").withColumn(uids, F.when(F.size(uids) == 0, found).otherwise(F.col(uids))).drop("__ticker", "__found")


def source_chunks(nodes: DataFrame) -> DataFrame:
    """(source, chunks): the uids of each source's chunks, sorted, from nodes (uid, type, attributes as JSON).

    Attributes that are no JSON, or name no source_pdf, are skipped. One row holds a source's chunks.
    """
    parsed = F.from_json("attributes", "source_pdf string", {"mode": "PERMISSIVE"})
    rows = nodes.where("type = 'chunk'").select("uid", parsed["source_pdf"].alias("source")).where("source <> ''")
    return rows.groupBy("source").agg(F.array_sort(F.collect_list("uid")).alias("chunks"))


def name_index(nodes: DataFrame, order: str) -> DataFrame:
    """(name, uids): the uids of the entities (uid, name, type) of each normalised name, by order."""
    rows = nodes.where("type = 'entity'").select(entity_key(F.coalesce("name", F.lit(""))).alias("name"), F.struct(F.col(order).alias("o"), "uid").alias("x"))
    return rows.groupBy("name").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["uid"]).alias("uids"))


def chunk_uids(ids: Column) -> Column:
    """chunk: before each id that isn't blank."""
    return F.transform(F.filter(ids, lambda i: F.trim(i.cast("string")) != ""), lambda i: F.concat(F.lit("chunk:"), i.cast("string")))


def numbered(rows: DataFrame, order: str, prefix: str, out: str = "qid") -> DataFrame:
    """rows with an id like prefix_001, by order (which must be unique)."""
    ids = dense_ids(rows.select(F.col(order).alias("__o")), "__o").select("__o", F.format_string(f"{prefix}_%03d", F.col("id") + 1).alias(out))
    return rows.join(ids, F.col(order) == F.col("__o")).drop("__o")


def group_sizes(rows: DataFrame, by: str) -> DataFrame:
    """(size, groups, least, most, mean): how many groups have each size, and over all groups."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("size"))
    spread = sizes.groupBy("size").agg(F.count("*").alias("groups"))
    total = spread.agg(F.min("size").alias("least"), F.max("size").alias("most"), (F.sum(F.col("size") * F.col("groups")) / F.sum("groups")).alias("mean"))
    return spread.crossJoin(F.broadcast(total))


def presence(chunks: DataFrame, queries: DataFrame, fields: list[str]) -> DataFrame:
    """(field, chunk_presence_rate, query_presence_rate, chunk_empty_rate, query_empty_rate) of arrays of tags."""

    def rates(rows: DataFrame, name: str) -> DataFrame:
        long_ = long_form(rows.withColumn("__k", F.lit(1)), "__k", fields)
        full = F.avg((F.size("tags") > 0).cast("double"))
        return long_.groupBy("field").agg(full.alias(f"{name}_presence_rate"), (1 - full).alias(f"{name}_empty_rate"))

    return rates(chunks, "chunk").join(rates(queries, "query"), "field")


def candidate_score(evidence: Column, answer: Column, content: Column) -> Column:
    """1 for each word or number of the evidence that the content has, 8 for the answer (fixed weights)."""
    low = F.lower(F.coalesce(content, F.lit("")))
    words = F.regexp_extract_all(clean_text(F.coalesce(evidence, F.lit(""))), F.lit(EVIDENCE_TOKENS), F.lit(0))
    said = clean_text(F.coalesce(answer, F.lit("")))
    return F.size(F.filter(words, lambda w: low.contains(F.lower(w)))) + F.when((said != "") & low.contains(F.lower(said)), 8.0).otherwise(0.0)


def question_tags(tags: Column, question: Column) -> Column:
    """A struct of tag arrays, cleaned: industries, domains and sectors that the question names; no risk words among the
    entities; organizations are entities too."""
    low = F.lower(question)
    named = lambda f: F.filter(tags[f], lambda v: low.contains(F.lower(v)))
    entities = F.filter(tags["named_entities"], lambda v: ~F.lower(v).isin(*NO_ENTITIES))
    more = F.array_except(tags["organizations"], entities)
    return tags.withField("industries", named("industries")).withField("domains", named("domains")).withField("sectors", named("sectors")).withField("named_entities", F.concat(entities, more))


def retrieval_keywords(text: Column, metrics: Column, sections: Column, limit: int = 12) -> Column:
    """The metrics and sections, and the phrases of the text that are keywords by themselves; the first `limit`, distinct."""
    bought = F.when(text.rlike(r"(?i)\bpurchases of property, plant and equipment\b"), F.array(F.lit("purchases of property plant and equipment"), F.lit("pp&e"))).otherwise(F.array().cast("array<string>"))
    said = F.transform(F.regexp_extract_all(text, F.lit(KEY_PHRASES), F.lit(0)), lambda x: F.lower(x))
    return F.slice(F.array_distinct(F.concat(metrics, sections, bought, said)), 1, limit)


def caption(paragraphs: Column, back: int = 12) -> Column:
    """The nearest of the last `back` paragraphs that can be a caption: 12 to 180 characters with a letter, not over two $ or
    24 digits; else 'the financial table'."""
    near = F.transform(F.slice(F.reverse(paragraphs), 1, back), clean_text)
    fits = F.filter(near, lambda p: F.length(p).between(12, 180) & p.rlike("[A-Za-z]") & (F.length(F.regexp_replace(p, r"[^$]", "")) <= 2) & (F.length(F.regexp_replace(p, "[^0-9]", "")) <= 24))
    return F.coalesce(F.get(fits, F.lit(0)), F.lit("the financial table"))
