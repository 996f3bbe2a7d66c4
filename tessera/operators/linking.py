"""Linking surface forms to entities, and making labels for training retrievers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.functions.text import clean_text, entity_key, first_text, jaccard
from tessera.operators.lexical import top_k
from tessera.operators.vector import inner_products
from tessera.operators.vector_grid import top_products
from tessera.session import written


def link(surfaces: DataFrame, entities: DataFrame, threshold: float = 0.82) -> DataFrame:
    """(surface, uid, how): exact name, else the first name equal in lower case, else the most similar vector.

    surfaces: (surface, vec or null); entities: (uid, name, ord, vec). Only what has no equal name is compared by
    vectors; that set of surfaces is the stated side of an exact search, in blocks.
    """
    exact = surfaces.join(entities.select(F.col("name").alias("surface"), "uid"), "surface").select("surface", "uid", F.lit("exact").alias("how"))
    rest = surfaces.join(exact.select("surface").distinct(), "surface", "left_anti")
    first = entities.groupBy(F.lower("name").alias("low")).agg(F.min_by("uid", "ord").alias("uid"))
    lower = rest.join(first, F.lower("surface") == F.col("low")).select("surface", "uid", F.lit("lower").alias("how"))
    rest = rest.join(lower.select("surface").distinct(), "surface", "left_anti").where("vec IS NOT NULL")
    scored = inner_products(entities.select(F.col("uid").alias("vec_id"), F.col("vec").alias("embedding")), rest.select(F.col("surface").alias("vec_id"), F.col("vec").alias("embedding")))
    similar = top_k(scored, 1, digits=12).where(F.col("score") >= threshold).select(F.col("query_id").alias("surface"), F.col("doc_id").alias("uid"), F.lit("vector").alias("how"))
    return exact.union(lower).union(similar)


def resolve(terms: DataFrame, entities: DataFrame, least: int = 3) -> DataFrame:
    """(id, uid), distinct: entities whose normalised name is the term's, else, for terms of `least` characters, those that
    have it as one of their words. terms: (id, term); entities: (uid, name)."""
    t = terms.select("id", entity_key(F.col("term")).alias("norm")).distinct()
    e = entities.select("uid", entity_key(F.col("name")).alias("norm"))
    whole = t.join(e, "norm").select("id", "uid", "norm")
    rest = t.join(whole.select("norm").distinct(), "norm", "left_anti").where(F.length("norm") >= least)
    words = e.select("uid", F.explode(F.array_distinct(F.split("norm", " "))).alias("norm"))
    return whole.select("id", "uid").union(rest.join(words, "norm").select("id", "uid")).distinct()


def resolved_counts(terms: DataFrame, entities: DataFrame, least: int = 3) -> DataFrame:
    """(id, n): how many entities resolve() finds for each id, of those with any.

    Ids of one term share its count, which is taken once a term, so common words cost no pairs of ids and entities; only
    ids of several terms are resolved to pairs, as their terms may find the same entity.
    """
    t = terms.select("id", entity_key(F.col("term")).alias("norm")).where("id IS NOT NULL AND norm IS NOT NULL").distinct()
    few = t.groupBy("id").agg(F.first("norm").alias("norm"), F.count("*").alias("terms"))
    sole = few.where("terms = 1").select("id", "norm")
    e = entities.select("uid", entity_key(F.col("name")).alias("norm"))
    whole = e.groupBy("norm").agg(F.count_distinct(F.struct("uid")).alias("n"))
    part = e.select("uid", F.explode(F.array_distinct(F.split("norm", " "))).alias("norm")).where(F.length("norm") >= least)
    part = part.join(whole, "norm", "left_anti").groupBy("norm").agg(F.count_distinct(F.struct("uid")).alias("n"))
    one = sole.join(whole.union(part), "norm").select("id", "n")
    several = resolve(terms.join(few.where("terms > 1").select("id"), "id", "left_semi"), entities, least)
    nameless = resolve(terms.where("id IS NULL"), entities, least)
    return one.union(several.union(nameless).groupBy("id").agg(F.count("*").alias("n")))


def synonyms(phrases: DataFrame, queries: DataFrame | None = None, threshold: float = 0.8, most: int = 100) -> DataFrame:
    """(source, target, score): each query phrase's nearest others, by the share of the best score, no self.

    phrases and queries (all phrases, if None): (id, name, vec); only those of three letters or digits take part. A query's
    most + 1 best inner products count, itself among them; the share is that of the largest, and where that isn't above
    zero there are no synonyms. Both sides are dealt to blocks and compared block by block, see top_products.
    """
    ok = F.length(F.regexp_replace(F.coalesce("name", F.lit("")), "[^A-Za-z0-9]", "")) > 2
    sides = [side.where(ok).select("id", F.col("vec").cast("array<double>").alias("vec")) for side in (phrases if queries is None else queries, phrases)]
    best = top_products(*sides, k=most + 1)
    share = F.col("score") / F.max("score").over(Window.partitionBy("query_id"))
    found = best.withColumn("share", F.when(F.max("score").over(Window.partitionBy("query_id")) > 0, share))
    return found.where((F.col("share") >= threshold) & (F.col("query_id") != F.col("id"))).select(F.col("query_id").alias("source"), F.col("id").alias("target"), F.col("share").alias("score"))


def best_chunk(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, chunk_id, score): of a question's source the chunk with the largest word overlap; a sole chunk whatever it has.

    questions: (id, source, text); chunks: (chunk_id, source, text).
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))
    pairs = questions.select("id", "source", words(F.col("text")).alias("q")).join(chunks.select("chunk_id", "source", words(F.col("text")).alias("c")), "source")
    scored = pairs.select(F.col("id").alias("query_id"), F.col("chunk_id").alias("doc_id"), jaccard(F.col("q"), F.col("c")).alias("score"), F.count("*").over(Window.partitionBy("id")).alias("n"))
    return top_k(scored.where((F.col("score") > 0) | (F.col("n") == 1)), 1).select(F.col("query_id").alias("id"), F.col("doc_id").alias("chunk_id"), "score")


def training_samples(linked: DataFrame, evidence: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, start_nodes, target_nodes) as maps by type; questions without start entities go.

    linked: (id, uid); evidence: (id, chunk_id); mentions: (chunk_id, uid).
    """
    starts = linked.groupBy("id").agg(F.array_sort(F.collect_set("uid")).alias("s"))
    chunks = evidence.groupBy("id").agg(F.array_sort(F.collect_set(F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")))).alias("c"))
    ents = evidence.join(mentions, "chunk_id").groupBy("id").agg(F.array_sort(F.collect_set("uid")).alias("e"))
    none = F.array().cast("array<string>")
    out = starts.join(chunks, "id", "left").join(ents, "id", "left")
    return out.select("id", F.create_map(F.lit("entity"), F.col("s")).alias("start_nodes"), F.create_map(F.lit("chunk"), F.coalesce("c", none), F.lit("entity"), F.coalesce("e", none)).alias("target_nodes"))


def node_text(fields: list[str], name: str = "name") -> Column:
    """Labelled fields joined by full stops; without any the node's name."""
    parts = F.concat_ws(". ", *(F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "", F.concat(F.lit(f"{f}: "), F.trim(F.col(f).cast("string")))) for f in fields))
    return F.when(parts == "", F.concat(F.lit("Node: "), F.coalesce(name, F.lit("")))).otherwise(parts)


def map_text(attributes: Column, name: Column) -> Column:
    """name: x, then a key: value line for each attribute that isn't null, by key."""
    kept = F.array_sort(F.map_entries(F.map_filter(attributes, lambda k, v: v.isNotNull())))
    return F.concat_ws("\n", F.concat(F.lit("name: "), name), F.nullif(F.array_join(F.transform(kept, lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n"), F.lit("")))


def node_type(uid: Column) -> Column:
    """The node type by an id's prefix (fixed prefixes)."""
    return F.when(uid.startswith("chunk:"), "chunk").when(uid.startswith("entity:"), "entity").when(uid.startswith("doc:") | uid.startswith("document:"), "document").otherwise("unknown")


def preview_text(most: int = 512) -> Column:
    """A node's text for baselines and teachers: the first of its preview, chunk id, summary and name, cut to `most`."""
    return F.substring(first_text("text_preview", "chunk_id", "summary", "name"), 1, most)


def typed_node_texts(nodes: DataFrame, records: DataFrame, chunks: DataFrame, most: int = 512) -> tuple[DataFrame, dict[str, int]]:
    """(uid, type, text) of all nodes, and how many there are of each type, fallbacks and empty texts: both from one job.

    nodes: (uid, type or null); records: (uid, type, text), each uid once; chunks: (chunk_id, text), each id once. A node's type
    is its own, else its record's, else what its id begins with. A chunk's text is that of the chunk with its uid, else with
    the uid less "chunk:", else its record's; others have their record's text. Texts are cleaned and cut to `most`
    characters; without one a node is called by its uid ("Node: ..."). Nodes that repeat have a row each; a null uid has
    the fallback without a name. The counts are gathered while the texts are written.
    """
    known = records.select("uid", F.col("type").alias("record_type"), F.col("text").alias("record_text"))
    named = nodes.select("uid", "type").join(known, "uid", "left").withColumn("type", F.coalesce(F.nullif("type", F.lit("")), F.nullif("record_type", F.lit("")), node_type(F.coalesce("uid", F.lit("")))))
    whole = chunks.select(F.col("chunk_id").cast("string").alias("whole_id"), F.col("text").alias("whole_text"))
    bare = chunks.select(F.col("chunk_id").cast("string").alias("bare_id"), F.col("text").alias("bare_text"))
    is_chunk = F.col("type") == "chunk"
    met = named.join(whole, is_chunk & (F.col("uid") == F.col("whole_id")), "left")
    met = met.join(bare, is_chunk & (F.regexp_replace("uid", "^chunk:", "") == F.col("bare_id")), "left")
    filled = lambda c: F.nullif(clean_text(F.col(c)), F.lit(""))
    text = F.coalesce(filled("whole_text"), filled("bare_text"), filled("record_text"), F.concat(F.lit("Node: "), F.coalesce("uid", F.lit(""))))
    out = met.select("uid", "type", F.substring(text, 1, most).alias("text"))
    counts = Observation("node_texts")
    of = {"nodes": F.lit(True), **{f"{t}_texts": F.col("type") == t for t in ("entity", "chunk", "document")}, "fallbacks": F.col("text").startswith("Node:"), "empty": F.trim("text") == ""}
    texts = written(out.observe(counts, *(F.count_if(condition).alias(name) for name, condition in of.items())), "node-texts")
    return texts, {name: int(n) for name, n in counts.get.items()}
