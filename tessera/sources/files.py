"""File sources and sinks: JSON lines, JSON, CSV, graph bundles, indexes, resumable tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions.text import attributes_map

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped and a byte-order mark is ignored."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("encoding", "UTF-8").json(path)


def read_jsonl_safe(spark: SparkSession, path: str, schema: StructType, raw_chars: int = 300) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): rows that parse as objects, and for others (file, line, raw preview).

    A line's number is its place in its block of the file after the lines of the blocks before; only the blocks' counts are
    gathered, so a large file is numbered by many tasks.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    lines = lines.join(starts, ["file", "block"]).select("value", "file", (F.col("at") + F.col("shift")).alias("line"))
    lines = lines.withColumn("value", F.regexp_replace("value", "^﻿", "")).where(F.trim("value") != "")
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = lines.withColumn("j", F.from_json("value", wide, {"columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("j").isNull() | F.col(f"j.{CORRUPT}").isNotNull() | ~F.ltrim("value").startswith("{")
    return parsed.where(~bad).select("line", *(F.col(f"j.{f.name}").alias(f.name) for f in schema.fields)), parsed.where(bad).select("file", "line", F.substring("value", 1, raw_chars).alias("raw"))


def read_json_any(spark: SparkSession, path: str, schema: StructType, key: str = "chunks") -> DataFrame:
    """By suffix: .jsonl as lines; .json as a list of rows, or as an object with the rows under `key`."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    text = spark.read.option("wholetext", True).text(path)
    from pyspark.sql.types import ArrayType

    rows = ArrayType(schema)
    direct = F.when(F.ltrim("value").startswith("["), F.from_json("value", rows))
    under = F.from_json("value", StructType([StructField(key, rows)]))[key]
    return text.select(F.explode(F.coalesce(direct, under)).alias("r")).select("r.*")


def read_indexed_csv(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """CSV without null parsing; the first of `keys` that is a column must be unique, and id counts rows in file order."""
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, quote='"', escape='"', nullValue="\u0000", emptyValue="").na.fill("")
    key = next((k for k in keys if k in df.columns), None)
    if key is None:
        raise ValueError(f"none of {keys} is a column of {path}")
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique in {path}")
    from tessera.operators.ranking import dense_ids

    return dense_ids(df.withColumn("__at", F.monotonically_increasing_id()), "__at").drop("__at")


def write_rows(df: DataFrame, path: str, kind: str) -> None:
    """Overwrites path with jsonl, csv or parquet."""
    writer = df.write.mode("overwrite")
    {"jsonl": writer.json, "csv": writer.option("header", True).option("escape", '"').csv, "parquet": writer.parquet}[kind](path)


def write_graph(nodes: DataFrame, relations: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes (uid, name, type), relations (name), edges (source, relation, target); other columns as JSON attributes."""
    for name, df, keep in (("nodes", nodes, ["uid", "name", "type"]), ("relations", relations, ["name"]), ("edges", edges, ["source", "relation", "target"])):
        rest = [c for c in df.columns if c not in keep]
        attributes = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
        write_rows(df.select(*keep, attributes.alias("attributes")), f"{path}/{name}", "csv")


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, relations and edges as write_graph left them, attributes as string maps."""
    out = {}
    for name in ("nodes", "relations", "edges"):
        df = spark.read.csv(f"{path}/{name}", header=True, escape='"', multiLine=True)
        out[name] = df.withColumn("attributes", attributes_map(F.col("attributes")))
    return out


def write_index(rows: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame], manifest: dict) -> None:
    """Rows (chunk_id, modality, text ...) with vectors by `encode`, partitioned by modality, and a manifest beside them.

    Vectors of an index that is already there are taken over for equal ids and texts; only the rest are encoded.
    """
    spark = rows.sparkSession
    hashed = rows.dropDuplicates(["chunk_id"]).withColumn("text_hash", F.xxhash64("text"))
    try:
        old = spark.read.parquet(f"{path}/current").select("chunk_id", "text_hash", "vec")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        old = None
    if old is not None:
        known = hashed.join(old, ["chunk_id", "text_hash"])
        todo = hashed.join(old, ["chunk_id", "text_hash"], "left_anti")
        result = known.unionByName(encode(todo), allowMissingColumns=True)
    else:
        result = encode(hashed)
    result.write.mode("overwrite").partitionBy("modality").parquet(f"{path}/next")
    spark.read.parquet(f"{path}/next").write.mode("overwrite").partitionBy("modality").parquet(f"{path}/current")
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_index(spark: SparkSession, path: str, records: DataFrame | None = None) -> DataFrame:
    """The index; raises if ids repeat, or if records lack any of its ids."""
    index = spark.read.parquet(f"{path}/current")
    if not index.groupBy("chunk_id").count().where("count > 1").isEmpty():
        raise ValueError("ids repeat in the index")
    if records is not None and not index.join(records, "chunk_id", "left_anti").isEmpty():
        raise ValueError("the index has ids that the records lack")
    return index


def resume(todo: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Appends work() of the rows whose key isn't at path yet, and returns all that is there."""
    spark = todo.sparkSession
    try:
        todo = todo.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    work(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def ensure(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path, built only if it is missing or `force`."""
    if not force:
        try:
            return spark.read.parquet(path)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cache_path(root: str, name: str, config: dict) -> str:
    """A folder named by the MD5 of a configuration."""
    import hashlib

    return f"{root}/{name}-{hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()}"


def passages(spark: SparkSession, path: str) -> DataFrame:
    """(title, passage) of a JSON object {title: text}; the passage begins with the title's line."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("title", "text")).select("title", F.concat_ws("\n", "title", "text").alias("passage"))


def flatten_runs(rows: DataFrame, method: str) -> DataFrame:
    """(method, query_id, rank, chunk_id, score) of rows with retrieved_chunks arrays."""
    flat = rows.select("query_id", F.posexplode("retrieved_chunks").alias("at", "c"))
    return flat.select(F.lit(method).alias("method"), "query_id", (F.col("at") + 1).alias("rank"), F.col("c.chunk_id").alias("chunk_id"), F.col("c.score").alias("score"))


#: What a file's sampled records are worth (fixed values): a text, a question, tags, all tag fields, tags named as a query's;
#: and what its path adds or takes.
SOURCE_WEIGHTS = {"text": 3, "question": 20, "tags": 5, "schema": 5, "query_tags": 15}
PATH_BONUS, PATH_MALUS = 100, -100


def discover(spark: SparkSession, root: str, fields: list[str], sample: int = 50) -> DataFrame:
    """(path, records, score), best first: which JSON lines files under root look like tagged questions.

    The first `sample` lines of each file are looked at; files without questions or tags are left out.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    order = Window.partitionBy("path").orderBy("at")
    first = lines.where("block = 0 AND trim(value) <> ''").withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample)
    row = F.from_json("value", "map<string,string>")
    has = lambda *names: F.coalesce(F.greatest(*(F.coalesce(F.length(row[n]) > 0, F.lit(False)) for n in names), F.lit(False)), F.lit(False))
    tags = F.from_json(F.coalesce(row["query_semantic_tags"], row["semantic_tags"], row["tags"]), "map<string,string>")
    exact = F.coalesce(F.array_sort(F.map_keys(tags)) == F.array(*map(F.lit, sorted(fields))), F.lit(False))
    w = SOURCE_WEIGHTS
    parts = [(has("question", "query", "text"), w["text"]), (has("question", "query"), w["question"]), (tags.isNotNull(), w["tags"]), (exact, w["schema"]), (row["query_semantic_tags"].isNotNull(), w["query_tags"])]
    worth = sum((F.coalesce(c.cast("int"), F.lit(0)) * x for c, x in parts), F.lit(0))
    found = first.select("path", worth.alias("worth"), parts[0][0].alias("asked"), tags.isNotNull().alias("tagged")).groupBy("path").agg(F.count("*").alias("records"), F.sum("worth").alias("score"), F.bool_or("asked").alias("asked"), F.bool_or("tagged").alias("tagged"))
    low = F.lower("path")
    bonus = F.when(low.contains("/qa/") | low.contains("queries") | low.contains("questions"), PATH_BONUS).otherwise(0) + F.when(low.contains("/data/chunks/"), PATH_MALUS).otherwise(0)
    return found.where("asked AND tagged").select("path", "records", (F.col("score") + bonus).alias("score")).orderBy(F.desc("score"), "path")


def markdown_table(rows: DataFrame, limit: int = 1000) -> str:
    """A report table as Markdown, numbers with four decimals; of more than `limit` rows the first ones, and a line that says so."""
    head = rows.columns
    show = lambda x: f"{x:.4f}" if isinstance(x, float) else "" if x is None else str(x)
    found = rows.limit(limit + 1).collect()
    lines = ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(map(show, r)) + " |" for r in found[:limit])]
    return "\n".join([*lines, *([f"\nThe first {limit} of {rows.count()} rows."] if len(found) > limit else [])])
