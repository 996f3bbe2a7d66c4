"""Queries over texts, tags, pages, conversations and events: text functions, tagging, audit, chunking, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, metrics, qrels, ranking, tags
from tessera.plans.retrieval import docs, table
from tessera.streaming import events as stream



def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf).select("doc_id", F.md5(T.clean_text(t)).alias("clean"), F.md5(T.normalize_evidence(t)).alias("norm"), F.md5(T.normalize_evidence(t, comma=False)).alias("norm_b"), F.md5(T.phrase_key(t)).alias("phrase"), F.size(T.tokens(t)).alias("n_tokens"), T.stable_id("source", "doc_id").alias("sid"), T.safe_file_name(F.concat("lang", F.lit("/ "), "source")).alias("file"), F.array_join(T.years(t), ",").alias("years"))


def previews(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.length(T.preview(F.col("text"), 320)).alias("n"), F.md5(T.preview(F.col("text"), 320)).alias("h"))


def first_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered coalesce and concatenation, on columns that are null or empty for some rows."""
    rows = docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("lang")).alias("text"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("embed_text"), F.lit("s").alias("summary"))
    return rows.select("doc_id", T.first_text("text", "embed_text", "summary").alias("a"), T.first_text("embed_text", "text", "summary").alias("b"), T.first_text("text", "summary", "embed_text").alias("c"), T.joined_text("text", "embed_text", "summary").alias("e"))


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.sentence_rows(docs(spark, sf))
    return rows.select("doc_id", "ord", F.md5("sentence").alias("h"))


def semantic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.semantic_chunks(docs(spark, sf)).select("doc_id", "chunk_no", "sentence_start", "sentence_end", "text")


def sentence_breakpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Windowed percentiles over sentence lengths' differences, an oracle-friendly stand-in for vector distances."""
    rows = chunking.sentence_rows(docs(spark, sf)).select("doc_id", "ord", F.length("sentence").cast("double").alias("n"))
    from pyspark.sql import Window

    rows = rows.withColumn("distance", F.abs(F.lead("n").over(Window.partitionBy("doc_id").orderBy("ord")) - F.col("n")))
    return chunking.breakpoints(rows)


def dedupe_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.keep_first(docs(spark, sf), F.lower("text"), ["doc_id"]).select("doc_id", "lang")


def dedupe_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.keep_last(docs(spark, sf).select("doc_id", "lang", "text"), F.lower("text"), ["doc_id"]).select("doc_id", "lang")


def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.round_robin(docs(spark, sf).select("doc_id", "source"), "source", "doc_id", 50).select("doc_id", "source", F.col("round").cast("long").alias("round"))


def positional_split(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.positional_split(docs(spark, sf).select("doc_id"), "doc_id")


ROLES = [("junk", r"[*$%&#!]{3}"), ("table", r" \| "), ("licence", r"(?i)licen[sc]e"), ("short", r"(?s)^.{0,200}$")]
LABELS = {"email": "@", "number": "[0-9]", "caps": "[A-Z]{4}", "licence": r"(?i)licen[sc]e", "umlaut": "[äöü]"}


def regex_role_and_type(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", tags.first_label(F.col("text"), ROLES, "prose").alias("role"), F.array_join(tags.find_labels(F.col("text"), LABELS), ",").alias("labels"))


def doc_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in tags: words by pattern, so that overlap and audit have something to work on."""
    t = F.col("text")
    words = lambda p: F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(0)))
    return docs(spark, sf).select("doc_id", words(r"[A-Z][a-z]{7,9}").alias("named_entities"), words(r"[a-z]{11,12}").alias("organizations"), words(r"[0-9]{4}").alias("dates"))


def tag_overlap_count(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's tags against those of the next document."""
    a = doc_tags(spark, sf)
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("named_entities").alias("n2"), F.col("organizations").alias("o2"))
    return a.join(b, "doc_id").select("doc_id", tags.overlap_count([(F.col("named_entities"), F.col("n2")), (F.col("organizations"), F.col("o2"))]).alias("overlap"), F.size(tags.overlap(F.col("named_entities"), F.col("n2"))).alias("named"))


def tag_audit_rates(spark: SparkSession, sf: str) -> DataFrame:
    rates, _ = tags.audit(doc_tags(spark, sf), "doc_id", ["named_entities", "organizations", "dates"])
    return rates.withColumn("rate", F.round("rate", 6))


def tag_top_values(spark: SparkSession, sf: str) -> DataFrame:
    _, values = tags.audit(doc_tags(spark, sf), "doc_id", ["named_entities", "organizations", "dates"])
    return values.select("field", "tag", "n", F.col("rank").cast("long").alias("rank"))


def tag_status(spark: SparkSession, sf: str) -> DataFrame:
    by = docs(spark, sf).groupBy("source").agg(F.avg((F.length("text") < 100).cast("double")).alias("missing"), F.avg((~F.col("text").rlike(r"[*$%&#!]{3}")).cast("double")).alias("clean"), F.avg((F.length("text") < 300).cast("double")).alias("empty"), F.count_if(F.col("text").contains("@")).alias("odd"))
    return by.select("source", tags.status(F.col("missing"), F.col("clean"), F.col("empty"), F.col("odd")).alias("status"))


def html_fields(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(h, r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, r'<html lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all(h, F.lit(r'href="([^"]*)"'), F.lit(1))).alias("links"), F.regexp_count(h, F.lit("<p>")).alias("paragraphs"))


def json_attribute_parse(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "plain").otherwise(F.col("props")).alias("props"))
    m = T.attributes_map(F.col("props"))
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"), F.coalesce(m["raw"], F.lit("")).alias("raw"))


def qa_em_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's turns against the turn before."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    rows = c.join(p, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text", "before")
    out = metrics.answer_scores(rows, "key", "text", "before")
    return out.select("key", "em", *(F.round(x, 6).alias(x) for x in ("f1", "precision", "recall")))


def page_range_join(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of documents of a source (by hundreds of characters) that hold the page a passage asks for."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.lit("1").alias("page_start"), F.when(F.col("doc_id") % 4 != 0, (F.col("n_chars") / 500).cast("int").cast("string")).alias("page_end"))
    q = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"), F.when(F.col("item_id") % 9 == 0, "n/a").otherwise((F.col("item_id") % 6 + 1).cast("string")).alias("page"))
    return q.join(d, "source").where(qrels.page_overlaps(F.col("page"), F.col("page_start"), F.col("page_end"))).select("item_id", "doc_id")


def union_modalities(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "lang")
    return d.unionByName(table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id")), allowMissingColumns=True).groupBy("kind", "lang").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def gold_semi(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).join(table(spark, sf, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi").select("doc_id")


def pending_anti(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id")


def schema_except(spark: SparkSession, sf: str) -> DataFrame:
    """Fields that a record's tags lack or have too many of."""
    m = F.map_from_arrays(F.when(F.col("doc_id") % 2 == 0, F.array(*map(F.lit, tags.FIELDS[:9]))).otherwise(F.array(*map(F.lit, [*tags.FIELDS, "extra"]))), F.sequence(F.lit(1), F.when(F.col("doc_id") % 2 == 0, 9).otherwise(12)))
    return docs(spark, sf).select("doc_id", F.array_join(tags.schema_issues(m), ",").alias("issues"))


def multiset_intersect(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    return d.where("doc_id % 3 = 0").select("source", "lang").intersectAll(d.where("doc_id % 3 = 1").select("source", "lang")).groupBy("source", "lang").agg(F.count("*").alias("n"))


def summary_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"), F.count_distinct("text").alias("texts"))


def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return stream.tumbling(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


def events_session(spark: SparkSession, sf: str) -> DataFrame:
    return stream.sessions(table(spark, sf, "events"), "2 hours")


QUERIES = {f.__name__: f for f in (text_functions, previews, first_texts, sentence_split, semantic_chunks, sentence_breakpoints, dedupe_keep_first, dedupe_keep_last, round_robin_sample, positional_split, regex_role_and_type, tag_overlap_count, tag_audit_rates, tag_top_values, tag_status, html_fields, json_attribute_parse, qa_em_f1, page_range_join, union_modalities, gold_semi, pending_anti, schema_except, multiset_intersect, summary_counts, events_tumbling, events_session)}

_COL = "regexp_replace({0}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')"
_PROT = "text"
for _i, _a in enumerate(T.ABBREVIATIONS):
    _PROT = f"replace({_PROT}, '{_a}', chr(1) || '{_i}' || chr(1))"
_BACK = "s"
for _i, _a in enumerate(T.ABBREVIATIONS):
    _BACK = f"replace({_BACK}, chr(1) || '{_i}' || chr(1), '{_a}')"
_SENT = f"""parts AS (SELECT doc_id, string_split(regexp_replace({_PROT}, '([.!?])[ \\t\\n\\r\\f\\x0B]+([A-Z0-9$])', '\\1' || chr(2) || '\\2', 'g'), chr(2)) AS p FROM documents),
cl AS (SELECT doc_id, list_filter(list_transform(p, lambda s: trim({_COL.format(_BACK)})), lambda s: length(s) >= 25 AND regexp_matches(s, '[A-Za-z]')) AS l FROM parts),
sent AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS ord FROM cl)"""
_KEY = "trim(regexp_replace(regexp_replace(replace(lower({0}), '&', ' and '), '\\b(inc|incorporated|corp|corporation|company|co|ltd|plc|llc)\\b\\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_TAGS = """dt AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{7,9}')) AS ne, list_distinct(regexp_extract_all(text, '[a-z]{11,12}')) AS org, list_distinct(regexp_extract_all(text, '[0-9]{4}')) AS dates FROM documents)"""
_LONG = f"""{_TAGS}, lf AS (SELECT doc_id, 'named_entities' AS field, ne AS tags FROM dt UNION ALL SELECT doc_id, 'organizations', org FROM dt UNION ALL SELECT doc_id, 'dates', dates FROM dt), li AS (SELECT doc_id, field, unnest(tags) AS tag FROM lf)"""
_ANS = "array_to_string(list_filter(string_split_regex(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"
ORACLES = {
    "text_functions": f"""SELECT doc_id, md5(trim({_COL.format("translate(text, chr(160) || '−—', ' --')")})) AS clean, md5(trim(regexp_replace(lower(text), '[^a-z0-9$%.,()\\-]+', ' ', 'g'))) AS norm, md5(trim(regexp_replace(lower(text), '[^a-z0-9$%.()\\-]+', ' ', 'g'))) AS norm_b,
        md5(trim(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'))) AS phrase, len(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._%$-]*'))::INT AS n_tokens, left(sha1(source || '||' || doc_id), 16) AS sid, regexp_replace(lang || '/ ' || source, '[^A-Za-z0-9._-]+', '_', 'g') AS file,
        coalesce(array_to_string(list_distinct(regexp_extract_all(text, '\\b20\\d{{2}}\\b')), ','), '') AS years FROM documents""",
    "previews": f"WITH t AS (SELECT doc_id, trim({_COL.format('text')}) AS t FROM documents), p AS (SELECT doc_id, CASE WHEN length(t) > 320 THEN rtrim(left(t, 317)) || '...' ELSE t END AS p FROM t) SELECT doc_id, length(p)::INT AS n, md5(p) AS h FROM p",
    "first_texts": """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN lang END AS t, CASE WHEN doc_id % 2 = 0 THEN source END AS e FROM documents)
        SELECT doc_id, coalesce(nullif(t, ''), nullif(e, ''), 's') AS a, coalesce(nullif(e, ''), nullif(t, ''), 's') AS b, coalesce(nullif(t, ''), 's') AS c, concat_ws(chr(10), nullif(t, ''), nullif(e, ''), 's') AS e FROM r""",
    "sentence_split": f"WITH {_SENT} SELECT doc_id, ord::INT AS ord, md5(sentence) AS h FROM sent",
    "sentence_breakpoints": f"""WITH {_SENT}, d AS (SELECT doc_id, ord, count(*) OVER (PARTITION BY doc_id) AS n, abs(lead(length(sentence)) OVER (PARTITION BY doc_id ORDER BY ord) - length(sentence))::DOUBLE AS distance FROM sent),
        w AS (SELECT doc_id, ord, distance, unnest(range(0, greatest(ceil((n - 32) / 24), 0)::BIGINT + 1)) AS w FROM d WHERE distance IS NOT NULL), h AS (SELECT * FROM w WHERE ord >= w * 24 AND ord + 1 < w * 24 + 32),
        l AS (SELECT doc_id, w, quantile_cont(distance, 0.95) AS lim FROM h GROUP BY ALL HAVING count(*) >= 2) SELECT DISTINCT doc_id, ord::INT AS ord FROM h JOIN l USING (doc_id, w) WHERE distance >= lim""",
    "dedupe_keep_first": "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) = 1",
    "dedupe_keep_last": "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id DESC) = 1",
    "round_robin_sample": "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round, min(doc_id) OVER (PARTITION BY source) AS f FROM documents) SELECT doc_id, source, round FROM r ORDER BY round, f LIMIT 50",
    "positional_split": "SELECT doc_id, CASE WHEN (row_number() OVER (ORDER BY doc_id) - 1) % 5 = 0 THEN 'dev' ELSE 'test' END AS split FROM documents",
    "regex_role_and_type": """SELECT doc_id, CASE WHEN regexp_matches(text, '[*$%&#!]{3}') THEN 'junk' WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'licence' WHEN length(text) <= 200 THEN 'short' ELSE 'prose' END AS role,
        concat_ws(',', CASE WHEN contains(text, '@') THEN 'email' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'number' END, CASE WHEN regexp_matches(text, '[A-Z]{4}') THEN 'caps' END, CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'licence' END, CASE WHEN regexp_matches(text, '[äöü]') THEN 'umlaut' END) AS labels FROM documents""",
    "tag_overlap_count": f"""WITH {_TAGS}, k AS (SELECT doc_id, list_distinct(list_filter(list_transform(ne, lambda x: {_KEY.format('x')}), lambda x: x <> '')) AS n, list_distinct(list_filter(list_transform(org, lambda x: {_KEY.format('x')}), lambda x: x <> '')) AS o, ne FROM dt)
        SELECT a.doc_id, (len(list_intersect(a.n, b.n)) + len(list_intersect(a.o, b.o)))::INT AS overlap, len(list_filter(a.ne, lambda x: {_KEY.format('x')} <> '' AND list_contains(b.n, {_KEY.format('x')})))::INT AS named FROM k a JOIN k b ON b.doc_id = a.doc_id + 1""",
    "tag_audit_rates": f"""WITH {_LONG}, f AS (SELECT field, count(DISTINCT doc_id) AS rows FROM lf GROUP BY field), g AS (SELECT field, count(DISTINCT doc_id) AS filled, count(*) AS tags,
        count(*) FILTER ((field <> 'dates' AND regexp_matches(tag, '(?i)\\b(19|20)\\d{{2}}\\b|\\b(january|february|march|april|may|june|july|august|september|october|november|december)\\b')) OR (field = 'organizations' AND regexp_matches(tag, '(?i)\\b(10-k|10-q|8-k|form|act of)\\b')) OR (field NOT IN ('organizations', 'named_entities') AND regexp_matches(tag, '(?i)\\b(inc|corp|ltd|llc|company)\\b'))) AS suspicious FROM li GROUP BY field)
        SELECT field, rows, coalesce(filled, 0) AS filled, coalesce(tags, 0) AS tags, coalesce(suspicious, 0) AS suspicious, round(coalesce(filled, 0) / rows, 6) AS rate FROM f LEFT JOIN g USING (field)""",
    "tag_top_values": f"WITH {_LONG}, c AS (SELECT field, tag, count(*) AS n FROM li GROUP BY ALL) SELECT field, tag, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, tag) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, tag) <= 25",
    "tag_status": """WITH a AS (SELECT source, avg((length(text) < 100)::INT) AS m, avg((NOT regexp_matches(text, '[*$%&#!]{3}'))::INT) AS c, avg((length(text) < 300)::INT) AS e, count(*) FILTER (contains(text, '@')) AS o FROM documents GROUP BY source)
        SELECT source, CASE WHEN m > 0.1 OR c < 0.8 THEN 'FAIL' WHEN c < 0.95 OR e > 0.3 OR o > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM a""",
    "html_fields": """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, 'href="([^"]*)"'))::INT AS links, len(regexp_extract_all(html, '<p>'))::INT AS paragraphs FROM pages""",
    "json_attribute_parse": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'raw' ELSE coalesce(array_to_string(list_sort(json_keys(props)), ','), '') END AS keys, CASE WHEN event_id % 5 = 0 THEN 'plain' ELSE '' END AS raw FROM events",
    "qa_em_f1": f"""WITH c AS (SELECT conv_id, turn, text FROM conversations), j AS (SELECT c.conv_id || ':' || c.turn AS key, {_ANS.format('c.text')} AS p, {_ANS.format('b.text')} AS g FROM c JOIN c b ON b.conv_id = c.conv_id AND b.turn + 1 = c.turn),
        k AS (SELECT key, p, g, list_filter(string_split(p, ' '), lambda x: x <> '') AS pt, list_filter(string_split(g, ' '), lambda x: x <> '') AS gt FROM j),
        n AS (SELECT *, CASE WHEN p <> g AND (p IN ('yes', 'no', 'noanswer') OR g IN ('yes', 'no', 'noanswer')) THEN 0 ELSE coalesce(list_sum(list_transform(list_distinct(pt), lambda x: least(len(list_filter(pt, lambda y: y = x)), len(list_filter(gt, lambda y: y = x))))), 0) END AS n FROM k)
        SELECT key, (p = g)::INT AS em, round(CASE WHEN n = 0 THEN 0 ELSE 2 * (n / len(pt)) * (n / len(gt)) / (n / len(pt) + n / len(gt)) END, 6) AS f1, round(CASE WHEN n = 0 THEN 0 ELSE n / len(pt) END, 6) AS precision, round(CASE WHEN n = 0 THEN 0 ELSE n / len(gt) END, 6) AS recall FROM n""",
    "page_range_join": """WITH d AS (SELECT doc_id, source, 1 AS a, CASE WHEN doc_id % 4 <> 0 THEN (n_chars // 500)::INT ELSE 1 END AS b FROM documents) SELECT item_id, doc_id FROM benchmark JOIN d ON d.source = 'src' || (item_id % 20) AND item_id % 9 <> 0 AND item_id % 6 + 1 BETWEEN a AND b""",
    "union_modalities": "SELECT kind, lang, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT 'doc' AS kind, lang, doc_id AS id FROM documents UNION ALL SELECT 'page', NULL, page_id FROM pages) GROUP BY ALL",
    "gold_semi": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "pending_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "schema_except": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'missing:locations,missing:products' ELSE 'extra:extra' END AS issues FROM documents",
    "multiset_intersect": "SELECT source, lang, count(*) AS n FROM (SELECT source, lang FROM documents WHERE doc_id % 3 = 0 INTERSECT ALL SELECT source, lang FROM documents WHERE doc_id % 3 = 1) GROUP BY ALL",
    "summary_counts": "SELECT lang, source, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, count(DISTINCT text) AS texts FROM documents GROUP BY ALL",
    "events_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_session": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
}
