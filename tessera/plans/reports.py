"""Queries over report rules, on documents and parts to which report-like phrases are added: roles, tags, covers, questions,
context lines, table cells, evidence pages, passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import extraction, filings, linking, questions
from tessera.plans.retrieval import docs, items, table

#: What documents begin with, by their number.
PHRASES = (
    "Signatures of the officers", "Exhibit Index and exhibits", "Table of Contents", "FORM 10-K annual report Commission File Number: 001-36743",
    "Consolidated Statement of income in millions: revenue and net sales, $1,200 2% (3) 44 55 66 77 88\n1\n2", "Risk Factors: credit risk and litigation in 2024 and 2021",
    "Management's Discussion and Analysis of liquidity and capital expenditures", "Note 7 on dividends; see the chart", "Plain words about gross margin and segments",
    "Securities and Exchange Commission, trading symbol X", "For the fiscal year ended September 28, 2024 (408) 996-1010", "Net sales increased as part ii of the cash flow statement shows",
)
#: Questions, by number.
QUESTIONS = ("How much did margin change?", "Compare revenue versus cost", "Why did it fall?", "Give a summary", "What is the EPS?", "Tell us more")
#: Contexts of tables, by number.
CONTEXTS = ("Gross margin percentage by region", "Net sales by region", "Condensed balance sheet", "Fees billed by auditors", "Other data")


def _nth(options: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(number, F.lit(len(options))) + 1).cast("int"))


def report_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text, page, modality, section)"""
    i = F.col("doc_id")
    return docs(spark, sf).select("doc_id", F.concat(_nth(PHRASES, i), F.lit(". "), F.col("text")).alias("text"), (i % 3 + 1).alias("page"), _nth(("text", "table", "text", "image"), F.floor(i / 12)).alias("modality"), F.lit(None).cast("string").alias("section"))


def report_tags(spark: SparkSession, sf: str) -> DataFrame:
    out = filings.chunk_tags(report_texts(spark, sf))
    lists = ("years", "financial_metrics", "business_topics", "risk_topics", "section_tags")
    return out.select("doc_id", "chunk_role", "is_navigation_only", "is_front_matter", "evidence_type", *(F.array_join(c, "|").alias(c) for c in lists))


def question_intents(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("query_id", filings.intent(_nth(QUESTIONS, F.col("query_id"))).alias("intent"))


def cover_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = report_texts(spark, sf)
    return rows.select("doc_id", *(F.coalesce(c, F.lit("")).alias(n) for n, c in zip(questions.COVER, questions.cover_fields(F.col("text")), strict=True)))


def context_lines(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("x/AAPL_10-K_"), F.col("p_brand"), F.lit(".htm")).alias("source_pdf"), F.col("p_size").alias("page"), _nth(("table", "image", "text"), k).alias("modality"), F.when(k % 2 == 0, F.col("p_name")).otherwise("").alias("text"), F.concat(F.lit("A  pie chart of "), F.col("p_type")).alias("summary"), F.when(k % 4 == 0, "").otherwise("|a|b|").alias("table_markdown"), F.array("p_brand", F.lit("7")).alias("key_values"))
    return rows.select("p_partkey", F.md5(filings.embed_text({"AAPL": "Apple"})).alias("lines"))


def _html(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each supplier: a table with a header and a row of amounts, after a table without numbers."""
    head = "<TABLE><tr><td>only</td><td>words</td></tr></TABLE><table><tr><th>Name</th><th>FY23</th><th>Net sales</th></tr>"
    cells = F.concat(F.lit("<tr><td> <b>"), F.col("s_name"), F.lit("</b>  total</td><td>$</td><td>"), F.format_string("%,d", F.col("s_suppkey") * 1234), F.lit("</td><td>)</td></tr></table>"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"), F.concat(F.lit(head), cells).alias("html"))


def html_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    return filings.html_tables(_html(spark, sf)).select("page_id", "table_index", "row_index", F.array_join("cells", "|").alias("cells"))


def html_table_values(spark: SparkSession, sf: str) -> DataFrame:
    return filings.table_values(filings.html_tables(_html(spark, sf)))


def natural_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Generated questions about parts in plain words, of both forms, and others as they are."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    q = F.when(k % 3 == 0, F.concat(F.lit("What value does Acme report for "), F.col("p_name"), F.lit(" under 2023?"))).when(k % 3 == 1, F.concat(F.lit("For Acme's filing period ended May 2024, what value is reported for "), F.col("p_name"), F.lit(" under 2023?"))).otherwise(F.concat(F.lit("Is  "), F.col("p_name"), F.lit(" sold?")))
    evidence = F.concat(F.lit("Table context: "), _nth(CONTEXTS, F.floor(k / 3)), F.lit(". HTML table row: x"))
    return p.select("p_partkey", questions.natural_question(q, F.lit("Acme"), evidence, F.when(k % 2 == 0, "4%").otherwise("4")).alias("question"))


def text_questions(spark: SparkSession, sf: str) -> DataFrame:
    return report_texts(spark, sf).select("doc_id", F.coalesce(questions.text_question(F.col("text"), F.lit("Acme")), F.lit("")).alias("question"), F.coalesce(questions.checked_box(F.col("text")), F.lit("")).alias("box"), questions.unnatural(F.col("text")).alias("unnatural"))


def answer_units(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_linenumber")
    answer = F.when(k == 1, F.lit("2024-01-31")).when(k == 2, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("%"))).when(k == 3, F.format_string("%,d", F.col("l_extendedprice").cast("int"))).when(k == 4, F.lit("about 4 years")).otherwise(F.col("l_quantity").cast("int").cast("string"))
    evidence = _nth(("$ in millions", "in thousands of shares", "percent of total", "number of shares in thousands", "nothing"), F.col("l_partkey"))
    rows = table(spark, sf, "lineitem").select(questions.answer_type(answer).alias("kind"), questions.unit_for(answer, evidence).alias("unit"), k.alias("line"))
    return rows.groupBy("kind", "unit", "line").agg(F.count("*").alias("n"))


def focus_passages(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.md5(extraction.focus_passage(F.col("text"), ["zz", "the "], most=300, lead=2)).alias("passage"))


def evidence_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of a source that has a passage's first two words."""
    pages = docs(spark, sf).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    labels = items(spark, sf).select(F.col("query_id").alias("id"), F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("doc"), F.col("text").alias("label"), F.when(F.col("query_id") % 2 == 0, "1,2").otherwise("").alias("value"))
    return questions.evidence_page(pages, labels)


def multimodal_queries(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).select(F.col("doc_id").cast("string").alias("chunk_id"), "source", _nth(("table", "text", "image"), F.col("doc_id")).alias("modality"), F.col("doc_id").alias("ord"))
    asked = rows.where("modality = 'table'").select(F.col("ord").alias("query_id"), "chunk_id", "source")
    return questions.multimodal(asked, rows).select("query_id", F.array_join("chunk_ids", ",").alias("chunk_ids"))


def best_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The document of a passage's source with the largest word overlap."""
    asked = items(spark, sf).select(F.col("query_id").alias("id"), F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("source"), "text")
    return linking.best_chunk(asked, docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "source", "text"))


def json_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of events within code fences, within words, bare and broken."""
    k = F.col("event_id")
    raw = F.when(k % 4 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(k % 4 == 1, F.concat(F.lit("Here: "), F.col("props"), F.lit(" done"))).when(k % 4 == 2, F.col("props")).otherwise("{broken")
    return table(spark, sf, "events").select("event_id", F.try_variant_get(T.parsed_json(raw), "$.k", "long").alias("k"))


def labelled_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Passages with the documents that hold their longest words, as samples of start and target nodes."""
    from tessera.plans.graphs import mentions, starts

    s = starts(spark, sf).select(F.col("sample").alias("id"), F.col("entity").alias("uid"))
    m = mentions(spark, sf).select("chunk_id", F.col("entity").alias("uid"))
    evidence = docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("chunk_id"))
    out = linking.training_samples(s, evidence, m)
    return out.select("id", F.array_join(F.col("start_nodes")["entity"], ",").alias("starts"), F.array_join(F.col("target_nodes")["chunk"], ",").alias("chunks"), F.array_join(F.col("target_nodes")["entity"], ",").alias("entities"))


QUERIES = {f.__name__: f for f in (report_tags, question_intents, cover_fields, context_lines, html_table_rows, html_table_values, natural_questions, text_questions, answer_units, focus_passages, evidence_pages, multimodal_queries, best_chunks, json_objects, labelled_samples)}

_Q = lambda s: "'" + s.replace("'", "''") + "'"
_LIST = lambda some: "[" + ", ".join(map(_Q, some)) + "]"
_HAS = lambda p, t="t": f"regexp_matches({t}, {_Q('(?i)' + p)})"
_FOUND = lambda patterns: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_HAS(p)} THEN {_Q(k)} END" for k, p in patterns.items()) + "], lambda x: x IS NOT NULL), '|')"
_TEXTS = f"""tx AS (SELECT doc_id, ({_LIST(PHRASES)})[doc_id % {len(PHRASES)} + 1] || '. ' || text AS t, doc_id % 3 + 1 AS page, (['text', 'table', 'text', 'image'])[doc_id // 12 % 4 + 1] AS modality FROM documents),
lw AS (SELECT *, lower(t) AS low, len(regexp_extract_all(lower(t), '\\bitem\\s+\\d+[a-z]?\\b')) AS items, len(regexp_extract_all(lower(t), '\\bexhibit\\b')) AS exhibits FROM tx),
rl AS (SELECT *, CASE WHEN contains(low, 'signatures') THEN 'signature' WHEN contains(low, 'exhibit index') OR exhibits >= 4 THEN 'exhibit_list' WHEN contains(low, 'table of contents') THEN 'table_of_contents'
    WHEN page = 1 AND contains(low, 'form 10-k') AND contains(low, 'commission file number') THEN 'cover_page' WHEN page = 1 AND contains(low, 'securities and exchange commission') AND (contains(low, 'trading symbol') OR contains(low, 'nasdaq')) THEN 'cover_page'
    WHEN regexp_matches(low, '\\b(consolidated statement|balance sheet|statement of cash flows|statement of operations)\\b') THEN 'financial_statement' WHEN regexp_matches(low, '\\brisk factors?\\b') AND items < 3 THEN 'risk_factor'
    WHEN regexp_matches(low, {_Q(filings.SECTIONS['md&a'])}) THEN 'mdna' WHEN regexp_matches(low, '\\bnotes to consolidated financial statements\\b|\\bnote \\d+\\b') THEN 'footnote' ELSE 'section_content' END AS role FROM lw),
mt AS (SELECT *, role IN ('cover_page', 'table_of_contents', 'signature', 'exhibit_list', 'metadata') AS meta FROM rl)"""
_ETYPE = """CASE WHEN modality = 'table' THEN 'table' WHEN modality = 'image' THEN 'figure' WHEN regexp_matches(low, '\\b(consolidated statement|balance sheet|cash flow statement|statement of cash flows)\\b') THEN 'table'
    WHEN regexp_matches(low, '\\b(years ended|three months ended|six months ended|in millions|in thousands|assets|liabilities|net sales|total revenue)\\b') AND len(regexp_extract_all(t, '[-(]?\\$?\\d[\\d,]*(?:\\.\\d+)?%?\\)?')) >= 8 AND len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) >= 3 THEN 'table'
    WHEN regexp_matches(low, '\\b(figure|chart|graph)\\b') THEN 'figure' ELSE 'text' END"""
_COVERS = ", ".join("coalesce(" + ", ".join(f"nullif(trim(regexp_replace(regexp_extract(t, {_Q(p)}, 1), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), '')" for p in ps) + f", '') AS {name}" for name, ps in questions.COVER.items())
_SENTS = "string_split(regexp_replace(raw, '([.!?]) +', '\\1' || chr(2), 'g'), chr(2))"
ORACLES = {
    "report_tags": f"""WITH {_TEXTS} SELECT doc_id, role AS chunk_role, role IN ('table_of_contents', 'exhibit_list') AS is_navigation_only, role IN ('cover_page', 'table_of_contents', 'signature', 'metadata') AS is_front_matter, CASE WHEN meta THEN 'metadata' ELSE {_ETYPE} END AS evidence_type,
        CASE WHEN role = 'cover_page' THEN '' ELSE coalesce(array_to_string(list_filter(regexp_extract_all(t, '\\b20\\d{{2}}\\b'), lambda x, i: list_position(regexp_extract_all(t, '\\b20\\d{{2}}\\b'), x) = i), '|'), '') END AS years,
        CASE WHEN meta THEN '' ELSE {_FOUND(filings.METRICS)} END AS financial_metrics, CASE WHEN meta THEN '' ELSE {_FOUND(filings.TOPICS)} END AS business_topics, CASE WHEN meta THEN '' ELSE {_FOUND(filings.RISKS)} END AS risk_topics, {_FOUND(filings.SECTIONS)} AS section_tags FROM mt""",
    "question_intents": f"""WITH q AS (SELECT item_id AS query_id, lower(({_LIST(QUESTIONS)})[item_id % {len(QUESTIONS)} + 1]) AS t FROM benchmark) SELECT query_id, CASE WHEN {_HAS('\\b(calculate|compute|how much|difference|change|growth|margin)\\b')} THEN 'calculate' WHEN {_HAS('\\b(compare|versus|vs\\.?|between)\\b')} THEN 'compare'
        WHEN {_HAS('\\b(explain|why|describe)\\b')} THEN 'explain' WHEN {_HAS('\\b(summarize|summary)\\b')} THEN 'summarize' WHEN {_HAS('|'.join(filings.METRICS.values()))} OR {_HAS('\\b(what|which|show|find)\\b')} THEN 'extract_value' ELSE 'unknown' END AS intent FROM q""",
    "cover_fields": f"WITH {_TEXTS} SELECT doc_id, {_COVERS} FROM tx",
    "context_lines": """WITH p AS (SELECT *, p_partkey % 3 AS m, 'Company: Apple' || chr(10) || 'Ticker: AAPL' || chr(10) || 'Filing type: 10-K' || chr(10) || 'Source filing: AAPL_10-K_' || p_brand || '.htm' || chr(10) || 'Page: ' || p_size || chr(10) || 'Modality: ' || (['table', 'image', 'text'])[p_partkey % 3 + 1] AS head, 'A pie chart of ' || p_type AS s FROM part)
        SELECT p_partkey, md5(head || chr(10) || CASE m WHEN 0 THEN 'Table summary: ' || s || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE chr(10) || 'Table markdown: |a|b|' END WHEN 1 THEN 'Visual type: pie chart' || chr(10) || 'Visible labels and values: ' || p_brand || ', 7' || chr(10) || 'Image summary: ' || s
            ELSE 'Passage: ' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE s END END) AS lines FROM p""",
    "html_table_rows": "SELECT s_suppkey AS page_id, 0 AS table_index, 0 AS row_index, 'only|words' AS cells FROM supplier UNION ALL SELECT s_suppkey, 1, 0, 'Name|FY23|Net sales' FROM supplier UNION ALL SELECT s_suppkey, 1, 1, s_name || ' total|' || format('{:,}', s_suppkey * 1234) FROM supplier",
    "html_table_values": "SELECT s_suppkey AS page_id, 1 AS table_index, s_name || ' total' AS label, 'Net sales' AS \"column\", format('{:,}', s_suppkey * 1234) AS value FROM supplier",
    "natural_questions": """WITH p AS (SELECT p_partkey, p_name, p_partkey // 3 % 5 AS c, p_partkey % 3 AS f, p_partkey % 2 = 0 AS pct FROM part), m AS (SELECT *, p_name || CASE WHEN c = 0 AND pct THEN ' gross margin percentage' WHEN c = 0 THEN ' gross margin' WHEN c = 1 THEN ' net sales' WHEN c = 3 THEN ' fees' ELSE '' END AS m FROM p)
        SELECT p_partkey, CASE f WHEN 0 THEN 'What was Acme''s ' || m || ' for 2023?' WHEN 1 THEN 'For the period ended May 2024, what was Acme''s ' || m || ' for 2023?' ELSE 'Is ' || p_name || ' sold?' END AS question FROM m""",
    "text_questions": f"""WITH {_TEXTS}, l AS (SELECT doc_id, t, trim(regexp_replace(low, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS l FROM lw) SELECT doc_id, CASE WHEN contains(l, 'net sales') AND (contains(l, 'increased') OR contains(l, 'decreased')) THEN 'What does Acme say drove the change in net sales?'
        WHEN contains(l, 'revenue') AND (contains(l, 'increased') OR contains(l, 'decreased')) THEN 'What does Acme say about revenue performance in this filing?' WHEN contains(l, 'gross margin') THEN 'What does Acme explain about gross margin in this filing?'
        WHEN regexp_matches(l, '\\b(liquidity|cash|cash equivalents)\\b') THEN 'What does Acme disclose about cash or liquidity?' WHEN contains(l, 'risk') AND len(string_split(l, ' ')) > 100 THEN 'What risk factor does Acme discuss in this section?'
        WHEN contains(l, 'segment') AND (contains(l, 'sales') OR contains(l, 'operating')) THEN 'What does Acme disclose about segment performance?' ELSE '' END AS question, '' AS box, regexp_matches(t, '(?i)\\$\\d|\\bbillion\\b|compared to|fiscal 20\\d{{2}}') AS unnatural FROM l""",
    "answer_units": f"""WITH a AS (SELECT l_linenumber AS line, CASE l_linenumber WHEN 1 THEN '2024-01-31' WHEN 2 THEN floor(l_quantity)::INT || '%' WHEN 3 THEN format('{{:,}}', floor(l_extendedprice)::INT) WHEN 4 THEN 'about 4 years' ELSE floor(l_quantity)::INT::VARCHAR END AS a, (['$ in millions', 'in thousands of shares', 'percent of total', 'number of shares in thousands', 'nothing'])[l_partkey % 5 + 1] AS e FROM lineitem),
        k AS (SELECT *, CASE line WHEN 1 THEN 'date' WHEN 2 THEN 'percentage' WHEN 4 THEN 'text' ELSE 'number' END AS kind, regexp_matches(a, '^\\(?-?\\d+(?:\\.\\d+)?%?\\)?$') AS plain FROM a)
        SELECT kind, CASE WHEN (line = 2 OR contains(e, 'percent')) AND plain THEN '%' WHEN contains(e, 'shares') AND NOT contains(e, 'number of shares') THEN 'shares' WHEN contains(e, '$') THEN 'million' WHEN contains(e, 'in thousands') THEN 'thousand' WHEN line = 2 THEN '%' WHEN kind = 'date' THEN 'date' ELSE '' END AS unit, line, count(*) AS n FROM k GROUP BY ALL""",
    "focus_passages": f"""WITH r AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS raw FROM documents), s AS (SELECT doc_id, raw, {_SENTS} AS s FROM r), h AS (SELECT *, list_filter(range(1, len(s) + 1), lambda i: regexp_matches(lower(s[i]), 'zz|the ')) AS a FROM s)
        SELECT doc_id, md5(CASE WHEN length(raw) <= 300 THEN raw WHEN len(s) <= 1 THEN left(raw, 300) WHEN len(a) > 0 THEN left(array_to_string(list_transform(a, lambda i: array_to_string(s[greatest(i - 1, 1):i + 1], ' ')), ' '), 300) ELSE left(array_to_string(s[1:2], ' '), 300) END) AS passage FROM h""",
    "evidence_pages": """WITH l AS (SELECT item_id AS id, 'src' || (item_id % 20) AS doc, list_transform(regexp_extract_all(text, '[a-zA-Z][a-zA-Z]+')[1:2], lambda x: lower(x)) AS w, CASE WHEN item_id % 2 = 0 THEN '12' ELSE '' END AS v FROM benchmark)
        SELECT id, min(doc_id) AS page FROM l JOIN documents d ON d.source = l.doc WHERE (v = '' OR contains(regexp_replace(text, '[,$()]', '', 'g'), v)) AND len(w) > 0 AND len(list_filter(w, lambda x: NOT contains(lower(text), x))) = 0 GROUP BY id""",
    "multimodal_queries": "WITH f AS (SELECT source, min(doc_id) FILTER (doc_id % 3 = 1) AS t, min(doc_id) FILTER (doc_id % 3 = 2) AS i FROM documents GROUP BY source) SELECT doc_id AS query_id, t || ',' || doc_id || ',' || i AS chunk_ids FROM documents JOIN f USING (source) WHERE doc_id % 3 = 0 AND t IS NOT NULL AND i IS NOT NULL",
    "best_chunks": """WITH q AS (SELECT item_id AS id, 'src' || (item_id % 20) AS source, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS w FROM benchmark), d AS (SELECT doc_id, source, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS w FROM documents),
        s AS (SELECT id, doc_id AS chunk_id, round(len(list_intersect(q.w, d.w)) / (len(q.w) + len(d.w) - len(list_intersect(q.w, d.w))), 6) AS score, count(*) OVER (PARTITION BY id) AS n FROM q JOIN d USING (source)) SELECT id, chunk_id, score FROM s WHERE score > 0 OR n = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) = 1""",
    "json_objects": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN (props->>'$.k')::BIGINT END AS k FROM events",
    "labelled_samples": f"""WITH st AS (SELECT DISTINCT sample AS id, entity FROM (SELECT item_id AS sample, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._%$-]*')) AS entity FROM benchmark) WHERE length(entity) >= 10), m AS (SELECT DISTINCT doc_id AS id, entity FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._%$-]*')) AS entity FROM documents) WHERE length(entity) >= 10),
        s AS (SELECT id, array_to_string(list_sort(list(entity)), ',') AS starts FROM st GROUP BY id), e AS (SELECT id, array_to_string(list_sort(list(entity)), ',') AS entities FROM m GROUP BY id) SELECT s.id, starts, CASE WHEN d.doc_id IS NULL THEN '' ELSE 'chunk:' || d.doc_id END AS chunks, coalesce(entities, '') AS entities FROM s LEFT JOIN documents d ON d.doc_id = s.id LEFT JOIN e ON e.id = s.id""",
}
