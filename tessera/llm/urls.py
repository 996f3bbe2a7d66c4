"""URL verdicts: rules first, else link-graph propagation of trust and distrust.

Edges join the hosts of pages to the hosts of absolute links in their HTML, and each host to its parent domain and back,
up to the name of two labels, whether or not the parents have pages (host names nest, so a site's parts vouch for each
other). Trust is a personalised PageRank along edges from all hosts with pages that rules allow, weighed by their number;
distrust is one against the edges from all hosts with pages that rules block. A host is blocked where distrust outweighs
trust; without either it is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.tables import table
from tessera.operators.joins import left_join_unique
from tessera.session import discard, free_shuffles, written


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
DAMPING = 0.85
#: Rounds between two tests of convergence.
ROUNDS = 8
#: Propagation goes on until ROUNDS more change the scores by less than this in sum, counted in seed pages.
TOLERANCE = 1e-3
#: A host is blocked where distrust exceeds this many times its trust.
RATIO = 1.0
#: Outgoing edges of a host that one task takes at a time; a host with more has its edges dealt, and its score repeated.
HUB = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The name of the longest rule that fits (of equal lengths the first by name), else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def host_graph(pages: DataFrame) -> DataFrame:
    """(src, dst, w): weighted host edges without loops, from (host, html); links count, containment counts as one."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]+)"""), F.lit(1))).alias("url"))
    links = written(links.select("src", host_of(F.col("url")).alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")), "host-links")
    hosts = pages.select("host").union(links.select("dst")).distinct()
    parts = F.split("host", r"\.")
    name = lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts) - 2), lambda i: F.struct(name(i).alias("src"), name(i + 1).alias("dst")))
    parents = hosts.where(F.size(parts) > 2).select(F.inline(steps)).distinct()
    nested = parents.withColumn("w", F.lit(1.0))
    nested = nested.union(nested.select("dst", "src", "w"))
    return links.union(nested).where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank from (host, trusted, blocked), both scaled to sum to one.

    Mass at hosts without outgoing edges is lost. Without a number of rounds it goes on until ROUNDS more reach no new host
    and change each score's sum over all hosts by less than tolerance seed pages (the rest is then below 0.4 of that);
    damping must be below one. Scores are rounded at the end, to 9 significant digits, so order doesn't show. A hub's edges
    are dealt over parts of HUB edges, which its score meets in as many tasks.
    """
    spark = edges.sparkSession
    both = edges.select(F.lit("trust").alias("way"), "src", "dst", "w").union(edges.select(F.lit("distrust"), "dst", "src", "w"))
    both = both.withColumn("key", F.concat_ws(" ", "way", "src"))
    out = written(both.groupBy("key", "way", "src").agg(F.sum("w").alias("total"), F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / HUB).cast("int")), "host-degrees")
    shares = left_join_unique(both, out, "key", "n", ["total", "parts"])
    both = written(shares.select("way", "src", "dst", (F.col("w") / F.col("total")).alias("p"), F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part")), "host-edges")
    hubs = out.where("parts > 1").select("way", F.col("src").alias("host"), "parts")
    dealt = not hubs.isEmpty()

    def spread(rank: DataFrame) -> DataFrame:
        """(way, host, r, part): a row for each part of the host's edges."""
        if not dealt:
            return rank.select("way", "host", "r", F.lit(0).alias("part"))
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        return rank.join(hubs, ["way", "host"], "left").select("way", "host", "r", parts.alias("part"))

    totals = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trusted") / F.lit(float(totals.t or 1) or 1.0), F.lit("distrust"), F.col("blocked") / F.lit(float(totals.b or 1) or 1.0))).alias("way", "seed"))
    start = written(start.where("seed > 0"), "seeds")
    rank, done = start.select("way", "host", F.col("seed").alias("r")), 0
    pages = {"trust": float(totals.t or 1) or 1.0, "distrust": float(totals.b or 1) or 1.0}
    kept = start.select("way", "host", (F.col("seed") * (1 - damping)).alias("r"), F.lit(0.0).alias("before"))
    while done != rounds:
        block, now = rank, ROUNDS if rounds is None else min(ROUNDS, rounds - done)
        for k in range(now):
            moved = spread(block).join(both.withColumnRenamed("src", "host"), ["way", "host", "part"]).select("way", F.col("dst").alias("host"), (F.col("r") * F.col("p") * damping).alias("r"), F.lit(0.0).alias("before"))
            every = moved.union(kept)
            every = every.union(rank.select("way", "host", F.lit(0.0), "r")) if k == now - 1 else every
            block = every.groupBy("way", "host").agg(F.sum("r").alias("r"), F.sum("before").alias("before"))
        block = written(block, "ranks")
        moves = block.groupBy("way").agg(F.sum(F.abs(F.col("r") - F.col("before"))).alias("change"), F.count_if((F.col("before") == 0) & (F.col("r") > 0)).alias("fresh")).collect()
        discard(rank)
        rank, done = block, done + now
        free_shuffles(spark)  # and what the driver held for the joins' broadcasts
        if rounds is None and all(m.change * pages[m.way] < tolerance and not m.fresh for m in moves):
            break
    score = lambda way: F.format_string("%.8e", F.sum(F.when(F.col("way") == way, F.col("r")).otherwise(0.0))).cast("double").alias(way)
    return rank.groupBy("host").agg(score("trust"), score("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, ratio: float = RATIO) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, trust, distrust.

    A null url, or one without ://, has an empty host and path, fits no rule and is allowed. Rows that repeat get equal
    rows; null html has no links. An empty table gives an empty result; other columns are not looked at.
    """
    url = F.col("url")
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), "html")
    action = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.action)))
    named = parsed.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"))
    counted = named.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(action[F.col("rule")] == "allow").alias("trusted"), F.count_if(action[F.col("rule")] == "block").alias("blocked"))
    hosts = written(counted, "hosts")
    ranks = propagate(host_graph(parsed.select("host", "html")), hosts)
    judged = written(hosts.join(ranks, "host", "left").select("host", "pages", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "judged")
    out = left_join_unique(named, judged, "host", "pages", ["trust", "distrust"])
    method = F.when(F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)) * ratio, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce(action[F.col("rule")], method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: The rules, the graph, and 150 rounds of both ranks (0.85 ** 150 of the mass is then still under way).
OP5_SQL = """
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, html FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, html FROM u),
f AS (SELECT page_id, host, path, html, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h),
a AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS act FROM f),
li AS (SELECT host AS src, translate(regexp_extract(unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*["'']?([a-z][a-z0-9+.-]*://[^"''\\s>]+)', 1)), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM h),
lw AS (SELECT src, dst, count(*)::DOUBLE AS w FROM li GROUP BY ALL),
hs AS (SELECT DISTINCT host FROM (SELECT host FROM h UNION ALL SELECT dst FROM lw)),
ch AS (SELECT host AS src, regexp_replace(host, '^[^.]*\\.', '') AS dst FROM hs WHERE len(string_split(host, '.')) > 2 UNION SELECT dst, regexp_replace(dst, '^[^.]*\\.', '') FROM ch WHERE len(string_split(dst, '.')) > 2),
ed AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM lw UNION ALL SELECT src, dst, 1.0::DOUBLE FROM ch UNION ALL SELECT dst, src, 1.0::DOUBLE FROM ch) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
bo AS (SELECT 'allow' AS way, src, dst, w FROM ed UNION ALL SELECT 'block', dst, src, w FROM ed),
pr AS (SELECT way, src, dst, w / sum(w) OVER (PARTITION BY way, src) AS p FROM bo),
sc AS (SELECT act AS way, host, count(*) AS c FROM a WHERE act IS NOT NULL AND host <> '' GROUP BY act, host), se AS (SELECT way, host, c / sum(c) OVER (PARTITION BY way) AS s FROM sc),
rk AS (SELECT 0 AS k, way, host, s AS r FROM se UNION ALL SELECT k, way, host, sum(r) AS r FROM (SELECT rk.k + 1 AS k, rk.way, pr.dst AS host, rk.r * pr.p * 0.85::DOUBLE AS r FROM rk JOIN pr ON pr.way = rk.way AND pr.src = rk.host WHERE rk.k < 150 UNION ALL SELECT DISTINCT rk.k + 1, se.way, se.host, se.s * 0.15::DOUBLE FROM rk CROSS JOIN se WHERE rk.k < 150) GROUP BY ALL),
fi AS (SELECT host, coalesce(sum(r) FILTER (way = 'allow'), 0) AS t, coalesce(sum(r) FILTER (way = 'block'), 0) AS b FROM rk WHERE k = 150 GROUP BY host)
SELECT page_id, a.host, path, rule, coalesce(act, CASE WHEN coalesce(b, 0) > coalesce(t, 0) * (1 + 1e-9) THEN 'block' ELSE 'allow' END) AS verdict FROM a LEFT JOIN fi ON fi.host = a.host
"""
