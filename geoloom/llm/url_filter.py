"""URL filters: host and path rules, and trust that spreads over links between hosts.

Rules name a host, meant with its subdomains, and the start of a path; the longest that fits decides.
Pages without a rule are judged by their host.  Each host's share of pages that rules allow seeds
trust, the share that rules block seeds distrust.  Trust follows links (personalised PageRank: a
host hands on DAMPING of its trust in the proportion of its links), distrust runs against them (a
host gets that of the hosts it links to).  A host is blocked when its distrust exceeds its trust by
more than THRESHOLD; a difference within MARGIN of it counts as equal, so a tie - and sums whose last digits hang on
their order - allows.  Links are the absolute and scheme-less hrefs of the pages' html; those within a
host don't count.

Everything is DataFrame work.  Links are counted per pair of hosts before any join, both flows share
one join and one aggregation a round, and every round is written to the shared folder.  A round hands on what the
one before it added.  As all the trust added shrinks by DAMPING a round, and so does the most distrust that
a host gets, what later rounds can still add to any host is bounded; rounds end when it can't change any host's
verdict, or is below TOLERANCE.  Without links between hosts the seeds are the fixed point and no round runs.  Links of a
hub and pages of one host are not gathered in a task (`join_hot`).

Nulls: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed;
null html has no links.  Null and repeated page_ids are rows of their own.  A host of repeated rows
counts each.  An empty table gives no rows; other columns are not read."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, table

#: verdict, host, start of the path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, TOLERANCE, THRESHOLD, MAX_RULES = 0.85, 1e-10, 0.05, 1000
#: Differences of scores up to this are rounding: far above what sums of float64 shares lose, and above what rounds leave out at TOLERANCE.
MARGIN = 1e-9
#: Rounds after which what was added is joined to the totals and the verdicts are looked at.
LOOK = 8
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    raw = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null.  Rules are part of the plan, so
    they are MAX_RULES at most."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = F.lit(None)
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: links between unlike hosts."""
    low = F.translate(F.col("to"), string.ascii_uppercase, string.ascii_lowercase)
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), 1)).alias("to"))
    return links.select("src", low.alias("dst")).where("src != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def seeds(judged: DataFrame) -> DataFrame:
    """host, trust, distrust: the shares of a host's pages that rules allow and block."""
    share = lambda v: F.sum((F.coalesce(F.col("found.verdict"), F.lit("")) == v).cast("int")) / F.count("*")
    return judged.where("host != ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))


def spread(seeded: DataFrame, links: DataFrame, threshold: float = THRESHOLD, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust at the end of the rounds: below the fixed point by less than the tolerance, or
    by less than would bring any host's distrust less trust to the other side of the threshold and its margin."""
    total = table(seeded.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust")), "seeds")
    links = table(links, "links")
    if not links.limit(1).count():
        return total
    out = links.groupBy("src").agg(F.sum("n").alias("total"), F.count("*").alias("n"))
    hubs = hot_keys(out, ["src"], links.count())
    share = join_hot(links, out.drop("n"), ["src"], hubs).select("src", "dst", (F.col("n") / F.col("total") * damping).alias("w"))
    ways = share.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.col("w").alias("wt"), F.lit(0.0).alias("wd"))
    ways = table(ways.union(share.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("wt"), F.col("w").alias("wd"))), "ways")
    hubs = hot_keys(ways.groupBy("host").agg(F.count("*").alias("n")), ["host"], ways.count())
    sums = [F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")]
    added, new = [], total
    while True:
        moved = join_hot(ways, new, ["host"], hubs).select(F.col("to").alias("host"), (F.col("trust") * F.col("wt")).alias("trust"), (F.col("distrust") * F.col("wd")).alias("distrust"))
        new = table(moved.groupBy("host").agg(*sums), "added")
        added.append(new)
        left = new.agg(F.sum("trust").alias("trust"), F.max("distrust").alias("distrust")).first()
        bound = ((left["trust"] or 0.0) + (left["distrust"] or 0.0)) * damping / (1 - damping)
        if bound <= tolerance or len(added) == LOOK:
            total = table(reduce(DataFrame.union, added, total).groupBy("host").agg(*sums), "spread")
            added = []
            if bound <= tolerance or not total.where(F.abs(F.col("distrust") - F.col("trust") - threshold - MARGIN) <= bound).limit(1).count():
                return total


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust as far as the verdicts called for them."""
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = rows.withColumn("found", best_rule(F.col("host"), F.col("path"), rules))
    scores = spread(seeds(judged), host_links(pages, url_col, html_col), threshold, damping)
    counts = table(rows.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    whole = join_hot(judged, scores, ["host"], hot_keys(counts, ["host"], counts.agg(F.sum("n")).first()[0] or 0), "left")
    own = F.when(F.coalesce(F.col("distrust"), F.lit(0.0)) - F.coalesce(F.col("trust"), F.lit(0.0)) - threshold > MARGIN, "block").otherwise("allow")
    return whole.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


#: Rounds of the SQL, which can't look at its own progress: what is left is below 1e-10 of the mass.
_SQL_ROUNDS = 160


def _oracle() -> str:
    pattern = _LINK.replace("'", "''")
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    return f"""
WITH RECURSIVE rules(verdict, rh, rp) AS (VALUES {rules}),
p AS (SELECT page_id, html, row_number() OVER () AS row, coalesce(regexp_extract({rest}, '^([^/?#]*)', 1), '') AS raw,
             coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT page_id, html, row, path, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host FROM p),
f AS (SELECT row, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict FROM h JOIN rules
      ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY row),
j AS (SELECT page_id, html, host, path, rule, verdict FROM h LEFT JOIN f USING (row)),
l AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{pattern}', 1)),
      '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS dst FROM j) WHERE src <> '' AND src <> dst GROUP BY ALL),
ways AS (SELECT src, dst, CAST({DAMPING} AS DOUBLE) * n / sum(n) OVER (PARTITION BY src) AS w FROM l),
r(n, host, trust, distrust) AS (
    SELECT 0, host, CAST({1 - DAMPING} AS DOUBLE) * count(*) FILTER (verdict = 'allow') / count(*),
           CAST({1 - DAMPING} AS DOUBLE) * count(*) FILTER (verdict = 'block') / count(*) FROM j WHERE host <> '' GROUP BY host
    UNION ALL SELECT n + 1, host, sum(trust), sum(distrust) FROM (
        SELECT r.n, dst AS host, trust * w AS trust, CAST(0 AS DOUBLE) AS distrust FROM r JOIN ways ON host = src
        UNION ALL SELECT r.n, src, CAST(0 AS DOUBLE), distrust * w FROM r JOIN ways ON host = dst) WHERE n < {_SQL_ROUNDS} GROUP BY n, host),
s AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM r GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) - {THRESHOLD} > {MARGIN}
       THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN s ON j.host = s.host
"""


ORACLE_SQL = _oracle()


def op8_link_graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and link-graph verdicts for all pages."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("trust", "distrust")
