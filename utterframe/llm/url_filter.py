"""URL filtering by hashed host-suffix and path-prefix expressions.

Each url is expanded into expressions: the suffixes of its host by labels, with the prefixes of its
path, only of the lengths that some rule has, so the expansion is bounded by the rules and not by the
url.  Expressions meet the rules
by an equi-join on the first bytes of their SHA-256, full digests confirm, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Of a url that no rule fits: nothing is held against it.
DEFAULT = "allow"
#: Hex digits of the digest that are joined on.
PREFIX = 8
#: Rules up to this number are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``(rule_host, rule_path, rule_verdict)`` with host A-Z lower-cased."""
    return spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, rule_verdict string")


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both are empty if the url is null or has no ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return df.withColumn("host", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn("path", path)


def judge_urls(df: DataFrame, rules: DataFrame, keys: Sequence[str] = ("page_id",), url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``keys``, the url, and ``host``, ``path``, ``rule`` (host + path of the rule, else null) and ``verdict``, a row for each row of ``df``.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest
    rule wins (of its text, then the longer host, then the smaller text, then ``block``).  Rules with a
    null part are ignored.  Rows with equal keys and url share one look-up and come back as often as
    they were; nulls are keys like others.  Urls that are null, empty or without ``://`` have empty
    host and path and fit no rule with a host.  Other columns are left out; no rows give no rows.
    """
    rules = rules.dropna().select(
        "rule_host", "rule_path", F.lower("rule_verdict").alias("rule_verdict"), F.concat("rule_host", "rule_path").alias("rule")
    ).withColumn("digest", F.sha2("rule", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX))
    # bounded by the longest rule
    of = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_host")).alias("hosts"), F.collect_set(F.length("rule_path")).alias("paths")).first()
    lits = lambda xs: F.array(*map(F.lit, sorted(xs))) if xs else F.array().cast("array<int>")
    rows = split_url(df.groupBy(*keys, url_col).agg(F.count("*").alias("__copies")), url_col)
    labels = F.sequence(F.lit(1), F.least(F.lit(of["labels"] or 1), F.size(F.split("host", r"\."))))
    suffixes = F.filter(F.transform(labels, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n)), lambda h: F.array_contains(lits(of["hosts"]), F.length(h)))
    prefixes = F.transform(F.filter(lits(of["paths"]), lambda n: n <= F.length("path")), lambda n: F.left(F.col("path"), n))
    expressions = F.array_distinct(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))
    rows = rows.withColumn("expression", F.explode_outer(expressions))
    rows = rows.withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX))
    rules = rules.withColumnRenamed("digest", "full")
    on = ["prefix"]
    if rules.count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    else:
        # an expression that many urls share is dealt to as many tasks as the shuffle has
        salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64(*keys, url_col), F.lit(salts)).cast("int"))
        rules = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on += ["salt"]
    fits = (F.col("digest") == F.col("full")) & (F.length("host") >= F.length("rule_host")) & F.endswith("host", "rule_host") & F.startswith("path", "rule_path")
    best = F.when(fits, F.struct(F.length("rule"), F.length("rule_host"), F.col("rule"), F.col("rule_verdict")))
    found = rows.join(rules, on, "left").groupBy(*keys, url_col, "host", "path", "__copies").agg(F.max(best).alias("best"))
    found = found.withColumn("__copies", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return found.select(*keys, url_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"))


#: The same result in DuckDB, for the rules above.
ORACLE_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u
), r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path,
       (SELECT arg_max(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
       coalesce((SELECT arg_max(v, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM p
"""
