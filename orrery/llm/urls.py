"""URL filters: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, full digests, rule precedence."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Hexadecimal digits of the digest that rules and expressions are joined on.
PREFIX_DIGITS = 8
#: Up to so many rules are broadcast (some 200 bytes each); more are joined by shuffles, salted.
BROADCAST_RULES = 100_000
SALTS = 16


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (verdict, host, path) triples."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _expression(host: str, path: str):
    return F.sha2(F.concat(F.col(host), F.lit("\0"), F.col(path)).cast("binary"), 256)


def url_verdicts(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Judges each row's URL: (key, host, path, rule, verdict), one row per input row.

    Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
    ``#`` or the end. A null URL or one without ``://`` has both empty. A rule (verdict, host, path) fits its host and all
    subdomains if the URL's path starts with the rule's. Of several the longest (host and path together) wins, then the longer
    host, then ``block``. Without any the verdict is ``default`` and rule is null. Rules with a null part are void.

    Each distinct (host, path) is expanded once, into the suffixes and prefixes of the sizes that occur among the rules: a path
    length of a rule at a time, by a join on the number of labels. Repeated rows are judged alike and all returned; an empty table gives an empty result; other
    columns of ``pages`` are not looked at, whatever their names.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    lower = F.translate(F.regexp_extract("_url", r"(?s)^.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    rows = rows.select(
        "_key",
        F.coalesce(lower, F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("_url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )
    listed = rules.select("verdict", "host", "path").where("verdict is not null and host is not null and path is not null")
    listed = listed.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block beats allow
    listed = listed.select(
        F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("chars"), F.length("host").alias("r_host"),
        F.concat("host", "path").alias("rule"), "verdict", _expression("host", "path").alias("r_digest"),
    )
    sizes = cut(listed.groupBy("labels").agg(F.collect_set("chars").alias("chars")))  # a row for each number of labels, of a known size
    places = rows.select("host", "path").distinct().withColumn("parts", F.split("host", r"\.", -1))
    exploded = places.withColumn("labels", F.explode(F.sequence(F.lit(1), F.size("parts")))).join(sizes, "labels")
    exploded = exploded.withColumn("chars", F.explode("chars")).where("length(path) >= chars")
    exploded = exploded.select(
        "host", "path",
        F.expr("array_join(slice(parts, size(parts) - labels + 1, labels), '.')").alias("_suffix"),
        F.expr("substring(path, 1, chars)").alias("_start"),
    )
    exploded = exploded.select("host", "path", _expression("_suffix", "_start").alias("digest"))
    exploded = exploded.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    listed = listed.withColumn("r_prefix", F.substring("r_digest", 1, PREFIX_DIGITS))
    on = F.col("prefix") == F.col("r_prefix")
    if listed.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        met = exploded.join(F.broadcast(listed), on)
    else:  # one expression may stand for a third of all pages
        exploded = exploded.withColumn("salt", F.pmod(F.hash("host", "path"), F.lit(SALTS)))
        listed = listed.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = exploded.join(listed, on & (F.col("salt") == F.col("r_salt")))
    met = met.where("digest = r_digest")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "r_host", "verdict", "rule")).alias("best"))
    # Written and not broadcast, as it grows with the pages; so Spark may split a place with a third of all pages.
    judged = rows.join(cut(best).hint("merge"), ["host", "path"], "left")
    return judged.select(
        F.col("_key").alias(key), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


#: The rules of the registered query, given by its contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark, RULES))


OP10_SQL = r"""
WITH rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
    ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
p AS (
  SELECT row_number() OVER () AS r, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
m AS (
  SELECT p.*, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, verdict DESC) AS best
  FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE best = 1
"""
