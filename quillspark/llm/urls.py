"""URL rules by host suffix and path prefix.

Each URL is expanded into (host suffix, path prefix) expressions; the expressions meet the rules in an equi-join on a
short hash prefix, full digests confirm the hits and the longest rule decides. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rules are broadcast up to this many, of this many bytes in all; beyond, the join shuffles with the rules copied to every salt.
BROADCAST_RULES, BROADCAST_BYTES = 100_000, 32 << 20
SALTS = 32
#: Characters of the hexadecimal SHA-256 that the join compares.
PREFIX_HEX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded; empty without ``://`` or for null."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path).cast("binary"), 256)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", default: str = "allow") -> DataFrame:
    """Each row's host, path, deciding rule and verdict.

    pages: ``key`` and url; rules: host, path, verdict. A rule fits its host and all subdomains when the URL's path
    starts with the rule's path. The longest rule (of host and path together) wins; among equally long ones the
    longer host, then ``allow`` before ``block``, then the rule's text, decide. Repeated rules count once. Rules with
    a null host, path or verdict are left out. Null URLs, and those without ``://``, have an empty host and path and no rule.
    Every row of pages gives one row, repeated and null keys included; other columns are not read. A URL is expanded only into
    suffixes of as many labels and prefixes of such lengths as some rule has, so its cost grows with its length alone.
    """
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null").distinct()
    rules = rules.select(
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        F.length("host").alias("host_length"),
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.struct(_labels(F.col("host")).alias("labels"), F.length("path").alias("length")).alias("shape"),
    )
    # one row: how many labels rule hosts have and how long their paths are; only such suffixes and prefixes can match
    facts = rules.agg(F.count("*").alias("n"), F.sum(F.octet_length("rule")).alias("bytes"), F.sort_array(F.collect_set("shape")).alias("shapes")).first()
    rules = rules.drop("shape")
    urls = pages.select(F.col(key), F.col("url").cast("string").alias("url")).select(
        F.col(key), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("_row")
    )
    if not facts["n"]:
        return urls.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shapes = F.array(*[F.struct(F.lit(int(s["labels"])).alias("labels"), F.lit(int(s["length"])).alias("length")) for s in facts["shapes"]])
    shapes = F.filter(shapes, lambda s: (s["labels"] <= F.col("labels")) & (s["length"] <= F.length("path")))
    expressions = F.transform(shapes, lambda s: F.concat_ws("\n", F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.substring("path", F.lit(1), s["length"])))
    urls = urls.withColumn("labels", _labels(F.col("host")))
    # one row for each URL and expression; a URL without any, or with an empty host, keeps one row with a null digest
    seen = urls.withColumn("e", F.explode_outer(F.when(F.col("host") != "", expressions))).withColumn("digest", F.sha2(F.col("e").cast("binary"), 256)).drop("e", "labels")
    seen = seen.withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    rules = rules.withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))
    if facts["n"] <= BROADCAST_RULES and facts["bytes"] <= BROADCAST_BYTES:
        hits = seen.join(F.broadcast(rules), "short", "left")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = seen.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"], "left")
    order = F.struct(F.length("rule").alias("a"), F.col("host_length").alias("b"), (F.col("rule_verdict") == "allow").alias("c"), F.col("rule").alias("rule"), F.col("rule_verdict").alias("rule_verdict"))
    # rows of one URL meet in one task already, so this shuffles one row for each URL
    best = hits.groupBy("_row", key, "host", "path").agg(F.max(F.when(F.col("digest") == F.col("rule_digest"), order)).alias("best"))
    return best.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
