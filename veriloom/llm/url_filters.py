"""URL filters: host-suffix and path-prefix expressions meet the rules on short hash prefixes; full digests confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that the join compares first.
PREFIX_DIGITS = 8
#: A rule table of at most so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_RULES = 100_000
#: Fixed rules of the query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, most: int) -> Column:
    """The host and all its parents of at most so many parts, longest first."""
    parts = F.split(host, r"\.")
    first = F.greatest(F.size(parts) - most + 1, F.lit(1))
    return F.transform(F.sequence(first, F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def path_prefixes(path: Column, most: int) -> Column:
    """The empty path and the path up to and with each of the first so many slashes."""
    parts = F.split(path, "/", most + 1)
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))


def directory(path: Column) -> Column:
    """The path up to its last slash, slash included; empty without one."""
    return F.regexp_extract(path, "^((?s:.*)/)", 1)


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The verdict of the longest rule that fits each URL: the rule's host is the URL's or a parent of it, and the URL's path starts with the rule's path.

    A URL is expanded into every pair of host suffix and path prefix that ends in a slash, as deep as the deepest rule's
    host and path; a rule has one such key, its host and its path up to the last slash. Keys are joined on the first
    digits of their digests, then full digests, the rest of the path and the longest rule decide. Of equal lengths the
    longer host wins, then block over allow. The join works on distinct (host, path) pairs, so repeated URLs are judged
    once. DataFrame functions only.

    rules: verdict, host, path. Columns: the id, host, path, rule (host and path; null if none fits), verdict (the
    rule's, else default). A null or malformed URL has an empty host and path and the default; rules with null parts
    don't fit; repeated rows each have a row; an empty table of URLs gives no rows, one of rules the default for all; a
    very long URL costs no more expansions than a short one; other columns are ignored.
    """
    src = urls.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = rules.select("verdict", F.col("host").alias("r_host"), F.col("path").alias("r_path")).where("verdict is not null and r_host is not null and r_path is not null").distinct()
    digest = lambda host, start: F.sha2(F.concat_ws("\n", host, start), 256)
    known = known.withColumn("digest", digest(F.col("r_host"), directory(F.col("r_path")))).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    slashes = F.length("r_path") - F.length(F.replace("r_path", F.lit("/"), F.lit("")))
    size = known.agg(F.count("*").alias("n"), F.max(F.size(F.split("r_host", r"\."))).alias("parts"), F.max(slashes).alias("slashes")).head()
    if size["n"] <= BROADCAST_RULES:
        known = F.broadcast(known)
    pairs = src.select("host", "path").distinct()
    keys = pairs.select("host", "path", F.explode(host_suffixes(F.col("host"), size["parts"] or 1)).alias("suffix")).select("host", "path", "suffix", F.explode(path_prefixes(F.col("path"), size["slashes"] or 0)).alias("start"))
    keys = keys.withColumn("full", digest(F.col("suffix"), F.col("start"))).withColumn("short", F.substring("full", 1, PREFIX_DIGITS))
    fits = keys.join(known, "short").where((F.col("full") == F.col("digest")) & (F.col("suffix") == F.col("r_host")) & F.col("path").startswith(F.col("r_path")))
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("verdict"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("verdict").alias("said")), order).alias("best"))
    return src.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.said", F.lit(default)).alias("verdict"))


def fixed_rules(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES) + " AS t(verdict, host, path)")
