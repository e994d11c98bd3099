"""Operator 4: URL filter rules by a sort-merge range join (native).

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's.
Each url is probed once for every suffix of its host at a label border, of at most as many labels as a
rule has, so a rule becomes one
interval over canonical keys: reversed host, a zero byte, path prefix. Prefix intervals nest or are
disjoint. Rule starts, rule ends and probes are sorted by key; the sweep carries the stack of active
rules as its top, and each rule knows the rule below it on the stack (``parents``). The sweep runs
over key ranges in parallel: each range starts from the top that the ranges before it leave, which
is a prefix scan over one row for each range. Of the rules found for the suffixes of one host the
longest wins (host and path together; ties go to the longer host).

Urls are folded to distinct (host, path) first and joined back at the end, so a host or url that a
third of all rows share is swept once; the join back may split hot keys (adaptive skew join).

A null url, or one without ``://``, has empty host and path, no rule and the default verdict. Page
rows are never merged: repeated rows and null page_ids come back as often as they came. An empty
rule table gives every url the default verdict. Duplicate rules: block wins over allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import stage, table, width, work_dir

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    # (?s) with \z: line breaks belong to hosts and paths like any other character
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return host, path


def _key(labels: Column, path: Column) -> Column:
    """Canonical key: labels from the top level down, each ended by a dot, a zero byte, the path."""
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("\x00"), path).cast("binary")


def parents(rules: DataFrame) -> DataFrame:
    """``rules`` (id, host, path, key) with the id of the rule below each on the stack, or null.

    Within one host a rule's depth is the number of starts less the number of ends before it; its
    parent is the latest rule before it that is one less deep."""
    ends = rules.select("host", F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(-1).alias("turn"), F.lit(None).cast("long").alias("id"))
    events = rules.select("host", "key", F.lit(1).alias("turn"), "id").unionByName(ends)
    at = Window.partitionBy("host").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = events.withColumn("depth", F.sum("turn").over(at)).where("turn = 1")
    asks = starts.select("host", "key", "id", (F.col("depth") - 1).alias("level"), F.lit(None).cast("long").alias("open"))
    gives = starts.select("host", "key", "id", F.col("depth").alias("level"), F.col("id").alias("open"))
    before = Window.partitionBy("host", "level").orderBy("key", F.col("open").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = asks.unionByName(gives).withColumn("parent", F.last("open", ignorenulls=True).over(before))
    return rules.join(known.where("open IS NULL").select("id", "parent"), "id")


def numbered(rules: DataFrame) -> DataFrame:
    """Distinct rules with an id that follows from their text alone."""
    one = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    return one.select("host", "path", "verdict", F.concat("host", "path").alias("rule"), F.xxhash64("host", "path").alias("id"), _key(F.split("host", r"\."), F.col("path")).alias("key"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` holds distinct (host, path); returns host, path, rule, verdict where a rule fits."""
    spark = urls.sparkSession
    folder = work_dir(spark, "url-rules")
    rules = stage(parents(numbered(rules)), f"{folder}/rules")
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    # a suffix of more labels than any rule has fits none: what a host of any length costs is bounded by the rules
    labels = F.split("host", r"\.")
    labels = F.slice(labels, F.greatest(F.lit(1), F.size(labels) - F.lit(most - 1)), F.lit(most))
    suffix = F.expr("transform(sequence(1, size(labels)), i -> slice(labels, i, size(labels) - i + 1))")
    probes = urls.where((F.col("host") != "") & F.lit(most > 0)).withColumn("labels", labels).select("host", "path", F.explode(suffix).alias("labels"))
    probe = probes.select(_key(F.col("labels"), F.col("path")).alias("key"), F.lit(1).alias("turn"), F.lit(None).cast("long").alias("top"), "host", "path")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("host", "path")]
    # a start shows its rule as the top, an end the rule below; 0 stands for an empty stack
    starts = rules.select("key", F.lit(0).alias("turn"), F.col("id").alias("top"), *nothing)
    ends = rules.select(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(-1).alias("turn"), F.coalesce("parent", F.lit(0)).cast("long").alias("top"), *nothing)
    events = probe.unionByName(starts).unionByName(ends)
    # ranges of keys; written once, so that a recomputed sample cannot move their borders
    # (the hash lets a border fall between equal keys, so a path that very many hosts share is dealt out too)
    ranged = events.repartitionByRange(width(spark), "key", "turn", F.xxhash64("host", "path")).withColumn("part", F.spark_partition_id())
    ranged = stage(ranged, f"{folder}/events")
    last = ranged.where("top IS NOT NULL").groupBy("part").agg(F.max_by("top", F.struct("key", "turn")).alias("left"))
    every = ranged.select("part").distinct().join(last, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried = every.select(F.col("part"), F.last("left", ignorenulls=True).over(before).alias("carry"))
    sweep = Window.partitionBy("part").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.withColumn("seen", F.last("top", ignorenulls=True).over(sweep)).where("host IS NOT NULL")
    found = swept.join(F.broadcast(carried), "part").select("host", "path", F.coalesce("seen", "carry", F.lit(0)).alias("id"))
    best = found.where("id <> 0").join(rules.select("id", "rule", "verdict", F.length("host").alias("h")), "id")
    return best.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "h", "rule")).alias("best")).select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    found = match(rows.select("host", "path").distinct(), rules)
    return rows.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


ORACLE = r"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (SELECT page_id, host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
  FROM cut LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM best
"""
