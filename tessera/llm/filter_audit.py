"""Operator 13: audit of how filters interact, in every order.

Each row gets a five-bit mask of the filters that it fails, by native expressions. All that is asked
of an order of filters is a sum over the 32 masks: what a step removes are the rows whose mask holds
its bit and none of the bits before. So rows are counted once in at most 32 cells a part, and the 120
orders with their five steps are enumerated from cells.

Whether a text was seen before is a question to all rows: a groupBy of texts, by their SHA-256, gives
each text its smallest doc_id, and a row fails where its own is larger. Rows are first folded by
(text, part, labels), each task its own, so a text that a third of all rows share reaches the shuffle
as a row for each task and part. Texts themselves are never shuffled.

A null text counts as empty: it fails ``A`` (no words) and may fail ``E``. A null lang is the part ''.
A row without doc_id has no labels and never fails ``E``; rows that repeat a doc_id are not copies of
one another. Labels that repeat a doc_id count if any of them is 1. An empty table has no parts and gives no
rows. Columns beside doc_id, text and the part are not read."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import WORD, gathered, table

LETTERS = "ABCDE"
_NULLS = 1024  # hash classes of rows without doc_id


def text_mask(text: Column) -> Column:
    """Bits 0 to 3 for the filters A to D, which look at one text alone."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    count = F.size(words)
    fails = (
        count < 100,
        F.size(F.array_distinct(words)) * F.lit(100).cast("long") < count * F.lit(80).cast("long"),
        F.regexp_count(text, F.lit("[A-Z]")) * F.lit(100).cast("long") > F.char_length(text) * F.lit(10).cast("long"),
        text.rlike(r"[#$%&*|]"),
    )
    mask = F.lit(0)
    for k, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << k).otherwise(0)
    return mask


def cells(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """part, mask, rows, good, toxic: the histogram of masks of each part."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part, F.lit("")).alias("part"), F.sha2(text, 256).alias("sha"), text_mask(text).alias("mask"))
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("sha"), F.lit(_NULLS))).otherwise(0))
    flag = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    marks = marks.withColumn("spread", F.lit(0).cast("long"))
    marked = rows.join(marks, ["doc_id", "spread"], "left").na.fill(0, ["good", "toxic"])
    kinds = ["sha", "part", "good", "toxic"]
    own = marked.groupBy("doc_id", "spread", *kinds, "mask").agg(F.count("*").alias("n"))
    folded = own.groupBy(*kinds, "mask").agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("sha"))  # a row for each part and pair of labels
    fresh = F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    split = folded.withColumn("fresh", fresh)
    either = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("fresh").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("fresh")).alias("n"))))
    counted = split.select("part", "good", "toxic", either.alias("c")).where("c.n > 0")
    return counted.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("rows"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def orders(cell: DataFrame) -> DataFrame:
    """What each step of each order of the filters keeps and removes: 600 rows a part."""
    steps = []
    for order in permutations(LETTERS):
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << LETTERS.index(letter)
            steps.append(("".join(order), k + 1, before, bit))
            before |= bit
    literal = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"b":{b},"f":{f}}}' for o, s, b, f in steps) + "]"), "array<struct<o:string,s:int,b:int,f:int>>")
    each = cell.select("*", F.inline(literal))
    passed, failing = F.col("mask").bitwiseAND(F.col("b")) == 0, F.col("mask").bitwiseAND(F.col("f")) != 0
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).alias
    out = each.groupBy("part", F.col("o").alias("filter_order"), F.col("s").alias("step"), "f").agg(
        total("rows", passed & ~failing)("kept"),
        total("rows", passed & failing)("removed"),
        total("rows", ~passed & failing)("redundant"),
        total("rows", F.col("mask") == F.col("f"))("unique_fails"),
        total("good", passed & failing)("good_lost"),
        total("toxic", passed & failing)("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "f"))).drop("f")


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders(cells(docs, labels, F.col(part)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gathered(filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE = r"""
WITH first AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY ALL),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
rows AS (
    SELECT coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(doc_id > least, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM documents d JOIN first f ON f.t = coalesce(d.text, '') LEFT JOIN marks USING (doc_id)),
parsed AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM rows),
failed AS (
    SELECT part, good, toxic, (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END)
        || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails FROM parsed),
grouped AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
every AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS f, filter_order[:step - 1] AS b FROM every, range(1, 6) s(step)),
judged AS (
    SELECT *, len(list_intersect(string_split(fails, ''), string_split(b, ''))) = 0 OR b = '' OR fails = '' AS passed, contains(fails, f) AS failing FROM grouped, steps),
summed AS (
    SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (passed AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (passed AND failing), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (NOT passed AND failing), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (passed AND failing), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (passed AND failing), 0)::BIGINT AS toxic_lost
    FROM judged GROUP BY ALL)
SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM summed
"""
