"""The latest other row of a group, without pairs."""

import random

from tessera.operators.relational import latest_other


def test_latest_other_is_that_of_all_pairs(spark):
    r = random.Random(4)
    rows = [(f"a{k:03d}", r.choice(["s1", "s2", "s3", None])) for k in range(60)] + [("lone", "s9"), ("none", "s8")]
    among = [(k, g, n) for n, (k, g) in enumerate(rows) if r.random() < 0.4 or k == "lone"] + [("x", "s1", None)]
    got = latest_other(spark.createDataFrame(rows, "id string, g string"), spark.createDataFrame(among, "id string, g string, at int"), "g", "id", "at", "anchor")
    want = {k: max((n, c) for c, h, n in among if h == g and c != k and n is not None)[1] for k, g in rows if any(h == g and c != k and n is not None for c, h, n in among) and g}
    assert dict(map(tuple, got.collect())) == want


def test_a_group_is_met_once(spark):
    """Of 300 rows that all are candidates in one group, 90,000 pairs were made before."""
    rows = spark.range(300).selectExpr("concat('k', id) AS id", "'g' AS g", "id AS at")
    out = latest_other(rows, rows, "g", "id", "at", "anchor")
    assert {r.anchor for r in out.where("id <> 'k299'").collect()} == {"k299"} and out.where("id = 'k299'").first().anchor == "k298"
