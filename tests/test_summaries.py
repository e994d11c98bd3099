"""First lines as summaries, and the order of links that weigh the same."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessera.operators import text as x
from tessera.plans import relational


@pytest.mark.parametrize(
    "content, summary",
    [
        ("costs 100", "costs 100"),
        ("0 apples\nx", "0 apples"),
        ("   \n  11 pears 11  \nx", "11 pears 11"),
        ("# a\n  # b\n 2 plums 2 ", "2 plums 2"),
        ("y" * 159 + "00", "y" * 159 + "0…"),
        (None, ""),
    ],
)
def test_lines_lose_spaces_and_nothing_else(spark, content, summary):
    assert spark.createDataFrame([(content,)], "c string").select(x.derive_summary(F.col("c"))).first()[0] == summary


@pytest.mark.parametrize("turned", [False, True])
def test_links_of_one_weight_have_one_order(spark, turned):
    rows = [("N1", "N2", 0.7), ("N2", "N1", 0.7), ("N4", "N3", 0.9), ("N3", "N4", 0.9), ("N4", "N5", 0.9)]
    rows = [(a, b, "similar_to", "system", w, None) for a, b, w in (rows[::-1] if turned else rows)]
    edges = spark.createDataFrame(rows, "src string, dst string, type string, provenance string, weight double, invalidated_ms long").coalesce(1)
    store = SimpleNamespace(edges=edges)
    ranks = {(r.a, r.src, r.dst): r["rank"] for r in relational.ranked_links(store).collect()}
    assert ranks == {("N1", "N1", "N2"): 1, ("N1", "N2", "N1"): 2, ("N2", "N1", "N2"): 1, ("N2", "N2", "N1"): 2, ("N3", "N3", "N4"): 1, ("N3", "N4", "N3"): 2, ("N4", "N3", "N4"): 1, ("N4", "N4", "N3"): 2, ("N4", "N4", "N5"): 3, ("N5", "N4", "N5"): 1}
    ranked = {tuple(r) for r in relational.ranked_links(store).groupBy("src", "dst").agg(F.min("rank").alias("n")).where("n > 1").select("src", "dst").collect()}
    assert ranked == {("N2", "N1"), ("N4", "N3")}
