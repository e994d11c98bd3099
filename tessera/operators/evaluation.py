"""Retrieval-log analytics and ranking evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def surfacings(log: DataFrame, n: int, shown: int = 5) -> DataFrame:
    """event_id, session_id, ts, rank, id of what each search showed; ``n`` nodes in all."""
    rank = F.explode(F.sequence(F.lit(0), F.lit(shown - 1)))
    return log.where("action = 'search'").select("event_id", "session_id", "ts", "base", rank.alias("rank")).select("event_id", "session_id", "ts", "rank", ((F.col("base") + F.col("rank")) % n).alias("id"))


def fetched_after(shown: DataFrame, log: DataFrame) -> DataFrame:
    """``shown`` with ``hit``: the session fetched that id later. The last fetch of each (session, id)
    decides, so no search meets more than one row."""
    last = log.where("action = 'get'").groupBy("session_id", F.col("base").alias("id")).agg(F.max("ts").alias("got"))
    return shown.join(last, ["session_id", "id"], "left").withColumn("hit", F.coalesce(F.col("got") > F.col("ts"), F.lit(False))).drop("got")


def any_get_after(log: DataFrame) -> DataFrame:
    """event_id of searches with ``any_get``: the session fetched anything later."""
    last = log.where("action = 'get'").groupBy("session_id").agg(F.max("ts").alias("got"))
    return log.where("action = 'search'").join(last, "session_id", "left").select("event_id", "session_id", F.coalesce(F.col("got") > F.col("ts"), F.lit(False)).alias("any_get"))


def ir_metrics(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """query_id with recall@k, precision@1, reciprocal rank and nDCG@k of a ranked list (query_id,
    id, rank from 1) against gold (query_id, id)."""
    marked = ranked.join(gold.select("query_id", "id").distinct().withColumn("gold", F.lit(True)), ["query_id", "id"], "left").where("gold")
    size = gold.groupBy("query_id").agg(F.count_distinct("id").alias("n"))
    near = F.col("rank") <= k
    sums = marked.groupBy("query_id").agg(F.count_if(near).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"))
    best = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    rows = size.join(sums, "query_id", "left").withColumn("best", best)
    zero = F.lit(0.0)
    return rows.select(
        "query_id",
        F.round(F.coalesce(F.col("hits") / F.col("n"), zero), 6).alias("recall"),
        F.when(F.col("first") == 1, 1).otherwise(0).alias("p1"),
        F.round(F.coalesce(1 / F.col("first"), zero), 6).alias("rr"),
        F.round(F.coalesce(F.col("dcg"), zero) / F.col("best"), 6).alias("ndcg"),
    )


def threshold_sweep(pairs: DataFrame, thresholds: list[float], score: str = "score", positive: str = "positive") -> DataFrame:
    """threshold, kept, precision, recall, admitted_negatives. Scores are counted into the cells
    between thresholds once; the sweep is a running sum over cells."""
    cut = sorted(thresholds)
    cell = sum((F.col(score) >= t).cast("int") for t in cut)
    cells = pairs.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.count_if(F.col(positive)).alias("p"))
    grid = pairs.sparkSession.createDataFrame([(t, k + 1) for k, t in enumerate(cut)], "threshold double, cell int").join(cells, "cell", "left")
    up = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over thresholds
    kept, tp = F.coalesce(F.sum("n").over(up), F.lit(0)), F.coalesce(F.sum("p").over(up), F.lit(0))
    total = pairs.agg(F.count_if(F.col(positive)).alias("all"))
    rows = grid.select("threshold", kept.alias("kept"), tp.alias("tp")).crossJoin(total)  # one row
    return rows.select(
        "threshold",
        "kept",
        F.round(F.when(F.col("kept") > 0, F.col("tp") / F.col("kept")).otherwise(0.0), 6).alias("precision"),
        F.round(F.when(F.col("all") > 0, F.col("tp") / F.col("all")).otherwise(0.0), 6).alias("recall"),
        (F.col("kept") - F.col("tp")).alias("admitted_negatives"),
    )


def gold_from_log(log: DataFrame, n: int) -> DataFrame:
    """query_id (a search event), id: what the session fetched of that search's results before its
    next search. Searches number the groups within a session; a fetch belongs to the group it is in."""
    w = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seg = log.withColumn("g", F.sum((F.col("action") == "search").cast("int")).over(w))
    shown = surfacings(log, n).select(F.col("event_id").alias("query_id"), "id")
    heads = seg.where("action = 'search'").select("session_id", "g", F.col("event_id").alias("query_id"))
    gets = seg.where("action = 'get' AND g > 0").select("session_id", "g", F.col("base").alias("id"))
    return gets.join(heads, ["session_id", "g"]).select("query_id", "id").distinct().join(shown, ["query_id", "id"], "left_semi")


def xorshift(seed: int):
    """A 32-bit xorshift generator of numbers in [0, 1)."""
    state = seed & 0xFFFFFFFF or 1
    while True:
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        yield state / 2**32


def paired_bootstrap(scores: DataFrame, iterations: int = 2000, seed: int = 1) -> DataFrame:
    """arm, delta, low, high: mean of (b - a) over the queries of each arm with a 95 % band. The
    resampling is one seeded sequence, so an arm's differences (one for each query) go to one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = (pdf.b - pdf.a).to_numpy()[pdf.query_id.argsort().to_numpy()]
        nxt, n = xorshift(seed), len(pdf)
        means = sorted(sum(d[int(next(nxt) * n)] for _ in range(n)) / n for _ in range(iterations))
        return pd.DataFrame([(pdf.arm.iloc[0], d.mean(), means[int(0.025 * iterations)], means[-(-975 * iterations // 1000) - 1])], columns=["arm", "delta", "low", "high"])

    return scores.groupBy("arm").applyInPandas(run, "arm string, delta double, low double, high double")


def unpaired_bootstrap(scores: DataFrame, iterations: int = 2000, seed: int = 1) -> DataFrame:
    """arm, delta, low, high: mean of side b less mean of side a (arm, side, query_id, value) with a 95 % band; each
    side is drawn anew with as many members as it has, from one seeded sequence for both."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query_id")
        a, b = (pdf.value[pdf.side == x].to_numpy() for x in "ab")
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=["arm", "delta", "low", "high"])
        nxt = xorshift(seed)
        draw = lambda v: sum(v[int(next(nxt) * len(v))] for _ in range(len(v))) / len(v)
        means = sorted(-draw(a) + draw(b) for _ in range(iterations))
        return pd.DataFrame([(pdf.arm.iloc[0], b.mean() - a.mean(), means[int(0.025 * iterations)], means[-(-975 * iterations // 1000) - 1])], columns=["arm", "delta", "low", "high"])

    return scores.groupBy("arm").applyInPandas(run, "arm string, delta double, low double, high double")
