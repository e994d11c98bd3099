"""Calibration of scores and gates: scorers over chunk vectors, space reports, densities of what a gate shows,
labels against the time they were true, counters merged by key, and bootstraps dealt to tasks.

Distributions are counts of values in cells, never sorted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vector import cosine

# --- bootstraps. The generator is linear over bits, so any place of its sequence can be jumped to.


def _step(x: np.ndarray) -> np.ndarray:
    x = x ^ (x << np.uint32(13))
    x = x ^ (x >> np.uint32(17))
    return x ^ (x << np.uint32(5))


def _powers() -> np.ndarray:
    """Row k: what 2^k steps make of each of the 32 bits."""
    rows = [_step(np.uint32(1) << np.arange(32, dtype=np.uint32))]
    for _ in range(63):
        rows.append(_times(rows[-1], rows[-1]))
    return np.array(rows)


def _times(states: np.ndarray, by: np.ndarray) -> np.ndarray:
    out = np.zeros_like(states)
    for bit in range(32):
        out ^= np.where((states >> np.uint32(bit)) & 1, by[bit], np.uint32(0))
    return out


def jump(seed: int, places: np.ndarray) -> np.ndarray:
    """The generator's state after each of ``places`` steps from ``seed``."""
    state = np.full(len(places), (seed & 0xFFFFFFFF) or 1, np.uint32)
    powers = _powers()
    for k in range(int(places.max(initial=0)).bit_length()):
        state = np.where((places >> k) & 1, _times(state, powers[k]), state)
    return state


def bootstrap(values: DataFrame, iterations: int = 2000, seed: int = 1, block: int = 250) -> DataFrame:
    """arm, delta, low, high: the mean of ``values`` (arm, side, query_id, value), by side, resampled ``iterations`` times from
    one seeded sequence; a 95 % band. With sides a and b the delta is that of b less a, each drawn as often as it has
    members, a first; with one side it is that side's mean.

    Iterations are dealt to tasks in blocks; each block jumps to its place in the sequence, so the
    draws are those of one pass. A task holds the values of one arm."""
    packed = values.groupBy("arm").agg(
        *[F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == x, F.struct("query_id", "value")))), lambda z: z["value"]).alias(x) for x in "ab"],
    )
    dealt = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-iterations // block) - 1))))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for arm, first, second, n in zip(*(b.column(k).to_pylist() for k in ("arm", "a", "b", "block"))):
                runs = np.arange(n * block, min(iterations, (n + 1) * block))
                state = jump(seed, runs * (len(first) + len(second)))
                means = []
                for side in (np.array(first, np.float64), np.array(second, np.float64)):
                    total = np.zeros(len(runs))
                    for _ in range(len(side)):
                        state = _step(state)
                        total += side[(state / 2**32 * len(side)).astype(np.int64)]
                    means.append(total / len(side) if len(side) else np.zeros(len(runs)))
                yield pa.RecordBatch.from_arrays([pa.array([arm] * len(runs)), pa.array(means[1] - means[0])], names=["arm", "mean"])

    whole = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    delta = packed.select("arm", (F.when(F.size("b") > 0, whole("b")).otherwise(0.0) - F.when(F.size("a") > 0, whole("a")).otherwise(0.0)).alias("delta"))
    w = Window.partitionBy("arm").orderBy("mean")
    ranked = dealt.repartition("arm", "block").mapInArrow(draw, "arm string, mean double").withColumn("n", F.row_number().over(w) - 1)
    at = lambda k: F.min(F.when(F.col("n") == k, F.col("mean")))
    band = ranked.groupBy("arm").agg(at(int(0.025 * iterations)).alias("low"), at(-(-975 * iterations // 1000) - 1).alias("high"))
    return delta.join(band, "arm")


# --- scorers


def max_similarity(pairs: DataFrame, chunks: DataFrame, centre: bool = False) -> DataFrame:
    """``pairs`` (a, b, ...) with ``sim``: the best cosine of a's first chunk with any chunk of b (node_id, seq, embedding),
    0 where either has none. ``centre`` subtracts the mean of all chunks first."""
    rows = chunks.select("node_id", "seq", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    if centre:
        flat = rows.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m"))
        mean = flat.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "m"))), lambda z: z["m"]).alias("mean"))  # one row, one number a dimension
        rows = rows.join(F.broadcast(mean)).select("node_id", "seq", F.zip_with("v", "mean", lambda x, m: x - m).alias("v"))
    seeds = rows.groupBy(F.col("node_id").alias("a")).agg(F.min_by("v", "seq").alias("seed"))
    met = pairs.select("a", "b").distinct().join(seeds, "a").join(rows.select(F.col("node_id").alias("b"), "v"), "b")
    best = met.groupBy("a", "b").agg(F.max(cosine(F.col("seed"), F.col("v"))).alias("sim"))
    return pairs.join(best, ["a", "b"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))


def drift(pairs: DataFrame, stored: str, recomputed: str) -> DataFrame:
    """compared, mean_abs, max_abs of two scores of the same pairs."""
    d = F.abs(F.col(stored) - F.col(recomputed))
    return pairs.agg(F.count("*").alias("compared"), F.round(F.coalesce(F.avg(d), F.lit(0.0)), 6).alias("mean_abs"), F.round(F.coalesce(F.max(d), F.lit(0.0)), 6).alias("max_abs"))


def separation(values: DataFrame, group: str | None = None, digits: int = 4) -> DataFrame:
    """For values (value, linked) of random and of linked pairs: their means, the 90th percentile of the random ones, and the
    chance that a linked one is larger, ties half. Values are counted to ``digits`` digits."""
    keys = [group] if group else []
    cells = values.groupBy(*keys, F.round("value", digits).alias("value")).agg(F.count_if("linked").alias("p"), F.count_if(~F.col("linked")).alias("q"))
    w = Window.partitionBy(*keys or [F.lit(0)]).orderBy("value")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.withColumns({"upto": F.sum("q").over(w), "all": F.sum("q").over(whole)})
    place = F.greatest(F.ceil(F.lit(0.9) * F.col("all")), F.lit(1))
    below = F.col("upto") - F.col("q") / 2
    mean = lambda n: F.round(F.sum(F.col("value") * F.col(n)) / F.sum(n), 5)
    return cells.groupBy(*keys).agg(
        F.sum("q").alias("random_pairs"), F.sum("p").alias("linked_pairs"), mean("q").alias("random_mean"), F.min(F.when(F.col("upto") >= place, F.col("value"))).alias("random_p90"),
        mean("p").alias("linked_mean"), F.round(F.sum(F.col("p") * below) / (F.sum("p") * F.sum("q")), 6).alias("auc"),
    )


def permuted_pairs(items: DataFrame, place: str, n: int, step: int = 1_000_003, offset: int = 12_345) -> DataFrame:
    """a, b: each of ``n`` items paired with another by a seeded permutation of their places 0 to n - 1: a join of
    equal places, of which none is its own."""
    other = (F.col(place) * step + offset) % n
    left = items.select(F.col("id").alias("a"), other.alias("p"))
    return left.join(items.select(F.col("id").alias("b"), F.col(place).alias("p")), "p").where("a <> b").select("a", "b")


# --- gates


def density(hits: DataFrame, probes: DataFrame, thresholds: list[float], shown: int = 3) -> DataFrame:
    """threshold, hit_rate, mean_shown, p90_shown, max_shown: how many of its hits (probe, score) each of ``probes`` (probe) would
    show at each threshold, ``shown`` at most. A probe's scores are counted into the cells between thresholds and
    summed from above; what follows are counts of (threshold, number shown)."""
    cut = sorted(thresholds)
    cell = sum((F.col("score") >= t).cast("int") for t in cut)
    counts = hits.groupBy("probe").agg(*[F.count_if(cell >= k + 1).alias(f"t{k}") for k in range(len(cut))])
    rows = probes.select("probe").join(counts, "probe", "left")
    each = F.array(*[F.struct(F.lit(t).alias("threshold"), F.least(F.coalesce(F.col(f"t{k}"), F.lit(0)), F.lit(shown)).alias("n")) for k, t in enumerate(cut)])
    cells = rows.select(F.inline(each)).groupBy("threshold", "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy("threshold").orderBy("n")
    cells = cells.withColumns({"upto": F.sum("c").over(w), "all": F.sum("c").over(Window.partitionBy("threshold"))})
    place = F.greatest(F.ceil(F.lit(0.9) * F.col("all")), F.lit(1))
    return cells.groupBy("threshold").agg(
        F.round(F.sum(F.when(F.col("n") > 0, F.col("c")).otherwise(0)) / F.sum("c"), 6).alias("hit_rate"), F.round(F.sum(F.col("n") * F.col("c")) / F.sum("c"), 6).alias("mean_shown"),
        F.min(F.when(F.col("upto") >= place, F.col("n"))).alias("p90_shown"), F.max("n").alias("max_shown"),
    )


def first_under(target: float) -> Column:
    """The lowest threshold at which fewer than ``target`` are shown on average, for an aggregate over ``density``."""
    return F.min(F.when(F.col("mean_shown") < target, F.col("threshold")))


def repaired(*gates: Column) -> list[Column]:
    """Gates in the order in which they must not fall: each at least the one before it."""
    return [F.greatest(*gates[: k + 1]) if k else g for k, g in enumerate(gates)]


# --- labels and counters


def prune_labels(labels: DataFrame, spans: DataFrame) -> DataFrame:
    """``labels`` (id, at_ms, ...) with ``verdict``: kept where the labelled note was live at that time, by its spans (id,
    from_ms, to_ms; null is open), else early, retired or unknown. An equi-join by id with a range."""
    inside = (F.col("at_ms") >= F.col("from_ms")) & (F.col("to_ms").isNull() | (F.col("at_ms") < F.col("to_ms")))
    known = spans.groupBy("id").agg(F.min("from_ms").alias("born"))
    live = labels.select("id", "at_ms").distinct().join(spans, "id").where(inside).select("id", "at_ms").distinct().withColumn("live", F.lit(True))
    rows = labels.join(known, "id", "left").join(live, ["id", "at_ms"], "left")
    verdict = F.when(F.col("live"), "kept").when(F.col("born").isNull(), "unknown").when(F.col("at_ms") < F.col("born"), "early").otherwise("retired")
    return rows.withColumn("verdict", verdict).drop("born", "live")


def merged_counters(rows: DataFrame, keys: list[str], counters: str) -> DataFrame:
    """``keys`` and the sum by name of their maps of counters. A name that no row has stays missing; one that rows have with
    nothing to count is 0. Names are summed in parts by each task, so a key that most rows share is no bottleneck."""
    flat = rows.select(*keys, F.explode(counters).alias("name", "n")).groupBy(*keys, "name").agg(F.sum("n").alias("n"))
    held = flat.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias(counters))
    return rows.select(*keys).distinct().join(held, keys, "left").withColumn(counters, F.coalesce(counters, F.create_map().cast("map<string,bigint>")))
