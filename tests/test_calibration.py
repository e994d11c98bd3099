"""Calibration, bootstraps and vector sums against plain Python; the inverted file against all rows."""

import random

import numpy as np
import pytest

from tessera.operators import calibration, evaluation, vector


def unit(m):
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


# --- vectors


def clustered(n, dim=12, groups=8, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    rows = centres[r.integers(0, groups, n)] + 0.05 * r.normal(size=(n, dim))
    rows[::97] = 0
    rows[1 : n - 1 : 50] = rows[0 : n - 2 : 50] if n > 100 else rows[1 : n - 1 : 50]
    return rows


def frame(spark, rows, name):
    return spark.createDataFrame([(f"{name}{k:05d}", [float(x) for x in v]) for k, v in enumerate(rows)], f"{'query_id' if name == 'q' else 'id'} string, embedding array<double>")


@pytest.mark.parametrize("k", [1, 10, 700])
def test_knn_is_exact_and_skips(spark, k):
    rows = clustered(600)
    asked = np.concatenate([rows[:20], np.zeros((1, 12)), np.random.default_rng(1).normal(size=(5, 12))])
    found, seen = vector.knn_report(frame(spark, asked, "q"), frame(spark, rows, "c"), k, "id")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in found.collect()}
    scores = np.round(unit(asked) @ unit(rows).T, 6)
    for q in range(len(asked)):
        order = sorted(range(len(rows)), key=lambda c: (-scores[q, c], c))[:k]  # noqa: B023
        for place, c in enumerate(order):
            name, score = got[f"q{q:05d}", place + 1]
            assert abs(score - scores[q, c]) < 2e-6 and (name == f"c{c:05d}" or abs(scores[q, int(name[1:])] - scores[q, c]) < 2e-6)
    assert len(got) == len(asked) * min(k, len(rows))
    counts = {r.query_id: (r.visited, r.skipped) for r in seen.collect()}
    assert all(v + s == max(a + b for a, b in counts.values()) for v, s in counts.values())
    if k == 1:
        assert sum(s for _, s in counts.values()) > sum(v for v, _ in counts.values())


def test_knn_of_nothing(spark):
    some, none = frame(spark, clustered(5), "c"), frame(spark, [], "c")
    assert vector.knn(frame(spark, clustered(3), "q"), none, 3, "id").count() == 0
    assert vector.knn(frame(spark, [], "q"), some, 3, "id").count() == 0


def test_mean_similarity(spark):
    rows = clustered(90)
    groups = ["one" if k == 7 else f"g{k % 4}" for k in range(len(rows))]
    df = spark.createDataFrame([(g, [float(x) for x in v]) for g, v in zip(groups, rows)], "group string, embedding array<double>")
    for r in vector.mean_similarity(df).collect():
        own = unit(rows[[g == r.group for g in groups]])
        pairs = (own @ own.T)[np.triu_indices(len(own), 1)]
        assert r.members == len(own) and (r.mean is None if len(own) == 1 else abs(r.mean - pairs.mean()) < 1e-9)


def test_moments(spark):
    rows = clustered(200)
    corpus = frame(spark, rows, "c")
    asked = corpus.where("id < 'c00030'").withColumnRenamed("id", "query_id").unionByName(frame(spark, clustered(5, seed=9), "q"))
    got = {r.query_id: r for r in vector.similarity_moments(asked, corpus, "id").collect()}
    for name, v in [(r.query_id, np.array(r.embedding)) for r in asked.collect()]:
        s = [float(unit(v) @ u) for k, u in enumerate(unit(rows)) if f"c{k:05d}" != name]
        assert got[name].n == len(s) and abs(got[name]["mean"] - np.mean(s)) < 1e-9 and abs(got[name].sd - np.std(s)) < 1e-6


# --- bootstraps


def test_jumps():
    x, states = evaluation.xorshift(7), []
    for _ in range(300):
        states.append(int(next(x) * 2**32))
    places = np.array([0, 1, 2, 63, 64, 255, 300])
    assert calibration.jump(7, places).tolist() == [7, *(states[p - 1] for p in places[1:])]
    far = calibration.jump(1, np.array([10**12, 10**12 + 1]))
    assert calibration._step(far[:1])[0] == far[1]


def test_bootstraps_are_those_of_one_pass(spark):
    r = random.Random(5)
    rows = [(f"q{k:03d}", ("x", "y")[k % 2], r.choice("ab"), r.random(), r.random()) for k in range(60)]
    df = spark.createDataFrame(rows, "query_id string, arm string, side string, a double, b double")
    paired = df.selectExpr("query_id", "arm", "'b' AS side", "b - a AS value")
    want = {x.arm: tuple(x)[1:] for x in evaluation.paired_bootstrap(df.select("query_id", "arm", "a", "b"), 200).collect()}
    got = {x.arm: (x.delta, x.low, x.high) for x in calibration.bootstrap(paired, 200, block=33).collect()}
    assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want) and got.keys() == want.keys()
    sides = df.selectExpr("query_id", "arm", "side", "b AS value")
    want = {x.arm: tuple(x)[1:] for x in evaluation.unpaired_bootstrap(sides, 200).collect()}
    got = {x.arm: (x.delta, x.low, x.high) for x in calibration.bootstrap(sides, 200, block=7).collect()}
    assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want) and got.keys() == want.keys()


# --- gates, labels, counters


def test_density(spark):
    r = random.Random(1)
    hits = [(f"p{r.randrange(30)}", round(r.random(), 2)) for _ in range(150)]
    cuts = [0.2, 0.5, 0.9]
    probes = [f"p{k}" for k in range(35)]
    got = {x.threshold: x for x in calibration.density(spark.createDataFrame(hits, "probe string, score double"), spark.createDataFrame([(p,) for p in probes], "probe string"), cuts).collect()}
    for t in cuts:
        shown = sorted(min(3, sum(p == q and s >= t for q, s in hits)) for p in probes)
        x = got[t]
        assert abs(x.hit_rate - sum(n > 0 for n in shown) / 35) < 1e-6 and abs(x.mean_shown - sum(shown) / 35) < 1e-6 and x.max_shown == shown[-1] and x.p90_shown == shown[-(-9 * 35 // 10) - 1]


def test_pruned_labels(spark):
    spans = spark.createDataFrame([(1, 10, 20), (1, 30, None), (2, 5, 6)], "id int, from_ms long, to_ms long")
    labels = spark.createDataFrame([(i, t) for i in (1, 2, 3) for t in (4, 10, 19, 20, 30, 99)], "id int, at_ms long")
    got = {(r.id, r.at_ms): r.verdict for r in calibration.prune_labels(labels, spans).collect()}
    assert [got[1, t] for t in (4, 10, 19, 20, 30, 99)] == ["early", "kept", "kept", "retired", "kept", "kept"]
    assert [got[2, t] for t in (4, 10)] == ["early", "retired"] and {got[3, t] for t in (4, 99)} == {"unknown"}


def test_counters_keep_missing_apart_from_zero(spark):
    rows = spark.createDataFrame([(1, {"a": 2, "z": 0}), (1, {"a": 3}), (2, {}), (2, None), (3, {"z": 0})], "k int, counters map<string,bigint>")
    got = {r.k: r.counters for r in calibration.merged_counters(rows, ["k"], "counters").collect()}
    assert got == {1: {"a": 5, "z": 0}, 2: {}, 3: {"z": 0}}


def test_max_similarity_is_one_sided(spark):
    chunks = [("a", 1, [0.0, 1.0]), ("a", 0, [1.0, 0.0]), ("b", 0, [0.0, 1.0]), ("b", 3, [1.0, 1.0])]
    df = spark.createDataFrame(chunks, "node_id string, seq int, embedding array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "none")], "a string, b string")
    got = {(r.a, r.b): round(r.sim, 6) for r in calibration.max_similarity(pairs, df).collect()}
    assert got == {("a", "b"): 0.707107, ("b", "a"): 1.0, ("a", "none"): 0.0}


def test_later_visits_send_only_rows_that_can_count(spark):
    rows = clustered(600)
    cells = vector.fit_cells(frame(spark, rows, "c"), "id")
    asked = frame(spark, rows[:5], "q").selectExpr("query_id", "embedding", "0.9D AS least")
    visits = vector._visits(asked, cells, 1, True)
    sent = vector._meet(visits, cells, 600, "id").collect()
    first = vector._meet(vector._visits(asked, cells, 1, False), cells, 600, "id").collect()
    assert all(r.score >= 0.9 for r in sent)
    assert sum(r.score >= 0.9 for r in sent + first) == int((np.round(unit(rows[:5]) @ unit(rows).T, 6) >= 0.9).sum())
