"""A hop takes a node's smallest neighbours only, and the nearest nodes by (depth, id) are those of all."""

import random

from tessera.operators import graph


def test_capped_front(spark):
    rng = random.Random(7)
    ids = [f"n{k:02d}" for k in range(40)]
    links = {(a, b) for a in ids for b in [rng.choice(ids[:3]), rng.choice(ids)] if a != b}
    near = {a: {y for x, y in links if x == a} | {x for x, y in links if y == a} for a in ids}
    edges = spark.createDataFrame([(a, b, "relates_to", 1.0) for a, b in links], "src string, dst string, type string, weight double")
    seeds = spark.createDataFrame([(a, a) for a in ids], "query_id string, id string")
    got = {tuple(r) for r in graph.subgraph(seeds, edges, spark.createDataFrame([(a,) for a in ids], "id string"), cap=5).select("query_id", "src", "dst").collect()}
    want = set()
    for q in ids:
        one = near[q] - {q}
        two = {y for x in one for y in near[x]} - one - {q}
        front = set([q, *sorted(one), *sorted(two)][:5])
        want |= {(q, a, b) for a, b in links if a in front and b in front}
    assert got == want
