"""Graph operators over edge tables: frontiers, PageRank, closures, components, health.

Loops work on distributed frames and write their state to the shared checkpoint folder each round,
so the plan stays short and a lost executor costs the running round only."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import temporal as t
from .relational import symmetrise

# fixed values: what an edge type conducts; other types conduct nothing
CONDUCTANCE = {"derived_from": 0.5, "documents": 0.7, "references": 0.7, "relates_to": 0.5, "similar_to": 0.3}
TRAVERSABLE = tuple(CONDUCTANCE)
PPR_ALPHA, PPR_ROUNDS, PPR_EPSILON = 0.5, 20, 1e-6
#: Rounds of PageRank between two writes and looks at the change.
ROUNDS_A_JOB = 4


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, set here only if there is none and Spark runs in one process."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` below the shared folder and read it again, with its size known to the
    planner. What this process has written is deleted when it ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-settled/{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _delete_written() -> None:
    for spark, path in _written:
        with suppress(Exception):  # the session has ended, or the folder is gone
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def subgraph(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, depth: int = 2, cap: int = 500, types: tuple[str, ...] = TRAVERSABLE) -> DataFrame:
    """Edges among the nodes within ``depth`` hops of the seeds (query_id, id), per query.

    ``edges`` and ``nodes`` hold what is live. The ``cap`` nearest nodes by (depth, id) stay. So a hop needs the 2 * cap
    smallest neighbours of a node only: where fewer than cap nodes are seen, those hold cap unseen ones or all there are,
    and where more are seen, nothing deeper stays."""
    usable = edges.where(F.col("type").isin(*types)).join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    order = Window.partitionBy("a").orderBy("b")
    hops = symmetrise(usable).distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= 2 * cap).drop("n")
    seen = seeds.select("query_id", "id").distinct().withColumn("depth", F.lit(0))
    rim = seen
    for d in range(1, depth + 1):
        rim = rim.join(hops.withColumnRenamed("a", "id"), "id").select("query_id", F.col("b").alias("id")).distinct()
        rim = rim.join(seen, ["query_id", "id"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(rim)
    w = Window.partitionBy("query_id").orderBy("depth", "id")
    front = seen.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).select("query_id", "id")
    left = front.withColumnRenamed("id", "src").join(usable, "src")
    return left.join(front.withColumnRenamed("id", "dst"), ["query_id", "dst"]).select("query_id", "src", "dst", "type", "weight")


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = PPR_ALPHA, rounds: int = PPR_ROUNDS, epsilon: float = PPR_EPSILON) -> DataFrame:
    """query_id, id, rank, via: mass that walks from the seeds (query_id, id, score) over the edges
    (query_id, src, dst, type, weight). Mass at a node without edges is dropped, not shared. ``via``
    is the neighbour with the largest inflow (ties: smallest id)."""
    table = F.create_map(*[F.lit(x) for kv in CONDUCTANCE.items() for x in kv])
    c = edges.where("src <> dst").withColumn("c", F.coalesce(table[F.col("type")], F.lit(0.0)) * F.when(F.col("weight") == 0, 1.0).otherwise(F.col("weight"))).where("c > 0")
    both = c.select("query_id", F.col("src").alias("a"), F.col("dst").alias("b"), "c").unionByName(c.select("query_id", F.col("dst").alias("a"), F.col("src").alias("b"), "c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy("query_id", "a"))
    moves = settle(both.withColumn("share", share).select("query_id", "a", "b", "share"))
    total = F.sum("score").over(Window.partitionBy("query_id"))
    start = settle(seeds.withColumn("p", F.col("score") / total).where("p > 0").select("query_id", F.col("id").alias("a"), "p"))
    ranks = start.withColumnRenamed("p", "r")
    restart = start.select("query_id", "a", ((1 - alpha) * F.col("p")).alias("m"))
    for done in range(0, rounds, ROUNDS_A_JOB):
        new = ranks
        for _ in range(min(ROUNDS_A_JOB, rounds - done)):
            flow = new.join(moves, ["query_id", "a"]).select("query_id", F.col("b").alias("a"), (alpha * F.col("r") * F.col("share")).alias("m"))
            new = flow.unionByName(restart).groupBy("query_id", "a").agg(F.sum("m").alias("r"))
        new = settle(new)
        change = new.withColumnRenamed("r", "n").join(ranks, ["query_id", "a"], "full").groupBy("query_id").agg(F.sum(F.abs(F.coalesce("n", F.lit(0.0)) - F.coalesce("r", F.lit(0.0)))).alias("d"))
        ranks = new
        if (change.agg(F.max("d")).first()[0] or 0) < epsilon:
            break
    inflow = ranks.join(moves, ["query_id", "a"]).groupBy("query_id", F.col("b").alias("id")).agg(F.min_by("a", F.struct(-F.round(F.col("r") * F.col("share"), 12), "a")).alias("via"))
    return ranks.withColumnRenamed("a", "id").join(inflow, ["query_id", "id"], "left").select("query_id", "id", F.col("r").alias("rank"), "via")


def pagerank_within(edges: DataFrame, seeds: DataFrame, alpha: float = PPR_ALPHA, rounds: int = PPR_ROUNDS, epsilon: float = PPR_EPSILON) -> DataFrame:
    """``personalised_pagerank`` where each query's edges are few, as ``subgraph`` makes them: its cap bounds the nodes of a
    query, and so what one task holds. A query is one group, its rounds are products over arrays, and it
    ends on its own once its ranks change by less than ``epsilon``; nothing is shuffled between rounds."""

    def walk(key, links, start):
        links = links[links.src != links.dst]
        c = links.type.map(CONDUCTANCE).fillna(0.0).to_numpy() * np.where(links.weight == 0, 1.0, links.weight)
        src, dst, c = links.src.to_numpy()[c > 0], links.dst.to_numpy()[c > 0], c[c > 0]
        start = start[start.score > 0]
        total = start.score.sum()
        names, place = np.unique(np.concatenate([src, dst, start.id.to_numpy()]).astype(str), return_inverse=True)
        a, b = np.concatenate([place[: len(src)], place[len(src) : 2 * len(src)]]), np.concatenate([place[len(src) : 2 * len(src)], place[: len(src)]])
        share = np.concatenate([c, c])
        share = share / np.bincount(a, share, len(names))[a]
        first = np.bincount(place[2 * len(src) :], start.score.to_numpy() / total if total else None, len(names)).astype(float)
        rank = first
        for _ in range(rounds):
            new = alpha * np.bincount(b, rank[a] * share, len(names)) + (1 - alpha) * first
            change, rank = np.abs(new - rank).sum(), new
            if change < epsilon:
                break
        flow = np.round(rank[a] * share, 12)
        order = np.lexsort((a, -flow, b))  # the largest inflow of each node first; ties by the neighbour's name
        order = order[rank[a[order]] > 0]
        heads, at = np.unique(b[order], return_index=True)
        via = np.full(len(names), None, object)
        via[heads] = names[a[order][at]]
        held = rank > 0
        return pd.DataFrame({"query_id": [key[0]] * int(held.sum()), "id": names[held], "rank": rank[held], "via": via[held]})

    kind = dict(seeds.dtypes)["query_id"]
    both = edges.select("query_id", "src", "dst", "type", "weight").groupBy("query_id").cogroup(seeds.select(F.col("query_id").alias("query_id"), F.col("id").alias("id"), F.col("score").cast("double").alias("score")).groupBy("query_id"))
    return both.applyInPandas(walk, f"query_id {kind}, id string, rank double, via string")


def graph_hits(ranks: DataFrame, direct: DataFrame, base: float = 0.3) -> DataFrame:
    """Scores of nodes that only the graph surfaced: base x best direct score x rank / best rank."""
    best = direct.groupBy("query_id").agg(F.max("score").alias("top"))
    new = ranks.join(direct.select("query_id", "id"), ["query_id", "id"], "left_anti")
    top = F.max("rank").over(Window.partitionBy("query_id"))
    return new.join(best, "query_id").withColumn("score", base * F.col("top") * F.col("rank") / top).select("query_id", "id", "score", "via")


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """id, root of every node with an edge (a, b): the smallest id of its component. Alternating
    large-star and small-star rounds, log many."""
    now, mark = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = settle(small.distinct())
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def terminal_successors(ids: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, successor: live nodes reached from ``ids`` along live ``supersedes`` edges (src replaces
    dst) through invalidated ones. Cycles end where nothing new is reached."""
    step = edges.where(t.live() & (F.col("type") == "supersedes")).select(F.col("dst").alias("at"), F.col("src").alias("next"))
    gone = nodes.where(~t.live()).select(F.col("id").alias("at"))
    seen = rim = settle(ids.select("id", F.col("id").alias("at")).distinct())
    while True:
        rim = rim.join(gone, "at", "left_semi").join(step, "at").select("id", F.col("next").alias("at")).distinct()
        rim = settle(rim.join(seen, ["id", "at"], "left_anti"))
        if rim.isEmpty():
            break
        seen = seen.unionByName(rim)
    alive = nodes.where(t.live()).select(F.col("id").alias("at"))
    return seen.where("id <> at").join(alive, "at", "left_semi").select("id", F.col("at").alias("successor"))


def origin_principals(ids: DataFrame, nodes: DataFrame, edges: DataFrame, revisions: DataFrame, sessions: DataFrame, hops: int = 3) -> DataFrame:
    """id, principal_id: who stands behind a node: creators and content revisers of it and of what it
    comes from, at most ``hops`` steps over derived_from and supersedes."""
    step = edges.where(t.live() & F.col("type").isin("derived_from", "supersedes")).select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct()
    seen = rim = ids.select("id", F.col("id").alias("at")).distinct()
    for _ in range(hops):
        rim = rim.join(step, "at").select("id", F.col("next").alias("at")).distinct()
        seen = seen.unionByName(rim)
    made = nodes.select(F.col("id").alias("at"), F.col("created_by_session").alias("s"))
    changed = revisions.where("reason IS NULL OR reason = 'edit'").select(F.col("node_id").alias("at"), F.col("session_id").alias("s"))
    who = made.unionByName(changed).join(sessions.select(F.col("id").alias("s"), "principal_id"), "s").select("at", "principal_id").distinct()
    return seen.distinct().join(who, "at").select("id", "principal_id").distinct()


def live_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Both directions, without repeats, of live edges between live authored nodes: a, b."""
    known = nodes.where(t.live() & t.authored()).select("id")
    e = edges.where(t.live()).join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select("dst", "src")).distinct()


def family_hubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """family, id: the live authored node with most links in each project family; ties: smallest id."""
    counted = live_links(nodes, edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    rows = nodes.where(t.live() & t.authored()).select("id", t.project_family(F.col("project")).alias("family")).join(counted, "id")
    w = Window.partitionBy("family").orderBy(F.desc("n"), "id")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("family", "id", "n")


def detached(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Live authored nodes that no family's hub can reach; none where there are no links at all."""
    links = live_links(nodes, edges)
    roots = components(links)
    held = roots.join(family_hubs(nodes, edges).select("id"), "id", "left_semi").select("root").distinct()
    reached = roots.join(held, "root", "left_semi").select("id").union(family_hubs(nodes, edges).select("id"))
    every = nodes.where(t.live() & t.authored()).select("id")
    return every.join(reached, "id", "left_anti").where(F.lit(not links.isEmpty()))


def edgeless(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = symmetrise(edges.where(t.live())).select(F.col("a").alias("id")).distinct()
    return nodes.where(t.live() & t.authored()).select("id").join(ends, "id", "left_anti")


def backbone(edges: DataFrame, most: int = 40) -> DataFrame:
    """A spanning forest (src, dst, type) that prefers strong edges: the one that Kruskal's order
    (strength, weight, ids) gives. The order is total, so that forest is unique, and Boruvka's rounds
    find it in parallel: each tree takes its first outward edge, then trees that meet are joined."""
    strength = (
        F.when(F.col("type") == "supersedes", 5).when((F.col("provenance") == "agent") & (F.col("type") != "similar_to"), 4).when(F.col("type") == "derived_from", 3).when(F.col("type") == "similar_to", 1).otherwise(2)
    )
    key = F.struct((-strength).alias("s"), (-F.col("weight")).alias("w"), "src", "dst", "type")
    left = settle(edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), key.alias("e")))
    forest = left.limit(0).select("e")
    for _ in range(most):
        ends = left.select("a", "e").unionByName(left.select(F.col("b").alias("a"), "e"))
        picked = settle(ends.groupBy("a").agg(F.min("e").alias("e")).select("e").distinct())
        if picked.isEmpty():
            return forest.select("e.src", "e.dst", "e.type")
        forest = settle(forest.unionByName(picked).distinct())
        joined = left.join(picked, "e", "left_semi").select("a", "b")
        roots = components(joined)
        left = left.join(roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", "left")
        left = settle(left.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), "e").where("a <> b"))
    raise RuntimeError("the forest did not settle")
