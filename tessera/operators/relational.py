"""Scans, joins, windows and set operations of the memory store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import temporal as t


def latest_revision(revisions: DataFrame) -> DataFrame:
    """The revision with the largest number of each node: one aggregation, combined before the shuffle."""
    body = F.struct("rev", "content", "session_id", "reason", "ts_ms")
    return revisions.groupBy("node_id").agg(F.max_by(body, "rev").alias("r")).select("node_id", "r.rev", "r.content", "r.session_id", "r.reason", "r.ts_ms")


def symmetrise(edges: DataFrame, *keep: str) -> DataFrame:
    """Both directions of each edge as (a, b); a self-loop comes once."""
    there = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *keep)
    back = edges.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), *keep)
    return there.unionByName(back)


def degree(edges: DataFrame) -> DataFrame:
    """id and the number of edges at it."""
    return symmetrise(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("edge_count"))


def enriched(nodes: DataFrame, revisions: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their latest revision and number of live edges."""
    text = latest_revision(revisions).select(F.col("node_id").alias("id"), "rev", "content", F.col("ts_ms").alias("updated_ms"))
    rows = nodes.join(text, "id").join(degree(edges.where(t.live())), "id", "left")
    return rows.withColumn("edge_count", F.coalesce("edge_count", F.lit(0)).cast("bigint"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first rows of each key in a total order; ranks are cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def as_of_revision(revisions: DataFrame, at: int) -> DataFrame:
    """The revision of each node that was current at ``at``."""
    return latest_revision(revisions.where(F.col("ts_ms") <= at))


def as_of_join(points: DataFrame, revisions: DataFrame) -> DataFrame:
    """For each row of ``points`` (node_id, at_ms) the revision then current; rows before the first get none."""
    rows = points.join(revisions.select("node_id", "rev", "ts_ms"), "node_id").where("ts_ms <= at_ms")
    return rows.groupBy("node_id", "at_ms").agg(F.max("rev").alias("rev"))


def undirected_pairs(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def upsert(base: DataFrame, delta: DataFrame, key: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``delta`` in place of those of equal key."""
    return base.join(delta.select(*key), list(key), "left_anti").unionByName(delta)


def keyset_page(df: DataFrame, after: tuple[float, int, str] | None, limit: int) -> DataFrame:
    """A page in order (score desc, detected asc, id asc) behind the row ``after``, one row over to
    tell whether there is more."""
    if after:
        score, detected, last = after
        s, d = F.col("score"), F.col("detected_ms")
        df = df.where((s < score) | ((s == score) & ((d > detected) | ((d == detected) & (F.col("id") > last)))))
    return df.orderBy(F.desc("score"), "detected_ms", "id").limit(limit + 1)


def within_budget(df: DataFrame, key: str, order: Sequence[str], cost: str, budget: int, item: str) -> DataFrame:
    """Greedy selection in order: an item that would overflow is skipped, later smaller ones may fit.

    What is used only grows, so once an item of some cost is skipped all later ones of that cost are:
    of each cost the first budget / cost items are enough, and a key of any size sends at most
    budget x ln(budget) items to the walk. Items without cost always fit."""
    cut = Window.partitionBy(key, cost).orderBy(*order, item)
    costly = df.where(F.col(cost) > 0).withColumn("_n", F.row_number().over(cut)).where((F.col("_n") <= budget) & (F.col("_n") * F.col(cost) <= budget))
    items = F.sort_array(F.collect_list(F.struct(*order, item, cost)))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(z, x):
        fits = z["used"] + x[cost] <= budget
        return F.struct(
            F.when(fits, z["used"] + x[cost]).otherwise(z["used"]).alias("used"), F.when(fits, F.concat(z["kept"], F.array(x[item]))).otherwise(z["kept"]).alias("kept")
        )

    kept = F.aggregate("items", start, step)
    walked = costly.groupBy(key).agg(items.alias("items")).select(key, F.explode(kept["kept"]).alias(item))
    return walked.unionByName(df.where(F.col(cost) <= 0).select(key, item))


def resolve_scopes(requests: DataFrame, repos: DataFrame, branches: DataFrame) -> DataFrame:
    """Which branch of which repository each request reads: request_id, repo_id, branch, note.

    ``requests`` (request_id, repo, branch, remote, ctx_branch): a named repository (all of that name), else that
    of the caller's remote, else all. The branch asked for, else the caller's own in their repository, else
    the default one. A branch that is not indexed is replaced by the default, unless it was
    asked for by name; ``note`` says so, or why there is no branch."""
    r = repos.select("repo_id", "display_name", "remote_key", "default_branch")
    named = requests.where("repo IS NOT NULL").join(r, F.col("repo") == F.col("display_name"), "left")
    own = requests.where("repo IS NULL AND remote IS NOT NULL").join(r, F.col("remote") == F.col("remote_key"), "left")
    every = requests.where("repo IS NULL AND remote IS NULL").crossJoin(r)  # such a request reads all repositories
    rows = named.unionByName(own).unionByName(every)
    rows = rows.withColumn("wanted", F.coalesce("branch", F.when(F.col("remote") == F.col("remote_key"), F.col("ctx_branch"))))
    live = branches.where("retired_ms IS NULL")
    for name in ("wanted", "default_branch"):
        there = live.select(F.col("repo_id").alias("r"), F.col("branch").alias("b"), F.lit(True).alias(f"has_{name}")).distinct()
        rows = rows.join(there, (F.col("repo_id") == F.col("r")) & (F.col(name) == F.col("b")), "left").drop("r", "b")
    asked = F.col("wanted").isNotNull()
    stuck = asked & (F.col("branch").isNotNull() | F.col("default_branch").isNull() | (F.col("default_branch") == F.col("wanted")))
    what = (
        F.when(F.col("repo_id").isNull(), F.when(F.col("repo").isNotNull(), "unknown repository").otherwise("remote not indexed"))
        .when(F.col("has_wanted"), F.lit(None))
        .when(stuck, "branch not indexed")
        .when(F.col("default_branch").isNull(), "no default branch")
        .when(F.col("has_default_branch").isNull(), "default branch not indexed")
        .when(asked, "default branch instead")
    )
    rows = rows.withColumn("note", what)
    branch = F.when(F.col("has_wanted"), F.col("wanted")).when(F.col("note").isNull() | (F.col("note") == "default branch instead"), F.col("default_branch"))
    return rows.select("request_id", "repo_id", branch.alias("branch"), "note")


def fold_jobs(events: DataFrame, lease_ms: int, most: int) -> DataFrame:
    """job, state, owner, expires_ms, attempts, ended_ms: what events (job, at_ms, seq, op, owner) leave of each
    job, taken in order of time and number.

    ``claim`` leases a job that is pending, or running with a lease that has ended, up to ``most`` times; only its owner
    can ``renew``, ``succeed`` or ``fail`` it, and a failure gives it back while attempts are left;
    ``cancel`` ends what has not ended; ``reconcile``, after a crash, gives back or fails what runs."""
    start = F.struct(
        F.lit("pending").alias("state"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("long").alias("expires_ms"), F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("long").alias("ended_ms")
    )

    def step(z, x):
        running, spent = z["state"] == "running", z["attempts"] >= most
        mine = running & (z["owner"] == x["owner"])
        free = (z["state"] == "pending") | (running & (z["expires_ms"] <= x["at_ms"]))
        open_ = ~z["state"].isin("done", "failed", "cancelled")

        def becomes(state, owner=None, expires=None, attempts=None, ended=None):
            return F.struct(
                F.lit(state).alias("state"), (F.lit(None).cast("string") if owner is None else owner).alias("owner"), (F.lit(None).cast("long") if expires is None else expires).alias("expires_ms"),
                (z["attempts"] if attempts is None else attempts).alias("attempts"), (F.lit(None).cast("long") if ended is None else ended).alias("ended_ms"),
            )

        op, now = x["op"], x["at_ms"]
        back = F.when(spent, becomes("failed", ended=now)).otherwise(becomes("pending"))
        return (
            F.when((op == "claim") & free & ~spent, becomes("running", x["owner"], now + lease_ms, z["attempts"] + 1))
            .when((op == "renew") & mine, becomes("running", z["owner"], now + lease_ms))
            .when((op == "succeed") & mine, becomes("done", ended=now))
            .when(((op == "fail") & mine) | ((op == "reconcile") & running), back)
            .when((op == "cancel") & open_, becomes("cancelled", ended=now))
            .otherwise(z)
        )

    history = F.sort_array(F.collect_list(F.struct("at_ms", "seq", "op", "owner")))
    return events.groupBy("job").agg(F.aggregate(history, start, step).alias("z")).select("job", "z.*")


def branch_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths of two file lists (path, unit_id) with what happened: added, changed or removed."""
    both = before.select("path", F.col("unit_id").alias("old")).join(after.select("path", F.col("unit_id").alias("new")), "path", "full")
    what = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("path", what.alias("change")).where("change IS NOT NULL")


def scd2_commit(files: DataFrame, after: DataFrame, at: int) -> DataFrame:
    """The file intervals (path, unit_id, valid_from_ms, invalidated_ms) after a commit at ``at``."""
    open_now = files.where(t.live()).select("path", "unit_id")
    gone = open_now.join(after, ["path", "unit_id"], "left_anti").withColumn("_gone", F.lit(True))
    closed = files.join(gone, ["path", "unit_id"], "left")
    end = F.when(F.col("_gone") & t.live(), F.lit(at).cast("bigint")).otherwise(F.col("invalidated_ms"))
    new = after.join(open_now, ["path", "unit_id"], "left_anti").select("path", "unit_id", F.lit(at).cast("bigint").alias("valid_from_ms"), F.lit(None).cast("bigint").alias("invalidated_ms"))
    return closed.select("path", "unit_id", "valid_from_ms", end.alias("invalidated_ms")).unionByName(new)


def latest_other(rows: DataFrame, among: DataFrame, group: str, key: str, at: str, out: str) -> DataFrame:
    """key, ``out``: for each of ``rows`` (key, group) the latest by ``at`` of ``among`` (key, group, at) in its group that
    is not itself. The two latest of a group are enough, so no pair is made; one row a group meets the rows."""
    two = Window.partitionBy(group).orderBy(F.desc(at), F.desc(key))
    best = among.where(F.col(at).isNotNull()).groupBy(group, key).agg(F.max(at).alias(at)).withColumn("_n", F.row_number().over(two)).where("_n <= 2")
    best = best.groupBy(group).agg(F.max(F.when(F.col("_n") == 1, F.col(key))).alias("_one"), F.max(F.when(F.col("_n") == 2, F.col(key))).alias("_two"))
    met = rows.select(group, key).where(F.col(key).isNotNull()).distinct().join(best, group).withColumn(out, F.when(F.col("_one") != F.col(key), F.col("_one")).otherwise(F.col("_two")))
    return met.where(F.col(out).isNotNull()).select(key, out)
