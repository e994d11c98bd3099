"""Life cycles folded from events: consolidation candidates with undo and reopening, what their decisions retire,
and worker leases.

A candidate's status is a finite automaton, so what a stretch of events does is a map of its four statuses, and
maps of stretches compose. Histories are cut into slots of time, each slot is folded to such a map on its
own, the maps of a candidate give the status at the start of each slot, and then every event knows the
status that it met. No history is ever one array, and a candidate that most events belong to is many rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settle

#: Letters of the statuses, and of each operation the status that it needs and the one that it gives.
STATUS = {"n": "none", "p": "pending", "a": "applied", "d": "dismissed"}
MOVES = {"detect": "np", "propose": "pp", "apply": "pa", "dismiss": "pd", "undo": "ap", "reopen": "dp"}
SLOT_MS = 86_400_000


def _after(states: Column, op: Column) -> Column:
    """A string of statuses after an operation: each that it needs becomes what it gives, others stay."""
    out = states
    for name, (needs, gives) in MOVES.items():
        out = F.when(op == name, F.translate(states, needs, gives)).otherwise(out)
    return out


def effective(events: DataFrame, slot_ms: int = SLOT_MS) -> DataFrame:
    """The events (candidate, at_ms, seq, op, ...) that change something: those that meet the status they need, in
    order of time and number."""
    rows = settle(events.withColumn("slot", F.floor(F.col("at_ms") / slot_ms)))
    listed = rows.groupBy("candidate", "slot").agg(F.sort_array(F.collect_list(F.struct("at_ms", "seq", "op"))).alias("xs"))
    whole = listed.select("candidate", "slot", F.aggregate("xs", F.lit("npad"), lambda z, x: _after(z, x["op"])).alias("map"))
    slots = whole.groupBy("candidate").agg(F.sort_array(F.collect_list(F.struct("slot", "map"))).alias("ms"))
    compose = lambda s, m: F.call_function("translate", s, F.lit("npad"), m)
    starts = F.aggregate("ms", F.array(F.lit("n")), lambda z, m: F.concat(z, F.array(compose(F.element_at(z, -1), m["map"]))))
    slots = slots.select("candidate", F.inline(F.zip_with("ms", F.slice(starts, 1, F.size("ms")), lambda m, s: F.struct(m["slot"].alias("slot"), s.alias("start")))))
    met = F.aggregate("xs", F.array("start"), lambda z, x: F.concat(z, F.array(_after(F.element_at(z, -1), x["op"]))))
    told = listed.join(slots, ["candidate", "slot"]).select("candidate", F.inline(F.zip_with("xs", F.slice(met, 1, F.size("xs")), lambda x, s: F.struct(x["at_ms"].alias("at_ms"), x["seq"].alias("seq"), s.alias("met")))))
    needs = F.create_map(*[F.lit(x) for op, (n, _) in MOVES.items() for x in (op, n)])
    return rows.drop("slot").join(told, ["candidate", "at_ms", "seq"]).where(F.col("met") == needs[F.col("op")]).drop("met")


def candidate_states(done: DataFrame, every: DataFrame) -> DataFrame:
    """candidate, status, proposal, decided_ms, reopened, undone of each candidate of ``every``, from the effective events
    ``done`` (candidate, at_ms, seq, op, note). A proposal lasts until the candidate is reopened."""
    when = F.struct("at_ms", "seq")
    gives = F.create_map(*[F.lit(x) for op, (_, g) in MOVES.items() for x in (op, STATUS[g])])
    last = lambda *ops: F.max(F.when(F.col("op").isin(*ops), when))
    proposed = F.max(F.when(F.col("op") == "propose", F.struct("at_ms", "seq", "note")))
    found = done.groupBy("candidate").agg(
        F.max_by(gives[F.col("op")], when).alias("status"), proposed.alias("p"), last("reopen").alias("r"), last("apply", "dismiss").alias("d"),
        F.count_if(F.col("op") == "reopen").alias("reopened"), F.count_if(F.col("op") == "undo").alias("undone"),
    )
    kept = F.col("r").isNull() | (F.struct("p.at_ms", "p.seq") > F.col("r"))
    decided = F.when(F.col("status").isin("applied", "dismissed"), F.col("d.at_ms"))
    found = found.select("candidate", "status", F.when(F.col("p").isNotNull() & kept, F.col("p.note")).alias("proposal"), decided.alias("decided_ms"), "reopened", "undone")
    rows = every.select("candidate").distinct().join(found, "candidate", "left")
    return rows.select("candidate", F.coalesce("status", F.lit("none")).alias("status"), "proposal", "decided_ms", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("reopened", "undone")])


def artifact_states(done: DataFrame) -> DataFrame:
    """artifact, retired_ms, by, decisions of everything that an effective ``apply`` (candidate, at_ms, seq, op, changes)
    ever retired. An artifact is retired by the first decision that still stands, and live again when
    none does: undoing one decision leaves what another has retired."""
    when = F.struct("at_ms", "seq")
    ends = done.where(F.col("op").isin("apply", "undo")).groupBy("candidate").agg(F.max(F.when(F.col("op") == "apply", when)).alias("a"), F.max(F.when(F.col("op") == "undo", when)).alias("u"))
    standing = ends.where(F.col("u").isNull() | (F.col("a") > F.col("u"))).select("candidate", "a.at_ms", "a.seq", F.lit(True).alias("stands"))
    touched = done.where("op = 'apply'").select("candidate", "at_ms", "seq", F.explode("changes").alias("artifact"))
    rows = touched.join(standing, ["candidate", "at_ms", "seq"], "left")
    first = F.min(F.when(F.col("stands"), F.struct("at_ms", "candidate")))
    return rows.groupBy("artifact").agg(first.alias("f"), F.count("*").alias("decisions")).select("artifact", F.col("f.at_ms").alias("retired_ms"), F.col("f.candidate").alias("by"), "decisions")


def leases(events: DataFrame, ttl_ms: int) -> DataFrame:
    """role, at_ms, seq, owner, granted, expires_ms of each ``hold`` of events (role, at_ms, seq, op, owner): granted to an
    owner that has the lease, or to any where nobody has or it has ended; ``release`` by its owner ends it.

    A role's events pass in order through one task, which keeps the last lease only, so memory doesn't grow with them."""
    ordered = events.repartition("role").sortWithinPartitions("role", "at_ms", "seq").select("role", "at_ms", "seq", "op", "owner")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, holder, until = None, None, 0
        for b in batches:
            out = []
            for role, at, seq, op, owner in zip(*(b.column(k).to_pylist() for k in range(5))):
                if role != now:
                    now, holder, until = role, None, 0
                if op == "release":
                    holder = None if holder == owner else holder
                    continue
                granted = holder is None or holder == owner or until <= at
                if granted:
                    holder, until = owner, at + ttl_ms
                out.append((role, at, seq, owner, granted, until))
            if out:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["role", "at_ms", "seq", "owner", "granted", "expires_ms"])

    return ordered.mapInArrow(fold, "role string, at_ms long, seq long, owner string, granted boolean, expires_ms long")
