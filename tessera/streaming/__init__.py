"""Structured Streaming forms of the stateful operators: feed, quotas, sessions, queue drain.

Each takes a streaming (or batch) frame of events and returns the transformed frame; ``drain`` runs a
stream over the files that are there and stops, which is how tests and back-fills use them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def activity_feed(events: DataFrame) -> DataFrame:
    """Events as the feed shows them: with whether they went well."""
    return events.select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.error").isNull().alias("ok"))


def quota_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Calls of each user in windows, one after another or each ``slide`` later than the one before; later data than the watermark is dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.window("at", window, slide).alias("w")).agg(F.count("*").alias("calls")).select("user_id", F.col("w.start").alias("start"), "calls")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events no further apart than the gap."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def pending(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The embedding queue: chunks without a vector."""
    return chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti")


_JOB = "job string, state string, owner string, expires_ms long, attempts long, ended_ms long"


def job_states(events: DataFrame, lease_ms: int, most: int) -> DataFrame:
    """The state of each job after each batch that has events of it: the stateful form of
    ``relational.fold_jobs``, for events (job, at_ms, seq, op, owner). Events of a batch are taken in order of time."""
    import pandas as pd

    def become(z: tuple, at: int, op: str, owner: str) -> tuple:
        state, holder, expires, attempts, ended = z
        running = state == "running"
        mine, spent = running and holder == owner, attempts >= most
        if op == "claim" and not spent and (state == "pending" or running and expires <= at):
            return "running", owner, at + lease_ms, attempts + 1, None
        if op == "renew" and mine:
            return "running", holder, at + lease_ms, attempts, None
        if op == "succeed" and mine:
            return "done", None, None, attempts, at
        if op == "fail" and mine or op == "reconcile" and running:
            return ("failed", None, None, attempts, at) if spent else ("pending", None, None, attempts, None)
        if op == "cancel" and state not in ("done", "failed", "cancelled"):
            return "cancelled", None, None, attempts, at
        return z

    def run(key, frames, state):
        z = state.get if state.exists else ("pending", None, None, 0, None)
        rows = pd.concat(list(frames)).sort_values(["at_ms", "seq"])
        for at, op, owner in zip(rows.at_ms, rows.op, rows.owner):
            z = become(tuple(z), int(at), op, owner)
        state.update(z)
        yield pd.DataFrame([(key[0], *z)], columns=[x.split()[0] for x in _JOB.split(", ")]).astype({"expires_ms": "Int64", "ended_ms": "Int64"})

    return events.groupBy("job").applyInPandasWithState(run, _JOB, _JOB.split(", ", 1)[1], "update", "NoTimeout")


_CANDIDATE = "candidate string, status string, proposal string, decided_ms long, changed array<string>, revived array<string>"


def candidate_states(events: DataFrame) -> DataFrame:
    """The state of each candidate after each batch that has events of it: the stateful form of
    ``lifecycle.candidate_states``, for events (candidate, at_ms, seq, op, note, changes). What the standing decision has
    changed is a list state; undoing it gives that list back as ``revived``."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    from tessera.operators.lifecycle import MOVES, STATUS

    class Candidate(StatefulProcessor):
        def init(self, handle):
            self.row = handle.getValueState("row", "status string, proposal string, decided_ms long")
            self.changed = handle.getListState("changed", "artifact string")

        def handleInputRows(self, key, rows, timerValues):
            status, proposal, decided = self.row.get() if self.row.exists() else ("n", None, None)
            changed, revived = [x[0] for x in self.changed.get()], []
            for x in pd.concat(list(rows)).sort_values(["at_ms", "seq"]).itertuples():
                needs, gives = MOVES[x.op]
                if status != needs:
                    continue
                status = gives
                if x.op == "propose":
                    proposal = x.note
                elif x.op == "reopen":
                    proposal = decided = None
                elif x.op == "undo":
                    revived, changed, decided = revived + changed, [], None
                elif x.op != "detect":
                    decided = int(x.at_ms)
                    changed = list(x.changes) if x.op == "apply" else []
            self.row.update((status, proposal, decided))
            self.changed.put([(c,) for c in changed]) if changed else self.changed.clear()
            yield pd.DataFrame({"candidate": [key[0]], "status": [STATUS[status]], "proposal": [proposal], "decided_ms": pd.array([decided], "Int64"), "changed": [changed], "revived": [revived]})

    return events.groupBy("candidate").transformWithStateInPandas(Candidate(), _CANDIDATE, "update", "none")


_LEASE = "role string, owner string, what string, at_ms long"


def leases(events: DataFrame, ttl_ms: int, late: str = "0 seconds") -> DataFrame:
    """What becomes of worker leases: ``granted``, ``refused``, ``released`` and ``expired``, for events (role, at_ms, seq,
    op, owner). A lease ends by a timer once the watermark of all roles has passed it; no event of its own role is needed."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Lease(StatefulProcessor):
        def init(self, handle):
            self.handle, self.held = handle, handle.getValueState("held", "owner string, until_ms long")

        def set(self, owner=None, until=None):
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if owner is None:
                self.held.clear()
            else:
                self.held.update((owner, until))
                self.handle.registerTimer(until)

        def handleInputRows(self, key, rows, timerValues):
            out = []
            owner, until = self.held.get() if self.held.exists() else (None, 0)
            for x in pd.concat(list(rows)).sort_values(["at_ms", "seq"]).itertuples():
                at = int(x.at_ms)
                if owner is not None and until <= at:
                    out.append((owner, "expired", until))
                    owner = None
                if x.op == "release":
                    if owner == x.owner:
                        out.append((owner, "released", at))
                        owner = None
                elif owner in (None, x.owner):
                    owner, until = x.owner, at + ttl_ms
                    out.append((owner, "granted", at))
                else:
                    out.append((x.owner, "refused", at))
            self.set(owner, until)
            yield pd.DataFrame([(key[0], *x) for x in out], columns=[x.split()[0] for x in _LEASE.split(", ")])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.held.exists():
                owner, until = self.held.get()
                self.held.clear()
                yield pd.DataFrame([(key[0], owner, "expired", until)], columns=[x.split()[0] for x in _LEASE.split(", ")])

    timed = events.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return timed.groupBy("role").transformWithStateInPandas(Lease(), _LEASE, "append", "eventTime")


def latest(stream: DataFrame, folder: str, key: str) -> DataFrame:
    """Run an updating stream over what is there and return the last row of each key."""
    out = f"{folder}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{out}/data")

    query = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{out}/data")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in stream.columns if c != key]), "batch").alias("z")).select(key, "z.*")


def drain(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run the stream over what is there, into Parquet below ``folder``, and read the result."""
    out = f"{folder}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data")
