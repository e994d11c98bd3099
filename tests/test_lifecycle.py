"""Life cycles against folds written plainly, in batch and as streams that end in the same state."""

import random

import pytest

from tessera import streaming
from tessera.operators import lifecycle

SCHEMA = "candidate string, at_ms long, seq long, op string, note string, changes array<string>"
OPS = ["detect", "propose", "apply", "dismiss", "undo", "reopen"]


def history(n, hot=0.4):
    r = random.Random(n)
    out = []
    for k in range(n):
        c = "hot" if r.random() < hot else f"c{r.randrange(12)}"
        out.append((c, r.randrange(20) * 1000, k, r.choice(OPS), f"note {k}", [f"A{r.randrange(6)}", f"B{c}"]))
    return out


def fold(rows):
    state, retired = {}, {}
    for c, at, seq, op, note, changes in sorted(rows, key=lambda x: (x[1], x[2])):
        z = state.setdefault(c, {"status": "none", "proposal": None, "decided": None, "changed": [], "reopened": 0, "undone": 0})
        s = z["status"]
        if op == "detect" and s == "none":
            z["status"] = "pending"
        elif op == "propose" and s == "pending":
            z["proposal"] = note
        elif op == "apply" and s == "pending":
            z |= {"status": "applied", "decided": at, "changed": changes}
            for a in changes:
                retired.setdefault(a, 0)
                retired[a] += 1
        elif op == "dismiss" and s == "pending":
            z |= {"status": "dismissed", "decided": at}
        elif op == "undo" and s == "applied":
            z |= {"status": "pending", "decided": None, "changed": [], "undone": z["undone"] + 1}
        elif op == "reopen" and s == "dismissed":
            z |= {"status": "pending", "decided": None, "proposal": None, "reopened": z["reopened"] + 1}
    artifacts = {}
    for a, n in retired.items():
        stands = sorted((z["decided"], c) for c, z in state.items() if a in z["changed"])
        artifacts[a] = (*(stands[0] if stands else (None, None)), n)
    return state, artifacts


@pytest.mark.parametrize("slot", [1, 3000, 10**9])
def test_states_and_artifacts(spark, slot):
    rows = history(600)
    events = spark.createDataFrame(rows, SCHEMA).repartition(3)
    state, artifacts = fold(rows)
    done = lifecycle.effective(events, slot)
    got = {r.candidate: (r.status, r.proposal, r.decided_ms, r.reopened, r.undone) for r in lifecycle.candidate_states(done, events).collect()}
    assert got == {c: (z["status"], z["proposal"], z["decided"], z["reopened"], z["undone"]) for c, z in state.items()}
    assert {r.artifact: (r.retired_ms, r.by, r.decisions) for r in lifecycle.artifact_states(done).collect()} == artifacts
    assert any(v[0] is None for v in artifacts.values()) or any(v[2] > 1 for v in artifacts.values())


def test_undo_leaves_what_another_decision_retired(spark):
    rows = [("x", 1, 1, "detect", None, []), ("x", 2, 2, "apply", None, ["A", "B"]), ("y", 1, 3, "detect", None, []), ("y", 3, 4, "apply", None, ["B"]), ("x", 4, 5, "undo", None, [])]
    done = lifecycle.effective(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in lifecycle.artifact_states(done).collect()} == {("A", None, None, 1), ("B", 3, "y", 2)}


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    done = lifecycle.effective(none)
    assert lifecycle.candidate_states(done, none).count() == 0 and lifecycle.artifact_states(done).count() == 0


def files(spark, rows, schema, folder, parts):
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
    return streaming.event_stream(spark, f"file://{folder}/in", schema)


def test_stream_of_candidates(spark, tmp_path):
    rows = sorted(history(120), key=lambda x: (x[1], x[2]))
    stream = files(spark, rows, SCHEMA, tmp_path, 3)
    got = streaming.latest(streaming.candidate_states(stream), f"file://{tmp_path}/out", "candidate").collect()
    state, _ = fold(rows)
    assert {r.candidate: (r.status, r.proposal, r.decided_ms, sorted(r.changed)) for r in got} == {c: (z["status"], z["proposal"], z["decided"], sorted(z["changed"])) for c, z in state.items()}


LEASE = "role string, at_ms long, seq long, op string, owner string"


def test_leases_in_batch(spark):
    rows = [("r", 0, 1, "hold", "a"), ("r", 5, 2, "hold", "b"), ("r", 9, 3, "hold", "a"), ("r", 18, 4, "hold", "b"), ("r", 19, 5, "hold", "b"), ("r", 20, 6, "release", "a"), ("r", 21, 7, "release", "b"), ("r", 22, 8, "hold", "c"), ("q", 1, 9, "hold", "b")]
    got = {(r.role, r.at_ms): (r.owner, r.granted, r.expires_ms) for r in lifecycle.leases(spark.createDataFrame(rows, LEASE), 10).collect()}
    assert got == {("r", 0): ("a", True, 10), ("r", 5): ("b", False, 10), ("r", 9): ("a", True, 19), ("r", 18): ("b", False, 19), ("r", 19): ("b", True, 29), ("r", 22): ("c", True, 32), ("q", 1): ("b", True, 11)}


def test_a_lease_ends_without_an_event_of_its_role(spark, tmp_path):
    rows = [("r", 1000, 1, "hold", "a"), ("q", 2000, 2, "hold", "b"), ("q", 50_000, 3, "hold", "b"), ("q", 90_000, 4, "release", "b"), ("q", 91_000, 5, "hold", "c"), ("q", 92_000, 6, "hold", "d")]
    stream = files(spark, rows, LEASE, tmp_path, 6)
    got = [tuple(r) for r in streaming.drain(streaming.leases(stream, 10_000), "append", f"file://{tmp_path}/out").collect()]
    assert ("r", "a", "expired", 11_000) in got  # r has one event only
    assert [x for x in got if x[0] == "q" and x[2] in ("released", "refused")] == [] or ("q", "d", "refused", 92_000) in got
    assert ("q", "b", "expired", 12_000) in got and ("q", "c", "granted", 91_000) in got and got.count(("r", "a", "expired", 11_000)) == 1
