"""The best part of a note for each query, against a plain count; hits are never rows."""

import random
import re

from tessera.operators import sections, text
from tessera.plans import queries


def test_best_parts(spark, monkeypatch):
    monkeypatch.setattr(text, "WORDS_A_GROUP", 40)
    monkeypatch.setattr(text, "QUERIES_A_BLOCK", 3)
    rng, words = random.Random(4), [f"w{k}" for k in range(30)]
    bodies = {f"n{k}": "\n# h\n".join(" ".join(rng.choices(words, k=rng.randrange(30))) for _ in range(rng.randrange(1, 6))) for k in range(40)}
    bodies |= {"empty": "", "none": None, "blank": "# \n \n", "other": "no such word"}
    asked = {q: set(rng.sample(words, rng.randrange(1, 9))) for q in range(8)} | {8: {"absent"}}
    notes = spark.createDataFrame(list(bodies.items()), "id string, body string")
    got = text.best_parts(sections.stretches(notes, "id", "body"), "id", spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id long, term string"))
    want = set()
    for r in {r.id for r in notes.collect()}:
        parts = [(p.seq, set(re.findall(r"\w+", p.text))) for p in sections.split(notes.where(notes.id == r), "id", "body").collect()] if r in ("n0", "n1", "empty", "none", "blank", "other") else None
        if parts is None:
            parts = [(k, set(re.findall(r"\w+", p))) for k, p in enumerate(re.split(r"\n(?=# h\n)", bodies[r]))]
        for q, terms in asked.items():
            best = max(((len(terms & held), -seq) for seq, held in parts), default=(0, 0))
            if best[0]:
                want.add((q, r, -best[1], best[0]))
    found = list(map(tuple, got.collect()))
    assert set(found) == want and len(found) == len(want)


def test_hits_are_not_shuffled(spark):
    plan = queries()["t4_best_chunk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, node_id", plan)
