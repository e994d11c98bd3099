"""Operators that SQL can't express, against small models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import plans, streaming
from tessera.operators import code, evaluation, graph, ranking, relational, text, vector, writing
from tessera.sources.corpus import Store

DIR = "/root/testdata/sf0.001"


def test_mmr_prefers_variety():
    ids, scores = ["a", "b", "c"], [1.0, 0.9, 0.5]
    vecs = [np.array([1.0, 0]), np.array([1.0, 0.01]), np.array([0, 1.0])]
    assert [x[1] for x in ranking.diversify_rows(ids, scores, vecs, 3, 1.0, 0.3)] == ["a", "c", "b"]
    assert [x[1] for x in ranking.diversify_rows(ids, scores, vecs, 3, 1.0, 1.0)] == ["a", "b", "c"]


def test_fold_keeps_protected_pairs_and_needs_a_kept_result():
    ids, scores = ["a", "b", "c"], [1.0, 0.9, 0.8]
    vecs = [np.array([1.0, 0]), np.array([1.0, 0.001]), None]
    assert ranking.diversify_rows(ids, scores, vecs, 3, 0.93, 1.0) == [(1, "a", ["b"]), (2, "c", [])]
    assert ranking.diversify_rows(ids, scores, vecs, 3, 0.93, 1.0, {("a", "b")}) == [(1, "a", []), (2, "b", []), (3, "c", [])]
    assert ranking.diversify_rows(ids, scores, vecs, 3, 0.93, 1.0, set(), {("b", "c")}) == [(1, "a", ["b"]), (2, "c", [])]
    assert ranking.diversify_rows(ids, scores, vecs, 3, 1.0, 1.0, set(), {("a", "c")}) == [(1, "a", []), (2, "b", []), (3, "c", [])]


def pagerank(edges, seeds, alpha=0.5):
    out, degree = {}, {}
    for s, d, kind, w in edges:
        c = graph.CONDUCTANCE.get(kind, 0) * (w or 1)
        if c > 0 and s != d:
            for a, b in ((s, d), (d, s)):
                out.setdefault(a, []).append((b, c))
                degree[a] = degree.get(a, 0) + c
    total = sum(seeds.values())
    p = {k: v / total for k, v in seeds.items()}
    r = dict(p)
    for _ in range(20):
        n = {}
        for a, m in r.items():
            for b, c in out.get(a, []):
                n[b] = n.get(b, 0) + alpha * m * c / degree[a]
        for k, v in p.items():
            n[k] = n.get(k, 0) + (1 - alpha) * v
        change = sum(abs(n.get(k, 0) - r.get(k, 0)) for k in {*n, *r})
        r = n
        if change < 1e-6:
            break
    return r


def test_pagerank(spark):
    rng = random.Random(1)
    kinds = [*graph.CONDUCTANCE, "supersedes"]
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.choice(kinds), rng.choice([0.0, 0.5, 1.0])) for _ in range(40)]
    seeds = {"n0": 2.0, "n1": 1.0, "lone": 1.0}
    e = spark.createDataFrame([("q", *x) for x in edges], "query_id string, src string, dst string, type string, weight double")
    s = spark.createDataFrame([("q", k, v) for k, v in seeds.items()], "query_id string, id string, score double")
    got = {r.id: r["rank"] for r in graph.personalised_pagerank(e, s).collect()}
    by_group = {(r.query_id, r.id): (round(r["rank"], 6), r.via) for r in graph.pagerank_within(e, s).collect()}
    assert by_group == {(r.query_id, r.id): (round(r["rank"], 6), r.via) for r in graph.personalised_pagerank(e, s).collect()}
    alone = graph.pagerank_within(e.limit(0), s).collect()  # seeds without an edge keep their restart only
    assert {r.id for r in alone} == {r.id for r in s.where("score > 0").collect()} and all(r.via is None for r in alone)
    want = pagerank(edges, seeds)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(f"{rng.randrange(60):02d}", f"{rng.randrange(60):02d}") for _ in range(45)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in pairs)}
    got = {r.id: r.root for r in graph.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == want


def test_terminal_successors_survive_cycles(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 1), ("c", None), ("x", 1), ("y", 1)], "id string, invalidated_ms long")
    edges = spark.createDataFrame([("b", "a", "supersedes", None), ("c", "b", "supersedes", None), ("y", "x", "supersedes", None), ("x", "y", "supersedes", None)], "src string, dst string, type string, invalidated_ms long")
    got = {(r.id, r.successor) for r in graph.terminal_successors(nodes.where("invalidated_ms IS NOT NULL").select("id"), nodes, edges).collect()}
    assert got == {("a", "c"), ("b", "c")}


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(50, 8)).astype(np.float32)
    m[7] = 0
    rows = spark.createDataFrame([(f"c{i:02d}", v.tolist()) for i, v in enumerate(m)], "chunk_id string, embedding array<float>").repartition(3)
    got = {}
    for r in vector.knn(rows.where("chunk_id < 'c05'").withColumnRenamed("chunk_id", "query_id"), rows, 4, "chunk_id").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    n = np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    u = np.divide(m, n, where=n > 0, out=np.zeros((50, 8)))
    s = np.round(u @ u.T, 6)
    for i in range(5):
        assert [x for _, x in sorted(got[f"c{i:02d}"])] == [f"c{j:02d}" for j in sorted(range(50), key=lambda j: (-s[i, j], j))[:4]]


def test_chunks_follow_headings():
    text = "# Intro\nhello\n\n## Ranking\nscores\n\n## Decay\ndays"
    got = writing.chunks_of("n", text)
    assert [(h, k) for _, h, k, _ in got] == [("H1: Intro", 0), ("H1: Intro > H2: Ranking", 1), ("H1: Intro > H2: Decay", 2)]
    changed = writing.chunks_of("n", text.replace("days", "weeks"))
    assert sum(a[0] != b[0] for a, b in zip(got, changed)) == 1
    assert {x[0] for x in got}.isdisjoint(x[0] for x in writing.chunks_of("m", text))
    assert all(len(t) <= 1600 for *_, t in writing.chunks_of("n", "word " * 5000))


def test_rewrite_keeps_sections_labels_and_code(spark):
    body = "see [[My Note#part|label]] and [[my-note]] but `[[my-note]]` and [[other]] [ ```\n[[my note]]"
    df = spark.createDataFrame([(body, "My Note", "new"), (body, "my note", None), ("[[a]] `[[a]]` [[a#b]] [[a|]]", "A", "z"), ("", "x", "y")], "body string, link string, target string")
    got = [tuple(r.r) for r in df.select(writing.rewrite(F.col("body"), F.col("link"), F.col("target")).alias("r")).collect()]
    assert got == [
        ("see [[new#part|label]] and [[new]] but `[[my-note]]` and [[other]] [ ```\n[[my note]]", 2),
        ("see label and my-note but `[[my-note]]` and [[other]] [ ```\n[[my note]]", 2),
        ("[[z]] `[[a]]` [[z#b]] [[z|]]", 3),
        ("", 0),
    ]


def test_query_terms(spark):
    df = spark.createDataFrame([(1, 'plain "a quoted-phrase" words'), (2, "  !! "), (3, 'open "quote')], "id int, q string")
    got = [(r.id, r.term) for r in text.query_terms(df, "id", "q").orderBy("id", "pos").collect()]
    assert got == [(1, "a quoted phrase"), (1, "plain"), (1, "words"), (3, "open"), (3, "quote")]


def test_budget_skips_and_continues(spark):
    df = spark.createDataFrame([("k", 1, "a", 60), ("k", 2, "b", 50), ("k", 3, "c", 40)], "key string, pos int, item string, cost long")
    got = {r.item for r in relational.within_budget(df, "key", ["pos"], "cost", 100, "item").collect()}
    assert got == {"a", "c"}


def test_capped_matching(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("a", "d", 0.7), ("c", "d", 0.6)], "a string, b string, score double")
    got = {(r.a, r.b) for r in writing.capped_matching(pairs, 2).collect()}
    assert got == {("a", "b"), ("a", "c"), ("c", "d")}


def test_capped_matching_is_the_greedy_one(spark):
    rng = random.Random(9)
    rows = sorted({(f"{a:02d}", f"{b:02d}", rng.choice([0.5, 0.6, 0.7])) for a, b in ((rng.randrange(15), rng.randrange(15, 30)) for _ in range(120))})
    rows = list({r[:2]: r for r in rows}.values())
    want, n = set(), {}
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if n.get(a, 0) < 3 and n.get(b, 0) < 3:
            n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
            want.add((a, b))
    assert {(r.a, r.b) for r in writing.capped_matching(spark.createDataFrame(rows, "a string, b string, score double"), 3).collect()} == want


def test_backbone_is_kruskals(spark):
    rng = random.Random(4)
    kinds = ["supersedes", "derived_from", "similar_to", "references"]
    rows = list({(f"{rng.randrange(20):02d}", f"{rng.randrange(20):02d}", rng.choice(kinds)): rng.choice([0.5, 0.7]) for _ in range(50)}.items())
    rows = [(*k, rng.choice(["agent", "system"]), w) for k, w in rows]
    strength = lambda t, p: 5 if t == "supersedes" else 4 if p == "agent" and t != "similar_to" else 3 if t == "derived_from" else 1 if t == "similar_to" else 2
    root, want = {}, set()

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for s, d, t, p, w in sorted(rows, key=lambda r: (-strength(r[2], r[3]), -r[4], r[0], r[1], r[2])):
        if find(s) != find(d):
            root[find(s)] = find(d)
            want.add((s, d, t))
    got = graph.backbone(spark.createDataFrame(rows, "src string, dst string, type string, provenance string, weight double")).collect()
    assert {tuple(r) for r in got} == want


def test_budget_matches_the_plain_walk(spark):
    rng = random.Random(6)
    rows = [("k", i, f"i{i:03d}", rng.choice([0, 1, 5, 30, 60, 90, 200])) for i in range(200)]
    used, want = 0, set()
    for _, _, item, cost in rows:
        if used + cost <= 300:
            used += cost
            want.add(item)
    got = relational.within_budget(spark.createDataFrame(rows, "key string, pos int, item string, cost long"), "key", ["pos"], "cost", 300, "item")
    assert {r.item for r in got.collect()} == want


def test_xorshift_is_the_32_bit_sequence():
    g, s, want = evaluation.xorshift(1), 1, []
    for _ in range(5):
        s ^= s << 13 & 0xFFFFFFFF
        s ^= s >> 17
        s ^= s << 5 & 0xFFFFFFFF
        want.append(s / 2**32)
    assert [next(g) for _ in range(5)] == want and want[0] == 270369 / 2**32


def test_fnv1a(spark):
    assert vector.fnv1a("") == 0x811C9DC5 and vector.fnv1a("a") == 0xE40C292C
    texts = ["", "a", "é ñ", "a\nb", "\U0001F600 x", "日本"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.fnv1a(F.col("t")).alias("h")).collect()
    assert all(r.h == vector.fnv1a(r.t) for r in rows)


def test_streams_agree_with_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(4).write.parquet(folder)
    events = spark.read.parquet(folder)
    stream = streaming.event_stream(spark, folder, events.schema)
    fed = streaming.drain(streaming.activity_feed(stream), "append", str(tmp_path))
    assert sorted(map(tuple, fed.collect())) == sorted(map(tuple, streaming.activity_feed(events).collect()))
    # windows that the watermark has passed are the batch's windows, once and unchanged
    batch = {(r.user_id, r.start): r.calls for r in streaming.quota_windows(events).collect()}
    calls = streaming.drain(streaming.quota_windows(stream, late="400 days"), "append", str(tmp_path)).collect()
    assert all(batch[r.user_id, r.start] == r.calls for r in calls)
    assert streaming.sessions(events).agg(F.sum("events")).first()[0] == events.count()
    chunks = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    assert [r.chunk_id for r in streaming.pending(chunks, chunks.where("chunk_id = 'c1'")).collect()] == ["c2"]


def test_file_sources(spark, tmp_path):
    from tessera.sources import files

    (tmp_path / "gold.jsonl").write_text('{"query": " q ", "gold": ["a"], "origin": "mined"}\n\n{"query": \n{"query": "x", "gold": [], "origin": "mined"}\n{"query": "x", "gold": ["b"], "origin": "guess"}\n')
    got = files.gold_file(spark, str(tmp_path / "gold.jsonl")).collect()
    assert [(r.query, r.malformed) for r in got if not r.malformed] == [("q", False)] and sum(r.malformed for r in got) == 3
    (tmp_path / "set.json").write_text('{"docs": [{"id": "d1", "title": "t", "content": "c"}], "queries": [{"query": "q", "relevant": ["d1"]}], "edges": []}')
    found = files.evaluation_set(spark, str(tmp_path / "set.json"))
    assert found["docs"].count() == 1 and found["queries"].first().relevant == ["d1"] and found["edges"].count() == 0
    (tmp_path / "run.jsonl").write_text('{"session": "s", "step": 1, "tool": "search"}\nnoise\n{"session": "s", "step": 2, "tool": "get", "error": "no"}\n')
    assert [(r.tool, r.ok) for r in files.transcripts(spark, str(tmp_path / "run.jsonl")).orderBy("step").collect()] == [("search", True), ("get", False)]
    src = tmp_path / "src"
    for name, body in {"a.ts": b"export class A {}\nfunction b() {}", "vendor/c.ts": b"class C {}", "d.txt": b"x", "e.rs": b"\0" * 100, "f.lua": b"-- x"}.items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_bytes(body)
    found = files.code_files(spark, str(src))
    assert {(r.path.rsplit("/", 1)[1], r.lang) for r in found.collect()} == {("a.ts", "typescript"), ("f.lua", "lua")}
    named = code.symbols(found.withColumn("content", F.col("content").cast("string"))).where("kind <> 'module'").collect()
    assert {(r.kind, r.name, r.start_line) for r in named} == {("class", "A", 1), ("function", "b", 2)}


def merge(spark, notes, additions=(), conflicts=()):
    n = spark.createDataFrame(notes, "id string, body string, other string")
    a = spark.createDataFrame(list(additions), "id string, pos int, section string, text string")
    c = spark.createDataFrame(list(conflicts), "id string, pos int, text string")
    return {r.id: r.text for r in writing.merge_notes(n, a, c).collect()}


def test_merged_notes_say_nothing_twice(spark):
    note = "intro\n\n## Facts\n- one\n- two\n\n## Other\ntext"
    add = [("Facts", "three"), ("Facts", "- one"), ("Nowhere", "four"), ("Facts", "1. three"), ("Other", "five"), ("Facts", " ")]
    got = merge(spark, [("n", note, "Twin"), ("m", "- a\n", "Twin"), ("o", "plain", "Twin"), ("e", None, "T")], [("n", k, *x) for k, x in enumerate(add)] + [("m", 0, "x", "b"), ("o", 0, "", "b\nc"), ("o", 1, "", "d")], [("n", 0, "a or b"), ("n", 1, "a or b")])
    assert got["n"] == "intro\n\n## Facts\n- one\n- two\n- three\n\n## Other\ntext\n\n- five\n\n## Merged from: Twin\n- four\n\n## Unresolved conflicts\n- a or b"
    assert got["m"] == "- a\n- b" and got["o"] == "plain\n\nb\nc\n- d" and got["e"] == ""


def test_sections_hold_their_subsections_and_code_has_no_headings(spark):
    note = "# A\nx\n## B\ny\n\n```\n# C\n```\n\n# D #\nz\n# A\nw"
    got = merge(spark, [("n", note, "T")], [("n", 0, "A", "p"), ("n", 1, "B", "q"), ("n", 2, "C", "r"), ("n", 3, "D", "s")])
    assert got["n"] == "# A\nx\n## B\ny\n\n```\n# C\n```\n\n- p\n- q\n\n# D #\nz\n\n- s\n# A\nw\n\n## Merged from: T\n- r"


def test_distilled(spark):
    df = spark.createDataFrame([(" sum ", ["- a", "b", "a", " "]), ("", ["x"]), ("s", [])], "s string, f array<string>")
    assert [r[0] for r in df.select(writing.distilled(F.col("s"), F.col("f"))).collect()] == ["sum\n\n- a\n- b", "- x", "s"]


def test_ulid_shaped(spark):
    import hashlib

    keys, letters = ["a", "", "é", "N000000001"], "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
    got = {r.k: r.ulid for r in writing.ulid_shaped(spark.createDataFrame([(k,) for k in keys], "k string"), "k").collect()}
    for k in keys:
        n = int.from_bytes(hashlib.sha256(k.encode()).digest()[:16], "big")
        assert got[k] == "".join(letters[n // 32**i % 32] for i in reversed(range(26)))


def test_links_of_every_note_are_rewritten(spark):
    got = [r.id for r in plans.queries()["x3_rewrite_links"](spark, DIR).collect()]
    assert sorted(got) == sorted(r.id for r in Store(spark, DIR).linked.select("id").collect())


def test_working_set_weighs_whole_notes(spark):
    used = {r.node_id: -(-len(r.content) // 4) for r in Store(spark, DIR).current.select("node_id", "content").collect() if r.content}
    spent = {}
    for r in plans.queries()["e19_working_set"](spark, DIR).collect():
        spent[r.scope] = spent.get(r.scope, 0) + used.get(r.id, 0)
    assert spent and max(spent.values()) <= 1500


def test_unsettled_components_are_an_error(spark):
    edges = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(40)], "a string, b string")
    with pytest.raises(RuntimeError):
        graph.components(edges, most=1)


def test_successors_of_a_long_chain(spark):
    n = 33
    nodes = spark.createDataFrame([(f"n{i:02d}", None if i == n else 1) for i in range(n + 1)], "id string, invalidated_ms bigint")
    edges = spark.createDataFrame([(f"n{i + 1:02d}", f"n{i:02d}", "supersedes", None) for i in range(n)], "src string, dst string, type string, invalidated_ms bigint")
    got = graph.terminal_successors(nodes.where("id = 'n00'").select("id"), nodes, edges).collect()
    assert [(r.id, r.successor) for r in got] == [("n00", f"n{n}")]


def test_phrases_of_many_lengths(spark):
    words = [f"w{chr(97 + i)}" for i in range(20)]
    docs = spark.createDataFrame([(1, " ".join(words))], "id int, body string")
    phrases = spark.createDataFrame([(n, " ".join(words[:n])) for n in range(1, 21)], "phrase_id int, phrase string")
    assert {r.phrase_id for r in text.phrase_hits(docs, "id", "body", phrases).collect()} == set(range(1, 21))


def test_job_states_stream_as_the_fold(spark, tmp_path):
    rng = random.Random(14)
    ops = ["claim"] * 4 + ["renew", "succeed", "fail", "fail", "cancel", "reconcile"]
    rows = [(f"j{rng.randrange(30)}", 1000 * k, k, rng.choice(ops[:-2] if rng.random() < 0.9 else ops), f"w{rng.randrange(2)}") for k in range(600)]
    schema = "job string, at_ms long, seq long, op string, owner string"
    for k in range(3):  # three files in order of time are three batches
        spark.createDataFrame(rows[200 * k : 200 * (k + 1)], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    df = spark.createDataFrame(rows, schema)
    want = {tuple(r) for r in relational.fold_jobs(df, 5000, 3).collect()}
    assert {r[1] for r in want} >= {"done", "failed", "running"}
    got = streaming.latest(streaming.job_states(streaming.event_stream(spark, f"file://{tmp_path}/in", schema), 5000, 3), f"file://{tmp_path}/out", "job")
    assert {tuple(r) for r in got.select("job", "state", "owner", "expires_ms", "attempts", "ended_ms").collect()} == want


def test_bootstraps(spark):
    rng = random.Random(3)
    body = [(f"q{k:03d}", "x", rng.random(), rng.random() + 0.5) for k in range(80)]
    paired = evaluation.paired_bootstrap(spark.createDataFrame(body, "query_id string, arm string, a double, b double"), 400).first()
    mean = sum(b - a for *_, a, b in body) / 80
    assert abs(paired.delta - mean) < 1e-9 and paired.low < mean < paired.high and paired.high - paired.low < 0.4
    sides = [(q, "x", "ab"[k % 2], a + k % 2) for k, (q, _, a, _) in enumerate(body)]
    both = evaluation.unpaired_bootstrap(spark.createDataFrame(sides, "query_id string, arm string, side string, value double"), 400).first()
    assert 0.7 < both.low < both.delta < both.high < 1.3
    one = spark.createDataFrame(sides[:1], "query_id string, arm string, side string, value double")
    assert evaluation.unpaired_bootstrap(one, 10).count() == 0


def test_fold_replay(spark):
    rows = [("e", 0, "a"), ("e", 1, "b"), ("e", 2, "c"), ("e", 3, "d"), ("f", 0, "a"), ("f", 1, "x")]
    vectors = [("a", [1.0, 0.0]), ("b", [0.9, 0.436]), ("c", [0.0, 1.0]), ("d", [0.1, 0.995])]
    shown = spark.createDataFrame(rows, "event_id string, rank int, node_id string")
    got = {r.gate: (r.searches_with_fold, r.folds) for r in writing.replay_folds(shown, spark.createDataFrame(vectors, "node_id string, embedding array<float>"), [0.5, 0.95, 0.999]).collect()}
    assert got == {0.5: (1, 2), 0.95: (1, 1), 0.999: (0, 0)}


def test_stems(spark):
    words = {"classes": "class", "ponies": "poni", "cats": "cat", "gas": "gas", "running": "runn", "played": "play", "glass": "glass", "virus": "virus", "sing": "sing", "stresses": "stress"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.s for r in df.select("w", text.stem(F.col("w")).alias("s")).collect()} == words


def test_phrases_of_any_length(spark):
    docs = spark.createDataFrame([("d1", "one two three four five"), ("d2", "two three"), ("d3", "one two three five four"), ("d4", None), ("d5", "one")], "id string, body string")
    asked = ["one", "two three", "one two three", "one two three four", "one two three four five six", "", "!!"]
    phrases = spark.createDataFrame(list(enumerate(asked)), "phrase_id int, phrase string")
    got = {(r.phrase_id, r.id) for r in text.phrase_hits(docs, "id", "body", phrases).collect()}
    bodies = {"d1": "one two three four five", "d2": "two three", "d3": "one two three five four", "d5": "one"}
    assert got == {(k, d) for k, p in enumerate(asked[:5]) for d, b in bodies.items() if f" {p} " in f" {b} "}
    assert text.phrase_hits(docs, "id", "body", phrases.limit(0)).count() == 0
