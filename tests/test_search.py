"""The text index against BM25 written plainly."""

import math
import random
import re
from collections import Counter

import pytest

from tessera.operators import search
from tessera.operators.text import query_terms, stem, stem_of
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def words(t):
    return re.findall(r"[\w]+", (t or "").lower())


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(40)] + ["running", "runs", "run", "cats", "cat"]
    body = lambda n: " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=n))
    return [(f"d{k:03d}", r.choice([None, "", body(3)]), r.choice([None, body(5), body(60), body(200)])) for k in range(300)] + [("only", None, None), ("rare", "zebra", "the running zebra crossing and the running zebra crossing")]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('index')}/i"
    search.build(spark.createDataFrame(corpus, "id string, title string, body string"), "id", ("title", "body"), folder)
    return search.load(spark, folder, "id")


RAW = {1: '"w1 w2" w3 run', 2: '"running zebra crossing" nothing', 3: "cats", 4: '"w0 w0 w0"', 5: "", 6: "unknown words only", 7: '"w5 w1 w0 w2" w7 w8 w9', 8: 'w0 "w0" w0'}


@pytest.fixture(scope="module")
def queries(spark):
    rows = spark.createDataFrame(list(RAW.items()), "query_id int, raw string")
    return query_terms(rows, "query_id", "raw").select("query_id", "term").distinct()


def brute(spark, corpus, queries):
    asked = {}
    for q, t in map(tuple, queries.collect()):
        asked.setdefault(q, set()).add(t)
    every = sorted({w for d in corpus for f in d[1:] for w in words(f)} | {w for t in asked.values() for x in t for w in x.split()})
    stems = dict(map(tuple, spark.createDataFrame([(w,) for w in every], "w string").select("w", stem(F.col("w"))).collect()))
    out = {}
    for f in (1, 2):
        docs = {d[0]: [stems[w] for w in words(d[f])] for d in corpus}
        avg = sum(map(len, docs.values())) / len(docs)
        df = Counter(w for d in docs.values() for w in set(d))
        idf = lambda w: math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))  # noqa: B023, E731
        for q, terms in asked.items():
            for t in {tuple(stems[w] for w in t.split()) for t in terms}:
                for k, d in docs.items():
                    tf = sum(tuple(d[i : i + len(t)]) == t for i in range(len(d) - len(t) + 1))
                    if tf:
                        out[q, k] = out.get((q, k), 0) + sum(map(idf, t)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(d) / avg))
    return {k: round(v, 6) for k, v in out.items()}


def near(got, want):
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_scores_with_phrases(spark, corpus, index, queries):
    near({(r.query_id, r.id): r.score for r in search.scan(index, queries).collect()}, brute(spark, corpus, queries))


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_best_and_totals(spark, corpus, index, queries, k):
    want = brute(spark, corpus, queries)
    got = search.search_with_totals(index, queries, k).collect()
    for q in RAW:
        ranked = sorted((-s, d) for (a, d), s in want.items() if a == q)
        mine = sorted((r.rank, r.id, r.score, r.total) for r in got if r.query_id == q)
        assert [x[0] for x in mine] == list(range(1, min(k, len(ranked)) + 1)) and all(x[3] == len(ranked) for x in mine)
        assert all(abs(x[2] + s) < 2e-6 for x, (s, _) in zip(mine, ranked))


def test_best_among(spark, corpus, index, queries):
    some = spark.createDataFrame([(d[0],) for d in corpus[::3]], "id string")
    want = {k: v for k, v in brute(spark, corpus, queries).items() if k[1] in {d[0] for d in corpus[::3]}}
    got = search.search(index, queries, 5, some).collect()
    for q in RAW:
        ranked = sorted((-s, d) for (a, d), s in want.items() if a == q)[:5]
        assert [round(-s, 5) for s, _ in ranked] == [round(r.score, 5) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
    totals = dict(map(tuple, search.totals(index, *search._prepared(index, queries), some).collect()))
    assert totals == {q: n for q in RAW if (n := sum(a == q for a, _ in want))}


def test_blocks_are_skipped_and_rows_stay(spark, corpus, index):
    one = spark.createDataFrame([(1, "zebra")], "query_id int, term string")
    terms, hits = search._prepared(index, one)
    best, judged = search._best(index, terms, hits, 1, None)
    assert [r.id for r in best.collect()] == ["rare"] and judged.count() == 1
    many = spark.createDataFrame([(1, "w0"), (1, "w39")], "query_id int, term string")
    judged = search._best(index, *search._prepared(index, many), 3, None)[1]
    assert 0 < judged.where("NOT read").count() < judged.count()


def test_empty_index(spark, tmp_path):
    search.build(spark.createDataFrame([], "id string, title string, body string"), "id", ("title", "body"), f"file://{tmp_path}/e")
    empty = search.load(spark, f"file://{tmp_path}/e", "id")
    assert search.search_with_totals(empty, spark.createDataFrame([(1, "a"), (1, "a b")], "query_id int, term string"), 3).count() == 0


def test_stems_are_one_in_tasks_and_queries(spark):
    every = ["s", "gas", "cats", "class", "classes", "flies", "bus", "ties", "running", "sing", "bed", "hoped", "agreed", "встречs", "straßeing", "ıss", "x_ings", "éed", "naïved", "sses", "iesing", "aaing"]
    rows = spark.createDataFrame([(w,) for w in every], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    assert [stem_of(r.w) for r in rows] == [r.s for r in rows]


def test_slices_lose_no_posting(spark, corpus, tmp_path, monkeypatch):
    """Small slices end at blocks; frequencies are those of a plain count."""
    monkeypatch.setattr(search, "SLICE", 40)
    docs = spark.createDataFrame(corpus, "id string, title string, body string")
    search.build(docs, "id", ("title", "body"), f"file://{tmp_path}/i")
    index = search.load(spark, f"file://{tmp_path}/i", "id")
    want = Counter((f, stem_of(w)) for d in corpus for f, t in zip(("title", "body"), d[1:]) for w in {stem_of(w) for w in words(t)})
    assert {(r.field, r.term): r.df for r in index.words.collect()} == dict(want)
    assert {tuple(r) for r in index.postings.select("field", "term").distinct().collect()} == set(want)
