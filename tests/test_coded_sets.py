"""Sets that are sent once for each edge travel as codes, and what two of them share is what their words share."""

import random

from pyspark.sql import functions as F

from tessera.operators import text


def test_codes_share_what_words_share(spark, monkeypatch):
    monkeypatch.setattr(text, "CODES", 64)  # most words have none
    r = random.Random(8)
    sets = {f"n{k}": sorted({f"w{int(r.random() ** 3 * 300)}" for _ in range(r.randint(0, 60))}) for k in range(40)} | {"none": None}
    edges = [(r.choice([*sets]), r.choice([*sets])) for _ in range(300)]
    frame = spark.createDataFrame(list(sets.items()), "node_id string, w array<string>")
    got = text.met(spark.createDataFrame(edges, "src string, dst string"), text.coded(frame, "node_id", "w"))
    rows = got.select("src", "dst", "n_src", "n_dst", "both", text.shared_jaccard(F.col("n_src"), F.col("n_dst"), F.col("both")).alias("j")).collect()
    assert len(rows) == len(edges)
    for x in rows:
        a, b = sets[x.src], sets[x.dst]
        assert (x.n_src, x.n_dst) == (None if a is None else len(a), None if b is None else len(b))
        assert x.both == (None if a is None or b is None else len(set(a) & set(b)))
        if a is not None and b is not None:
            assert x.j == (len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0)


def test_an_edge_sends_few_bytes(spark):
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    words = F.expr("transform(sequence(1, 300), k -> substr(sha2(cast((id * 31 + k * k) % 9000 AS string), 256), 1, 12))")
    sets = spark.range(200).select(F.col("id").cast("string").alias("node_id"), F.array_distinct(words).alias("w"))
    edges = spark.range(20_000).select((F.col("id") % 200).cast("string").alias("src"), (F.col("id") * 7 % 199).cast("string").alias("dst"))
    known = text.coded(sets, "node_id", "w")
    before = written()
    assert text.met(edges.hint("merge"), known.hint("merge")).agg(F.sum("both")).first()[0] > 0
    assert written() - before < 20_000 * 1200  # 300 words of 12 letters are 4,200 bytes
