"""Visits of cells meet in tasks of bounded size, and what is made of a batch is bounded too."""

import numpy as np
import pyarrow as pa

from tessera.operators import vector


def test_no_task_holds_all_visits_of_a_cell(spark, monkeypatch):
    monkeypatch.setattr(vector, "TASK_BYTES", 1 << 12)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 16)
    monkeypatch.setattr(vector, "DEAL", 1)
    r = np.random.default_rng(3)
    rows = [(k, r.normal(size=4).tolist()) for k in range(400)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = corpus.withColumnRenamed("id", "query_id")
    got = {(x.query_id, x["rank"]): (x.id, x.score) for x in vector.knn(queries, corpus, 5, "id").collect()}
    m = np.array([np.array(v, np.float32) for _, v in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(m @ m.T, 6)
    for q in range(400):
        best = sorted(range(400), key=lambda k: (-scores[q, k], k))[:5]
        assert [got[q, k + 1][0] for k in range(5)] == best
    cells = vector.fit_cells(corpus, "id")
    visits = vector.settle(vector._visits(queries, cells, 400, False))  # every query in every cell
    met = vector._meet(visits, cells, 5, "id")
    sizes = met.select("query_id").rdd.mapPartitions(lambda it: [len({x[0] for x in it})]).collect()
    assert len(sizes) > 40 and max(sizes) < 200  # queries in one task


def test_slices_of_batches(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300))], names=["x"])
    got = list(vector._slices(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in got] == [512, 512, 276] and pa.Table.from_batches(got).column("x").to_pylist() == list(range(1300))
