"""The limits of operator 3 come from every labelled good document."""

import random

from tessera.llm.compression_rules import fit


def test_every_good_document_counts(spark):
    r = random.Random(2)
    vocabulary = [f"word{k}" for k in range(400)]
    texts = [(k, " ".join(r.choices(vocabulary, k=60))) for k in range(4100)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bands = lambda ids: fit(docs, spark.createDataFrame([(k,) for k in ids], "doc_id long")).fitted
    whole, half, rest = bands(range(4100)), bands(range(0, 4100, 2)), bands(range(1, 4100, 2))
    assert whole == tuple((a[0], min(a[1], b[1]), max(a[2], b[2])) for a, b in zip(half, rest)) and whole
