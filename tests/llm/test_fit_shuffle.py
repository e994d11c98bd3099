"""What the limits of operator 3 are fitted on meets the labels without its text."""

from pyspark.sql import functions as F

from tessera.llm.compression_rules import fit


def test_no_text_is_shuffled(spark):
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    words = "concat_ws(' ', transform(sequence(1, 80), k -> sha2(cast(id * 99 + k AS string), 256)))"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr(words).alias("text"))
    good = spark.createDataFrame([(k,) for k in range(0, 3000, 3)], "doc_id long")
    before = written()
    assert fit(docs, good).fitted
    assert written() - before < 1 << 20  # 15 MB of texts
