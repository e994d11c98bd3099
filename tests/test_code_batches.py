"""Files are dealt once, their tokens never, and an Arrow batch may end anywhere in a file."""

from tessera.operators import code

from .test_code import WANT

SCHEMA = "path string, lang string, content string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_not_shuffled(spark):
    plan = _plan(code.statements(code.tokens(spark.createDataFrame([("a.ts", "typescript", "class A { }")], SCHEMA))))
    assert "Window" not in plan and plan.count("Exchange ") == 1
    assert "Generate" in plan[: plan.index("Exchange ")]  # files are dealt before they are cut


def test_small_batches(spark):
    files = spark.createDataFrame([(path, lang, text) for path, (lang, text, _) in WANT.items()], SCHEMA)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        found = []
        for rows in ("3", "10000"):
            spark.conf.set(key, rows)
            found.append(sorted(map(str, code.statements(code.tokens(files.coalesce(1))).collect())))
    finally:
        spark.conf.set(key, old)
    assert found[0] == found[1] and found[0]
