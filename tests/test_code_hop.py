"""Symbols that share a name, and names that share a symbol, are met once a query."""

import random

from tessera.operators.text import hop_to_symbols


def test_pairs_are_made_once(spark, capsys):
    r = random.Random(3)
    hits = [(r.randint(0, 3), f"n{r.randint(0, 5)}", r.random()) for _ in range(60)]
    symbols = [(f"y{k}", f"n{k % 7}") for k in range(40)] + [("y1", "n2"), ("y1", "n4"), ("y2", "n3"), ("y2", "n3"), ("y0", "n6")]
    want = {}
    for q, n, score in hits:
        for y, m in symbols:
            if n == m:
                want[q, y] = max(want.get((q, y), 0), score)
    found = hop_to_symbols(spark.createDataFrame(hits, "query_id int, name string, score double"), spark.createDataFrame(symbols, "id string, name string"))
    rows = [tuple(x) for x in found.collect()]
    assert len(rows) == len(want) and {(q, y): score for q, y, score in rows} == want
    found.explain()
    assert "HashAggregate" not in capsys.readouterr().out  # no row is grouped after symbols meet queries
