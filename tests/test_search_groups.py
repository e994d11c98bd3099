"""Groups of blocks meet blocks of queries as matrices and give what a plain sum gives."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import search


def packed(r, docs, terms, allowed):
    """Groups of two blocks of four documents, as rows of arrays, and postings (document, term) with their weights."""
    held, groups = {}, []
    for g in range(0, docs, 8):
        rows = []
        for block in (g // 4, g // 4 + 1):
            for t in range(terms):
                own = [d for d in range(block * 4, block * 4 + 4) if d < docs and r.random() < (0.9 if t < 2 else 0.1)]
                w = [round(r.random(), 1) + 0.1 for _ in own]
                held |= {(d, t): x for d, x in zip(own, w)}
                if own:
                    rows.append((t, block, max(w), own, w))
        cut = [x for x in allowed if g <= x < g + 8] if allowed is not None else None
        groups.append(([x[0] for x in rows], [x[1] for x in rows], [x[2] for x in rows], [len(x[3]) for x in rows], [d for x in rows for d in x[3]], [w for x in rows for w in x[4]], cut))
    return held, groups


@pytest.mark.parametrize("kept,cells,some", [(64, 1 << 21, False), (1, 7, False), (2, 60, True)])
def test_best_of_tasks(monkeypatch, kept, cells, some):
    monkeypatch.setattr(search, "KEPT", kept)
    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "SEED_BLOCKS", 1)
    r = random.Random(11)
    allowed = sorted(r.sample(range(70), 40)) if some else None
    held, groups = packed(r, 70, 12, allowed)
    queries = {q: {t: 0.5 + r.random() for t in r.sample(range(12), r.randint(1, 5))} for q in range(9)}
    blocks = [list(queries)[i : i + 3] for i in (0, 3, 6)]
    rows = []
    for g in groups:
        for b in blocks:
            flat = [(i, t, idf) for i, q in enumerate(b) for t, idf in queries[q].items()]
            rows.append((*g, b, [x[0] for x in flat], [x[1] for x in flat], [x[2] for x in flat]))
    names = ["codes", "blocks", "tops", "sizes", "ords", "weights", "allowed", "asked", "place", "q_codes", "idfs"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[i]], pa.list_(k)) for i, k in enumerate(kinds)], names=names) for x in rows]
    want = defaultdict(float)
    for q, terms in queries.items():
        for (d, t), w in held.items():
            if t in terms and (allowed is None or d in allowed):
                want[q, d] += terms[t] * w
    for k in (1, 4, 100):
        found = defaultdict(dict)
        for b in search._scored(k, False)(iter(batches)):
            for q, d, score in zip(*[c.to_pylist() for c in b.columns]):
                assert abs(want[q, d] - score) < 1e-9
                found[q][d] = score
        for q in queries:
            best = sorted((s for (a, _), s in want.items() if a == q), reverse=True)[:k]
            assert np.allclose(sorted(found[q].values(), reverse=True)[: len(best)], best)
            assert len(found[q]) >= len(best)
        judged = [x for b in search._scored(k, True)(iter(batches)) for x in zip(*[c.to_pylist() for c in b.columns])]
        assert len({x[:2] for x in judged}) == len(judged)
        assert k > 1 or kept == 1 or any(not x[3] for x in judged)  # blocks are skipped
        assert k < 100 or all(x[3] for x in judged)
