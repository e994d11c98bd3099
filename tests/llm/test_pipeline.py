"""The stages of the corpus pipeline, each against brute force on its own input."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

import corpus_pipeline as cp
from tessera.llm import bpe_codec

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def stages(spark):
    r = random.Random(8)
    words = {"aa": ["lom", "lomar", "mirol", "arol", "tolam", "ramo"], "bb": ["quix", "xiqu", "zuqi", "xuzi", "wizuk", "kwi"]}
    rows = []
    for i in range(150):
        k = ("aa", "bb")[i % 2]
        body = r.choices(words[k], k=r.randint(30, 80))
        rows.append((len(rows), " ".join(body), k, f"s{i % 4}" if i % 9 else None, 0))
        if i % 4 == 0:
            near = list(body)
            near[r.randrange(len(near))] = body[0] + "x"
            rows += [(len(rows), " ".join(near), k, "s1", 0), (len(rows) + 1, " ".join(body), k, "s0", 0)]
    rows += [(900, None, "aa", "s1", 0), (901, "12 34 !", "bb", "s2", 0), (902, "", None, None, 0), (None, "lom lomar mirol arol", None, "s3", 0)]
    docs, out = spark.createDataFrame(rows, SCHEMA), [rows]
    for _, step in cp.STAGES:
        docs = spark.createDataFrame((got := step(spark, docs, "").collect()), docs.schema if len(out) < 5 else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
        out.append([tuple(x) for x in got])
    return out


def grams(t):
    w = (t or "").split()
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def test_language(stages):
    before, after = stages[0], stages[1]
    assert {x[0] for x in before} - {x[0] for x in after} == {900, 901, 902}
    assert all(x[2] is not None for x in after)


def test_copies(stages):
    before, after = stages[1], stages[2]
    best = {}
    for i, t, *_ in before:
        best[t] = max((x for x in (i, best.get(t)) if x is not None), default=None)
    assert Counter((x[0], x[1]) for x in after) == Counter((i, t) for t, i in best.items())


def test_near_copies(stages):
    before, after = stages[2], stages[3]
    sets = [grams(x[1]) for x in before]
    root = list(range(len(before)))
    for _ in root:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and len(a & b) >= 0.8 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    groups = defaultdict(list)
    for i, x in enumerate(before):
        groups[root[i]].append(x[0])
    want = Counter(min((i for i in g if i is not None), default=None) for g in groups.values())
    assert Counter(x[0] for x in after) == want and len(after) < len(before)


def test_mix(stages):
    before, after = stages[3], stages[4]
    size = {x[0]: len((x[1] or "").split()) for x in before}
    total, got = Counter(), Counter()
    for x in before:
        total[x[3]] += size[x[0]]
    for x in after:
        got[x[3]] += size[x[0]]
    assert {x[:2] for x in after} <= {x[:2] for x in before}
    assert max(Counter(x[0] for x in after).values()) <= 3
    assert abs(sum(got.values()) - sum(total.values())) <= 5 * max(size.values())
    assert len(cp.COLUMNS) == len(after[0])


def test_encoding(stages):
    before, after = stages[4], stages[5]
    enc = bpe_codec.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = Counter((x[0], len(enc.encode_ordinary(x[1])), hashlib.sha256(x[1].encode()).hexdigest()) for x in before)
    assert Counter((x[0], x[1], x[3]) for x in after) == want


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, step in cp.STAGES:
        docs = step(spark, docs, "")
        assert docs.count() == 0


def test_repeated_rows(spark):
    a, b, c = ("lom lomar mirol arol tolam ramo " + " ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a, "aa", "s1", 0)] * 3 + [(1, b, "aa", "s0", 0)] * 2 + [(1, b, "bb", "s1", 0), (2, c, "aa", "s0", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    once = [(None, a, "aa", "s1", 0), (1, b, "aa", "s0", 0), (2, c, "aa", "s0", 0)]
    for step in (cp.drop_copies, cp.drop_near_copies):
        assert Counter(map(tuple, step(spark, docs, "").collect())) == Counter(once)
    placed = Counter(tuple(x) for x in cp.mix_sources(spark, spark.createDataFrame(once, SCHEMA), "").collect())
    assert placed.keys() <= set(once) and max(placed.values()) <= 3


def test_mixed_files_are_in_the_order_of_turns(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.llm import mixing

    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20 + i % 7)), "aa", f"s{i % 3}", 0) for i in range(400)], SCHEMA)
    kept, real = {}, mixing.mix

    def mix(*args, **named):
        placements, documents = real(*args, **named)
        for r in sorted(placements.collect(), key=lambda r: r.turn):
            kept.setdefault(r.shard, []).append(r.doc_id)
        return placements, documents

    monkeypatch.setattr(mixing, "mix", mix)
    out = cp.mix_sources(spark, docs, "")
    rows = out.withColumn("part", F.spark_partition_id()).select("part", "doc_id").collect()
    parts = defaultdict(list)
    for r in rows:
        parts[r.part].append(r.doc_id)
    assert len(parts) > 10 and sorted(parts.values()) == sorted(kept.values())
