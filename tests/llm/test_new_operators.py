"""Operators 11 to 13 against brute force: nulls, ties, repeated rows, long texts, further columns of
clashing names, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera import llm
from tessera.llm import filter_audit, importance, token_counts

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, score bigint, rank string, part string, mask int, spread bigint, copy bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    r = random.Random(11)
    words = ["".join(r.choices("abcdefgh", k=r.randint(1, 8))) for _ in range(200)] + ["BIG", "don't", "<|endoftext|>", "日本語", "naïve", "x" * 100]
    out = [" ".join(r.choice(words) for _ in range(r.choice([0, 3, 20, 60, 150]))) for _ in range(90)]
    return [None, "", " \n ", *out, *out[:9], "x" * 70_000, "Word " * 30_000, "Ünï ćødé tëxt 日本語\n" * 40, "A\t b  c\n\n d\x1ce f g", " lead", "trail ", "a | b", "100% #1", "ÀÉ" + "Z" * 30, "é ́x İstanbul ΑΣ Σ"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    far = [-(2**63), 2**63 - 1]
    out = [((far + [i])[i % 40 if i % 40 < 2 else 2] if i < 80 else i, t, ["en", "de", None, ""][i % 4], "s", 0, 1, 2, "x", "y", 3, 4, 5) for i, t in enumerate(texts())]
    some = r.choice(out)
    return [*out, (None, out[5][1], "en", *some[3:]), (None, None, None, *some[3:]), out[7], out[7], (out[7][0], out[8][1], *out[7][2:])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def counted(df):
    return Counter(map(tuple, df.collect()))


def duck(sql, **tables):
    con = duckdb.connect()
    for name, (cols, rows) in tables.items():
        con.register(f"{name}_arrow", pa.table({c: pa.array([r[i] for r in rows], k) for i, (c, k) in enumerate(cols)}))
        con.sql(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
    found = con.sql(sql)
    return found.columns, found.fetchall()


# --- 11


def plain_counts(path, found):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t or "")) for t in found]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in found]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, rows, empty, file):
    path = public_tokenizers.path(file)
    want = Counter((r[0], len((r[1] or "").encode()), n, n > 40) for r, n in zip(rows, plain_counts(path, [r[1] for r in rows])))
    assert counted(token_counts.token_counts(docs, path, limit=40)) == want
    assert token_counts.token_counts(empty, path).count() == 0


def test_parts_sum_to_the_whole():
    r = random.Random(3)
    bits = ["a", "B", "é", "é", "́", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "'s", "'ll", "'", "!", "1", "２", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "İ", "Σ", "日本", "😀", "‍", "word"]
    found = ["".join(r.choices(bits, k=r.randint(0, 12))) for _ in range(5000)]
    for file in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        one = token_counts.Counter(public_tokenizers.path(file))
        assert one.by_words == (file == "word_bpe_49k.json")
        assert one.count(found, part=3, size=50).tolist() == plain_counts(public_tokenizers.path(file), found)


def test_batches_are_balanced():
    got = list(token_counts.balanced(((i, "x" * (i % 7)) for i in range(1000)), 100))
    assert sum(map(len, got)) == 1000 and all(100 <= sum(len(p) for _, p in b) < 107 for b in got[:-1])
    cut = list(token_counts.parts("ab " * 1000, token_counts._WHITE, 100))
    assert "".join(cut) == "ab " * 1000 and max(map(len, cut)) <= 103


def test_words_are_forgotten_in_turn(monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN", 50)
    one, path = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json")), public_tokenizers.path("word_bpe_49k.json")
    found = [" ".join(f"w{k}" for k in range(n, n + 40)) for n in range(0, 400, 20)]
    assert [int(one.count([t])[0]) for t in found] == plain_counts(path, found)
    assert len(one.known) + len(one.older) < 250


def test_white_space_is_safe_only_where_it_is_dropped():
    good = {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": r"[\p{L}]+|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, "normalizer": None, "added_tokens": []}
    assert token_counts.drops_white_space(good)
    assert not token_counts.drops_white_space(good | {"normalizer": {"type": "NFKC"}})
    assert not token_counts.drops_white_space(good | {"added_tokens": [{"content": "a b"}]})
    assert not token_counts.drops_white_space(good | {"pre_tokenizer": good["pre_tokenizer"] | {"pattern": {"Regex": r" ?[\p{L}]+"}}})
    assert not token_counts.drops_white_space({})


# --- 12


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def features(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(rows, target, share=5, least=20):
    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r[1])[1])
    for x in target:
        t.update(features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for r in rows:
        n, f = features(r[1])
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([r[0], n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2]))
    for k, x in enumerate(able[: share * len(able) // 100]):
        x[5] = k + 1
    return Counter(map(tuple, out))


TARGET = ["abc a b Naïve 日本語", None, "", "cab bac", "Word word word", "Word word word"]


@pytest.mark.parametrize("share", [5, 50, 100, 0])
def test_resample(spark, docs, rows, share):
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id bigint, text string")
    got = counted(importance.resample(docs, target, (share, 100)).select("doc_id", "n_words", "n_features", "weight", "score", "rank"))
    assert got == brute_resample(rows, TARGET, share)


def test_resample_of_nothing(spark, docs, rows, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert importance.resample(empty, none).count() == 0
    assert counted(importance.resample(docs, none).select("doc_id", "n_words", "n_features", "weight", "score", "rank")) == brute_resample(rows, [])


def test_repeated_rows_are_drawn_as_often_as_they_fit(spark):
    body = [(7, " ".join("abcde" for _ in range(25)))] * 150 + [(k, " ".join(f"w{k}" for _ in range(30))) for k in range(50)]
    docs = spark.createDataFrame(body, "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    for share in (1, 30, 60, 90):
        got = importance.resample(docs, none, (share, 100)).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
        assert counted(got) == brute_resample(body, [], share)


def test_windows_of_long_texts():
    r = random.Random(4)
    found = ["", "x" * 500 + " y z " + "ü" * 90, *(" ".join(r.choice(["a", "Bc", "é", "-", "x" * 70]) for _ in range(60)) for _ in range(40))]
    for size in (7, 64, 1 << 19):
        per = [[] for _ in found]
        for at, raw, ends, skip in importance.windows(pa.array(found), size):
            g = importance.Grams(raw, ends, skip, 10000, 3)
            for bucket, of in zip(g.bucket, g.of):
                for b, o in zip(bucket.tolist(), of.tolist()):
                    per[at[o]].append(b)
        assert [sorted(x) for x in per] == [sorted(features(t)[1]) for t in found]
    part = pa.array(["zero", *found, "last"])[1:-1]  # a slice of an array
    assert sum(len(b) for w in importance.windows(part) for b in importance.Grams(*w[1:], 10000, 3).bucket) == sum(len(features(t)[1]) for t in found)


def test_kth_key(spark):
    r = random.Random(6)
    for span in (3, 10**4, 2**63 - 1):
        body = [(r.randint(-span, span), r.randint(0, 3), r.choice([-(2**63), 2**63 - 1, 0, 5])) for _ in range(500)]
        df = spark.createDataFrame(body, "a bigint, b bigint, c bigint")
        for k in (1, 2, 77, 499, 500):
            bound = importance.kth_key(df, ["a", "b", "c"], k)
            got = sorted(map(tuple, df.where(importance.up_to(["a", "b", "c"], bound)).collect()))
            want = sorted(body)
            assert got[:k] == want[:k] and all(x == want[k - 1] for x in got[k:])


def test_resample_sql(docs, rows, spark):
    good = [r for r in rows if r[0] not in (rows[7][0],)]
    cols, found = duck(importance.ORACLE, documents=((("doc_id", pa.int64()), ("text", pa.string())), [r[:2] for r in good]), benchmark=((("item_id", pa.int64()), ("text", pa.string())), list(enumerate(TARGET))))
    assert cols == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(found) == Counter((a, c, d, e, f) for a, _, c, d, e, f in brute_resample(good, TARGET).elements())


# --- 13


def brute_audit(rows, labels):
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    parts = {}
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": r[0] is not None and r[0] > least[t]}
        parts.setdefault(r[2] or "", []).append(({x for x in fails if fails[x]}, r[0] in good, r[0] in toxic))
    out = []
    for part, docs in parts.items():
        total, some = Counter(), []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [d for d in docs if f in d[0] and not d[0] & before]
                total[f] += len(gone)
                some.append((part, "".join(order), k + 1, sum(not d[0] & (before | {f}) for d in docs), len(gone), sum(f in d[0] and bool(d[0] & before) for d in docs), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
        out += [(*x, total[x[1][x[2] - 1]]) for x in some]
    return Counter(out)


@pytest.fixture(scope="module")
def marks(rows):
    r = random.Random(8)
    out = [(x[0], r.choice([0, 1, None]), r.choice([0, 0, 1])) for x in rows if r.random() < 0.6]
    return [*out, *out[:10], (None, 1, 1), (10**9, 1, 1)]


AUDIT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit(spark, docs, rows, marks, empty):
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("part", F.lit("x"))
    assert counted(filter_audit.filter_audit(docs, labels).select(*AUDIT)) == brute_audit(rows, marks)
    assert counted(filter_audit.filter_audit(docs, labels.limit(0)).select(*AUDIT)) == brute_audit(rows, [])
    assert filter_audit.filter_audit(empty, labels).count() == 0


def test_filter_audit_sql(rows, marks):
    kinds = (("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()))
    cols, found = duck(filter_audit.ORACLE, documents=(kinds, [r[:3] for r in rows]), labels=((("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())), marks))
    assert Counter(tuple(r[cols.index(c)] for c in AUDIT) for r in found) == brute_audit(rows, marks)


def test_audit_sums(spark, docs, marks):
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    found = filter_audit.filter_audit(docs, labels)
    assert found.groupBy("part").count().where("count <> 600").isEmpty()
    last = found.groupBy("part", "filter_order").agg(F.sum("removed").alias("gone"), F.min("kept").alias("kept"))
    assert last.groupBy("part").agg(F.count_distinct("gone", "kept").alias("n")).where("n <> 1").isEmpty()


def test_no_python_in_the_audit(spark, docs, marks):
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    plan = filter_audit.filter_audit(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Cartesian|NestedLoop", plan)


def test_registered():
    assert {"op11_token_counts", "op12_importance", "op13_filter_audit"} <= llm.QUERIES.keys()
    assert {"op12_importance", "op13_filter_audit"} <= llm.ORACLE_SQL.keys()
