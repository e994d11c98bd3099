"""Ranked full-text search over an index that is written once: postings with positions and block maxima.

``build`` numbers the documents by their commonest word and their length and writes, for each stemmed term of a field, its postings in
blocks of ``BLOCK`` neighbouring numbers, each with the greatest weight that any of its documents can have.
``search`` finds the best k of each query: postings of the words asked for are dealt to tasks by groups of blocks and meet
blocks of queries as matrices. The most promising blocks of a group are scored first; the k-th score that a task has seen is a bound
that any other block must reach by the sum of its maxima, and only blocks that do are
scored. Neighbours have their commonest word in common, so documents of one language share blocks.

A term of several words is a phrase. Its occurrences are found from the rarest word: its documents are
the candidates, and the positions of the other words there must stand where the phrase wants them.
It weighs as a term whose inverse frequency is the sum over its words.

``totals`` counts all hits of a query apart, exactly, where their postings lie."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import remove, settle
from .text import stem, stem_of, tokens

K1, B = 1.2, 0.75
BLOCK, SEED_BLOCKS = 32, 4
#: Bytes of parsed documents for each bucket of words, and of postings for each part that is dealt.
BUCKET_BYTES = 64 << 20
#: Words that a task makes postings of at once, about.
SLICE = 1 << 20


@dataclass
class TextIndex:
    """The tables of an index: documents (ord, key), postings (field, term, block, n, top, and of
    each document in the block: ords, weights, norms, ats), words (bucket, field, term, df, idf)."""

    key: str
    buckets: int
    documents: DataFrame
    postings: DataFrame
    words: DataFrame


def share(tf: Column, norm: Column) -> Column:
    """The BM25 weight of a term in a field without its inverse frequency."""
    return tf * (K1 + 1) / (tf + norm)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _headed(fields: tuple[str, ...]):
    """For batches of (key, words of each field): key, the words of each field as a line, n (its number of words) of each, length of all
    and head, the commonest word, of equals the greatest; null if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [b.column(f) for f in fields]
            sizes = [np.asarray(x.value_lengths(), np.int64) for x in lists]
            coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            order = pc.array_sort_indices(coded.dictionary)
            place = np.empty(len(order), np.int64)
            place[np.asarray(order)] = np.arange(len(order))
            row = np.concatenate([np.repeat(np.arange(b.num_rows), n) for n in sizes])
            pairs, counts = np.unique(row * max(1, len(order)) + place[np.asarray(coded.indices)], return_counts=True)
            row, word = np.divmod(pairs, max(1, len(order)))
            best = np.lexsort((word, counts, row))
            last = best[np.flatnonzero(np.append(row[1:] != row[:-1], True)[: len(row)])]  # rows are sorted, so ends of rows stay in place
            head = np.full(b.num_rows, -1)
            head[row[last]] = word[last]
            names = coded.dictionary.take(order).take(pa.array(head, mask=head < 0))
            columns = [b.column("key"), *[pc.binary_join(x, " ") for x in lists], *[pa.array(n) for n in sizes], pa.array(sum(sizes)), names]
            yield pa.RecordBatch.from_arrays(columns, names=["key", *fields, *[f"n_{f}" for f in fields], "length", "head"])

    return run


def _posted(fields: tuple[str, ...], means: dict[str, float]):
    """For batches of (ord, a line of words for each field): rows of the postings, sorted by term in each slice; the documents of a
    row are in rising order. Neighbours come together, so a block is made where its documents are; one that two batches share
    comes in two rows, which readers add up. ``means`` are the average lengths of the fields."""

    def one(field: str, words: pa.Array, lengths: np.ndarray, ords: np.ndarray) -> Iterator[pa.RecordBatch]:
        coded = words.dictionary_encode()
        stems = [stem_of(w) for w in coded.dictionary.to_pylist()]
        terms = sorted(set(stems))
        if not terms:
            return
        ids = dict(zip(terms, range(len(terms))))
        row = np.repeat(np.arange(len(ords)), lengths)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        blocks, place = np.unique(ords // BLOCK, return_inverse=True)
        code = np.array([ids[s] for s in stems], np.int64)[np.asarray(coded.indices)] * len(blocks) + place[row]
        order = np.argsort(code, kind="stable")
        code, row, at = code[order], row[order], at[order]
        first = np.ones(len(code), bool)
        first[1:] = code[1:] != code[:-1]
        post = first.copy()
        post[1:] |= row[1:] != row[:-1]
        posts = np.flatnonzero(post)
        heads = np.flatnonzero(first[posts])
        ends = np.append(posts, len(code))
        norms = K1 * (1 - B + B * lengths[row[posts]] / means[field])
        weights = share(np.diff(ends), norms)
        groups = pa.array(np.append(heads, len(posts)).astype(np.int32))
        lists = lambda values: pa.ListArray.from_arrays(groups, values)
        ats = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at.astype(np.int32)))
        code = code[first]
        columns = [pa.array([field]).take(pa.array(np.zeros(len(code), np.int32))), pa.array(terms, pa.string()).take(pa.array(code // len(blocks))), pa.array(blocks[code % len(blocks)])]
        columns += [pa.array(np.diff(np.append(heads, len(posts)))), pa.array(np.maximum.reduceat(weights, heads))]
        columns += [lists(pa.array(ords[row[posts]])), lists(pa.array(weights)), lists(pa.array(norms)), lists(ats)]
        yield pa.RecordBatch.from_arrays(columns, names=["field", "term", "block", "n", "top", "ords", "weights", "norms", "ats"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ords = np.asarray(b.column("ord"), np.int64)
            lengths = {f: np.asarray(b.column(f"n_{f}"), np.int64) for f in fields}
            sizes = np.cumsum(sum(lengths.values()))
            start = 0
            while start < len(ords):  # whole blocks of about SLICE words
                end = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SLICE)) + 1
                end = int(np.searchsorted(ords, (ords[min(end, len(ords)) - 1] // BLOCK + 1) * BLOCK))
                part = b.slice(start, end - start)
                for f in fields:
                    words = pc.split_pattern(part.column(f), " ").flatten()
                    yield from one(f, words.filter(pc.not_equal(words, "")), lengths[f][start:end], ords[start:end])
                start = end

    return run


def build(docs: DataFrame, key: str, fields: tuple[str, ...], folder: str) -> None:
    """Write the index of ``docs`` below ``folder``. A null field is empty.

    Texts are parsed once, and written as lines of words. These are shuffled once, in the order of their numbers; the blocks of
    postings that tasks make of them stay in their files, so a range of documents is read together and a word is in many files."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    counts = [f"n_{f}" for f in fields]
    schema = ", ".join([f"key {kind}", *[f"`{f}` string" for f in fields], *[f"`{n}` bigint" for n in counts], "length bigint", "head string"])
    words = docs.select(F.col(key).alias("key"), *[tokens(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields])
    words.mapInArrow(_headed(fields), schema).write.mode("overwrite").parquet(f"{folder}/lines")
    order = ["head", "length", "key"]
    lines = spark.read.schema(schema).parquet(f"{folder}/lines")
    numbered = lines.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id())
    numbered.select("ord", "key", *fields, *counts).write.mode("overwrite").parquet(f"{folder}/parsed")
    remove(spark, f"{folder}/lines")
    parsed = spark.read.parquet(f"{folder}/parsed")
    parsed.select("ord", "key").write.mode("overwrite").parquet(f"{folder}/documents")
    size = int(str(parsed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(1, min(1 << 14, size // BUCKET_BYTES))
    stats = parsed.agg(F.count("*").alias("n"), *[F.avg(f"n_{f}").alias(f) for f in fields]).first()  # one row
    means = {f: float(stats[f] or 0.0) for f in fields}
    parsed.select("ord", *fields, *counts).mapInArrow(_posted(fields, means), _POSTINGS).write.mode("overwrite").parquet(f"{folder}/postings")
    idf = F.log(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = spark.read.schema(_POSTINGS).parquet(f"{folder}/postings").groupBy("field", "term").agg(F.sum("n").alias("df")).withColumn("idf", idf)
    known.withColumns({"bucket": _bucket(F.col("term"), buckets), "buckets": F.lit(buckets)}).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/words")
    remove(spark, f"{folder}/parsed")


_POSTINGS = "field string, term string, block bigint, n bigint, top double, ords array<bigint>, weights array<double>, norms array<double>, ats array<array<int>>"
_WORDS = "field string, term string, df bigint, idf double, buckets int, bucket int"


def load(spark: SparkSession, folder: str, key: str) -> TextIndex:
    def read(name: str) -> DataFrame:
        kind = {"postings": _POSTINGS, "words": _WORDS}.get(name)
        return (spark.read.schema(kind) if kind else spark.read).parquet(f"{folder}/{name}")

    first = read("words").select("buckets").first()
    return TextIndex(key, first.buckets if first else 1, read("documents").withColumnRenamed("key", key), read("postings"), read("words").drop("buckets"))


def asked(index: TextIndex, queries: DataFrame) -> DataFrame:
    """query_id, term, field, idf, words, bucket of the terms (query_id, term) that are words and known."""
    terms = queries.select("query_id", stem(F.col("term")).alias("term")).where("instr(term, ' ') = 0").distinct()
    return terms.withColumn("bucket", _bucket(F.col("term"), index.buckets)).join(index.words, ["bucket", "term"])


def phrases(index: TextIndex, queries: DataFrame) -> DataFrame:
    """query_id, field, ord, weight of each document that holds a phrase of ``queries`` (query_id, term), in which
    words are apart by one space; a phrase counts once a query."""
    split = queries.where("instr(term, ' ') > 0").select("query_id", F.transform(F.split("term", " "), lambda w: stem(w)).alias("w")).distinct()
    part = split.select("query_id", F.array_join("w", " ").alias("phrase"), F.size("w").alias("size"), F.posexplode("w").alias("off", "term"))
    one = part.select("phrase", "size", "off", "term").distinct().withColumn("bucket", _bucket(F.col("term"), index.buckets))
    of = Window.partitionBy("phrase", "field")
    known = one.join(index.words, ["bucket", "term"]).withColumns({"n": F.count("*").over(of), "sum_idf": F.sum("idf").over(of), "rare": F.min(F.struct("df", "off")).over(of)["off"]})
    known = settle(known.where("n = size").select("field", "term", "phrase", "size", "off", "sum_idf", "rare"))  # a few rows a phrase
    each = F.inline(F.transform(F.arrays_zip("ords", "norms", "ats"), lambda p: F.struct(p["ords"].alias("ord"), p["norms"].alias("norm"), p["ats"].alias("at"))))
    posts = index.postings.select("field", "term", "ords", "norms", "ats").join(known.select("field", "term").distinct(), ["field", "term"], "left_semi")
    posts = settle(posts)  # those of the words of phrases, read once from the whole index
    first = posts.join(known.where("off = rare"), ["field", "term"]).select("field", "phrase", "size", "off", "sum_idf", each)
    first = settle(first.select("field", "phrase", "size", "sum_idf", "ord", "norm", F.transform("at", lambda p: p - F.col("off")).alias("starts")))
    others = known.where("off <> rare").select("field", "term", "phrase", "off")
    near = posts.join(others.select("field", "term"), ["field", "term"], "left_semi").select("field", "term", each).drop("norm")
    found = near.join(others.join(first.select("field", "phrase", "ord"), ["field", "phrase"]), ["field", "term", "ord"]).select("field", "phrase", "ord", "off", "at")
    found = found.groupBy("field", "phrase", "ord").agg(F.collect_list(F.struct("off", "at")).alias("others"))
    both = first.join(found, ["field", "phrase", "ord"], "left").where((F.col("size") == 1) | (F.size("others") == F.col("size") - 1))
    stands = lambda s: F.forall("others", lambda o: F.array_contains(o["at"], s + o["off"]))
    counted = both.withColumn("tf", F.size(F.filter("starts", stands))).where("tf > 0")
    asks = part.select("query_id", "phrase").distinct()
    return counted.select("phrase", "field", "ord", (F.col("sum_idf") * share(F.col("tf"), F.col("norm"))).alias("weight")).join(asks, "phrase").select("query_id", "field", "ord", "weight")


def _prepared(index: TextIndex, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The terms of ``queries`` that the index knows, and what their phrases weigh in which documents."""
    several = settle(queries.select("query_id", "term"))
    hits = phrases(index, several)
    if several.where("instr(term, ' ') > 0").isEmpty():
        hits = hits.limit(0)
    return settle(asked(index, several)), settle(hits)


def _posts(index: TextIndex, terms: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of the words of ``terms``, dealt by block before any query meets them, and the terms. What
    phrases weigh is a term of its own query."""
    name = F.concat(F.lit(" "), F.col("query_id").cast("string"))  # no word has a space
    each = hits.withColumn("block", F.floor(F.col("ord") / BLOCK)).groupBy("query_id", "block", "ord").agg(F.sum("weight").alias("weight"))
    each = each.groupBy("query_id", "block").agg(F.collect_list(F.struct("ord", "weight")).alias("p"))  # BLOCK documents at most
    each = each.select(F.lit("").alias("field"), name.alias("term"), "block", F.array_max("p.weight").alias("top"), F.col("p.ord").alias("ords"), F.col("p.weight").alias("weights"))
    known = index.postings.join(terms.select("field", "term").distinct(), ["field", "term"], "left_semi")
    both = known.select("field", "term", "block", "top", "ords", "weights").unionByName(each)
    own = hits.select("query_id", F.lit("").alias("field"), name.alias("term"), F.lit(1.0).alias("idf")).distinct()
    return both, terms.select("query_id", "field", "term", "idf").unionByName(own)


def _summed(rows: DataFrame) -> DataFrame:
    """query_id, ord, score of postings that are dealt by block and have met their queries: sums stay in their tasks."""
    each = rows.select("query_id", "block", "idf", F.inline(F.arrays_zip("ords", "weights")))
    return each.groupBy("block", "query_id", F.col("ords").alias("ord")).agg(F.round(F.sum(F.col("idf") * F.col("weights")), 6).alias("score")).drop("block")


def search(index: TextIndex, queries: DataFrame, k: int, among: DataFrame | None = None) -> DataFrame:
    """query_id, key, score, rank (from 1; ties by key) of the best ``k`` documents for the terms (query_id, term) of
    each query, of those whose key is in ``among`` if that is given."""
    terms, hits = _prepared(index, queries)
    return _best(index, terms, hits, k, among)[0]


#: Blocks of neighbouring documents that are scored together, queries that meet them at a time, cells (documents by terms) of a product.
GROUP, QUERIES_A_BLOCK, CELLS = 16, 256, 1 << 21
#: Blocks of queries whose best documents a task keeps in mind.
KEPT = 64


def _packed(index: TextIndex, terms: DataFrame, hits: DataFrame, among: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The postings that ``terms`` ask for, read from the index once: a row for each group of blocks, with arrays over its
    postings in the order of blocks and codes of terms, and the allowed documents of the group (null: all). With it, blocks of
    queries: a row of arrays over their terms."""
    posts, asks = _posts(index, terms, hits)
    codes = settle(asks.select("field", "term").distinct().withColumn("code", F.monotonically_increasing_id()))
    group = F.floor(F.col("block") / GROUP).alias("group")
    rows = posts.join(codes, ["field", "term"]).select(group, "block", "code", "top", "ords", "weights")
    if among is not None:
        some = index.documents.join(among.select(index.key), index.key, "left_semi").select(F.floor(F.col("ord") / BLOCK).alias("block"), "ord")
        some = some.groupBy("block").agg(F.sort_array(F.collect_set("ord")).alias("ords"))  # BLOCK documents at most
        none = F.lit(None)
        rows = rows.unionByName(some.select(group, "block", F.lit(-1).cast("bigint").alias("code"), F.lit(0.0).alias("top"), "ords", none.cast("array<double>").alias("weights")))
    size = int(str(index.postings._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(4 * index.postings.sparkSession.sparkContext.defaultParallelism, min(1 << 14, size // BUCKET_BYTES))
    rows = rows.repartition(parts, "group").sortWithinPartitions("group", "block", "code")
    kind = dict(terms.dtypes)["query_id"]
    packed = settle(rows.mapInArrow(_pack(among is not None), _PACKED))
    each = asks.join(codes, ["field", "term"]).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("code", "idf"))).alias("t"))
    each = each.select("query_id", F.col("t.code").alias("codes"), F.col("t.idf").alias("idfs"))
    return packed, settle(each.mapInArrow(_ask, f"asked array<{kind}>, place array<int>, codes array<bigint>, idfs array<double>"))


_PACKED = "codes array<bigint>, blocks array<bigint>, tops array<double>, sizes array<int>, ords array<bigint>, weights array<double>, allowed array<bigint>"


def _one(values) -> pa.ListArray:
    values = pa.array(values) if isinstance(values, np.ndarray) else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _pack(among: bool):
    """Sorted postings to a row for each group."""

    def row(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        flat = lambda c: pa.concat_arrays([x.flatten() for x in c.chunks])
        mark = pc.equal(t.column("code"), -1)
        allowed = flat(t.filter(mark).column("ords")) if among else None
        t = t.filter(pc.invert(mark))
        if not t.num_rows or among and not len(allowed):
            return
        plain = lambda c: pa.concat_arrays(t.column(c).chunks)
        sizes = pc.list_value_length(t.column("ords")).combine_chunks()
        last = _one(allowed) if among else pa.array([None], pa.list_(pa.int64()))
        columns = [_one(plain("code")), _one(plain("block")), _one(plain("top")), _one(sizes), _one(flat(t.column("ords"))), _one(flat(t.column("weights"))), last]
        yield pa.RecordBatch.from_arrays(columns, names=["codes", "blocks", "tops", "sizes", "ords", "weights", "allowed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            group = np.asarray(b.column("group"), np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(group)]
            for start, end in zip(cuts, cuts[1:]):
                if held and held[0].column("group")[0].as_py() != group[start]:
                    yield from row(held)
                    held = []
                held.append(b.slice(start, end - start))
        if held:
            yield from row(held)

    return run


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries, each a row."""
    for b in batches:
        for at in range(0, b.num_rows, QUERIES_A_BLOCK):
            some = b.slice(at, QUERIES_A_BLOCK)
            n = np.asarray(pc.list_value_length(some.column(1)))
            columns = [_one(some.column(0)), _one(np.repeat(np.arange(some.num_rows), n).astype(np.int32)), _one(some.column(1).flatten()), _one(some.column(2).flatten())]
            yield pa.RecordBatch.from_arrays(columns, names=["asked", "place", "codes", "idfs"])


class _Met:
    """A group of blocks and a block of queries: which postings any of the queries asks for, and their weights."""

    def __init__(self, group: tuple, codes: np.ndarray, place: np.ndarray, idfs: np.ndarray, n: int):
        code, block, top, size, ords, weights, allowed = group
        known, spot = np.unique(codes, return_inverse=True)
        self.table = np.zeros((len(known), n))
        self.table[spot, place] = idfs
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        wanted = known[at] == code
        self.code, self.top = at[wanted], top[wanted]
        self.blocks, self.block = np.unique(block[wanted], return_inverse=True)
        entry = np.repeat(wanted, size)
        owner = np.repeat(np.arange(len(self.code)), size[wanted])
        ords, weights = ords[entry], weights[entry]
        if allowed is not None:
            keep = np.isin(ords, allowed)
            ords, weights, owner = ords[keep], weights[keep], owner[keep]
        order = np.argsort(ords, kind="stable")
        self.owner, self.weights = owner[order], weights[order]
        self.ords, self.document = np.unique(ords[order], return_inverse=True)
        self.held_in = np.zeros(len(self.ords), np.int64)  # the block of each document
        self.held_in[self.document] = self.block[self.owner]

    def bounds(self) -> np.ndarray:
        """The most that a document of a block can reach, blocks by queries."""
        return _products(self.table, self.code, self.top, self.block, len(self.blocks))

    def scores(self, mask: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents in the blocks of ``mask``, and their scores by the queries of ``columns``."""
        some = np.flatnonzero(mask[self.held_in])
        own = mask[self.held_in][self.document]
        return some, _products(self.table[:, columns], self.code[self.owner[own]], self.weights[own], np.searchsorted(some, self.document[own]), len(some))

    def counts(self) -> np.ndarray:
        """How many documents hold any term of each query."""
        return (_products((self.table > 0).astype(float), self.code[self.owner], np.ones(len(self.owner)), self.document, len(self.ords)) > 0).sum(axis=0)


def _products(table: np.ndarray, rows: np.ndarray, by: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places (rising) the sum of its rows of ``table`` times ``by``, in matrices of at most about ``CELLS`` cells."""
    out, m = np.zeros((n, table.shape[1])), len(table)
    step = max(1, CELLS // max(1, m))
    for at in range(0, n, step):
        own, some = slice(*np.searchsorted(place, [at, at + step])), min(step, n - at)
        out[at : at + step] = np.bincount((place[own] - at) * m + rows[own], by[own], some * m).reshape(some, m) @ table
    return out


def _groups(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of packed groups that met blocks of queries: the arrays of the group, those of the queries, and their ids."""
    get = lambda name, i: batch.column(name)[i].values
    for i in range(batch.num_rows):
        group = [get(c, i).to_numpy(zero_copy_only=False) for c in ("codes", "blocks", "tops", "sizes", "ords", "weights")]
        allowed = get("allowed", i)
        place, codes, idfs = (get(c, i).to_numpy(zero_copy_only=False) for c in ("place", "q_codes", "idfs"))
        yield (*group, None if allowed is None else allowed.to_numpy(zero_copy_only=False)), (codes, place, idfs), get("asked", i)


def _scored(k: int, report: bool):
    """For groups of blocks that met blocks of queries: query_id, ord, score of a superset of the best ``k``; or, with ``report``,
    query_id, block, most of every block and whether it was scored.

    The k-th score that a task has seen for a query is a bound; blocks whose ``most`` is below it are not scored for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[object, tuple] = {}

        def end(state: tuple) -> pa.RecordBatch:
            asked, _, who, ords, score = state
            return pa.RecordBatch.from_arrays([asked.take(pa.array(who)), pa.array(ords), pa.array(score)], names=["query_id", "ord", "score"])

        for b in batches:
            for group, (codes, place, idfs), asked in _groups(b):
                n = len(asked)
                met = _Met(group, codes, place, idfs, n)
                if not len(met.ords):
                    continue
                name = asked[0].as_py()  # a query is in one block
                if name not in seen:
                    while len(seen) >= KEPT:
                        if not report:
                            yield end(seen[next(iter(seen))])
                        del seen[next(iter(seen))]
                    none = np.empty(0, np.int64)
                    seen[name] = (asked, np.full(n, -np.inf), none, none, np.empty(0))
                asked, least, who, ords, score = seen[name]
                most = met.bounds()
                done = np.zeros(most.shape, bool)
                new = np.flatnonzero(np.isinf(least))
                if len(new):  # no bound yet: the most promising blocks give one
                    np.put_along_axis(done, np.argsort(-most, axis=0, kind="stable")[:SEED_BLOCKS], True, axis=0)
                    done &= (most > 0) & np.isinf(least)
                for turn in range(0 if len(new) else 1, 2):  # then the blocks that can reach the k-th score
                    want = done if not turn else (most > 0) & (most >= least - 2e-6) & ~done
                    columns = np.flatnonzero(want.any(axis=0))
                    if len(columns):
                        some, got = met.scores(want[:, columns].any(axis=1), columns)
                        fits = (got > 0) & (got >= least[columns] - 2e-6) & want[met.held_in[some]][:, columns]
                        d, q = np.nonzero(fits)
                        least, who, ords, score = _kept(k, n, least, np.append(who, columns[q]), np.append(ords, met.ords[some[d]]), np.append(score, got[d, q]))
                        done = done | want
                seen[name] = (asked, least, who, ords, score)
                if report:
                    block, q = np.nonzero(most > 0)
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(q)), pa.array(met.blocks[block]), pa.array(most[block, q]), pa.array(done[block, q])], names=["query_id", "block", "most", "read"])
        if not report:
            for state in seen.values():
                yield end(state)

    return run


def _kept(k: int, n: int, least: np.ndarray, who: np.ndarray, ords: np.ndarray, score: np.ndarray) -> tuple:
    """The k-th score of each of ``n`` queries, and what can still be among its best: scores are rounded later, and ties decided then."""
    order = np.lexsort((-score, who))
    who, ords, score = who[order], ords[order], score[order]
    first = np.searchsorted(who, np.arange(n))
    have = np.searchsorted(who, np.arange(n), "right") - first >= k
    least = least.copy()
    least[have] = np.maximum(least[have], score[first[have] + k - 1])
    stays = score >= least[who] - 2e-6
    return least, who[stays], ords[stays], score[stays]


def _best(index: TextIndex, terms: DataFrame, hits: DataFrame, k: int, among: DataFrame | None, packed: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The best ``k``, and each block (query_id, block, most) with whether it was scored.

    Postings meet blocks of queries as matrices in their tasks; only the best of a task leave it."""
    kind, met = dict(terms.dtypes)["query_id"], _met(*(packed or _packed(index, terms, hits, among)))
    found = met.mapInArrow(_scored(k, False), f"query_id {kind}, ord bigint, score double").withColumn("score", F.round("score", 6))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), index.key)
    named = found.join(index.documents, "ord").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    judged = met.mapInArrow(_scored(k, True), f"query_id {kind}, block bigint, most double, read boolean")
    return named.select("query_id", index.key, "score", "rank"), judged


def _met(packed: DataFrame, blocks: DataFrame) -> DataFrame:
    return packed.crossJoin(blocks.withColumnRenamed("codes", "q_codes"))


def totals(index: TextIndex, terms: DataFrame, hits: DataFrame, among: DataFrame | None = None, packed: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """query_id, total: how many documents hold any term. They are counted where their postings lie."""
    kind = dict(terms.dtypes)["query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, (codes, place, idfs), asked in _groups(b):
                met = _Met(group, codes, place, np.ones(len(idfs)), len(asked))
                if not len(met.ords):
                    continue
                n = met.counts()
                q = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(q)), pa.array(n[q])], names=["query_id", "n"])

    each = _met(*(packed or _packed(index, terms, hits, among))).mapInArrow(run, f"query_id {kind}, n bigint")
    return each.groupBy("query_id").agg(F.sum("n").alias("total"))


def search_with_totals(index: TextIndex, queries: DataFrame, k: int, among: DataFrame | None = None) -> DataFrame:
    """``search`` with the exact number of all hits of each query."""
    terms, hits = _prepared(index, queries)
    packed = _packed(index, terms, hits, among)
    return _best(index, terms, hits, k, among, packed)[0].join(totals(index, terms, hits, among, packed), "query_id")


def scan(index: TextIndex, queries: DataFrame) -> DataFrame:
    """query_id, key, score of every hit: what ``search`` takes its best from."""
    posts, asks = _posts(index, *_prepared(index, queries))
    return _summed(posts.repartition("block").join(asks, ["field", "term"])).join(index.documents, "ord").select("query_id", index.key, "score")
