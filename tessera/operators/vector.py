"""Exact vector operators: cosine, nearest neighbours by an inverted file in both filter orders, seeded
neighbours, moments and mean similarities from sums of unit vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settle

#: Rows that the centres of cells are fitted on, and most cells.
SAMPLE, MOST_CELLS = 4096, 1024
#: Query vectors of one block and corpus rows of one cell (about): a product of that size is in memory at once.
QUERY_BLOCK, CELL = 512, 4096
#: Blocks of queries that meet a cell in one task, each deal of them with the cell's rows; and bytes of visits of a task (about).
DEAL, TASK_BYTES = 16, 16 << 20
#: Rows of the first visit, in k: of more, the k-th is a better bound for the rows of all other cells.
FIRST = 4


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 when either norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of ``QUERY_BLOCK`` rows: what is made of one is a few matrices of that many rows and a column a cell."""
    for b in batches:
        for at in range(0, b.num_rows, QUERY_BLOCK):
            yield b.slice(at, QUERY_BLOCK)


@dataclass
class Cells:
    """An inverted file over rows of unit length: ``centres`` are the cells' directions, ``radius`` the widest angle
    of a row from them and ``rows`` how many each has; the last cell is for rows without length, whose
    cosines are 0. ``table`` has (key, embedding, cell) of every row."""

    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    table: DataFrame

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """The greatest cosine that any row of each cell can have with each of ``unit``: an angle between a query
        and a row is at least that to the centre less the radius."""
        angle = np.arccos(np.clip(unit @ self.centres.T, -1, 1)) - self.radius[None, :-1]
        most = np.where(self.rows[:-1] > 0, np.cos(np.clip(angle, 0, np.pi)), -2.0)
        most[~unit.any(axis=1)] = 0.0
        return np.concatenate([most, np.full((len(unit), 1), 0.0 if self.rows[-1] else -2.0)], axis=1)


def fit_cells(corpus: DataFrame, key: str, sample: int = SAMPLE, rounds: int = 6) -> Cells:
    """Centres from a sample of about ``sample`` rows, chosen by the hash of their keys; then every row in its cell.
    There are about as many cells as the root of the number of rows, ``MOST_CELLS`` at most."""
    spark, n = corpus.sparkSession, corpus.count()
    count = max(1, min(MOST_CELLS, int(n**0.5), sample // 8))
    chosen = corpus.where(F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // sample)))) == 0).select(F.xxhash64(key, F.lit(1)).alias("h"), "embedding")
    rows = [r.embedding for r in sorted(chosen.limit(4 * sample).collect(), key=lambda r: r.h)]  # a bounded sample
    known = _unit(np.array(rows, np.float64)) if rows else np.zeros((1, 1))
    centres = known[np.linspace(0, len(known) - 1, min(count, len(known))).astype(int)]
    for _ in range(rounds):
        near = (known @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, known)
        centres = np.where(sums.any(axis=1)[:, None], _unit(sums), centres)
    held = spark.sparkContext.broadcast(centres)  # MOST_CELLS rows at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            unit = _unit(_matrix(b.column("embedding"))) if b.num_rows else np.zeros((0, held.value.shape[1]))
            product = unit @ held.value.T
            cell = product.argmax(axis=1)
            angle = np.arccos(np.clip(product.max(axis=1), -1, 1)) if b.num_rows else np.zeros(0)
            none = ~unit.any(axis=1)
            cell[none], angle[none] = len(held.value), 0.0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[*b.schema.names, "cell", "angle"])

    kind = dict(corpus.dtypes)[key]
    table = settle(corpus.select(key, "embedding").mapInArrow(place, f"{key} {kind}, embedding {dict(corpus.dtypes)['embedding']}, cell int, angle double"))
    radius, size = np.zeros(len(centres) + 1), np.zeros(len(centres) + 1, np.int64)
    for r in table.groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect():  # one row a cell
        radius[r.cell], size[r.cell] = r.r + 1e-9, r.n
    return Cells(centres, radius, size, table.drop("angle"))


def _visits(queries: DataFrame, cells: Cells, k: int, again: bool) -> DataFrame:
    """query_id, embedding, least, cell: the most promising cells that hold ``k`` rows together; or, ``again``, all others that
    can hold a row as good as the ``least`` score that the first visit has found."""
    held = queries.sparkSession.sparkContext.broadcast((cells.centres, cells.radius, cells.rows))
    kind, vector = dict(queries.dtypes)["query_id"], dict(queries.dtypes)["embedding"]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cells(*held.value, None)
        for b in _slices(batches):
            most = own.bounds(_unit(_matrix(b.column("embedding"))))
            order = np.argsort(-most, axis=1, kind="stable")
            sums = np.cumsum(own.rows[order], axis=1)
            first = (sums - own.rows[order] < k) & (np.take_along_axis(most, order, 1) > -2)
            if again:
                least = np.array([-2.0 if x is None else x for x in b.column("least").to_pylist()])
                first = ~first & (np.take_along_axis(most, order, 1) >= np.maximum(least - 1e-6, -1.5)[:, None])  # scores have six digits
            row, at = np.nonzero(first)
            names = pa.array(row)
            worst = pa.array(least[row]) if again else pa.nulls(len(row), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("query_id").take(names), b.column("embedding").take(names), worst, pa.array(order[row, at].astype(np.int32))], names=["query_id", "embedding", "least", "cell"])

    return queries.mapInArrow(choose, f"query_id {kind}, embedding {vector}, least double, cell int")


def _meet(visits: DataFrame, cells: Cells, k: int, key: str) -> DataFrame:
    """query_id, key, score: the ``k`` best of each visit, of those that reach its ``least`` score if it has one. Queries of a cell meet its rows in
    matrix products of bounded size, and tasks grow in number with the visits, not in size."""
    asked = {r.cell: r.n for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
    per_cell = lambda f: F.create_map(*[F.lit(int(x)) for c, n in (asked or {-1: 1}).items() for x in (c, f(c, n))])[F.col("cell")]
    block = F.pmod(F.xxhash64("query_id"), per_cell(lambda c, n: -(-n // QUERY_BLOCK)))
    part = F.pmod(F.xxhash64(key), per_cell(lambda c, n: max(1, -(-int(cells.rows[c]) // CELL))))
    size = 64 + 4 * cells.centres.shape[1]
    tasks = max(visits.sparkSession.sparkContext.defaultParallelism, -(-sum(asked.values()) * size // TASK_BYTES))
    dealt = visits.withColumn("block", block).withColumn("deal", F.floor(F.col("block") / DEAL)).repartition(tasks, "cell", "deal")
    packed = dealt.groupBy("cell", "deal", "block").agg(F.sort_array(F.collect_list(F.struct("query_id", "embedding", "least"))).alias("q"))
    deals = F.explode(F.sequence(F.lit(0).cast("long"), per_cell(lambda c, n: (-(-n // QUERY_BLOCK) - 1) // DEAL).cast("long")))
    met = cells.table.where(F.col("cell").isin(*asked)).withColumn("part", part).withColumn("deal", deals).repartition(tasks, "cell", "deal")
    rows = met.groupBy("cell", "deal", "part").agg(F.collect_list(F.struct(key, "embedding")).alias("c"))
    kinds = dict(cells.table.dtypes)[key], dict(visits.dtypes)["query_id"]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                q, c = b.column("q")[n].values, b.column("c")[n].values
                names = np.array(c.field(0).to_pylist())
                order = np.argsort(names, kind="stable")
                m = _unit(_matrix(c.field(1)))[order]
                scores = np.round(_unit(_matrix(q.field(1))) @ m.T, 6)
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                scores = np.take_along_axis(scores, top, 1)
                least = np.array([-2.0 if x is None else x for x in q.field(2).to_pylist()])
                row, at = np.nonzero(scores >= least[:, None] - 1e-9)
                yield pa.RecordBatch.from_arrays([q.field(0).take(pa.array(row)), pa.array(names[order][top[row, at]]), pa.array(scores[row, at])], names=["query_id", key, "score"])

    return packed.join(rows, ["cell", "deal"]).select("q", "c").mapInArrow(best, f"query_id {kinds[1]}, {key} {kinds[0]}, score double")


def knn(queries: DataFrame, corpus: DataFrame, k: int, key: str) -> DataFrame:
    """The k nearest rows of ``corpus`` (key, embedding) for each of ``queries`` (query_id, embedding):
    query_id, key, score (cosine, 6 digits), rank; ties by key. Exact: see ``knn_report``."""
    return knn_report(queries, corpus, k, key)[0]


def knn_report(queries: DataFrame, corpus: DataFrame, k: int, key: str) -> tuple[DataFrame, DataFrame]:
    """``knn`` and, of each query, how many cells were visited and skipped.

    Rows lie in the cells of an inverted file. A query first visits the most promising cells that
    hold ``FIRST`` times k rows together; the k-th score found there is what any other cell must be able to reach, by
    the triangle inequality of angles, to be visited too, and what its rows must reach to leave it. Queries meet cells
    by equality of the cell."""
    if corpus.isEmpty():
        none = queries.limit(0).select("query_id", F.lit(None).cast(dict(corpus.dtypes)[key]).alias(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        return none, queries.select("query_id", F.lit(0).cast("long").alias("visited"), F.lit(0).cast("long").alias("skipped"))
    cells = fit_cells(corpus, key)
    queries = settle(queries.select("query_id", "embedding"))
    before = settle(_visits(queries, cells, FIRST * k, False))
    first = settle(_meet(before, cells, k, key))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    least = first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    after = settle(_visits(queries.join(least, "query_id", "left"), cells, FIRST * k, True))
    found = first.unionByName(_meet(after, cells, k, key))
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    seen = before.unionByName(after).groupBy("query_id").agg(F.count("*").alias("visited"))
    return best, seen.withColumn("skipped", F.lit(int((cells.rows > 0).sum())) - F.col("visited"))


def knn_then_filter(queries: DataFrame, chunks: DataFrame, nodes: DataFrame, k: int, cap: int) -> DataFrame:
    """Nearest chunks first, filters second: k chunks, those of the given nodes, the best chunk of
    each node, ``cap`` nodes for each query."""
    near = knn(queries, chunks, k, "chunk_id").join(chunks.select("chunk_id", "node_id"), "chunk_id").join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    per_node = near.groupBy("query_id", "node_id").agg(F.max_by(F.struct("score", "chunk_id"), F.struct("score", -F.col("rank"))).alias("b")).select("query_id", "node_id", "b.score", "b.chunk_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return per_node.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def seeded_neighbours(seeds: DataFrame, chunks: DataFrame, k: int, cap: int, least: float) -> DataFrame:
    """For each seed node (query_id = node, embedding of its first chunk) the nearest other nodes."""
    near = knn(seeds, chunks, k, "chunk_id").join(chunks.select("chunk_id", "node_id"), "chunk_id").where("node_id <> query_id")
    per_node = near.groupBy("query_id", "node_id").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return per_node.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def first_vectors(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("node_id").agg(F.min_by("embedding", "seq").alias("embedding"))


def hashed_embedding(dim: int):
    """An offline embedder: signed counts of FNV-1a token hashes, scaled to length 1."""

    @F.pandas_udf("array<float>")
    def embed(texts):
        import pandas as pd

        def one(text):
            v = np.zeros(dim)
            for tok in re.findall(r"\w+", (text or "").lower()):
                h = fnv1a(tok)
                v[h % dim] += 1 if h & 1 == 0 else -1
            n = np.sqrt((v * v).sum())
            if n == 0:
                v[0] = n = 1
            return (v / n).astype(np.float32).tolist()

        return pd.Series([one(t) for t in texts])

    return embed


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    raw = text.encode("utf-16-le")
    h = 0x811C9DC5
    for at in range(0, len(raw), 2):
        h = (h ^ (raw[at] | raw[at + 1] << 8)) * 0x01000193 & 0xFFFFFFFF
    return h


def similarity_moments(queries: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """query_id, n, mean, sd of the cosines of each query with all other rows, without a pair: the sum over all rows
    is the query times the sum of unit vectors, that of squares a quadratic form of the sum of their outer
    products. A task sends one vector and one matrix."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, m = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                unit = _unit(_matrix(b.column("embedding")))
                n, s, m = n + len(unit), s + unit.sum(axis=0), m + unit.T @ unit
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([m.ravel().tolist()])], names=["n", "s", "m"])

    parts = corpus.select("embedding").mapInArrow(add, "n bigint, s array<double>, m array<double>")
    flat = parts.select("n", F.posexplode(F.concat("s", "m")).alias("at", "x"))
    sums = [r.x for r in flat.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()]  # d + d^2 numbers for vectors of d
    total = parts.agg(F.sum("n")).first()[0] or 0
    dim = int((len(sums) + 0.25) ** 0.5 - 0.5) if sums else 0
    held = queries.sparkSession.sparkContext.broadcast((np.array(sums[:dim]), np.array(sums[dim:]).reshape(dim, dim)))
    own = corpus.select(F.col(key).alias("query_id")).distinct().withColumn("self", F.lit(True))
    kind = dict(queries.dtypes)["query_id"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, m = held.value
        for b in batches:
            if not b.num_rows:
                continue
            unit = _unit(_matrix(b.column("embedding")))
            self = np.array([bool(x) for x in b.column("self").to_pylist()])
            norm = (unit * unit).sum(axis=1) * self
            n = np.full(len(unit), total) - self
            mean = (unit @ s - norm) / np.maximum(n, 1)
            square = (np.einsum("ij,jk,ik->i", unit, m, unit) - norm * norm) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column("query_id"), pa.array(n.astype(np.int64)), pa.array(mean), pa.array(np.sqrt(np.maximum(square - mean * mean, 0)))], names=["query_id", "n", "mean", "sd"])

    return queries.select("query_id", "embedding").join(own, "query_id", "left").mapInArrow(apply, f"query_id {kind}, n bigint, mean double, sd double").where("n > 0")


def mean_similarity(members: DataFrame) -> DataFrame:
    """group, members, mean: the mean cosine over all pairs of the members (group, embedding) of each group, null for
    one member. No pair is made: the square of the length of the sum of unit vectors is the sum over
    all pairs and the members themselves. A dimension is a row, so a group of any size is summed in parts."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = members.select("group", "embedding", norm.alias("norm"))
    flat = unit.select("group", F.posexplode(F.transform("embedding", lambda x: F.when(F.col("norm") > 0, x.cast("double") / F.col("norm")).otherwise(0.0))).alias("at", "x"))
    sums = flat.groupBy("group", "at").agg(F.sum("x").alias("x")).groupBy("group").agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    sizes = unit.groupBy("group").agg(F.count("*").alias("members"), F.count_if(F.col("norm") > 0).alias("able"))
    n = F.col("members")
    return sizes.join(sums, "group", "left").select("group", "members", F.when(n > 1, (F.col("square") - F.col("able")) / (n * (n - 1))).alias("mean"))
