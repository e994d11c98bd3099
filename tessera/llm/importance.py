"""Operator 12: importance resampling of documents towards a target distribution.

Texts are bags of hashed runs of 1 to 3 words. ``bucket_counts`` counts the buckets of a corpus,
``gains`` turns the counts of corpus and target into one integer gain a bucket, ``score`` sums them
over each document and adds a Gumbel variate made from its id, and ``draw`` takes the exact ``k``
highest scores.

Hashing is on arrays (``Grams``): words are found in the bytes of an Arrow batch, the CRC-32 of each
word is run over all words at once, and that of a run of words follows from those of its words,
because the checksum of joined strings is linear in the first. So no string of a run is ever made.

``draw`` selects by radix on the composite key (score, highest first; null ids last; doc_id; n_features):
each round counts rows by the next 12 bits of the key among the rows that share all bits before,
brings at most 4,096 counts to the driver and keeps the cell that holds the k-th row, until a cell is
taken whole or the key ends. What the rounds find is the exact k-th key. Only rows up to it are
range-sorted and ranked; all others keep a null rank and are never sorted.

A null text has no words. A null doc_id counts as an empty string where its variate is made and comes
after all others of the same score. Rows that repeat a doc_id have the same variate and are ordered
by n_features; equal rows are drawn as often as they fit, with ranks of their own. An empty table,
or too few rows to draw one, gives null ranks; an empty target counts 0 in each bucket. Columns beside key and text are not read."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import gathered, stage, table, work_dir

BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of text that are hashed at a time; a longer text is cut between words, and carries its last two on.
WINDOW = 1 << 19
_DIGIT, _PER_TASK = 12, 200_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


# --- hashing ---------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of one byte; what 0 to 63 zero bytes, and 2^6, 2^7, ... of them, make of a register's four bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1).astype(np.uint32)
    low = np.empty((64, 4, 256), np.uint32)
    low[0] = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    for n in range(1, 64):
        low[n] = byte[low[n - 1] & 255] ^ (low[n - 1] >> 8)
    high = np.empty((26, 4, 256), np.uint32)
    half = byte[low[63] & 255] ^ (low[63] >> 8)
    high[0] = half
    for k in range(1, 26):
        high[k] = _through(high[k - 1], high[k - 1])
    return byte, low, high


def _through(c: np.ndarray, by: np.ndarray) -> np.ndarray:
    return by[0, c & 255] ^ by[1, (c >> 8) & 255] ^ by[2, (c >> 16) & 255] ^ by[3, c >> 24]


def _shift(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums ``c`` of strings as they enter the checksum of those strings and ``n`` more bytes."""
    _, low, high = _tables()
    m = n & 63
    out = low[m, 0, c & 255] ^ low[m, 1, (c >> 8) & 255] ^ low[m, 2, (c >> 16) & 255] ^ low[m, 3, c >> 24]
    rest = np.flatnonzero(n >= 64)
    for k in range(26) if len(rest) else ():
        some = rest[(n[rest] >> (k + 6)) & 1 == 1]
        if len(some):
            out[some] = _through(out[some], high[k])
    return out


def _space(c: np.ndarray) -> np.ndarray:
    """Checksums of strings after one more space."""
    byte = _tables()[0]
    r = c ^ np.uint32(0xFFFFFFFF)
    return byte[(r ^ 32) & 255] ^ (r >> 8) ^ np.uint32(0xFFFFFFFF)


class Grams:
    """Runs of words in a stretch of bytes: ``bytes_`` holds texts one after another, text i from
    ``ends[i-1]`` on; of text i the first ``skip[i]`` words are there for runs that end later and
    count for nothing themselves."""

    def __init__(self, bytes_: np.ndarray, ends: np.ndarray, skip: np.ndarray, buckets: int, longest: int):
        self.texts = len(ends)
        inside = _IN_WORD[bytes_]
        begins = np.concatenate([[0], ends[:-1]])
        before = np.zeros(len(inside) + 1, bool)
        before[1:] = inside
        before[begins] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(len(inside) + 1, bool)
        after[:-1] = inside
        after[ends] = False
        size = np.flatnonzero(inside & ~after[1:]) + 1 - self.start
        self.owner = np.searchsorted(ends, self.start, "right")
        self.words = np.bincount(self.owner, minlength=self.texts)
        place = np.arange(len(size)) - (np.cumsum(self.words) - self.words)[self.owner]
        own = place >= skip[self.owner]
        crc = self._words(_LOWER[bytes_], size)
        run = crc
        self.bucket, self.of = [(crc % buckets)[own]], [self.owner[own]]
        for n in range(1, longest):
            run = _shift(_space(run[:-1]), size[n:]) ^ crc[n:]  # runs of n + 1 words, by their last word
            good = own[n:] & (place[n:] >= n)
            self.bucket.append((run % buckets)[good])
            self.of.append(self.owner[n:][good])

    def _words(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        byte = _tables()[0]
        out = np.full(len(size), 0xFFFFFFFF, np.uint32)
        live = np.flatnonzero(size <= 64)
        at, left = self.start[live], size[live]
        reg = out[live]
        for k in range(int(left.max(initial=0))):
            reg = byte[(reg ^ low[at + k]) & 255] ^ (reg >> 8)
            done = left == k + 1
            if done.any():
                out[live[done]] = reg[done]
                go = ~done
                live, at, left, reg = live[go], at[go], left[go], reg[go]
        out ^= np.uint32(0xFFFFFFFF)
        for w in np.flatnonzero(size > 64):
            out[w] = zlib.crc32(low[self.start[w] : self.start[w] + size[w]].tobytes())
        return out


def windows(texts: pa.Array, size: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, ends, skip) of about ``size`` bytes each: many short texts or a part of a long one."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data or b"", np.uint8)
    k = 0
    while k < len(texts):
        if at[k + 1] - at[k] > size:
            yield from _cut(k, raw[at[k] : at[k + 1]].tobytes(), size)
            k += 1
            continue
        end = max(k + 1, int(np.searchsorted(at, at[k] + size, "right")) - 1)
        yield np.arange(k, end), raw[at[k] : at[end]], at[k + 1 : end + 1] - at[k], np.zeros(end - k, np.int64)
        k = end


def _cut(row: int, text: bytes, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    at, carried = 0, []
    while at < len(text):
        cut = _GAP.search(text, at + size) if len(text) - at > size else None
        end = cut.start() if cut else len(text)
        part = b" ".join([*carried, text[at:end]])
        yield np.array([row]), np.frombuffer(part, np.uint8), np.array([len(part)]), np.array([len(carried)])
        carried, at = [w for w in _GAP.split(part) if w][-(LONGEST_RUN - 1) :], end


# --- counts and scores -----------------------------------------------------------------------


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many runs of all texts fall in each bucket. A task sends at most ``buckets`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, raw, ends, skip in windows(b.column(0)):
                for x in Grams(raw, ends, skip, buckets, LONGEST_RUN).bucket:
                    total += np.bincount(x, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for each bucket: a thousand times the log of its smoothed share in the target over that in the source."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    s, t = source.select("bucket", F.col("n").alias("s")), target.select("bucket", F.col("n").alias("t"))
    both = every.join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"))
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.join(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def score(docs: DataFrame, gain: DataFrame, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row. ``buckets`` gains reach the driver and each task."""
    array = np.zeros(buckets, np.int64)
    for r in gain.collect():  # one row a bucket
        array[r.bucket] = r.gain
    held = docs.sparkSession.sparkContext.broadcast(array)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for rows, raw, ends, skip in windows(b.column("text")):
                g = Grams(raw, ends, skip, buckets, LONGEST_RUN)
                words[rows] += g.words - skip
                for bucket, of in zip(g.bucket, g.of):
                    features[rows] += np.bincount(of, minlength=len(rows))
                    sums = np.concatenate([[0], np.cumsum(held.value[bucket])])
                    ends_ = np.searchsorted(of, np.arange(len(rows) + 1))
                    weight[rows] += np.diff(sums[ends_])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (words, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    weighed = rows.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    variate = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return weighed.withColumn("score", F.col("weight") + variate)


# --- selection -------------------------------------------------------------------------------


def _bits(x: int) -> int:
    """A signed 64-bit number as the unsigned one of the same order."""
    return x + (1 << 63)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def kth_key(rows: DataFrame, key: list[str], k: int) -> list[int]:
    """A bound of ``key`` (signed 64-bit columns, ascending): the rows up to it in order of the columns
    are the first ``k`` and those equal to the k-th. It may end before the last columns.

    A round brings one count for each value of the next ``_DIGIT`` bits to the driver."""
    bound: list[int] = []
    for c in key:
        least, most = rows.agg(F.min(c), F.max(c)).first()
        left = (_bits(least) ^ _bits(most)).bit_length()
        unsigned = F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
        value = _bits(least) >> left
        while left:
            take = min(_DIGIT, left)
            left -= take
            cell = F.shiftrightunsigned(unsigned, left)
            counts = sorted(((r.cell & ((1 << take) - 1)), r.n) for r in rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).collect())
            for digit, n in counts:
                if n >= k:
                    break
                k -= n
            value = value << take | digit
            rows = rows.where(cell == _signed(value))
            if n == k:  # taken whole: the largest key in this cell is a bound
                return [*bound, ((value + 1) << left) - 1 - (1 << 63)]
        bound.append(value - (1 << 63))
    return bound


def up_to(key: list[str], bound: list[int]) -> Column:
    """Is a row's key, cut to the length of ``bound``, at most ``bound``?"""
    within = F.col(key[len(bound) - 1]) <= bound[-1]
    for c, v in reversed(list(zip(key, bound[:-1]))):
        within = (F.col(c) < v) | ((F.col(c) == v) & within)
    return within


def draw(scored: DataFrame, share: tuple[int, int] = (PERCENT, 100), least_words: int = LEAST_WORDS, folder: str | None = None) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3, ... for the drawn floor(share * N) of the N rows of at least
    ``least_words`` words, in order of score, and null for all others."""
    spark = scored.sparkSession
    folder = folder or work_dir(spark, "importance")
    names = scored.columns
    key = ["by_score", "by_null", "by_id", "n_features"]
    keyed = scored.withColumns({"by_score": F.bitwise_not("score"), "by_null": F.col("doc_id").isNull().cast("long"), "by_id": F.coalesce("doc_id", F.lit(0)).cast("long")})
    keyed = stage(keyed.withColumn("copy", F.monotonically_increasing_id()), f"{folder}/scored", narrow=True)
    able = F.col("n_words") >= least_words
    k = keyed.where(able).count() * share[0] // share[1]
    none = F.lit(None).cast("long").alias("rank")
    if not k:
        return keyed.select(*names, none)
    chosen = able & up_to(key, kth_key(keyed.where(able), key, k))
    picked = keyed.where(chosen).repartitionByRange(-(-k // _PER_TASK), *key, "copy").withColumn("part", F.spark_partition_id())
    picked = stage(picked, f"{folder}/ranges")
    sizes = picked.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*key, "copy")) + F.col("before")
    ranked = picked.join(F.broadcast(sizes), "part").withColumn("rank", rank.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))  # equals of the k-th row beyond k
    return ranked.select(*names, "rank").unionByName(keyed.where(~chosen).select(*names, none))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (PERCENT, 100), least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs`` (doc_id, text), resampled
    towards the texts of ``target``."""
    folder = work_dir(docs.sparkSession, "importance")
    counts = stage(bucket_counts(docs), f"{folder}/source", narrow=True)
    gain = gains(counts, bucket_counts(target))
    return draw(score(docs, gain, seed), share, least_words, folder)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return gathered(drawn.select("doc_id", "n_features", "weight", "score", "rank"))


#: CRC-32 is affine: the checksum of a string is the sum (XOR) of what each byte gives at its distance
#: from the end, started by four bytes of ones. ``reach`` holds that for each byte and distance.
ORACLE = r"""
WITH RECURSIVE bits(b, r, k) AS (
    SELECT i, i::UBIGINT, 0 FROM range(256) t(i) UNION ALL
    SELECT b, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END, k + 1 FROM bits WHERE k < 8),
one AS (SELECT b, r FROM bits WHERE k = 8),
bags AS (
    SELECT 0 AS side, doc_id AS id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents UNION ALL
    SELECT 1, item_id, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
words AS (SELECT side, row, unnest(range(1, len(w) + 1)) AS p, w FROM bags WHERE len(w) > 0),
runs AS (
    SELECT side, row, w[p] AS f FROM words UNION ALL
    SELECT side, row, w[p] || ' ' || w[p + 1] FROM words WHERE p < len(w) UNION ALL
    SELECT side, row, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] FROM words WHERE p < len(w) - 1),
feats AS (SELECT side, row, f, count(*) AS n FROM runs GROUP BY ALL),
texts AS (SELECT f, row_number() OVER () AS i, octet_length(encode(f)) AS size FROM (SELECT DISTINCT f FROM feats)),
reach(b, r, d) AS (
    SELECT b, r, 0 FROM one UNION ALL
    SELECT x.b, xor(x.r >> 8, o.r), d + 1 FROM reach x JOIN one o ON o.b = x.r & 255 WHERE d < (SELECT max(size) FROM texts)),
ones(d, r) AS (
    SELECT 0, 4294967295::UBIGINT UNION ALL
    SELECT d + 1, xor(x.r >> 8, o.r) FROM ones x JOIN one o ON o.b = x.r & 255 WHERE d < (SELECT max(size) FROM texts)),
letters AS (SELECT i, ('0x' || substr(h, 2 * k - 1, 2))::INT AS b, size - k AS d FROM (SELECT i, size, hex(encode(f)) AS h, unnest(range(1, size + 1)) AS k FROM texts)),
sums AS (SELECT i, bit_xor(r) AS r FROM letters JOIN reach USING (b, d) GROUP BY i),
hashed AS (SELECT f, xor(xor(s.r, o.r), 4294967295::UBIGINT) % 10000 AS bucket FROM texts JOIN sums s USING (i) JOIN ones o ON o.d = size),
counted AS (SELECT side, row, bucket, n FROM feats JOIN hashed USING (f)),
per AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM counted GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM per),
gain AS (SELECT bucket, floor(1000.0 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain FROM per, totals),
weights AS (SELECT row, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN gain USING (bucket) WHERE side = 0 GROUP BY row),
scored AS (
    SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        (coalesce(weight, 0) + floor(-1000.0 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0))))::BIGINT AS score
    FROM bags LEFT JOIN weights USING (row) WHERE side = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM ranked
"""
