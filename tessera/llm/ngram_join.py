"""Operator 1: n-gram Jaccard join by MinHash banding.

Every text becomes its set of word 5-grams (64-bit hashes; under five words, all words are one
gram). Equal sets are one class. ``choose_bands`` picks rows and bands for a target recall at the
threshold. Classes are shuffled by band hash; those that share a bucket are candidates, and every pair
of classes that share a band is verified on the full n-gram sets. Stars around the smallest class
of each bucket keep what says who shares buckets linear in the number of classes; their connected components
are groups within which all candidates lie. A group is dealt as pairs of blocks of ``block`` classes (fewer
where sets are large), so no task holds an unbounded group and no pair is left out. In a component of over
``most_parts`` blocks, which chains of buckets can make out of classes that mostly share none, only blocks that
share a bucket meet, each two once, and buckets scattered over many blocks are dealt by themselves
(``dealt_by_blocks``). In a task intersections come from an
incidence matrix, and it emits for each class only its number of links and one link towards
the smallest class it reaches, never the pairs. Connected components of those links are the result.

Result, one row for each input row: doc_id, class_id (smallest doc_id connected by links, the
document's own without any), n_links (other documents whose n-gram sets have a Jaccard similarity of
at least the threshold; equal sets count), n_grams, stays (this row represents its class: smallest
doc_id, then smallest text hash). A null text or one without words has no grams, no links and a
class of its own. Rows with a null doc_id take part like others; a class of only such rows has a
null class_id. Repeated rows are documents of their own and link to each other."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import remove, slices, stage, table, work_dir

N, THRESHOLD, RECALL, BLOCK, GRAMS_EACH, MOST_PARTS = 5, 0.8, 0.999, 512, 500, 16
_MULT = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, whose bands find a pair at the
    threshold with the target probability within ``most`` hash functions."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no bands reach this recall")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Word hashes; a bounded memory of a Python worker."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = Words()


def grams(text: str | None, n: int = N) -> np.ndarray:
    """The sorted set of hashed word n-grams."""
    words = (text or "").encode().split()  # bytes split at ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    h = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        h = h * _MULT + w[k : len(w) - n + 1 + k]
    return np.unique(_mix(h))


def band_hashes(sets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    rng = np.random.default_rng(20_240_229)
    a = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 512):
        part = sets[at : at + 512, None]
        np.minimum(low, ((part ^ b) * a).min(axis=0), out=low)
    out = np.zeros(bands, np.uint64)
    for r in low.reshape(bands, rows).T:
        out = _mix(out * _MULT + r)
    return out.view(np.int64)


def digest(sets: np.ndarray) -> bytes:
    return hashlib.blake2b(sets.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, bands: int, rows: int, n: int, text: str, key: str) -> DataFrame:
    """doc_id, text_key, digest (null without words), n_grams, bands."""
    seen_bands = bands, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict = {}  # of the slice: equal texts are hashed once
        for b in slices(batches, 512):
            last.clear()
            out = []
            for t in b.column("text"):
                t = t.as_py()
                if t not in last:
                    g = grams(t, n)
                    last[t] = (digest(g), len(g), band_hashes(g, *seen_bands).tolist()) if len(g) else (None, 0, None)
                out.append(last[t])
            d, m, s = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(d, pa.binary()), pa.array(m, pa.int64()), pa.array(s, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "digest", "n_grams", "bands"],
            )

    rows_in = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    return rows_in.mapInArrow(run, "doc_id bigint, text_key bigint, digest binary, n_grams bigint, bands array<bigint>")


def components(edges: DataFrame, folder: str, most: int = 40) -> DataFrame:
    """Connected components of edges (a, b): node, root, where root is the smallest node. Nodes
    without edges are absent. Alternating large-star and small-star steps; each is two joins on
    distributed edges, written to the shared folder, and the number of rounds grows with the log of
    the diameter."""
    spark = edges.sparkSession
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{folder}/edges-0")
    seen = None
    for k in range(1, most + 1):
        # the minima are written before they are joined: joins of plain shuffles are the ones that may
        # split a hot node, here the centre of a large star, over tasks
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{folder}/least-{k}-0")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, f"{folder}/large-{k}")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), f"{folder}/least-{k}-1")
        small = large.join(least, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        done = stage(small, f"{folder}/edges-{k}")
        mark = done.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        for old in (f"edges-{k - 1}", f"large-{k}", f"least-{k}-0", f"least-{k}-1"):
            remove(spark, f"{folder}/{old}")
        now = done
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    values, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    own_a = np.bincount(place[owner < len(a)], minlength=len(values))
    shared = (own_a > 0) & (count > own_a)
    rare = shared & (own_a * (count - own_a) <= 64)
    keep = rare[place]
    order = np.argsort(place[keep], kind="stable")
    p, o = place[keep][order], owner[keep][order]
    for x in np.split(o, np.flatnonzero(np.diff(p)) + 1) if len(o) else []:
        left, right = x[x < len(a)], x[x >= len(a)] - len(a)
        out[np.ix_(left, right)] += 1
    common = np.flatnonzero(shared & ~rare)
    for at in range(0, len(common), 1024):
        column = np.full(len(values), -1, np.int64)
        part = common[at : at + 1024]
        column[part] = np.arange(len(part))
        c = column[place]
        x = np.zeros((len(a) + len(b), len(part)), np.float32)
        x[owner[c >= 0], c[c >= 0]] = 1
        out += x[: len(a)] @ x[len(a) :].T
    return out


def verify(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold; ``b`` None: within ``a``, a set not with itself."""
    other = a if b is None else b
    both = intersections(a, other)
    na, nb = (np.array([len(x) for x in s], np.float64) for s in (a, other))
    linked = both >= threshold * (na[:, None] + nb[None, :] - both) - 1e-6
    if b is None:
        np.fill_diagonal(linked, False)
    return linked


def shared_band(a: list[list[int]], marks: list[list[int] | None], b: list[list[int]] | None, band: int) -> np.ndarray:
    """Which pairs share one of the bands that the left one marks (null: any); with ``band`` 0 or more:
    which share none of these, and have ``band`` as the first band that they share."""
    x = np.array(a, np.int64)
    y = x if b is None else np.array(b, np.int64)
    marked = np.zeros(x.shape, bool)
    for k, m in enumerate(marks):
        marked[k, slice(None) if m is None else m] = True
    marked[:, : max(band, 0)] = True
    seen = np.zeros((len(x), len(y)), bool)
    for k in np.flatnonzero(marked.any(axis=0)):
        seen |= (x[:, None, k] == y[None, :, k]) & marked[:, k, None]
    return seen if band < 0 else (x[:, None, band] == y[None, :, band]) & ~seen


#: Where a class is dealt: the group, its number of blocks and the class's block; ``band`` below 0 for all bands.
GROUPS = "array<struct<grp:binary,parts:int,part:int,band:int>>"


def dealt_by_blocks(far: DataFrame, parts: Column, bands: int, folder: str) -> DataFrame:
    """digest, marks, groups of the classes ``far`` (digest, n_grams, bands) of large components.

    A class lives in a block of its largest bucket; a block holds as many classes as ``parts`` says. A
    bucket whose blocks are few and mostly its own is *marked*: two blocks meet once, however many
    marked buckets they share, so a cluster whose members share most bands is dealt once. Other
    buckets, as chains of small ones, are dealt by themselves, but for those whose members all live in
    one marked bucket. ``marks`` are a class's bands with marked buckets: a pair that shares such a
    band counts where its blocks meet, any other in the first band that it shares."""
    at = ["band", "h"]
    each = far.select("digest", "n_grams", F.posexplode("bands").alias(*at))
    buckets = each.groupBy(*at).agg(F.count("*").alias("n"), parts).where("n > 1")
    held = stage(each.join(buckets, at), f"{folder}-held")
    home = held.groupBy("digest").agg(F.max(F.struct("n", "band", "h")).alias("top"), F.first("n_grams").alias("n_grams"))
    home = stage(home.select("digest", "n_grams", F.col("top.band").alias("top_band"), F.col("top.h").alias("top_h")), f"{folder}-home")
    lives = ["top_band", "top_h"]
    # equal hashes would make one block of two, which is no fault
    block = F.xxhash64(*lives, F.pmod(F.xxhash64("digest"), F.col("parts"))).alias("block")
    placed = stage(home.join(home.groupBy(*lives).agg(parts), lives).select("digest", *lives, block), f"{folder}-placed")
    full = placed.groupBy("block").agg(F.count("*").alias("size"))

    seen = held.join(placed, "digest")
    touched = stage(seen.groupBy(*at, "n", "parts", "block").agg(F.min(F.struct(*lives)).alias("low"), F.max(F.struct(*lives)).alias("high")), f"{folder}-touched")
    judged = touched.join(full, "block").groupBy(*at, "n", "parts")
    judged = judged.agg(F.count("*").alias("blocks"), F.sum("size").alias("sizes"), F.min("low").alias("low"), F.max("high").alias("high"))
    few = (F.col("blocks") <= 2 * F.col("parts") + bands) & (F.col("sizes") <= 4 * F.col("n"))
    judged = judged.withColumn("marked", (F.col("blocks") == 1) | ((F.col("parts") > 1) & few))
    judged = stage(judged.select(*at, "parts", "low", "high", "marked"), f"{folder}-judged")
    marked = judged.where("marked").select(*at)
    tops = marked.select(F.col("band").alias("top_band"), F.col("h").alias("top_h"), F.lit(True).alias("covered"))
    alone = judged.where("NOT marked").select(*at, "parts", (F.col("low") == F.col("high")).alias("one"), F.col("low.top_band"), F.col("low.top_h"))
    alone = alone.join(tops, lives, "left").where("NOT (one AND covered IS NOT NULL)").select(*at, "parts")

    inside = touched.join(marked, at, "left_semi").select(*at, "block")
    met = inside.join(inside.withColumnRenamed("block", "other"), at).select("block", "other").distinct()
    first = F.col("block") <= F.col("other")
    name = F.concat_ws(":", F.lit("blocks"), F.least("block", "other"), F.greatest("block", "other")).cast("binary").alias("grp")
    kind = F.when(F.col("block") == F.col("other"), -1).otherwise(-2).alias("parts")
    by_block = met.groupBy("block").agg(F.collect_list(F.struct(name, kind, F.when(first, 0).otherwise(1).alias("part"), F.lit(-1).alias("band"))).alias("here"))
    own = F.struct(F.concat_ws(":", "band", "h").cast("binary").alias("grp"), "parts", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part"), "band")
    by_bucket = held.drop("parts").join(alone, at).groupBy("digest").agg(F.collect_list(own).alias("there"))
    marks = held.join(marked, at, "left_semi").groupBy("digest").agg(F.collect_list("band").alias("marks"))
    out = placed.select("digest", "block").join(by_block, "block", "left").join(by_bucket, "digest", "left").join(marks, "digest", "left")
    none = F.array().cast(GROUPS)
    groups = F.concat(F.coalesce(F.col("here").cast(GROUPS), none), F.coalesce(F.col("there").cast(GROUPS), none))
    return out.select("digest", F.coalesce("marks", F.array().cast("array<int>")).alias("marks"), groups.alias("groups"))


def _roots(linked: np.ndarray, square: bool) -> np.ndarray:
    """The smallest index that each member reaches; rows first, then columns unless square."""
    m, n = linked.shape
    if square:
        root = np.arange(m)
        while True:
            new = np.minimum(root, np.where(linked, root[None, :], m).min(axis=1, initial=m))
            new = new[new]
            if (new == root).all():
                return root
            root = new
    left, right = np.arange(m), np.arange(m, m + n)
    while True:
        r = np.minimum(right, np.where(linked, left[:, None], m + n).min(axis=0, initial=m + n))
        x = np.minimum(left, np.where(linked, r[None, :], m + n).min(axis=1, initial=m + n))
        if (x == left).all() and (r == right).all():
            return np.concatenate([left, right])
        left, right = x, r


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, block: int = BLOCK, most_parts: int = MOST_PARTS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """See the module: doc_id, text_key, class_id, n_links, n_grams, stays for every row."""
    spark = docs.sparkSession
    folder = work_dir(spark, "ngram-join")
    bands, rows = choose_bands(threshold, recall)
    signed = stage(signatures(docs, bands, rows, n, text, key), f"{folder}/signed", narrow=True)
    known = signed.where("digest IS NOT NULL")
    # the smallest row of each class by doc_id (a null doc_id after all others) stands for its text
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    classes = stage(known.groupBy("digest").agg(rep.alias("rep"), F.count("*").alias("copies"), F.max("n_grams").alias("n_grams"), F.max("bands").alias("bands")), f"{folder}/classes")

    member = classes.select("digest", F.posexplode("bands").alias("band", "h"))
    bucket = member.groupBy("band", "h").agg(F.min("digest").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = member.join(bucket, ["band", "h"]).select(F.col("digest").alias("a"), "b")
    groups = components(stars, f"{folder}/candidates")
    rows_of = groups.join(classes.withColumnRenamed("digest", "node"), "node").select(F.col("node").alias("digest"), "root", "rep.doc_id", "rep.text_key", "copies", "n_grams", "bands")
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_grams") / (block * GRAMS_EACH))).cast("int").alias("parts")
    sizes = stage(rows_of.groupBy("root").agg(parts), f"{folder}/sizes", narrow=True)
    part = F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int").alias("part")
    narrow = ("digest", "doc_id", "text_key", "copies", "bands")
    near = rows_of.join(sizes.where(F.col("parts") <= most_parts), "root")
    whole = F.array(F.struct(F.col("root").alias("grp"), "parts", part, F.lit(-1).alias("band")))
    chosen = near.select(*narrow, F.lit(None).cast("array<int>").alias("marks"), whole.alias("groups"))
    if not sizes.where(F.col("parts") > most_parts).isEmpty():
        far = stage(rows_of.join(sizes.where(F.col("parts") > most_parts).select("root"), "root", "left_semi"), f"{folder}/far")
        chosen = chosen.unionByName(far.select(*narrow).join(dealt_by_blocks(far, parts, bands, f"{folder}/far"), "digest"))

    texts = docs.select(F.col(key).cast("long").alias("d"), F.xxhash64(text).alias("k"), F.col(text).alias("text"))
    again = stage(known.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.count("*").alias("n")).where("n > 1"), f"{folder}/again", narrow=True)
    if not again.isEmpty():  # of repeated rows one is enough, and tasks fold theirs before the shuffle
        twice = again.select(F.col("d").alias("d2"), F.col("k").alias("k2"))
        same = F.col("d").eqNullSafe(F.col("d2")) & (F.col("k") == F.col("k2"))
        texts = texts.join(twice, same, "left_anti").unionByName(texts.join(twice, same, "left_semi").groupBy("d", "k").agg(F.first("text").alias("text")))
    with_text = chosen.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))

    kept = ["digest", "copies", "bands", "marks", "groups"]

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [grams(t.as_py(), n) for t in b.column("text")]
            keep = pa.array([digest(s) == d for s, d in zip(sets, b.column("digest").to_pylist())], pa.bool_())
            cols = [b.column(c) for c in kept]
            made = pa.RecordBatch.from_arrays([*cols, pa.array([s.tobytes() for s in sets], pa.binary())], names=[*kept, "grams"])
            yield made.filter(keep)

    kinds = f"digest binary, copies bigint, bands array<bigint>, marks array<int>, groups {GROUPS}"
    sets = with_text.select(*kept, "text").mapInArrow(as_sets, f"{kinds}, grams binary")
    # a class's block meets every other block of its group, and itself; a group of a pair of blocks (parts
    # below 0) is that pair alone
    pair = F.expr(
        "if(g.parts < 0, array(struct(0 AS i, -1 - g.parts AS j)), transform(sequence(0, g.parts - 1), k -> struct(least(g.part, k) AS i, greatest(g.part, k) AS j)))"
    )
    wide = ("digest", "copies", "bands", "marks", "grams")
    dealt = sets.select(*wide, F.explode("groups").alias("g")).select(*wide, "g", F.explode(pair).alias("p"))
    dealt = dealt.select(*wide, "g.grp", "g.part", "g.band", "p.i", "p.j")

    def check(t: pa.Table) -> pa.Table:
        d, part, copies = t.column("digest").to_pylist(), np.array(t.column("part").to_pylist()), np.array(t.column("copies").to_pylist(), np.float64)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        signed_by, marks = t.column("bands").to_pylist(), t.column("marks").to_pylist()
        place = {x: k for k, x in reversed(list(enumerate(d)))}  # a repeated row would bring its class twice
        order = sorted(place.values(), key=lambda k: (part[k] != i, d[k]))
        body = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("grams")]
        names, weight = [d[k] for k in order], copies[order]
        m = len(order) if i == j else int(sum(part[k] == i for k in order))
        a = [body[k] for k in order[:m]]
        b = None if i == j else [body[k] for k in order[m:]]
        if not a or b == []:
            return pa.table({"digest": pa.array([], pa.binary()), "root": pa.array([], pa.binary()), "links": pa.array([], pa.int64())})
        linked = verify(a, b, threshold)
        left = [signed_by[k] for k in order[:m]], [marks[k] for k in order[:m]]
        linked &= shared_band(*left, None if b is None else [signed_by[k] for k in order[m:]], t.column("band")[0].as_py())
        if b is None:
            links = linked @ weight
        else:
            links = np.concatenate([linked @ weight[m:], weight[:m] @ linked])
        root = _roots(linked, b is None)
        hit = np.flatnonzero(links > 0)
        return pa.table({"digest": pa.array([names[k] for k in hit], pa.binary()), "root": pa.array([names[root[k]] for k in hit], pa.binary()), "links": pa.array(links[hit].astype(np.int64))})

    found = stage(dealt.groupBy("grp", "i", "j").applyInArrow(check, "digest binary, root binary, links bigint"), f"{folder}/links", narrow=True)
    roots = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")), f"{folder}/linked")
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    # classes are few against documents; all of this is narrow
    full = classes.select("digest", "rep", "copies").join(roots.withColumnRenamed("node", "digest"), "digest", "left").join(links, "digest", "left")
    full = full.withColumn("root", F.coalesce("root", "digest"))
    heads = full.groupBy("root").agg(F.min("rep").alias("head"))
    named = stage(full.join(heads, "root").select("digest", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), f"{folder}/named")
    for done in ("candidates", "linked", "links", "classes", "sizes", "again", "far", "far-held", "far-home", "far-placed", "far-touched", "far-judged"):
        remove(spark, f"{folder}/{done}")
    out = signed.select("doc_id", "text_key", "digest", "n_grams").join(named, "digest", "left")
    alone = F.col("digest").isNull()
    return out.select(
        "doc_id",
        "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "n_grams",
        F.when(alone, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))).alias("stays"),
    )


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_grams")


#: All pairs that share a gram, by plain joins: exact, and only for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
c AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 10 * c >= 8 * (a.n + b.n - c)),
r(x, y) AS (SELECT rid, rid FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT w.doc_id, (SELECT min(v.doc_id) FROM r JOIN w v ON v.rid = r.y WHERE r.x = w.rid) AS class_id, (SELECT count(*) FROM l WHERE l.x = w.rid) AS n_links, coalesce(n.n, 0) AS n_grams FROM w LEFT JOIN n USING (rid)
"""
