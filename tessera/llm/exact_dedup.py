"""Operator 10: exact deduplication through an extendible-hash index on shared files.

1. *Combine*: each task folds equal texts of its rows (hash table keyed by the bytes themselves,
   emptied at a byte bound) to one row with the list of their ids, so a text that a third of all rows
   repeat leaves a task as few rows.
2. *Own*: the 64-bit text hash is cut into equal key ranges, one owner task for each. An owner gets
   its range in hash order and fills buckets. A bucket over its capacity splits by one more bit of
   the hash, and the directory doubles where the bucket was as deep as the directory; in hash order
   only the last bucket can still grow, so one bucket at a time is in memory. Rows of one hash value
   cannot be split apart: they are chained in their bucket, and each new text is compared byte by
   byte with the chain. Sealed buckets become pages of one segment file for each owner, which ends in
   the directory: for each value of the leading bits the page of the bucket. It is written under a
   temporary name and moved. For each combined row the owner hands on its ids with the address where
   it found or put the text: owner, hash and place in the chain.
3. *Probe*: tasks open the segments, go through the directory to the page of each address and read
   there what the whole class has come to: the row that stays, the number of rows and the digest.

This is the bulk loading of an extendible-hash index: as rows come in hash order, the directory is a
depth that doubles while buckets split, and its array is laid out once, when the segment closes. There
are as many owners as the bytes of the input ask for.

A directory doubles at most MOST_DEPTH times; a bucket that would need more grows beyond its
capacity instead.

Null counts as the empty text. Texts are equal when identical after no change. Of equal texts exactly
one row stays: one with the largest doc_id, null being less than any; where rows with that id repeat,
the first of them in the order of the input's partitions. An empty table gives none."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Publisher, file_system, gathered, slices, stage, table, width, work_dir

MAGIC = b"XHI2"
BUCKET_BYTES = 1 << 20
#: Bytes of input, as they are stored, for each owner; there are as many owners as shuffle partitions at least.
OWNER_BYTES, MOST_OWNERS = 64 << 20, 1 << 20
COMBINE_BYTES = 8 << 20
MOST_DEPTH = 22
_TAIL = struct.Struct("<QIIQQ")  # pages, depth, prefix, offset of the directory, offset of the page list
_PAGE = struct.Struct("<QIQQI")  # address, depth, offset, bytes of the body, entries
_ENTRY = struct.Struct("<QIQqBQQQ32s")  # hash, place in its chain, bytes, largest id, whether there is any, task and row that have it, rows, digest
_POSTING = "owner int, h bigint, chain int, task bigint, row bigint, ids array<bigint>"


def default_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each distinct (hash, text) of what a task has read since its table was emptied,
    with the ids of its rows, and its place: task and number within the task."""
    names = ["h", "text", "ids", "task", "row"]
    task, row = TaskContext.get().partitionId(), 0
    held: dict[tuple[int, str], list] = {}
    size = 0

    def flush(row: int):
        keys = list(held)
        for at in range(0, len(keys), 256):
            part = keys[at : at + 256]
            columns = [
                pa.array([k[0] for k in part], pa.int64()),
                pa.array([k[1] for k in part], pa.string()),
                pa.array([held[k] for k in part], pa.list_(pa.int64())),
                pa.array([task] * len(part), pa.int64()),
                pa.array(range(row + at, row + at + len(part)), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        held.clear()

    for b in slices(batches, 512):
        for h, text, i in zip(b.column("h").to_pylist(), b.column("text").to_pylist(), b.column("id").to_pylist()):
            got = held.get((h, text))
            if got is None:
                held[h, text] = [i]
                size += 2 * len(text) + 200
            else:
                got.append(i)
                size += 40
            if size > COMBINE_BYTES:
                n = len(held)
                yield from flush(row)
                size, row = 0, row + n
    yield from flush(row)


class Owner:
    """The buckets and the directory of one key range, filled in hash order.

    The top ``prefix`` bits of the hash choose the owner; depths and addresses count bits after
    those. ``open`` is the bucket that takes rows now, ``later`` are the buckets above it."""

    def __init__(self, prefix: int, out: Publisher, capacity: int = BUCKET_BYTES, most_depth: int = MOST_DEPTH):
        self.prefix, self.out, self.capacity, self.most_depth = prefix, out, capacity, most_depth
        self.depth = 0  # of the directory
        self.open, self.later = (0, 0), []  # (depth, address)
        self.chains: dict[int, list[list]] = {}  # hash: entries [text, id, task, row, rows]
        self.bytes = 0
        self.pages: list[tuple[int, int, int, int, int]] = []
        out.write(MAGIC)

    def address(self, h: int, depth: int) -> int:
        return (h << self.prefix & (1 << 64) - 1) >> (64 - depth) if depth else 0

    def add(self, h: int, text: bytes, ids: list, task: int, row: int) -> int:
        """Insert one combined row; its place in the chain of its hash."""
        while self.address(h, self.open[0]) != self.open[1]:
            self.seal()
            self.open = self.later.pop()
        top = max((i for i in ids if i is not None), default=None)
        chain = self.chains.setdefault(h, [])
        for place, entry in enumerate(chain):
            if entry[0] == text:  # bytes decide, not hashes
                entry[4] += len(ids)
                if top is not None and (entry[1] is None or top > entry[1]):
                    entry[1:4] = top, task, row
                return place
        chain.append([text, top, task, row, len(ids)])
        self.bytes += len(text) + _ENTRY.size
        place = len(chain) - 1
        while self.bytes > self.capacity and len(self.chains) > 1 and self.open[0] < min(self.most_depth, 64 - self.prefix):
            self.split()
        return place

    def split(self) -> None:
        """Split the open bucket by one more bit. Where the upper half has rows already, the lower
        half can get no more and is sealed."""
        depth, low = self.open[0] + 1, self.open[1] << 1
        self.depth = max(self.depth, depth)  # the directory doubles where the bucket was as deep
        upper = {h: c for h, c in self.chains.items() if self.address(h, depth) != low}
        self.open = (depth, low)
        if not upper:
            self.later.append((depth, low + 1))
            return
        self.chains = {h: c for h, c in self.chains.items() if h not in upper}
        self.seal()
        self.open, self.chains = (depth, low + 1), upper
        self.bytes = sum(len(e[0]) + _ENTRY.size for c in upper.values() for e in c)

    def seal(self) -> None:
        """Write the open bucket as a page of the segment: its entries, then its texts."""
        if self.chains:
            import zstandard

            every = [(h, place, e) for h, c in self.chains.items() for place, e in enumerate(c)]
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(e[0] for _, _, e in every))
            self.pages.append((self.open[1], self.open[0], self.out.size, len(body), len(every)))
            for h, place, (text, top, task, row, n) in every:
                self.out.write(_ENTRY.pack(h, place, len(text), top or 0, top is not None, task, row, n, hashlib.sha256(text).digest()))
            self.out.write(body)
        self.chains, self.bytes = {}, 0

    def close(self) -> None:
        self.seal()
        directory = np.full(1 << self.depth, -1, "<i4")
        for k, (address, depth, *_) in enumerate(self.pages):
            span = self.depth - depth
            directory[address << span : (address + 1) << span] = k
        at = self.out.size
        self.out.write(directory.tobytes())
        listed = self.out.size
        for page in self.pages:
            self.out.write(_PAGE.pack(*page))
        self.out.write(_TAIL.pack(len(self.pages), self.depth, self.prefix, at, listed) + MAGIC)
        self.out.commit()


class Segment:
    """One owner's file: the directory in memory, pages read as they are asked for."""

    def __init__(self, folder: str, owner: int):
        fs, root = file_system(folder)
        self.file = fs.open_input_file(f"{root}/owner-{owner:06d}.xhi")
        end = self.file.size()
        tail = self.file.read_at(_TAIL.size + 4, end - _TAIL.size - 4)
        if tail[-4:] != MAGIC:
            raise ValueError("not a whole segment")
        n, self.depth, self.prefix, at, listed = _TAIL.unpack(tail[:-4])
        self.directory = np.frombuffer(self.file.read_at(4 << self.depth, at), "<i4")
        pages = self.file.read_at(_PAGE.size * n, listed)
        self.pages = [_PAGE.unpack_from(pages, _PAGE.size * k) for k in range(n)]
        self.now, self.entries = -1, {}

    def page(self, h: int) -> int:
        """The number of the page that holds an unsigned hash, by the directory; -1 if there is none."""
        return int(self.directory[(h << self.prefix & (1 << 64) - 1) >> (64 - self.depth) if self.depth else 0])

    def at(self, h: int) -> dict[tuple[int, int], tuple]:
        """The entries of the page of ``h`` by hash and place: (id, task, row, rows, digest, offset and length of the text)."""
        k = self.page(h)
        if k != self.now:
            self.now, self.entries = k, {}
            if k >= 0:
                _, _, offset, _, n = self.pages[k]
                each, place = _ENTRY.size, 0
                raw = self.file.read_at(each * n, offset)
                for e in range(n):
                    got, chain, size, top, has, task, row, rows, digest = _ENTRY.unpack_from(raw, each * e)
                    self.entries[got, chain] = (top if has else None, task, row, rows, digest.hex(), place, size)
                    place += size
        return self.entries

    def find(self, h: int, text: bytes) -> tuple[int | None, int] | None:
        """Probe for a text, by bytes: (keep_id, group_size), or None."""
        import zstandard

        chain = 0
        while (entry := self.at(h).get((h, chain))) is not None:
            _, _, offset, length, n = self.pages[self.now]
            body = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, offset + _ENTRY.size * n), max_output_size=1 << 31)
            if body[entry[5] : entry[5] + entry[6]] == text:
                return entry[0], entry[3]
            chain += 1
        return None


def build_index(
    docs: DataFrame, folder: str, postings: str, text: str = "text", key: str = "doc_id", hashed: Callable[[Column], Column] = default_hash, capacity: int = BUCKET_BYTES, owners: int | None = None, most_depth: int = MOST_DEPTH
) -> DataFrame:
    """Write the index of all rows to ``folder`` and, to ``postings``, the ids of all rows with their
    addresses in it: owner, h, chain, task, row, ids. Returns the postings."""
    spark = docs.sparkSession
    if owners is None:
        size = int(str(docs.select(text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size >= 1 << 60:  # the planner does not know, as where rows come from no files
            size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        owners = max(width(spark), min(MOST_OWNERS, size // OWNER_BYTES))
    prefix = max(1, (owners - 1).bit_length())
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(hashed(body).alias("h"), body.alias("text"), F.col(key).cast("long").alias("id"))
    combined = rows.mapInArrow(_combine, "h bigint, text string, ids array<bigint>, task bigint, row bigint")
    owner = F.shiftrightunsigned("h", 64 - prefix).cast("int")
    owned = combined.withColumn("owner", owner).repartitionById(1 << prefix, F.col("owner"))
    # in hash order as an unsigned number, and by place, so that a repeated task finds the same order;
    # the sort is the JVM's and may spill
    owned = owned.sortWithinPartitions("owner", F.col("h").bitwiseXOR(F.lit(-(1 << 63))), "task", "row")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, current = None, None
        names = ["owner", "h", "chain", "task", "row", "ids"]
        for b in slices(batches):
            chains = []
            columns = (b.column(k).to_pylist() for k in ("owner", "h", "text", "ids", "task", "row"))
            for o, h, t, ids, task, row in zip(*columns):
                if o != current:
                    if index:
                        index.close()
                    current, index = o, Owner(prefix, Publisher(folder, f"owner-{o:06d}.xhi"), capacity, most_depth)
                chains.append(index.add(h & (1 << 64) - 1, t.encode(), ids, task, row))
            yield pa.RecordBatch.from_arrays([b.column("owner"), b.column("h"), pa.array(chains, pa.int32()), b.column("task"), b.column("row"), b.column("ids")], names=names)
        if index:
            index.close()

    return stage(owned.mapInArrow(own, _POSTING), postings)


_MARKED = "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string"


def mark(postings: DataFrame, folder: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row, by probes of the index in ``folder``."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, current = None, None
        for b in slices(batches):
            out: list[tuple] = []
            for o, h, chain, task, row, ids in zip(*(b.column(k).to_pylist() for k in ("owner", "h", "chain", "task", "row", "ids"))):
                if o != current:
                    current, segment = o, Segment(folder, o)
                h &= (1 << 64) - 1
                top, its_task, its_row, n, digest, _, _ = segment.at(h)[h, chain]
                first = ids.index(top) if (task, row) == (its_task, its_row) else -1
                out += [(i, top, n, k == first, digest) for k, i in enumerate(ids)]
                if len(out) > 10_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _MARKED.split(", ")])

    return postings.mapInArrow(probe, _MARKED)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Index ``docs`` in a new shared folder and mark its rows."""
    folder = work_dir(docs.sparkSession, "exact-dedup")
    return gathered(mark(build_index(docs, f"{folder}/index", f"{folder}/postings"), f"{folder}/index"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
