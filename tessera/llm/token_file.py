"""Operator 8: token-id files of patched frame-of-reference blocks.

Documents are encoded by the tokenizers library, an end id is appended to each, and the ids are
written in ascending doc_id order. Layout of a shard file (little endian)::

    "PFR1"
    segments, each: n_blocks u32, then for all its blocks  minimum u32[], width u8[], exceptions u16[],
        packed low bits (bit plane after bit plane, BLOCK/8 bytes each),
        exception positions u8[], exception high parts u32[]
    footer: offset of each segment u64[], first block of each segment u64[], place of each block in its
        segment's packed bytes u32[] and exception lists u32[], doc ids i64[] with null flags u8[],
        ids of each document u64[]
    counts and offset of the footer, "PFR1"

A block holds 256 ids; the last is filled up with its first id. Each subtracts its minimum and packs
at the width that ``percentile`` of its differences need; larger ones keep their low bits in the pack
and their high part in the exception list. The index of block starts lets a reader decode any range.

Shards are ranges of (doc_id, hash of the text) of about equal bytes (``range_shards``), one task each, written under temporary
names and moved; the manifest names the committed files and gives each its offset: the ids before
it, a running sum over one row for each shard.

A null text counts as empty and gives the end id alone. Null doc_ids come first. Rows that repeat a
doc_id are ordered by the hash of their text and then by the text, and each has its place. An empty table gives an empty manifest."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Publisher, range_shards, read_file, slices, stage, table, width, work_dir

MAGIC, BLOCK, SEGMENT, PERCENTILE, SHARD_BYTES, END_ID = b"PFR1", 256, 2048, 90, 64 << 20, 2
_CACHE = 300_000  # entries of about 200 bytes in each of two generations


# --- the codec -------------------------------------------------------------------------------


def pack(values: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray, np.ndarray]:
    """One segment of up to SEGMENT blocks: its bytes, and each block's place in the packed bytes
    and in the exception lists."""
    n = -(-len(values) // BLOCK)
    v = np.empty(n * BLOCK, np.uint32)
    v[: len(values)] = values
    v[len(values) :] = values[(n - 1) * BLOCK]
    v = v.reshape(n, BLOCK)
    low = v.min(axis=1)
    v = v - low[:, None]
    at = max(0, -(-BLOCK * percentile // 100) - 1)
    limit = np.partition(v, at, axis=1)[:, at]
    bits = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.uint8)
    odd = (v >> np.minimum(bits, 31)[:, None]) * (bits < 32)[:, None]
    row, col = np.nonzero(odd)
    count = np.bincount(row, minlength=n)
    size = bits.astype(np.int64) * (BLOCK // 8)
    place = np.concatenate([[0], np.cumsum(size)])
    body = np.empty(place[-1], np.uint8)
    for w in np.unique(bits):
        if w:
            own = np.flatnonzero(bits == w)
            part = v[own].astype(np.uint16) if w <= 16 else v[own]
            planes = np.stack([np.packbits((part >> part.dtype.type(k)).astype(np.uint8) & 1, axis=1) for k in range(w)], axis=1)
            body[place[own][:, None] + np.arange(size[own[0]])] = planes.reshape(len(own), -1)
    data = b"".join(
        (struct.pack("<I", n), low.astype("<u4").tobytes(), bits.tobytes(), count.astype("<u2").tobytes(), body.tobytes(), col.astype(np.uint8).tobytes(), odd[row, col].astype("<u4").tobytes())
    )
    return data, place[:-1].astype("<u4"), (np.cumsum(count) - count).astype("<u4")


def unpack(data: bytes, at: int = 0) -> np.ndarray:
    """All ids of the segment that starts at ``at``, filling included."""
    (n,) = struct.unpack_from("<I", data, at)
    at += 4
    low = np.frombuffer(data, "<u4", n, at)
    bits = np.frombuffer(data, np.uint8, n, at := at + 4 * n)
    count = np.frombuffer(data, "<u2", n, at := at + n).astype(np.int64)
    at += 2 * n
    size = bits.astype(np.int64) * (BLOCK // 8)
    place = np.concatenate([[0], np.cumsum(size)])
    body = np.frombuffer(data, np.uint8, place[-1], at)
    at += place[-1]
    v = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(bits):
        if w:
            own = np.flatnonzero(bits == w)
            planes = body[place[own][:, None] + np.arange(size[own[0]])].reshape(len(own), w, BLOCK // 8)
            part = np.zeros((len(own), BLOCK), np.uint16 if w <= 16 else np.uint32)
            for k in range(w):
                part |= np.unpackbits(planes[:, k], axis=1).astype(part.dtype) << part.dtype.type(k)
            v[own] = part
    m = int(count.sum())
    col = np.frombuffer(data, np.uint8, m, at)
    high = np.frombuffer(data, "<u4", m, at + m)
    row = np.repeat(np.arange(n), count)
    v[row, col] |= high << bits[row].astype(np.uint32)
    return (v + low[:, None]).ravel()


def block_at(data: bytes, segment: int, k: int, packed: int, exception: int) -> np.ndarray:
    """One block by the index alone: block ``k`` of the segment at ``segment``."""
    (n,) = struct.unpack_from("<I", data, segment)
    base = segment + 4
    low = struct.unpack_from("<I", data, base + 4 * k)[0]
    w = data[base + 4 * n + k]
    bits = np.frombuffer(data, np.uint8, n, base + 4 * n).astype(np.int64)
    counts = np.frombuffer(data, "<u2", n, base + 5 * n).astype(np.int64)
    body = base + 7 * n
    v = np.zeros(BLOCK, np.uint32)
    for b in range(w):
        v |= np.unpackbits(np.frombuffer(data, np.uint8, BLOCK // 8, body + packed + b * BLOCK // 8)).astype(np.uint32) << np.uint32(b)
    lists = body + int(bits.sum()) * (BLOCK // 8)
    m = int(counts.sum())
    col = np.frombuffer(data, np.uint8, int(counts[k]), lists + exception)
    v[col] |= np.frombuffer(data, "<u4", int(counts[k]), lists + m + 4 * exception) << np.uint32(w)
    return v + np.uint32(low)


class ShardWriter:
    """Buffers one segment of ids at a time."""

    def __init__(self, folder: str, name: str, percentile: int = PERCENTILE):
        self.out, self.percentile = Publisher(folder, name), percentile
        self.out.write(MAGIC)
        self.held, self.n_held, self.blocks, self.ids = [], 0, 0, 0
        self.segments, self.places, self.odd, self.docs = [], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.ids += len(ids)
        if self.n_held >= SEGMENT * BLOCK:
            every = np.concatenate(self.held)
            full = len(every) // (SEGMENT * BLOCK) * (SEGMENT * BLOCK)
            for at in range(0, full, SEGMENT * BLOCK):
                self.flush(every[at : at + SEGMENT * BLOCK])
            self.held, self.n_held = [every[full:]], len(every) - full

    def flush(self, values: np.ndarray) -> None:
        data, places, odd = pack(values, self.percentile)
        self.segments.append((self.out.size, self.blocks))
        self.places.append(places)
        self.odd.append(odd)
        self.blocks += len(places)
        self.out.write(data)

    def commit(self) -> None:
        if self.n_held:
            self.flush(np.concatenate(self.held))
        at = self.out.size
        ids = np.array([0 if d is None else d for d, _ in self.docs], "<i8")
        none = np.array([d is None for d, _ in self.docs], np.uint8)
        counts = np.array([c for _, c in self.docs], "<u8")
        offsets, first = (np.array([s[k] for s in self.segments], "<u8") for k in (0, 1))
        for part in (offsets, first, *self.places, *self.odd, ids, none, counts):
            self.out.write(part.tobytes())
        self.out.write(struct.pack("<IIQQQ", len(self.segments), self.blocks, len(self.docs), self.ids, at) + MAGIC)
        self.out.commit()


def footer(data: bytes) -> dict:
    if data[:4] != MAGIC or data[-4:] != MAGIC:
        raise ValueError("not a whole token file")
    segments, blocks, docs, ids, at = struct.unpack("<IIQQQ", data[-36:-4])
    out: dict = {"ids": ids}
    for name, kind, n in (("offsets", "<u8", segments), ("first", "<u8", segments), ("places", "<u4", blocks), ("odd", "<u4", blocks), ("doc_id", "<i8", docs), ("none", "u1", docs), ("counts", "<u8", docs)):
        out[name] = np.frombuffer(data, kind, n, at)
        at += np.dtype(kind).itemsize * n
    return out


def documents(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of each document, one segment in memory at a time."""
    f = footer(data)
    at, left = 0, np.empty(0, np.uint32)
    todo = iter(f["offsets"].tolist())
    rest = f["ids"]
    for d, none, n in zip(f["doc_id"].tolist(), f["none"].tolist(), f["counts"].tolist()):
        parts, want = [], n
        while want > len(left) - at:
            parts.append(left[at:])
            want -= len(left) - at
            left, at = unpack(data, next(todo))[:rest], 0
            rest -= len(left)
        parts.append(left[at : at + want])
        at += want
        yield (None if none else d), (np.concatenate(parts) if len(parts) > 1 else parts[0])


# --- encoding --------------------------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_PACKS = [struct.Struct(f"<{n}I") for n in range(64)]


class Odd(Exception):
    """A text with a border that the pattern may match across."""


class Pieces(dict):
    """Ids of pieces as bytes, a bounded table of a Python worker. A key is a word that follows a
    space, or a line break and the word after it.

    A word of letters is one match of the byte-level pattern and goes to the library's BPE model as
    it is; a tail of punctuation after it is a match of its own; any other piece is encoded by the
    whole tokenizer. A piece that is empty or ends in white space is no piece."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, _byte_letters()
        self.line, self.space, self.tails, self.older = self.whole("\n"), self.letters[32], {}, {}
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # this table is the cache

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def tail(self, text: str) -> bytes:
        if text not in self.tails and len(self.tails) < 10_000:
            self.tails[text] = self.whole(text)
        return self.tails.get(text) or self.whole(text)

    def age(self) -> None:
        """Keep what was asked for since the last time, forget what was not."""
        self.older = dict(self)
        self.clear()

    def first(self, text: str) -> bytes:
        """The piece that a text begins with: no space goes before it."""
        base = text.rstrip(".,;:!?")
        if not (base.isascii() and base.isalpha()):
            return self.whole(text)
        return self.word(base) + (self.tail(text[len(base) :]) if len(base) < len(text) else b"")

    def word(self, letters: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(letters)]
        return _PACKS[len(ids)].pack(*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[-1].isspace():
            raise Odd
        if (got := self.older.get(piece)) is not None:
            self[piece] = got
            return got
        base = piece.rstrip(".,;:!?")
        body = base[1:] if piece[0] == "\n" else base
        if body.isalpha():
            head = self.line if piece[0] == "\n" else b""
            letters = body if body.isascii() else body.encode().decode("latin-1").translate(self.letters)
            got = head + self.word(letters if head else self.space + letters)
            if len(base) < len(piece):
                got += self.tail(piece[len(base) :])
        else:
            got = self.whole(piece if piece[0] == "\n" else " " + piece)
        self[piece] = got
        return got


class Encoder:
    """Ids of whole texts by the tokenizers library, which is used as it is loaded: the string of an
    added token in a text (``<|endoftext|>``) is that token. Texts that hold such a string are encoded whole.

    The byte-level pattern never matches across a border between a character that is no white space
    and a space or line break, so a text all of whose spaces and line breaks follow such characters
    is the sum of its pieces. Pieces are encoded by the library once and kept in a bounded table;
    all other texts are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.known = Pieces(self.tokenizer)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_one(self, text: str) -> bytes:
        first, *rest = text.replace("\n", " \n").split(" ")
        if not rest or self.added.search(text):
            return self.known.whole(text)
        try:
            if not first or first[-1].isspace():
                raise Odd
            return self.known.first(first) + b"".join(map(self.known.__getitem__, rest))
        except Odd:
            return self.known.whole(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > _CACHE:
            self.known.age()
        return [self.encode_one(t) for t in texts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_MANIFEST = "shard int, file string, docs bigint, ids bigint, bytes bigint"


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, percentile: int = PERCENTILE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) to ``folder``. Returns the manifest with ``start``,
    the number of ids in all files before."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    shard, shards = range_shards(rows, "doc_id", F.col("h"), F.octet_length("text") + F.lit(1), shard_bytes, width(spark))
    ordered = rows.withColumn("shard", shard).repartitionById(shards, F.col("shard")).sortWithinPartitions("doc_id", "h", "text").drop("h")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, now, files = encoder(path), None, None, []

        def close():
            out.commit()
            files.append((now, name, len(out.docs), out.ids, out.out.size))

        for b in slices(batches):
            ids = b.column("doc_id").to_pylist()
            for i, s, blob in zip(ids, b.column("shard").to_pylist(), enc.encode(b.column("text").to_pylist())):
                if s != now:
                    if out:
                        close()
                    now, name = s, f"shard-{s:06d}.pfr"
                    out = ShardWriter(folder, name, percentile)
                out.add(i, np.append(np.frombuffer(blob, "<u4"), np.uint32(end_id)))
        if out:
            close()
        cols = list(zip(*files)) or [()] * 5
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["shard", "file", "docs", "ids", "bytes"])

    files = stage(ordered.mapInArrow(save, _MANIFEST), f"{folder}/files", narrow=True)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return stage(files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long")), f"{folder}/manifest")


def read(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned 32 bit)."""
    spark = manifest.sparkSession
    files = manifest.count()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + with_ids]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                rows: list = []
                for d, ids in documents(read_file(folder, file)):
                    raw = ids.astype("<u4").tobytes()
                    rows.append((d, start, len(ids), zlib.crc32(raw), raw)[: 4 + with_ids])
                    start += len(ids)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    out = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return manifest.select("file", "start").repartition(max(1, min(files, 4 * width(spark)))).mapInArrow(load, out)


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = work_dir(spark, "token-file")
    manifest = write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read(manifest, folder, with_ids=False)
