"""Operator 7: deterministic sharded WARC writer, and its reader.

Records are range-sorted by id: shards are ranges of (id, payload hash) of about equal bytes, the same in
each run (``range_shards``). One task writes one shard: each record is a gzip member of its own with
regenerated headers (type, id, target, digests, length), and the file is rolled before a record that
would take its compressed size over ``roll_bytes``. Files are written under temporary names and
moved; the manifest (file, records, bytes, SHA-256) is written last and names what is committed, so
a lost or repeated task changes nothing.

Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is the
response, the others are revisits that refer to it and carry no payload; smaller ones are all
responses. Payload is the html in UTF-8, null counts as empty. Where rows repeat a page_id with an
equal payload, the first written is the response and the rest revisit it. A null page_id is written
first, under ``<urn:page:null>``; such a record revisits whenever its payload has a page_id
elsewhere. A null url gives no target header; control characters in urls are percent-encoded. An
empty table gives an empty manifest."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Publisher, range_shards, read_file, slices, stage, table, width, work_dir

LEAST, ROLL_BYTES, SHARD_BYTES, DATE = 100, 64 << 20, 256 << 20, "2000-01-01T00:00:00Z"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(5, zlib.DEFLATED, 31)  # no time stamp: equal records give equal bytes
    return c.compress(data) + c.flush()


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record, uncompressed."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    lines += [
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(data: bytes, step: int = 1 << 15) -> Iterator[bytes]:
    """The gzip members of a file, one after another; what is fed past a member's end is a step at most."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            part = view[at : at + step]
            if not part:
                raise ValueError("the file ends within a record")
            out.append(d.decompress(part))
            at += len(part) - len(d.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of one record; checks its length and block digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


_MANIFEST = "shard int, part int, file string, records bigint, bytes bigint, sha256 string"


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, least: int = LEAST) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html) to ``folder``; returns the manifest."""
    spark = pages.sparkSession
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html")).withColumn("h", F.xxhash64("html"))
    size = F.octet_length("html").cast("long")
    # narrow rows decide what is a revisit; the payloads are shuffled once, to be sorted, and what was
    # decided meets them in the sort: a mark stands before the records of its page
    digests = rows.where(F.octet_length("html") >= least).select("page_id", F.sha2("html", 256).alias("digest"), "h")
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    marks = digests.join(firsts, "digest").where("first IS NOT NULL AND NOT first <=> page_id").select("page_id", "digest", "first", "h").distinct()
    shard, shards = range_shards(rows, "page_id", F.col("h"), size + 300, shard_bytes, width(spark))
    records = rows.select("page_id", "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("bigint").alias("first"), F.lit(1).alias("turn"), "h")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("url", "html")]
    both = records.unionByName(marks.select("page_id", *nothing, "digest", "first", F.lit(0).alias("turn"), "h"))
    keyed = both.withColumn("shard", shard).repartitionById(shards, F.col("shard")).sortWithinPartitions("page_id", "h", "turn", "url")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, n, sha, files, shard_no, page = None, 0, 0, None, [], None, object()
        known: dict = {}  # of the page: digest to the page of the response
        seen: set = set()  # digests that the page has written

        def close():
            out.commit()
            files.append((shard_no, part, name, n, out.size, sha.hexdigest()))

        for b in slices(batches):
            for i, url, html, digest, first, s in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first", "shard"))):
                if i != page:
                    page = i
                    known.clear()
                    seen.clear()
                if html is None:
                    known[digest] = first
                    continue
                payload = html.encode()
                digest = hashlib.sha256(payload).hexdigest()
                first = known.get(digest, i if digest in seen and i is not None else None)
                if len(payload) >= least:
                    seen.add(digest)
                data = _gzip(record(i, url, payload, first, first is not None))
                if out and (out.size + len(data) > roll_bytes or s != shard_no):
                    close()
                    part, out = (part + 1, None) if s == shard_no else (0, None)
                if out is None:
                    shard_no, n, sha = s, 0, hashlib.sha256()
                    name = f"shard-{s:06d}-{part:04d}.warc.gz"
                    out = Publisher(folder, name)
                out.write(data)
                sha.update(data)
                n += 1
        if out:
            close()
        cols = list(zip(*files)) or [()] * 6
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["shard", "part", "file", "records", "bytes", "sha256"])

    cols = keyed.select("page_id", "url", "html", "digest", "first", "shard")
    return stage(cols.mapInArrow(archive, _MANIFEST), f"{folder}/manifest", narrow=True)


_RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string"


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the committed files, checked against manifest and digests."""
    spark = manifest.sparkSession
    files = manifest.count()

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x in (None, "<urn:page:null>") else int(x[10:-1])
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in _RECORD.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for file, sha in zip(b.column("file").to_pylist(), b.column("sha256").to_pylist()):
                data = read_file(folder, file)
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{file} is not the file of the manifest")
                rows: list = []
                for raw in members(data):
                    h, http, payload = parse(raw)
                    found = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    if h["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != found:
                        raise ValueError(f"damaged payload {h['WARC-Record-ID']}")
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    text = payload.decode() if payloads and h["WARC-Type"] == "response" else None
                    rows.append((number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), length, found, h["WARC-Type"], number(h.get("WARC-Refers-To")), text))
                    if len(rows) == 512:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return manifest.select("file", "sha256").repartition(max(1, min(files, 4 * width(spark)))).mapInArrow(load, _RECORD)


def op7_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "warc")
    manifest = write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, strlen(h) AS payload_bytes, min(page_id) OVER (PARTITION BY payload_digest) AS low, row_number() OVER (PARTITION BY payload_digest, page_id) AS nth FROM p),
r AS (SELECT *, payload_bytes >= 100 AND low IS NOT NULL AND (page_id IS DISTINCT FROM low OR nth > 1) AS again FROM q)
SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes, payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN low END AS refers_to
FROM r
"""
