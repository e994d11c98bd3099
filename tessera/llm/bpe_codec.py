"""Operator 5: byte-level BPE encoding and decoding with the tiktoken library.

``encode`` turns a text column into token ids (binary, little-endian unsigned 32-bit integers) by
the ranks of a local file; ``decode`` turns such ids back into raw bytes. Both are Arrow functions,
so they chain inside one Python worker. A null text counts as empty and gives no ids. Long texts
are split where the pattern can never match across: between a character that is no white space and
a space or line break. Each piece then gives the ids that the whole would give there, and neither
the pattern matcher nor the merge works on an unbounded string. Rows are independent: ties,
repeated rows and further columns need no care, an empty table gives an empty table."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import gathered, table

PIECE = 1 << 15
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


def pieces(text: str, size: int = PIECE):
    """Cut ``text`` at the first safe boundary after each ``size`` characters."""
    at = 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: Column, path: str, pattern: str, size: int = PIECE) -> Column:
    """Token ids of each text as little-endian unsigned 32-bit integers. ``path`` is a rank file
    that every executor can open (it is installed with the tokenizer package)."""
    import numpy as np

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        enc = encoding(path, pattern)
        out = []
        for t in texts:
            parts = [enc.encode_ordinary(p) for p in pieces(t.as_py() or "", size)]
            out.append(b"".join(np.array(p, "<u4").tobytes() for p in parts))
        return pa.array(out, pa.binary())

    return ids(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The raw bytes of token ids made by ``encode``."""
    import numpy as np

    @F.arrow_udf("binary")
    def raw(blobs: pa.Array) -> pa.Array:
        enc = encoding(path, pattern)
        return pa.array([enc.decode_bytes(np.frombuffer(b.as_py() or b"", "<u4").tolist()) for b in blobs], pa.binary())

    return raw(ids)


def encode_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    coded = docs.select(F.col(key).alias("doc_id"), encode(F.col(text), path, pattern).alias("ids"))
    coded = coded.withColumn("decoded", decode(F.col("ids"), path, pattern))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    return gathered(encode_digests(docs, path, public_tokenizers.PATTERN))
