"""Operator 11: token counts of whole texts by a tokenizers or sentencepiece file.

An Arrow function returns lengths only. Texts are cut into parts of about ``PART`` bytes at safe boundaries, and
parts of all texts of an Arrow batch are dealt to batches balanced by bytes, so neither one long
text nor many of them set the memory of a worker. Within a batch equal words are encoded once.

Which boundaries are safe depends on the file. Where white space is dropped before the model sees a
text and no added token holds any (``word`` files: lower-cased words with word ends), every ASCII
white space is one: no match of the pre-tokenizer reaches across, and neither composition of marks
nor lower-casing looks beyond it. A part is then split into words and the count of a text is the sum
over its words. For other files a part ends between a character that is no white space and a space
or line break, where a byte-level pattern never matches across, and is encoded as it is; texts for a
sentencepiece model are encoded whole, as its rules may join any two characters.

A null text counts as empty: 0 bytes, 0 tokens. An added token's string in a text (``<|endoftext|>``) is that
token, the library's default. Rows are independent: ties, repeated rows, null ids and further columns
need no care; an empty table gives an empty table."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import gathered, table

PART, BATCH, LIMIT = 1 << 17, 1 << 20, 2048
#: Words of up to LONGEST bytes are remembered, in two generations of KNOWN entries a worker.
LONGEST, KNOWN = 64, 200_000
_WHITE, _BREAK = re.compile(r"[\t-\r ]"), re.compile(r"(?<=\S)(?=[ \n])")


def parts(text: str, safe: re.Pattern, size: int = PART) -> Iterator[str]:
    """Cut ``text`` at the first safe boundary after each ``size`` characters."""
    at = 0
    while len(text) - at > size and (cut := safe.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def balanced(items: Iterable[tuple[int, str]], size: int = BATCH) -> Iterator[list[tuple[int, str]]]:
    """(owner, part) in batches of about ``size`` bytes, however many rows that is."""
    batch, held = [], 0
    for owner, part in items:
        batch.append((owner, part))
        held += len(part)
        if held >= size:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


class Counter:
    """Counts tokens of many texts with one loaded file."""

    def __init__(self, path: str):
        self.by_words, self.safe = False, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        self.lengths = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            self.by_words = drops_white_space(json.load(f))
        self.safe = _WHITE if self.by_words else _BREAK
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def words(self, texts: list[str]) -> np.ndarray:
        """Counts of distinct words: from memory, or else by the library in batches balanced by bytes."""
        if len(self.known) > KNOWN:
            self.known, self.older = {}, self.known
        known, older, out, new = self.known, self.older, np.empty(len(texts), np.int64), []
        for k, w in enumerate(texts):
            n = known.get(w)
            if n is None:
                n = older.get(w)
                if n is None:
                    new.append((k, w))
                    continue
                known[w] = n
            out[k] = n
        for batch in balanced(new):
            for (k, w), n in zip(batch, self.lengths([w for _, w in batch])):
                out[k] = n
                if len(w) <= LONGEST:
                    known[w] = n
        return out

    def count(self, texts: list[str], part: int = PART, size: int = BATCH) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        cut = ((i, p) for i, t in enumerate(texts) for p in (parts(t, self.safe, part) if self.safe else (t,)))
        for batch in balanced(cut, size):
            owners = np.array([i for i, _ in batch])
            if self.by_words:
                lists = pc.ascii_split_whitespace(pa.array([p for _, p in batch], pa.large_string()))
                coded = lists.flatten().dictionary_encode()
                each = self.words(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
                sums = np.concatenate([[0], np.cumsum(each)])
                ends = lists.offsets.to_numpy()
                lengths = sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]
            else:
                lengths = np.array(self.lengths([p for _, p in batch]))
            np.add.at(total, owners, lengths)
        return total


def drops_white_space(settings: dict) -> bool:
    """Is a text of this tokenizer file the sum of its words between ASCII white space?"""
    pre = settings.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = first.get("pattern", {}).get("Regex", "")
    removed = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    # every alternative names no white space: letters, numbers, the rest without white space, contractions
    apart = removed and all(re.fullmatch(r"'[a-z]+|\[\\p\{[LN]\}\]\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+", x) for x in pattern.split("|"))
    normal = settings.get("normalizer") or {}
    steps = normal.get("normalizers") or [normal]
    local = all(s.get("type") in (None, "NFC", "Lowercase") or s.get("type") == "Replace" and s["pattern"].get("Regex") == r"\s+" and s["content"] == " " for s in steps)
    added = settings.get("added_tokens") or []
    return bool(apart and local and not any(_WHITE.search(a["content"]) or a.get("normalized") or a.get("single_word") for a in added))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", key: str = "doc_id", part: int = PART) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text. ``path`` is a tokenizer file that
    every executor can open (it is installed with the tokenizer package)."""

    @F.arrow_udf("bigint")
    def lengths(texts: pa.Array) -> pa.Array:
        return pa.array(counter(path).count(texts.to_pylist(), part), pa.int64())

    whole = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), lengths("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return gathered(token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
