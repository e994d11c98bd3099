"""Operator 9: language identification by cross-parsing entropy.

A suffix automaton of labelled running text is built for each language. A text is normalised (lower
case, runs of letters with a space between and around them, UTF-8) and parsed greedily into phrases:
the longest match with the language's text from here, wherever it begins and however many words it
spans, then the next from where that ends; a byte that the language's text does not have is a phrase
of its own. Naming a phrase costs the logarithm of the sample's size, so phrases times that is the
cross-parsing entropy of the text; the language that needs the fewest normalised phrases wins.

Texts are parsed whole, in windows of ``WINDOW`` bytes at whose ends a phrase ends too: windows are the
lanes of an array program that takes one step of all automata at a time, so the cost is linear in the
text and the same for one long text and many short ones.

Learning uses text and non-null label of rows whose crc32(doc_id) mod ``folds`` is not ``held`` (a row
without doc_id belongs to no fold and may be used). Of these, for each label, the ``docs_per_language``
with the smallest hash of doc_id and text are read, ``chars_per_document`` characters of each, up to
``bytes_per_language`` bytes, or less so that all labels together have at most SAMPLE_BYTES. Every label
is learned: of the more labels, the fewer bytes of each, from no more documents than one for each
LEAST_BYTES of these. These are the documented bounds of the sample; automata need memory in proportion.
Prediction reads the text alone. A text that is null or has no letter gives ``und`` and score 0; so
does every text where there is nothing to learn from. Ties go to the label first in code point
order. Repeated rows give repeated predictions and count once in learning; further columns are not
looked at."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import gathered, table

_LETTERS = re.compile(r"[^\W\d_]+")
WINDOW, CHUNK_BYTES, SAMPLE_BYTES, LEAST_BYTES = 512, 4 << 20, 320_000, 12
_PREPARED: dict = {}


def normalised(text: str | None) -> bytes:
    """Runs of letters in lower case with a space between and around them; empty without a letter."""
    words = _LETTERS.findall((text or "").lower())
    if not any(c.isalpha() for w in words for c in w):  # \w has fractions and the like too
        return b""
    return f" {' '.join(words)} ".encode()


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """The transitions of each state; state 0 is the root."""
    steps, link, length, last = [{}], [-1], [0], 0
    for ch in data:
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and ch not in steps[p]:
            steps[p][ch] = new
            p = link[p]
        if p >= 0:
            q = steps[p][ch]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and steps[p].get(ch) == q:
                    steps[p][ch] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return steps


class Automaton:
    """A suffix automaton as arrays. Only states with several ways on, fewer than there are bytes in the
    sample, are rows over the sample's own classes of bytes; any other state keeps its one byte and one
    successor. A cell holds where the next state begins, with the number of phrases that end on the way
    in the two lowest bits: a phrase ends where there is no way on, and the byte begins the next one
    or is one."""

    def __init__(self, data: bytes):
        steps = suffix_automaton(data)
        known = sorted(set(data))
        self.classes = len(known) + 1  # the last one is that of bytes which the sample does not have
        self.code = np.full(256, len(known), np.int32)
        self.code[known] = np.arange(len(known))
        wide = np.fromiter((len(x) > 1 for x in steps), bool, len(steps))
        wide[0] = True
        self.rows = int(wide.sum()) * self.classes  # where single states begin
        place = np.where(wide, (np.cumsum(wide) - 1) * self.classes, self.rows + np.cumsum(~wide) - 1)
        at = place.tolist()
        self.again = np.full(self.classes, 1, np.int32)  # from the root, where an unknown byte is a phrase
        for ch, t in steps[0].items():
            self.again[self.code[ch]] = at[t] * 4
        cells = np.empty((self.rows // self.classes, self.classes), np.int32)
        cells[:] = self.again + 1
        cells[0] = self.again
        singles = np.zeros(len(steps) - len(cells), np.int32)
        self.byte = np.full(len(singles), -1, np.int32)
        for s, step in enumerate(steps):
            for ch, t in step.items():
                if wide[s]:
                    cells[at[s] // self.classes, self.code[ch]] = at[t] * 4
                else:
                    self.byte[at[s] - self.rows], singles[at[s] - self.rows] = self.code[ch], at[t] * 4
        self.cells = np.concatenate([cells.ravel(), singles])

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The cells that the classes ``byte`` lead to from ``state``."""
        single = state >= self.rows
        got = self.cells.take(np.where(single, state, state + byte))
        rare = np.flatnonzero(single)
        rare = rare[self.byte.take(state[rare] - self.rows) != byte[rare]]
        got[rare] = self.again.take(byte[rare]) + 1
        return got

    @property
    def nbytes(self) -> int:
        return self.cells.nbytes + self.byte.nbytes + self.again.nbytes + self.code.nbytes


class Model:
    """The automata of all labels."""

    def __init__(self, samples: dict[str, bytes]):
        self.labels = sorted(samples)
        self.cost = [math.log2(max(2, len(samples[k]))) for k in self.labels]
        self.automata = [Automaton(samples[k]) for k in self.labels]

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each normalised text in each language."""
        out = np.zeros((len(texts), len(self.labels)), np.int64)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK_BYTES):
                size += len(texts[end])
                end += 1
            if end == at + 1 and size > CHUNK_BYTES:  # one very long text, by parts of whole windows
                for k in range(0, size, CHUNK_BYTES):
                    out[at] += self._chunk([texts[at][k : k + CHUNK_BYTES]])[0]
            else:
                out[at:end] = self._chunk(texts[at:end])
            at = end
        return out

    def _chunk(self, texts: list[bytes]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts], np.int64)
        lanes = -(-sizes // WINDOW)
        n = int(lanes.sum())
        out = np.zeros((len(texts), len(self.labels)), np.int64)
        if not n:
            return out
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(n) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = np.repeat(np.cumsum(sizes) - sizes, lanes) + nth * WINDOW
        length = np.minimum(WINDOW, sizes[owner] - nth * WINDOW)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        flat = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
        steps = int(length[0])
        grid = np.ascontiguousarray(flat[start[:, None] + np.arange(steps)].T)
        active = np.searchsorted(-length, -np.arange(steps), "left")  # lanes that are longer than each step
        for k, automaton in enumerate(self.automata):
            state, count = np.zeros(n, np.int32), np.zeros(n, np.int32)
            for step in range(steps):
                m = active[step]
                got = automaton.step(state[:m], automaton.code.take(grid[step, :m]))
                count[:m] += got & 3
                np.right_shift(got, 2, out=state[:m])
            count += state > 0
            out[:, k] = np.bincount(owner, count, len(texts)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Label, score and the winner's phrases per byte for each text."""
        if not self.labels:
            return [("und", 0.0, 0.0)] * len(texts)
        body = [normalised(t) for t in texts]
        found = []
        for t, row in zip(body, self.phrases(body).tolist()):
            if not t:
                found.append(("und", 0.0, 0.0))
                continue
            bits = [n * c for n, c in zip(row, self.cost)]
            best = min(range(len(bits)), key=bits.__getitem__)
            spread = sum(2.0 ** -min(60.0, b - bits[best]) for b in bits)
            found.append((self.labels[best], 1.0 / spread, row[best] / len(t)))
        return found


def prepared(key: str, samples: dict[str, bytes]) -> Model:
    """One model for all tasks of a Python worker; ``key`` is a digest of the samples."""
    if key not in _PREPARED:
        _PREPARED.clear()
        _PREPARED[key] = Model(samples)
    return _PREPARED[key]


def held_out(key: Column, folds: int = 4, held: int = 2) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == held, F.lit(False))


def learn(
    docs: DataFrame, docs_per_language: int = 400, chars_per_document: int = 1_000, bytes_per_language: int = 40_000, folds: int = 4, held: int = 2
) -> dict[str, bytes]:
    """Normalised text of the bounded sample by label."""
    row = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string")))
    rows = docs.where(~held_out(F.col("doc_id"), folds, held) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", row.alias("row"))
    place = F.conv(F.substring("row", 1, 8), 16, 10).cast("double") / float(1 << 32)
    narrow = rows.select("lang", "row", place.alias("h"))
    # only hashes low enough to hold the sample four times over are ranked, so that a label which most
    # rows bear sends no more of them to its task than any other; equal rows are one
    limits = narrow.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a label
    if not limits:
        return {}
    room = max(1, min(bytes_per_language, SAMPLE_BYTES // len(limits)))
    docs_per_language = min(docs_per_language, -(-room // LEAST_BYTES))
    few = [(r.lang, 4.0 * docs_per_language / r.n) for r in limits]
    limits = F.broadcast(docs.sparkSession.createDataFrame(few, "lang string, limit double"))
    near = narrow.join(limits, "lang").where("h <= limit").select("lang", "row").distinct()
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("row")))
    chosen = ranked.where(F.col("n") <= docs_per_language).select("lang", "row")
    # SAMPLE_BYTES / LEAST_BYTES short rows are broadcast, and one more for each label, or fewer
    sample = rows.join(F.broadcast(chosen), ["lang", "row"]).select("lang", "row", F.substring("text", 1, chars_per_document).alias("text")).distinct()
    out: dict[str, bytes] = {}
    for r in sample.orderBy("lang", "row").toLocalIterator():
        if len(out.get(r.lang, b"")) < room and (t := normalised(r.text)):
            out[r.lang] = (out.get(r.lang, b"") + t)[:room]
    return out


def predict(docs: DataFrame, samples: dict[str, bytes], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and lang_pred, score, phrase_rate for every row."""
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    model = docs.sparkSession.sparkContext.broadcast(samples)  # SAMPLE_BYTES at most

    @F.arrow_udf("lang_pred string, score double, phrase_rate double")
    def label(texts: pa.Array) -> pa.Array:
        m, found = prepared(key, model.value), []
        for at in range(0, len(texts), 512):
            found += m.predict(texts.slice(at, 512).to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())],
            ["lang_pred", "score", "phrase_rate"],
        )

    # said to be nondeterministic so that a filter on the answer does not evaluate it a second time
    label = label.asNondeterministic()
    return docs.select(*keep, label(F.col("text")).alias("p")).select(*keep, "p.lang_pred", "p.score", "p.phrase_rate")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs))
    return gathered(found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))
