"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one a row of
digests for each placement; the output of each is written as Parquet and read as the next one's
docs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_codec, exact_dedup, language_id, mixing, ngram_join
from tessera.llm._shared import gathered, in_files, released, remove, stage, table, work_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language needs more phrases a byte than this is in none of the languages.
MOST_PHRASES = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay, with ``lang`` as predicted where it was null."""
    found = language_id.predict(docs, language_id.learn(docs), tuple(COLUMNS))
    known = found.where((F.col("lang_pred") != "und") & (F.col("phrase_rate") <= MOST_PHRASES))
    return in_files(known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS), docs)


def one_each(docs: DataFrame, chosen: DataFrame, key: Column, folder: str) -> DataFrame:
    """A row of ``docs`` for each distinct (d, k) of ``chosen``, d being a doc_id, null included, and k
    its ``key``. Of rows that share both, the first by source, lang, n_chars and text stays, once."""
    counted = stage(chosen.groupBy("d", "k").agg(F.count("*").alias("n")), folder, narrow=True)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (key == F.col("k"))
    once = docs.select(*COLUMNS).join(counted.where("n = 1"), same, "left_semi")
    more = counted.where("n > 1")
    if more.isEmpty():
        return once
    first = F.min(F.struct("source", "lang", "n_chars", "text")).alias("row")
    rows = docs.select(*COLUMNS).join(more, same, "left_semi").groupBy("doc_id", key.alias("k")).agg(first)
    return once.unionByName(rows.select("doc_id", "row.*").select(*COLUMNS))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest doc_id stays, or one without if none has any."""
    marked = exact_dedup.exact_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    chosen = marked.select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("k"))
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return in_files(one_each(docs, chosen, sha, work_dir(spark, "drop-copies")), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-gram similarity the one with the smallest doc_id stays."""
    stays = ngram_join.near_duplicates(docs).where("stays").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
    return in_files(one_each(docs, stays, F.xxhash64("text"), work_dir(spark, "drop-near-copies")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of whole documents: each as often as it is placed, in the order of shards and turns."""
    key = F.xxhash64("text")
    placements, _ = mixing.mix(docs.select("doc_id", "source", "text", key.alias("text_key")), whole=True, carry=("text_key",))
    placed = placements.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("source").alias("s"), "shard", "turn", "pass")
    placed = stage(placed, work_dir(spark, "placed"), narrow=True)
    shards = 1 + (placed.agg(F.max("shard")).first()[0] or 0)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (key == F.col("k")) & F.col("source").eqNullSafe(F.col("s"))
    rows = docs.select(*COLUMNS).join(placed, same)
    # a partition, and so a file, for each shard, in its order of turns
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("turn").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every placed document, with the digests of ids and decoded bytes."""
    import public_tokenizers

    coded = bpe_codec.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return gathered(coded)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe_encode", encode),
]

#: Banding, hypergeometric draws and byte-pair merges have no SQL form; tests/llm compares the stages
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, before = work_dir(spark, "pipeline"), None
    for k, (name, step) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with released(spark):  # what a stage has written for itself is not needed after its output
            docs = stage(step(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return docs
