"""File sources: labelled queries, evaluation sets, agent transcripts, source code, JDBC stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: file endings with a known grammar and their language
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "php": "php", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "ipp": "cpp", "tpp": "cpp", "inl": "cpp",
    "lua": "lua", "script": "lua",
}
# fixed values: folders that are never indexed
SKIP_DIRS = ("node_modules", "vendor", ".git", "dist", "build", "coverage", ".next", "out", ".turbo", ".cache", ".vscode-test")
MAX_BYTES, SNIFF_BYTES = 1_000_000, 8000


def parse_gold(lines: DataFrame) -> DataFrame:
    """``lines`` (value) of labelled queries as JSON: query, gold, origin, malformed. A line that is no
    JSON object, or lacks a query, an answer or a known origin, is malformed and keeps its row."""
    raw = F.from_json("value", "query STRING, gold ARRAY<STRING>, origin STRING")
    rows = lines.where(F.trim("value") != "").withColumn("r", raw)
    query = F.trim(F.coalesce("r.query", F.lit("")))
    good = (query != "") & (F.coalesce(F.size("r.gold"), F.lit(0)) > 0) & F.col("r.origin").isin("generated", "adjudicated", "mined")
    return rows.select(query.alias("query"), F.col("r.gold").alias("gold"), F.col("r.origin").alias("origin"), (~F.coalesce(good, F.lit(False))).alias("malformed"))


def gold_file(spark: SparkSession, path: str) -> DataFrame:
    return parse_gold(spark.read.text(path))


def evaluation_set(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """docs, queries and edges of one JSON object in a file."""
    schema = "docs ARRAY<STRUCT<id: STRING, title: STRING, content: STRING, facet: STRING>>, queries ARRAY<STRUCT<query: STRING, relevant: ARRAY<STRING>>>, edges ARRAY<STRUCT<src: STRING, dst: STRING, type: STRING>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return {name: whole.select(F.explode(name).alias("x")).select("x.*") for name in ("docs", "queries", "edges")}


def parse_transcripts(lines: DataFrame) -> DataFrame:
    """``lines`` (value) of agent transcripts: session, step, tool, ok; other lines vanish."""
    r = F.from_json("value", "session STRING, step BIGINT, tool STRING, error STRING")
    return lines.select(r.alias("r")).where("r.session IS NOT NULL AND r.tool IS NOT NULL").select("r.session", "r.step", "r.tool", F.col("r.error").isNull().alias("ok"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    return parse_transcripts(spark.read.text(path))


def language(path: Column) -> Column:
    """Language by file ending, or null."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return table[F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))]


def indexable(path: Column) -> Column:
    """A known language, no skipped folder on the way, not generated."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    file = F.element_at(parts, -1)
    return language(path).isNotNull() & ~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIP_DIRS])) & ~file.startswith("_ide_helper")


def looks_binary(content: Column) -> Column:
    """Over a tenth of the first bytes are zero."""
    head = F.hex(F.substring(content, 1, SNIFF_BYTES))
    n = F.least(F.octet_length(content), F.lit(SNIFF_BYTES))
    zeros = F.size(F.filter(F.regexp_extract_all(head, F.lit("(..)"), F.lit(1)), lambda b: b == "00"))
    return F.when(n > 0, 10 * zeros > n).otherwise(False)


def code_files(spark: SparkSession, path: str) -> DataFrame:
    """path, lang, content of the source files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= MAX_BYTES)
    return files.where(indexable(F.col("path")) & ~looks_binary(F.col("content"))).select("path", language(F.col("path")).alias("lang"), "content")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A table of a relational store, read in parallel ranges of an integer key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions)
    return reader.options(**options).load()
