"""Sections of notes by heading path: splitting, outlines, and narrowing to named sections, by built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREAMBLE = "(preamble)"


def _numbered(docs: DataFrame, key: str, content: str) -> DataFrame:
    """key, at, line, level, seq: lines with the level of those that are headings, and the number of headings so far."""
    lines = docs.select(key, F.posexplode(F.split(F.col(content), "\n")).alias("at", "line"))
    so_far = Window.partitionBy(key).orderBy("at")
    fenced = F.sum(F.startswith("line", F.lit("```")).cast("int")).over(so_far) % 2 == 1
    level = F.when(~fenced & F.col("line").rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract("line", "^(#+)", 1)))
    return lines.withColumn("level", level).withColumn("seq", F.count("level").over(so_far))


def _texts(lines: DataFrame, key: str) -> DataFrame:
    texts = lines.groupBy(key, "seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda z: z["line"]), "\n").alias("text"))
    return texts.where(~F.col("text").rlike(r"^\s*\z"))


def stretches(docs: DataFrame, key: str, content: str) -> DataFrame:
    """key, parts: the stretches of each note as an array of (seq, text). Where the notes are dealt by their key, no line is shuffled."""
    texts = _texts(_numbered(docs, key, content), key)
    return texts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("seq").cast("int").alias("seq"), "text"))).alias("parts"))


def split(docs: DataFrame, key: str, content: str) -> DataFrame:
    """key, seq, section, text: the stretches of each note between headings, with the path of headings above
    them, ``H1: A > H2: B``, null before the first. A heading ends its siblings and all below them; lines in fenced code are
    no headings. A stretch keeps its heading line; stretches without text are dropped. A null note has none."""
    lines = _numbered(docs, key, content)
    name = F.concat(F.lit("H"), F.col("level").cast("string"), F.lit(": "), F.regexp_extract("line", r"^#+\s+(.*\S)", 1))
    heads = lines.where("level IS NOT NULL").select(key, "seq", "level", name.alias("name"))
    w = Window.partitionBy(key).orderBy("seq")

    def above(k: int) -> Column:
        """The name of the heading of level k over this one, if none of a higher level came between."""
        last = F.max(F.when(F.col("level") <= k, F.col("seq"))).over(w)
        own = F.max(F.when(F.col("level") == k, F.struct("seq", "name"))).over(w)
        return F.when((F.col("level") > k) & (own["seq"] == last), own["name"])

    path = F.array_join(F.array_compact(F.array(*map(above, range(1, 6)), F.col("name"))), " > ")
    paths = heads.select(key, "seq", path.alias("section"))
    return _texts(lines, key).join(paths, [key, "seq"], "left").select(key, F.col("seq").cast("int").alias("seq"), "section", "text")


def section_name(section: Column) -> Column:
    return F.coalesce(section, F.lit(PREAMBLE))


def matches(section: Column, request: Column) -> Column:
    """Does a request mean this section: its whole path, or any heading of it, so that a heading brings what is below it?"""
    return (section_name(section) == request) | F.array_contains(F.split(section_name(section), " > ", -1), request)


def outline(chunks: DataFrame, key: str) -> DataFrame:
    """key, place, section, chars: the sections of each note in the order in which they are first seen."""
    sizes = chunks.groupBy(key, section_name(F.col("section")).alias("section")).agg(F.min("seq").alias("first"), F.sum(F.length("text")).alias("chars"))
    return sizes.select(key, F.row_number().over(Window.partitionBy(key).orderBy("first")).alias("place"), "section", "chars")


def narrow(requests: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """key, text, matched, missing, error of each note that ``requests`` (key, section) asks for: the texts of the sections that
    any request means, in order, or an error that names what is missing and what there is."""
    asked = requests.select(key, F.col("section").alias("request")).distinct()
    hits = asked.join(chunks, key).where(matches(F.col("section"), F.col("request")))
    texts = hits.select(key, "seq", "text").distinct().groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda z: z["text"]), "\n\n").alias("text"))
    found = hits.select(key, "request").distinct().withColumn("found", F.lit(True))
    split_ = asked.join(found, [key, "request"], "left").groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("found"), F.col("request")))).alias("matched"), F.sort_array(F.collect_list(F.when(F.col("found").isNull(), F.col("request")))).alias("missing")
    )
    names = outline(chunks, key).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "section"))), lambda z: z["section"]), ", ").alias("names"))
    rows = split_.join(texts, key, "left").join(names, key, "left")
    has = F.coalesce(F.concat(F.lit("it has: "), "names"), F.lit("it has no headings"))
    error = F.when(F.size("missing") > 0, F.concat(F.lit("no section named "), F.array_join("missing", ", "), F.lit("; "), has))
    return rows.select(key, F.when(error.isNull(), F.coalesce("text", F.lit(""))).alias("text"), "matched", "missing", error.alias("error"))
