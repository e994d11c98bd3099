"""Text functions and full-text search: parsing, postings, BM25, phrases, links, citations, lint."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settle

#: Words that have a code, and rows that they are chosen from (about).
CODES, CODE_SAMPLE = 1 << 16, 20_000
TOKEN = r"[\p{L}\p{N}_]+"
SUMMARY_CHARS = 160
# fixed values: names that stand for a link in prose about links
PLACEHOLDERS = ("id", "ids", "ulid", "node", "node-id", "name", "title", "slug", "link", "links", "wikilink", "wikilinks", "target", "x", "y", "foo", "bar")
# fixed values: openers that lean on another sentence, and dates relative to the day of writing
DANGLING = r"(?iu)^(this|that|it|these|those|they|see|above|below|here|это|этот|эта|он|она|оно|они|см\.?)(?!\p{L})"
RELATIVE_DATE = r"(?iu)(?<!\p{L})(today|yesterday|tomorrow|tonight|this week|last week|next week|сегодня|вчера|завтра|позавчера|на этой неделе|на прошлой неделе)(?!\p{L})"


# --- scalar functions


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def stem(word: Column) -> Column:
    """A word without the commonest English endings, so that plurals and verb forms meet."""
    w = F.regexp_replace(F.regexp_replace(word, "sses$", "ss"), "ies$", "i")
    w = F.regexp_replace(F.regexp_replace(w, "([^su])s$", "$1"), "([aeiouy][a-z]*[^aeiou])(?:ing|ed)$", "$1")
    return F.when((F.length(word) <= 3) | ~word.rlike("(?:s|ing|ed)$"), word).otherwise(w)


def stem_of(word: str) -> str:
    """``stem`` for tasks that have their words in Python."""
    if len(word) <= 3 or not word.endswith(("s", "ing", "ed")):
        return word
    w = re.sub("ies$", "i", re.sub("sses$", "ss", word))
    return re.sub("([aeiouy][a-z]*[^aeiou])(?:ing|ed)$", r"\1", re.sub("([^su])s$", r"\1", w))


def derive_summary(content: Column) -> Column:
    """The first line that is neither blank nor a heading, cut at 160 characters."""
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    line = F.coalesce(F.get(lines, 0), F.lit(""))
    return F.when(F.length(line) > SUMMARY_CHARS, F.concat(F.rtrim(F.substring(line, 1, SUMMARY_CHARS)), F.lit("…"))).otherwise(line)


def summary_is_redundant(summary: Column, chunk: Column) -> Column:
    """The shorter of the two, without its ellipsis, starts the longer."""
    first = F.length(summary) <= F.length(chunk)
    short, long = F.when(first, summary).otherwise(chunk), F.when(first, chunk).otherwise(summary)
    return (short != "") & long.startswith(F.regexp_replace(short, "…$", ""))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("bigint")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    pair = lambda u: F.array(F.lit(0xD800) + F.shiftright(u - 0x10000, 10), F.lit(0xDC00) + (u - 0x10000).bitwiseAND(F.lit(0x3FF)))
    units = F.flatten(F.transform(points, lambda u: F.when(u < 0x10000, F.array(u)).otherwise(pair(u))))
    return F.aggregate(units, F.lit(0x811C9DC5).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))


def slugify(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def id_target(slug: Column) -> Column:
    return F.when(slug.rlike("^[0-7][0-9a-hjkmnp-tv-z]{25}$"), F.upper(slug))


def without_code(content: Column) -> Column:
    """Text without fenced blocks and inline code spans."""
    return F.regexp_replace(content, r"```[\s\S]*?(?:```|$)|`[^`\n]*`", " ")


def normalize_query(q: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(q)), r"\s+", " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 when either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def coverage(reference: Column, other: Column) -> Column:
    """Share of the reference set that the other has; 1 for an empty reference."""
    r = F.array_distinct(reference)
    return F.when(F.size(r) == 0, 1.0).otherwise(F.size(F.array_intersect(r, other)) / F.size(r))


def shared_jaccard(n: Column, m: Column, both: Column) -> Column:
    """``jaccard`` from the sizes of two sets and of what they share."""
    return F.when((n == 0) | (m == 0), 0.0).otherwise(both / (n + m - both))


def shared_coverage(n: Column, both: Column) -> Column:
    """``coverage`` from the size of the reference set and of what the other has of it."""
    return F.when(n == 0, 1.0).otherwise(both / n)


def coded(sets: DataFrame, key: str, words: str) -> DataFrame:
    """key, n, codes, rest of ``sets`` (key, distinct ``words``): how many words, the commonest as small numbers, the others as
    they are. It is for sets that are sent once for each edge. The words with a code are the commonest of a sample of
    about ``CODE_SAMPLE`` rows by the hash of their keys; which they are changes the size of a row and no result."""
    every = max(1, -(-sets.count() // CODE_SAMPLE))
    sample = sets.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(F.explode(words).alias("word")).groupBy("word").count()
    common = [r.word for r in sample.orderBy(F.desc("count"), "word").limit(CODES).collect()]  # CODES words at most
    held = sets.sparkSession.sparkContext.broadcast(pa.array(common, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, size = b.column(1).flatten(), np.diff(b.column(1).offsets.to_numpy())
            code = pc.index_in(flat, held.value)
            row, known = np.repeat(np.arange(len(size)), size), np.asarray(code.is_valid())
            none = b.column(1).is_null()
            ends = lambda own: pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[own], minlength=len(size)))]).astype(np.int32))
            lists = lambda own, values: pa.ListArray.from_arrays(ends(own), values, mask=none)
            codes = pa.array((np.asarray(code.drop_null(), np.int64) - CODES // 2).astype(np.int16))
            rest = flat.filter(pa.array(~known))
            n = pa.array(size.astype(np.int32), mask=np.asarray(none))
            yield pa.RecordBatch.from_arrays([b.column(0), n, lists(known, codes), lists(~known, rest)], names=[key, "n", "codes", "rest"])

    return settle(sets.select(key, words).mapInArrow(run, f"{key} {dict(sets.dtypes)[key]}, n int, codes array<smallint>, rest array<string>"))


def met(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """``edges`` (src, dst) with the numbers of words at both ends, ``n_src`` and ``n_dst``, and of those they share, ``both``; ``sets``
    are ``coded``, by node_id, and what else they have comes along like ``n``."""
    end = lambda e: sets.select(F.col("node_id").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in sets.columns if c != "node_id"])
    rows = edges.join(end("src"), "src").join(end("dst"), "dst")
    both = F.size(F.array_intersect("codes_src", "codes_dst")) + F.size(F.array_intersect("rest_src", "rest_dst"))
    return rows.withColumn("both", both).drop("codes_src", "codes_dst", "rest_src", "rest_dst")


def normalize_remote(url: Column) -> Column:
    """host/owner/repo in lower case from a scheme or scp-like address."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[a-z+]+://", ""), r"^[^@/]+@", "")
    plain = F.regexp_replace(plain, r"^([^/:]+):(?:\d+/)?", "$1/")
    return F.lower(F.regexp_replace(F.regexp_replace(plain, r"/+$", ""), r"\.git$", ""))


def member_hash(kind: Column, members: Column) -> Column:
    """Identity of a candidate: its kind and members in any order."""
    return F.substring(F.sha2(F.concat_ws("\x00", kind, F.array_sort(members)), 256), 1, 24)


def age_bucket(days: Column) -> Column:
    return F.when(days < 7, "<7d").when(days < 30, "7-30d").when(days < 90, "30-90d").otherwise(">90d")


# --- queries


def query_terms(queries: DataFrame, key: str, raw: str) -> DataFrame:
    """key, pos, term and words: quoted phrases first, then single words; nothing for empty queries."""
    words = lambda c: F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    phrases = F.filter(F.transform(F.regexp_extract_all(F.col(raw), F.lit('"([^"]+)"'), F.lit(1)), words), lambda p: F.size(p) > 0)
    bare = F.transform(words(F.regexp_replace(F.col(raw), '"[^"]+"', " ")), lambda w: F.array(w))
    return queries.select(key, F.posexplode(F.concat(phrases, bare)).alias("pos", "words")).select(key, "pos", F.array_join("words", " ").alias("term"), F.size("words").alias("words"))


# --- postings and ranking


def postings(docs: DataFrame, key: str, *fields: str) -> DataFrame:
    """key, field, stemmed term, tf, dl (length of the field)."""
    out = None
    for f in fields:
        t = docs.select(key, F.lit(f).alias("field"), tokens(F.col(f)).alias("t")).withColumn("dl", F.size("t"))
        t = t.select(key, "field", "dl", F.explode("t").alias("word"))
        out = t if out is None else out.unionByName(t)
    words = out.groupBy(key, "field", "word", "dl").agg(F.count("*").alias("tf"))
    return words.groupBy(key, "field", stem(F.col("word")).alias("term"), "dl").agg(F.sum("tf").alias("tf"))


def field_stats(docs: DataFrame, *fields: str) -> DataFrame:
    """field, n documents, average length: over all documents of the index, empty fields included."""
    sizes = docs.select(*[F.size(tokens(F.col(f))).alias(f) for f in fields])
    row = sizes.agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in fields])
    return row.select("n", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", "avgdl"))


def bm25(queries: DataFrame, docs: DataFrame, key: str, fields: tuple[str, ...] = ("title", "body"), k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, key, score of OR-ed terms (query_id, term), summed over fields.

    Postings are cut to the terms that are asked for before anything is joined to them; frequencies
    of documents come from those postings, lengths ride along, so one shuffle by term is enough."""
    posted = postings(docs, key, *fields)
    asked = queries.select("query_id", stem(F.col("term")).alias("term")).distinct()
    hits = posted.join(asked.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    # one row for each field
    stats = F.broadcast(field_stats(docs, *fields))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.join(df, ["field", "term"]).join(stats, "field").select(key, "term", weight.alias("w"))
    return scored.join(asked, "term").groupBy("query_id", key).agg(F.round(F.sum("w"), 6).alias("score"))


def top_k(scored: DataFrame, k: int, key: str, by: str = "score") -> DataFrame:
    """The k best of each query with 1-based rank; ties by key."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def phrase_hits(docs: DataFrame, key: str, field: str, phrases: DataFrame) -> DataFrame:
    """Documents that hold a phrase (phrase_id, phrase) as consecutive tokens: those that hold its first
    three (or all, if it has fewer), met by equality of shingles, and then the whole of it. A phrase without a token is in none."""
    asked = phrases.select("phrase_id", tokens(F.col("phrase")).alias("p")).where(F.size("p") > 0)
    asked = asked.select("phrase_id", F.array_join("p", " ").alias("whole"), F.array_join(F.slice("p", 1, 3), " ").alias("shingle"))
    t = docs.select(key, tokens(F.col(field)).alias("t"))
    starts = lambda n: f"transform(sequence(1, size(t) - {n - 1}), i -> array_join(slice(t, i, {n}), ' '))"
    lengths = [r[0] for r in phrases.select(F.least(F.size(tokens(F.col("phrase"))), F.lit(3))).distinct().collect() if r[0]]  # three at most
    every = F.array_distinct(F.flatten(F.array(*[F.when(F.size("t") >= n, F.expr(starts(n))).otherwise(F.array().cast("array<string>")) for n in lengths or [1]])))
    near = t.select(key, F.explode(every).alias("shingle")).join(asked, "shingle").select("phrase_id", "whole", key)
    lines = t.select(key, F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")).alias("line"))
    hold = F.contains("line", F.concat(F.lit(" "), F.col("whole"), F.lit(" ")))
    return near.join(lines, key).where(hold).select("phrase_id", key).distinct()


# --- links and citations


def wikilinks(docs: DataFrame, key: str, content: str) -> DataFrame:
    """key, pos, raw, slug of each distinct link target, by its first appearance."""
    found = docs.select(key, F.posexplode(F.regexp_extract_all(without_code(F.col(content)), F.lit(r"\[\[([^\]|#]+)"), F.lit(1))).alias("pos", "raw"))
    found = found.withColumn("raw", F.trim("raw")).withColumn("slug", slugify(F.col("raw")))
    good = (F.length("slug") >= 2) & ~F.col("slug").isin(*PLACEHOLDERS) & ~F.col("raw").rlike(r"[<>…]|\.\.\.")
    first = Window.partitionBy(key, "slug").orderBy("pos")
    return found.where(good).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def resolve_slugs(links: DataFrame, titles: DataFrame) -> DataFrame:
    """``links`` (slug) against ``titles`` (id, title): slug, kind, target (null unless unique), n.

    A whole title wins; a link with a hyphen may also be the start of exactly one title, cut at a
    hyphen. Prefixes are exploded from the titles and met by equality."""
    asked = links.select("slug").distinct()
    known = titles.select("id", slugify(F.col("title")).alias("title_slug")).where("title_slug <> ''").distinct()
    exact = asked.join(known, F.col("slug") == F.col("title_slug")).groupBy("slug").agg(F.count("*").alias("n_exact"), F.min("id").alias("exact"))
    cuts = F.expr("transform(sequence(1, size(w) - 1), i -> array_join(slice(w, 1, i), '-'))")
    starts = known.withColumn("w", F.split("title_slug", "-")).where("size(w) > 2").select("id", "title_slug", F.explode(cuts).alias("slug")).where("contains(slug, '-')")
    prefix = starts.join(asked, "slug", "left_semi").groupBy("slug").agg(F.count("*").alias("n_prefix"), F.min("id").alias("prefix"))
    both = asked.join(exact, "slug", "left").join(prefix, "slug", "left")
    kind = (
        F.when(F.col("n_exact") == 1, "exact").when(F.col("n_exact") > 1, "ambiguous").when(F.col("n_prefix") == 1, "prefix").when(F.col("n_prefix") > 1, "ambiguous").otherwise("unknown")
    )
    target = F.when(F.col("n_exact") == 1, F.col("exact")).when(F.col("n_exact").isNull() & (F.col("n_prefix") == 1), F.col("prefix"))
    return both.select("slug", kind.alias("kind"), target.alias("target"))


def cited_symbols(docs: DataFrame, key: str, content: str) -> DataFrame:
    """key, name of each distinctive symbol name between backticks."""
    raw = docs.select(key, F.explode(F.regexp_extract_all(F.col(content), F.lit("`([^`\\n]{2,80})`"), F.lit(1))).alias("raw")).withColumn("raw", F.trim("raw"))
    tail = F.regexp_extract("raw", r"([^:]*)$", 1)
    named = raw.withColumn("name", F.regexp_extract(tail, r"^([^(]*)", 1))
    distinctive = F.col("name").rlike("[a-z0-9][A-Z]") | F.contains("name", F.lit("_")) | F.col("raw").rlike("[./:]")
    return named.where(distinctive).select(key, "name").distinct()


def hop_to_symbols(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """query_id, symbol, score: the best score at which a query cites a name (query_id, name, score) that a symbol (id, name) has.

    A name may be that of many symbols. So scores are reduced to names, and to sets of names that some symbol has, before symbols
    meet them: each pair of a query and a symbol is made once, and is not shuffled where the scores fit a broadcast."""
    best = settle(hits.groupBy("query_id", "name").agg(F.max("score").alias("score")))
    cited = symbols.join(best.select("name").distinct(), "name", "left_semi")
    named = settle(cited.groupBy(F.col("id").alias("symbol")).agg(F.sort_array(F.collect_set("name")).alias("names")))
    sets = named.select("names").distinct().select("names", F.explode("names").alias("name"))
    scored = settle(sets.join(best, "name").groupBy("query_id", "names").agg(F.max("score").alias("score")))
    return named.join(scored, "names").select("query_id", "symbol", "score")


def lint(docs: DataFrame, key: str, title: str, content: str) -> DataFrame:
    """key, rule: one row for each rule that a draft breaks."""
    t, summary = F.trim(F.col(title)), derive_summary(F.col(content))
    words = F.filter(F.split(t, r"\s+"), lambda w: w.rlike(r"^\p{L}") & (F.length(w) > 3))
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    label = ~F.contains(t, F.lit(":")) & (F.size(words) >= 3) & (capital >= 0.75 * F.size(words))
    whole = F.concat(t, F.lit("\n"), F.col(content))
    rules = {
        "title_long": F.length(t) > 100,
        "title_label": label,
        "summary_not_standalone": (F.length(summary) < 40) | summary.rlike(DANGLING) | summary.startswith("[["),
        "relative_date": whole.rlike(RELATIVE_DATE) & ~whole.rlike(r"\d{4}-\d{2}-\d{2}"),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return docs.select(key, F.explode(broken).alias("rule"))


# --- the part of a note that answers best

#: Words of notes and queries that meet at a time: a product's memory is their number by two bytes.
WORDS_A_GROUP, QUERIES_A_BLOCK = 20_000, 256


def best_parts(notes: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """query_id, key, seq, n: of each note (key, parts of (seq, text)) the part that holds most terms of a query (query_id, term),
    the first of equal ones, where it holds any. Notes are packed where they lie and meet blocks of queries as sums of rows of a
    matrix (terms by queries); a hit is no row, and what leaves a task is the result."""
    words = F.transform("parts", lambda p: F.struct(p["seq"].alias("seq"), F.array_distinct(tokens(p["text"])).alias("words")))
    kinds, note = dict(notes.dtypes), key

    def pack(batches):
        for batch in batches:
            parts = batch.column(1)
            each = parts.flatten()
            counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
            words, sizes = each.field(1), pc.list_value_length(each.field(1)).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), counts)
            held = np.cumsum(np.bincount(owner, sizes, batch.num_rows))
            group = (held // WORDS_A_GROUP).astype(np.int64)
            ends = [*(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
            first, flat, upto = np.concatenate([[0], np.cumsum(counts)]), words.flatten(), np.concatenate([[0], np.cumsum(sizes)])
            start = 0
            for end in ends:
                a, b = int(first[start]), int(first[end])
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [one(batch.column(0)[start:end]), one(pa.array(owner[a:b] - start, pa.int32())), one(each.field(0)[a:b]), one(pa.array(sizes[a:b], pa.int32())), one(flat[int(upto[a]) : int(upto[b])])],
                    ["ids", "owner", "seqs", "sizes", "words"],
                )
                start = end

    def block(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES_A_BLOCK):
                some = batch.slice(at, QUERIES_A_BLOCK)
                lengths, one = pc.list_value_length(some.column(1)).to_numpy(zero_copy_only=False), lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays([one(some.column(0)), one(pa.array(np.repeat(np.arange(some.num_rows), lengths), pa.int32())), one(some.column(1).flatten())], ["asked", "place", "terms"])

    def meet(batches):
        known = (None, None, None)
        for batch in batches:
            for k in range(batch.num_rows):
                ids, owner, seqs, sizes, words, asked, place, terms = (c[k].values for c in batch.columns)
                if known[0] is None or not known[0].equals(terms) or not known[1].equals(asked):
                    code = terms.dictionary_encode()
                    table = np.zeros((len(code.dictionary), len(asked)), np.uint16)
                    table[code.indices.to_numpy(), place.to_numpy()] = 1
                    known = (terms, asked, (code.dictionary, table))
                vocabulary, table = known[2]
                code = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
                part = np.repeat(np.arange(len(sizes)), sizes.to_numpy())[code >= 0]
                if not len(part):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                n = _sums(table, code[code >= 0], starts)
                part = part[starts]
                whose, seq = owner.to_numpy()[part], seqs.to_numpy()[part].astype(np.int64)
                rank = np.where(n > 0, (n.astype(np.int64) << 31) + ((1 << 31) - 1 - seq)[:, None], 0)  # most terms, then the first part
                heads = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
                best = np.maximum.reduceat(rank, heads, axis=0)
                i, j = np.nonzero(best)
                best = best[i, j]
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(j)), ids.take(pa.array(whose[heads][i])), pa.array(((1 << 31) - 1 - (best & ((1 << 31) - 1))).astype(np.int32)), pa.array(best >> 31)], ["query_id", note, "seq", "n"])

    def _sums(table, code, starts):
        """The rows of each stretch of ``code`` summed, so many at a time that their copy stays small."""
        stops, out, at = np.append(starts[1:], len(code)), np.empty((len(starts), table.shape[1]), np.uint32), 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(stops, starts[at] + WORDS_A_GROUP, "right")))
            out[at:to] = np.add.reduceat(table[code[starts[at] : stops[to - 1]]], starts[at:to] - starts[at], axis=0, dtype=np.uint32)
            at = to
        return out

    kind = dict(queries.dtypes)["query_id"]
    packed = notes.select(key, words.alias("parts")).mapInArrow(pack, f"ids array<{kinds[key]}>, owner array<int>, seqs array<int>, sizes array<int>, words array<string>")
    blocks = queries.groupBy("query_id").agg(F.collect_set("term").alias("terms")).mapInArrow(block, f"asked array<{kind}>, place array<int>, terms array<string>")
    return packed.crossJoin(blocks).mapInArrow(meet, f"query_id {kind}, {key} {kinds[key]}, seq int, n long")
