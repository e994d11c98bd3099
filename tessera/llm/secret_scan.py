"""Operator 6: secret scans with multipart credential linking (native).

Base kinds, found leftmost and without overlaps: ``assign`` (a key word, an assignment sign and a
value of 6 or more characters), ``access`` (an access identifier), ``hex`` (24 or more hex digits).
Linking: a weak candidate for the secret part (``weak``: a run of 32 to 128 key characters that
mixes digits and both cases) is reported only where an access identifier lies within ``scope``
characters in the same document; an ``endpoint`` (a url) only where an identifier and a secret
(``assign``, ``hex`` or ``weak``) both do. Scopes are joined as intervals: parts are dealt to cells
of ``scope`` characters and met by equi-join on document and cell, so a very long document with many
parts is spread over tasks, and nothing is compared across documents.

Positions are code points, end exclusive. They are running sums of the lengths of matches and of what
lies between them. A null or empty text has no spans. Rows are kept apart by an id given when the parts
are written, so repeated rows and null doc_ids are answered row by row. Further columns and an empty
table need no care."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import stage, table, work_dir

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a run that is too short can't hold a shorter match that is long enough, so these two ask for the length at once
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WEAK = r"[A-Za-z0-9+/_=-]{32,}"
ENDPOINT = r"""https?://[^\x00-\x20"'<>]+"""
KINDS = ("assign", "access", "hex", "weak", "endpoint")
SCOPE = 200


NO_SPANS = "cast(array() AS array<struct<start:int,end:int>>)"


def _named(x: Column, use) -> Column:
    """``use(x)`` with ``x`` computed once, however often it is used."""
    return F.transform(F.array(x), use)[0]


def running_sums(x: Column) -> Column:
    """array<int> of the sums of all elements up to each, by doubling steps: n log n for n elements.
    A string has under 2**31 characters, so 31 steps do; those beyond the size change nothing."""
    steps = F.array(*[F.lit(1 << k) for k in range(31)])

    def step(a, d):
        far = F.transform(a, lambda v, i: v + F.when(i >= d, F.get(a, i - d)).otherwise(F.lit(0)))
        return F.when(F.size(a) <= d, a).otherwise(far)

    return F.aggregate(steps, x, step)


def spans(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<start, end>> of the matches of a pattern that never matches the empty string."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def walk(hits):
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        ends = running_sums(F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.length(h)))
        every = F.zip_with(ends, hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), (keep(h) if keep else F.lit(True)).alias("good")))
        return F.transform(F.filter(every, lambda s: s["good"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    # the split is made only where there are matches
    return _named(found, lambda hits: F.when(F.size(hits) > 0, walk(hits)).otherwise(F.expr(NO_SPANS)))


def find_parts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and the spans of each kind, in columns named by kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    mixed = lambda hit: (F.length(hit) <= 128) & hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")
    return docs.select(
        F.col(key).alias("doc_id"),
        spans(t, ASSIGN, lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6).alias("assign"),
        spans(t, ACCESS).alias("access"),
        spans(t, HEX).alias("hex"),
        spans(t, WEAK, mixed).alias("weak"),
        spans(t, ENDPOINT).alias("endpoint"),
    )


def _near(a: DataFrame, b: DataFrame, scope: int) -> DataFrame:
    """Rows (uid, start, end) of ``a`` with a row of ``b`` at most ``scope`` characters away."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.greatest(lo, F.lit(0)) / scope), F.floor(hi / scope)))
    left = a.withColumn("cell", cells(F.col("start") - scope, F.col("end") + scope))
    right = b.select(F.col("uid"), F.col("start").alias("s"), F.col("end").alias("e")).withColumn("cell", cells(F.col("s"), F.col("e")))
    close = (F.col("s") <= F.col("end") + scope) & (F.col("e") >= F.col("start") - scope)
    return left.join(right, ["uid", "cell"]).where(close).select("uid", "start", "end").distinct()


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates and endpoints whose complementary parts co-occur: uid, kind, start, end."""
    some = parts.where((F.size("access") > 0) & (F.size("weak") + F.size("endpoint") > 0))
    each = {k: some.select("uid", F.explode(k).alias("x")).select("uid", "x.start", "x.end") for k in KINDS}
    weak = _near(each["weak"], each["access"], scope)
    secret = each["assign"].unionByName(each["hex"]).unionByName(weak)
    endpoint = _near(_near(each["endpoint"], each["access"], scope), secret, scope)
    return weak.withColumn("kind", F.lit("weak")).unionByName(endpoint.withColumn("kind", F.lit("endpoint")))


def scan(docs: DataFrame, scope: int = SCOPE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, the number of base spans by kind, base and all spans as kind:start:end lists."""
    spark = docs.sparkSession
    folder = work_dir(spark, "secrets")
    parts = stage(find_parts(docs, text, key).withColumn("uid", F.monotonically_increasing_id()), f"{folder}/parts", narrow=True)
    item = F.struct(F.col("start"), F.when(F.col("kind") == "weak", 3).otherwise(4).alias("rank"), F.col("end"))
    linked = link(parts, scope).groupBy("uid").agg(F.collect_list(item).alias("linked"))
    rows = parts.join(linked, "uid", "left")
    as_items = [F.expr(f"transform({k}, x -> named_struct('start', x.start, 'rank', {i}, 'end', x.end))") for i, k in enumerate(KINDS[:3])]
    base = F.sort_array(F.concat(*as_items))
    every = F.sort_array(F.concat(*as_items, F.coalesce("linked", F.expr("cast(array() AS array<struct<start:int,rank:int,end:int>>)"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda items: F.array_join(F.transform(items, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(every).alias("spans"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """DuckDB SQL for ``op6_secret_scan``."""
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, WEAK, ENDPOINT)))

    def part(rank: int, kind: str) -> str:
        p = patterns[kind].replace("'", "''")
        keep = {
            "assign": f"WHERE length(regexp_extract(x.hit, '{p}', 2)) >= 6",
            "weak": "WHERE length(x.hit) <= 128 AND regexp_matches(x.hit, '[0-9]') AND regexp_matches(x.hit, '[a-z]') AND regexp_matches(x.hit, '[A-Z]')",
        }.get(kind, "")
        return f"""{kind}_m AS (SELECT rid, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')),
{kind}_p AS (SELECT rid, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'start': cast(list_sum(list_transform(gaps[1:i], lambda z: length(z)))
  + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS bigint), 'hit': m[i]}})) AS x FROM {kind}_m),
{kind} AS (SELECT rid, {rank} AS rank, '{kind}' AS kind, x.start AS s, x.start + length(x.hit) AS e FROM {kind}_p {keep})"""

    near = lambda a, b: f"EXISTS (SELECT 1 FROM {b} y WHERE y.rid = {a}.rid AND y.s <= {a}.e + {SCOPE} AND y.e >= {a}.s - {SCOPE})"
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS[:3])
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),\n"
        + ",\n".join(part(i, k) for i, k in enumerate(KINDS))
        + f""",
w2 AS (SELECT * FROM weak WHERE {near("weak", "access")}), sec AS (SELECT * FROM assign UNION ALL SELECT * FROM hex UNION ALL SELECT * FROM w2),
e2 AS (SELECT * FROM endpoint WHERE {near("endpoint", "access")} AND {near("endpoint", "sec")}),
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex), every AS (SELECT * FROM base UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM e2),
b AS (SELECT rid, {listed}, {counts} FROM base GROUP BY rid), a AS (SELECT rid, {listed} FROM every GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)"""
    )


ORACLE = _oracle()
