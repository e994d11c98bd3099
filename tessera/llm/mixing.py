"""Operator 2: mixing sources to target weights (native).

Targets: sources share the size of all documents by weight, none gets more than ``cap`` times its
own size, and what is cut off is shared again among the others by weight.

Mix: each source's documents stand in a random order (md5 of seed, doc_id and text), which is cut into
blocks of equally many words; the words of a document may lie in several blocks. A target of f times
the source fills a list of slots, floor(f) passes over all blocks and one over some: slot j of a pass
holds block (a * j + c) mod n of the source's n, with a prime to n and both drawn from seed, source and
pass; the last slot is cut to meet the target to the word. The numbers of slots are the source's block
quotas. A splitting tree deals them to output shards: each node splits its shards in halves and draws how
many slots of each source go left from the multivariate hypergeometric distribution (one
hypergeometric draw after another, by inversion, from a hash of seed, node and source). With over
GROUP sources the tree deals groups of sources first and then, within the blocks that a group has got
in each shard, its sources. A leaf's quotas become slots: source by source shards take the next ones
of the list in a second permuted order, so they are disjoint, and what a shard takes of a document is
what its blocks hold of it. Within a shard rows are shuffled by a hash.

Nothing gathers a source in one task: order and running sums go over hash buckets of a bounded
number of rows, whose sums are then summed; equal rows of one scan task are folded before. The state of the tree is
numbers of blocks, never rows, and holds no more entries than there are blocks.

A null text counts as size 0 and is never taken. Null is a source of its own, last in order. A
null doc_id is ordered as the empty string. Rows are kept apart by no key, so repeated rows each
have their place in the order (rows equal in all columns read here are interchangeable). Sources
without a word get target 0. An empty table gives no rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import stage, table, width, word_count, work_dir

BUCKET_ROWS, GROUP, SHARD_WORDS, SEED = 2_000, 256, 1 << 24, 7
WEIGHTS = (1, 2, 3)
#: Primes above any number of blocks, so each is prime to it.
FACTORS = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """``sources`` (source, source_size) with weight and target. One row for each source: the
    windows run over sources, not documents."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    ranked = sources.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w)
    # capped sources are those with the least cap per weight: sort by it, and a source is capped when
    # sharing what the ones before it leave would give it at least its cap
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "n")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap * F.col("source_size")).over(ahead), F.lit(0))) / F.sum("weight").over(from_here)
    found = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= cap * F.col("source_size"))
    # the first source that is not capped fixes the level of all after it
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(all_rows)
    capped = (cap * F.col("source_size")).cast("double")
    return found.withColumn("target", F.least(capped, F.coalesce(level * F.col("weight"), capped))).select("source", "source_size", "weight", "target")


def ordered(docs: DataFrame, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, the columns ``carry``, and ``start``: the words of the source before the document in its
    random order. ``docs`` has doc_id, source, size, key (a digest of the text); read it from a table, it is scanned twice."""
    n = docs.count()
    digits = 8
    buckets = max(1, -(-n // BUCKET_ROWS))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("key")))
    place = F.conv(F.substring("h", 1, digits), 16, 10).cast("double") / float(16**digits)
    hashed = docs.withColumn("h", h).withColumn("bucket", F.floor(place * buckets).cast("long"))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base")
    # rows that agree in all columns share a hash and so a bucket: those of one scan task are one row here
    folded = hashed.groupBy("doc_id", "source", "size", *carry, "h", "bucket", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", *carry, "task").rowsBetween(Window.unboundedPreceding, -1)
    within = folded.withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    joined = within.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth")
    every = joined.select("doc_id", "source", "size", *carry, "base", "within", nth)
    return every.select("doc_id", "source", "size", *carry, (F.col("base") + F.col("within") + F.col("nth") * F.col("size")).alias("start"))


def _ln_factorial(x: str) -> str:
    """Stirling's series moved up by 8, exact to about 1e-12."""
    y = f"({x} + 9D)"
    product = " * ".join(f"({x} + {k}D)" for k in range(1, 9))
    return f"(({y} - 0.5D) * ln({y}) - {y} + 0.9189385332046727D + 1D / (12D * {y}) - 1D / (360D * {y} * {y} * {y}) - ln({product}))"


def _draw(total: str, good: str, sample: str, u: str) -> str:
    """A hypergeometric draw by inversion: how many of ``good`` among ``total`` are in a sample.

    Only values within 12 standard deviations of the mean are summed; the mass beyond is below 1e-30."""
    mean = f"({sample} * {good} / greatest({total}, 1D))"
    sd = f"sqrt(greatest(0D, {mean} * (1D - {good} / greatest({total}, 1D)) * ({total} - {sample}) / greatest({total} - 1D, 1D)))"
    low = f"greatest(0D, {sample} + {good} - {total}, floor({mean} - 12D * {sd}) - 1D)"
    high = f"least({good}, {sample}, ceil({mean} + 12D * {sd}) + 1D)"
    pmf = "exp(" + " + ".join(
        f"{sign}1D * {_ln_factorial(x)}"
        for sign, x in (
            ("", good), ("-", "k"), ("-", f"({good} - k)"),
            ("", f"({total} - {good})"), ("-", f"({sample} - k)"), ("-", f"({total} - {good} - {sample} + k)"),
            ("-", total), ("", sample), ("", f"({total} - {sample})"),
        )
    ) + ")"
    return (
        f"aggregate(transform(sequence(cast({low} as bigint), cast({high} as bigint)), q -> cast(q as double)), "
        f"named_struct('mass', 0D, 'got', {high}), "
        f"(c, k) -> if(c.mass >= {u}, c, named_struct('mass', c.mass + {pmf}, 'got', k)), c -> c.got)"
    )


def _split_shards(nodes: DataFrame, levels: int, seed: int) -> DataFrame:
    """``nodes`` (grp, items, shards) down to single shards: grp, shard, items. ``items`` are the
    structs (item, blocks) of a group, ``shards`` the structs (shard, blocks) among which they are dealt;
    both have the same sum. A node of no blocks has no row."""
    nodes = nodes.withColumn("node", F.lit(0).cast("long"))
    for level in range(levels):
        half = 1 << (levels - 1 - level)
        if level == 8:  # from here on there are nodes enough for all tasks
            nodes = nodes.repartition(width(nodes.sparkSession), "grp", "node")
        u = f"((pmod(xxhash64({seed}, {level}, grp, node, x.item), 9007199254740992) + 0.5D) / 9007199254740992D)"
        nodes = nodes.selectExpr("grp", "node", "items", "shards", f"filter(shards, s -> s.shard < (2 * node + 1) * {half}) AS low", f"filter(shards, s -> s.shard >= (2 * node + 1) * {half}) AS high")
        nodes = nodes.selectExpr("*", "aggregate(items, 0D, (s, x) -> s + x.blocks) AS total", "aggregate(low, 0D, (s, x) -> s + x.blocks) AS want")
        # one item after another: of the blocks still in the urn, how many of its own go left
        fold = (
            "aggregate(items, named_struct('rest', total, 'want', want, 'left', cast(array() AS array<double>)), (z, x) -> "
            f"aggregate(array({_draw('z.rest', 'x.blocks', 'z.want', u)}), z, (y, d) -> "
            "named_struct('rest', y.rest - x.blocks, 'want', y.want - d, 'left', concat(y.left, array(d)))), z -> z.left)"
        )
        some = lambda blocks: f"filter(zip_with(items, gone, (x, d) -> named_struct('item', x.item, 'blocks', {blocks})), x -> x.blocks > 0)"
        nodes = nodes.selectExpr("grp", "node", "items", "low", "high", f"{fold} AS gone").selectExpr(
            "grp", f"explode(array(named_struct('node', 2 * node, 'items', {some('d')}, 'shards', low), named_struct('node', 2 * node + 1, 'items', {some('x.blocks - d')}, 'shards', high))) AS n"
        ).select("grp", "n.node", "n.items", "n.shards").where("size(items) > 0")
    return nodes.select("grp", F.col("node").cast("int").alias("shard"), "items")


def splitting_tree(quotas: DataFrame, levels: int, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """``quotas`` (source, blocks) dealt to 2**levels shards: shard, source, blocks. Every shard gets
    the same number of blocks, give or take one. Sources are told apart by their place in code point order;
    a node holds ``group`` of them at most, or groups of sources, or groups of those."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row for each source
    numbered = quotas.where("blocks > 0").withColumn("at", place.cast("long"))
    top, total = numbered.agg(F.max("at"), F.sum("blocks")).first()
    total, depth = total or 0, 1
    while group**depth <= (top or 0):
        depth += 1
    shards = 1 << levels
    even = f"transform(sequence(0L, {shards - 1}L), s -> named_struct('shard', s, 'blocks', cast(floor((s + 1) * {total}D / {shards}) - floor(s * {total}D / {shards}) AS double)))"
    margins = numbered.sparkSession.range(1).selectExpr("0L AS grp", f"filter({even}, s -> s.blocks > 0) AS shards")
    for step in range(depth):
        size = group ** (depth - 1 - step)
        item = F.floor(F.col("at") / size).cast("long")
        sums = numbered.groupBy(F.floor(F.col("at") / (size * group)).cast("long").alias("grp"), item.alias("item")).agg(F.sum("blocks").cast("double").alias("blocks"))
        items = sums.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("item", "blocks"))).alias("items"))  # ``group`` structs at most
        dealt = _split_shards(items.join(margins, "grp"), levels, seed + step)
        flat = dealt.select(F.col("shard").cast("long").alias("shard"), F.explode("items").alias("i")).select("shard", "i.item", "i.blocks")
        margins = flat.groupBy(F.col("item").alias("grp")).agg(F.sort_array(F.collect_list(F.struct("shard", "blocks"))).alias("shards"))
    named = flat.join(numbered.select("at", "source"), F.col("item") == F.col("at"))
    return named.select(F.col("shard").cast("int").alias("shard"), "source", F.col("blocks").cast("long").alias("blocks"))


def _part(seed: int, what: str, digits: int = 7) -> Column:
    """A number below 16**digits from the seed, the source and a name."""
    h = F.md5(F.concat_ws(":", F.lit(f"{seed}:{what}"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))))
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long")


def block_plan(goals: DataFrame, block: int, least: int, seed: int = SEED, whole: bool = False) -> DataFrame:
    """For each source with words and a target: ``b`` words a block (the last block may be short), ``n`` blocks, ``full`` passes,
    ``r`` slots of the partial pass with ``cut`` words in the last of them, ``slots`` in all, and the
    permutations: slot j of a pass holds block (a * j + c) mod n, place i of the shards is slot (e * i + f) mod slots.
    For ``whole`` documents a is 1: the blocks of the partial pass are then neighbours in the random order, and only
    the documents at the two ends of the run, not at those of every block, move the words taken from the target."""
    factors = F.array(*[F.lit(x) for x in FACTORS])
    factor = lambda what: F.element_at(factors, (_part(seed, what) % len(FACTORS) + 1).cast("int")).cast("long")
    plan = goals.where("source_size > 0 AND want > 0").withColumn("b", F.least(F.lit(block), F.expr(f"(source_size + {least - 1}) div {least}")))
    plan = plan.withColumn("n", F.expr("(source_size + b - 1) div b")).withColumn("full", F.expr("want div source_size")).withColumn("rest", F.expr("want % source_size"))
    # the last block is drawn a slot, ``odd``, and c follows from it: so the words of the first slots are known
    plan = plan.withColumn("lack", F.expr("n * b - source_size")).withColumn("odd", _part(seed, "c") % F.col("n")).withColumn("a", (F.lit(1).cast("long") if whole else factor("a")) % F.col("n"))
    plan = plan.withColumn("c", F.expr("pmod(n - 1 - (a * odd) % n, n)")).withColumn("r", F.expr("(rest + b - 1) div b"))
    plan = plan.withColumn("r", F.expr("r + if(odd < r AND r * b - lack < rest, 1, 0)"))
    plan = plan.withColumn("cut", F.expr("rest - (r - 1) * b + if(odd < r - 1, lack, 0)")).withColumn("slots", F.expr("full * n + r"))
    return plan.withColumn("e", factor("e") % F.col("slots")).withColumn("f", _part(seed, "f") % F.col("slots"))


def filled(plan: DataFrame, dealt: DataFrame) -> DataFrame:
    """The slots of the leaves ``dealt`` (shard, source, blocks): source, block, pass, shard, b and ``upto``,
    the words that the mix takes from the beginning of the block."""
    before = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    runs = dealt.withColumnRenamed("source", "s").withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0)))
    places = runs.select("s", "shard", F.explode(F.expr("sequence(first, first + blocks - 1)")).alias("i"))
    slots = places.join(plan, F.col("s").eqNullSafe(F.col("source"))).withColumn("g", F.expr("(e * i + f) % slots"))
    slots = slots.withColumn("pass", F.expr("g div n")).withColumn("j", F.expr("g % n")).withColumn("block", F.expr("(a * j + c) % n"))
    upto = F.expr("if(pass = full AND j = r - 1, cut, if(block = n - 1, b - lack, b))")
    return slots.select("source", "block", "pass", "shard", "b", upto.alias("upto"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, levels: int | None = None, blocks_per_shard: int = 64, least: int = 64, seed: int = SEED, whole: bool = False, carry: tuple[str, ...] = ()
) -> tuple[DataFrame, DataFrame]:
    """Placements and documents of the mix of ``docs`` (doc_id, source, text).

    Placements: doc_id, source, start, block, pass, words, shard, turn; a row for each part of a document that a
    slot takes; sort a shard by ``turn`` to shuffle it. ``whole`` takes documents as a whole, with the block in
    which they begin. There are 2**levels shards, by default 16 or more so that each has SHARD_WORDS words at most (65,536 shards at most), of
    ``blocks_per_shard`` blocks of equally many words, less for sources that would have under ``least``. Documents: doc_id,
    source, start, size, source_size, target, taken. (source, start) tells rows with words apart, also where
    doc_ids repeat; columns named in ``carry`` come along in both."""
    spark = docs.sparkSession
    folder = work_dir(spark, "mixing")
    key = F.md5(F.coalesce("text", F.lit("")))
    sized = stage(docs.select("doc_id", "source", *carry, key.alias("key"), word_count(F.col("text")).alias("size")), f"{folder}/sizes", narrow=True)
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    goals = stage(goals.withColumn("want", F.round("target").cast("long")), f"{folder}/targets")
    total = goals.agg(F.sum("want")).first()[0] or 0
    if levels is None:
        levels = min(16, max(4, math.ceil(math.log2(max(1, total / SHARD_WORDS)))))
    block = max(1, -(-total // (blocks_per_shard << levels)))  # words
    rows = ordered(sized, seed, carry).join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = stage(rows, f"{folder}/ordered")
    plan = stage(block_plan(goals, block, least, seed, whole), f"{folder}/plan")
    dealt = stage(splitting_tree(plan.select("source", F.col("slots").alias("blocks")), levels, seed), f"{folder}/quotas", narrow=True)
    slots = stage(filled(plan, dealt).withColumnsRenamed({"source": "s", "block": "k"}), f"{folder}/slots", narrow=True)
    blocks = plan.select(F.col("source").alias("p"), F.col("b").alias("words_a_block"))
    pieces = rows.where("size > 0").join(blocks, F.col("source").eqNullSafe(F.col("p"))).withColumn("from", F.expr("start div words_a_block"))
    last = "from" if whole else "(start + size - 1) div words_a_block"
    pieces = pieces.withColumn("block", F.explode(F.expr(f"sequence(from, {last})")))
    placed = pieces.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k")))
    words = "if(start < block * b + upto, size, 0L)" if whole else "least(start + size, block * b + upto) - greatest(start, block * b)"
    turn = F.xxhash64(F.lit(seed), F.col("source"), F.col("start"), F.col("block"), F.col("pass"))
    placed = placed.withColumn("words", F.expr(words)).where("words > 0")
    placements = placed.select("doc_id", "source", *carry, "start", "block", "pass", "words", "shard", turn.alias("turn"))
    # what each shard takes of a document, then what all of them take
    shares = placements.groupBy("source", "start", "shard").agg(F.sum("words").alias("words"))
    sums = shares.groupBy(F.col("source").alias("s"), F.col("start").alias("at")).agg(F.sum("words").alias("mixed"), F.count("*").alias("shards"))
    own = F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") > 0)
    taken = F.coalesce("mixed", F.lit(0)).cast("long")
    documents = rows.join(sums, own, "left").select("doc_id", "source", *carry, "start", "size", "source_size", "target", taken.alias("taken"))
    return placements, documents


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the placements of all shards take of each document."""
    _, documents = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def _oracle(seed: int = SEED, levels: str = "greatest(4, cast(ceil(log2(greatest(1, tot / 16777216.0))) AS int))", least: int = 64, blocks_per_shard: int = 64) -> str:
    """DuckDB SQL for ``op2_mixing``: which blocks the last pass of a source takes follows from its
    permutation, to whichever shard the tree deals them."""
    part = lambda what: f"cast('0x' || substr(md5('{seed}:{what}:' || coalesce('=' || source, '')), 1, 7) AS bigint)"
    return rf"""
WITH d AS (SELECT doc_id, source, md5('{seed}:' || coalesce(cast(doc_id AS varchar), '') || ':' || md5(coalesce(text, ''))) AS h,
  cast(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS bigint) AS size FROM documents),
s AS (SELECT source, cast(sum(size) AS bigint) AS source_size FROM d GROUP BY source),
r AS (SELECT *, cast([1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS double) AS w FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT *, first(CASE WHEN level * w <= 3 * source_size THEN level END IGNORE NULLS)
  OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lam FROM l),
t AS (SELECT source, source_size, least(cast(3 * source_size AS double), coalesce(lam * w, cast(3 * source_size AS double))) AS target FROM f),
g AS (SELECT *, cast(round(target) AS bigint) AS want FROM t),
z AS (SELECT cast(sum(want) AS bigint) AS tot FROM g),
y AS (SELECT greatest(1, (tot + bl - 1) // bl) AS block FROM (SELECT tot, cast({blocks_per_shard} * 2 ** {levels} AS bigint) AS bl FROM z)),
p1 AS (SELECT g.*, least(block, (source_size + {least - 1}) // {least}) AS b, want // source_size AS full_, want % source_size AS rest FROM g, y WHERE source_size > 0 AND want > 0),
p2 AS (SELECT *, (source_size + b - 1) // b AS n FROM p1),
p3 AS (SELECT *, n * b - source_size AS lack, {part("c")} % n AS odd, {list(FACTORS)}[{part("a")} % {len(FACTORS)} + 1] % n AS a, (rest + b - 1) // b AS r0 FROM p2),
p4 AS (SELECT *, (n + (n - 1 - (a * odd) % n)) % n AS c, r0 + CASE WHEN odd < r0 AND r0 * b - lack < rest THEN 1 ELSE 0 END AS r FROM p3),
p5 AS (SELECT *, rest - (r - 1) * b + CASE WHEN odd < r - 1 THEN lack ELSE 0 END AS cut FROM p4),
j AS (SELECT *, unnest(range(r)) AS j FROM p5),
k AS (SELECT source, (a * j + c) % n AS k, (a * j + c) % n * b AS lo, (a * j + c) % n * b + CASE WHEN j = r - 1 THEN cut WHEN (a * j + c) % n = n - 1 THEN b - lack ELSE b END AS hi FROM j),
o AS (SELECT d.*, row_number() OVER () AS rid, g.source_size, g.target, coalesce(p5.full_, 0) AS passes, coalesce(p5.b, 1) AS b,
  cast(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN p5 ON d.source IS NOT DISTINCT FROM p5.source),
q AS (SELECT rid, source, start, size, unnest(range(start // b, (start + size - 1) // b + 1)) AS k FROM o WHERE size > 0),
x AS (SELECT rid, sum(greatest(0, least(start + size, hi) - greatest(start, lo))) AS part FROM q JOIN k ON q.k = k.k AND q.source IS NOT DISTINCT FROM k.source GROUP BY rid)
SELECT doc_id, size, source_size, target, cast(passes * size + coalesce(part, 0) AS bigint) AS taken FROM o LEFT JOIN x USING (rid)
"""


ORACLE = _oracle()
