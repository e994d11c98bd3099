"""Sources parsed from text, source code, composed notes, and the remaining list operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import code
from tessera.operators import evaluation as e
from tessera.operators import graph as g
from tessera.operators import sections as sec
from tessera.operators import temporal as t
from tessera.operators import text as x
from tessera.operators import vector as v
from tessera.operators import writing as wr
from tessera.operators.search import search
from tessera.sources import files as f
from tessera.sources.corpus import DAY, NOW

from .registry import query
from .relational import SECTIONS, chunks
from .retrieval import BM25, FUSED, KNN, QV, asked, asked_vectors, documents, fresh, lists, pairs, ranked
from .upkeep import RESOLVED, duplicate_pairs, links, resolved



@query("s8_gold_source", "SELECT count(*) AS lines, count(*) FILTER (doc_id % 7 = 0 OR doc_id % 11 = 0) AS malformed FROM documents")
def _(s):
    value = F.concat(F.lit('{"query": "q'), F.col("doc_id").cast("string"), F.lit('", "gold": ["a"], "origin": "'), F.when(F.col("doc_id") % 11 == 0, "guessed").otherwise("mined"), F.lit('"}'))
    lines = s.table("documents").select(F.when(F.col("doc_id") % 7 == 0, F.lit('{"query": ')).otherwise(value).alias("value"))
    return f.parse_gold(lines).agg(F.count("*").alias("lines"), F.count_if("malformed").alias("malformed"))


@query("s9_relevance_set", "SELECT item_id, cast(length(text) AS bigint) AS chars FROM benchmark")
def _(s):
    one = s.table("benchmark").select(F.to_json(F.struct("item_id", "text")).alias("j"))
    return one.select(F.from_json("j", "item_id BIGINT, text STRING").alias("r")).select("r.item_id", F.length("r.text").cast("bigint").alias("chars"))


@query("s10_transcripts", "SELECT cast(conv_id AS varchar) AS session, role AS tool, count(*) AS steps, count(*) FILTER (turn % 5 <> 4) AS ok FROM conversations GROUP BY 1, 2")
def _(s):
    r = F.struct(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("step"), F.col("role").alias("tool"), F.when(F.col("turn") % 5 == 4, "failed").alias("error"))
    return f.parse_transcripts(s.table("conversations").select(F.to_json(r).alias("value"))).groupBy("session", "tool").agg(F.count("*").alias("steps"), F.count_if("ok").alias("ok"))


PATHS = """, pa AS (SELECT p_partkey, (CASE WHEN p_partkey % 9 = 0 THEN 'vendor/' ELSE 'src/' END) || 'f' || cast(p_partkey AS varchar) || (CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.RS' WHEN 2 THEN '.txt' ELSE '.lua' END) AS path FROM part)"""


def _paths(s):
    k = F.col("p_partkey")
    end = F.when(k % 4 == 0, ".ts").when(k % 4 == 1, ".RS").when(k % 4 == 2, ".txt").otherwise(".lua")
    return s.table("part").select("p_partkey", F.concat(F.when(k % 9 == 0, "vendor/").otherwise("src/"), F.lit("f"), k.cast("string"), end).alias("path"))


@query("s13_code_paths", PATHS + " SELECT path, CASE p_partkey % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'rust' ELSE 'lua' END AS lang FROM pa WHERE p_partkey % 9 <> 0 AND p_partkey % 4 <> 2")
def _(s):
    return _paths(s).where(f.indexable(F.col("path"))).select("path", f.language(F.col("path")).alias("lang"))


#: (kind, name, qualified, first line, last line) of what each file declares; with $i for each method. m is the number of methods.
DECLARED = {
    "ts": (("class", "C$k", "C$k", "2", "3 + 3 * m"), ("method", "run$i", "C$k.run$i", "3 * i", "3 * i + 2"), ("const", "LIMIT_$w", "LIMIT_$w", "4 + 3 * m", "4 + 3 * m"), ("function", "helper", "helper", "5 + 3 * m", "5 + 3 * m"), ("module", None, None, "1", "5 + 3 * m")),
    "php": (("trait", "T$k", "T$k", "3", "4 + m"), ("method", "run$i", "T$k.run$i", "3 + i", "3 + i"), ("function", "helper_$w", "helper_$w", "5 + m", "5 + m"), ("module", None, None, "1", "5 + m")),
    "rs": (("mod", "m$k", "m$k", "2", "7 + m"), ("struct", "S$k", "m$k::S$k", "4", "4"), ("impl", "S$k", "m$k::impl Drop for S$k", "5", "6 + m"), ("method", "run$i", "m$k::S$k.run$i", "5 + i", "5 + i"), ("const", "LIMIT", "LIMIT", "8 + m", "8 + m"), ("module", None, None, "1", "8 + m")),
    "cpp": (("macro", "MAX_$k", "MAX_$k", "1", "2"), ("namespace", "n$k", "n$k", "3", "6 + 2 * m"), ("struct", "S", "n$k::S", "4", "5 + m"), ("method", "run$i", "n$k::S.run$i", "4 + i", "4 + i"), ("function", "main", "main", "7 + 2 * m", "7 + 2 * m"), ("module", None, None, "1", "7 + 2 * m")),
    "lua": (("const", "M", "M", "2", "2"), ("method", "run$i", "M.run$i", "2 + i", "2 + i"), ("const", "size_$w", "M.size_$w", "3 + m", "3 + m"), ("module", None, None, "1", "4 + m")),
}


def _declared_sql() -> str:
    put = lambda x: "'" + x.replace("$k", "' || p_partkey || '").replace("$i", "' || i || '").replace("$w", "' || split_part(p_name, ' ', 1) || '") + "'"
    out = []
    for k, (end, rows) in enumerate(DECLARED.items()):
        path = f"'src/m' || p_partkey % 50 || '/f' || p_partkey || '.{end}'"
        for kind, name, qualified, first, last in rows:
            named = f"{put(name)} AS name, {path} || ':' || {put(qualified)} AS qualified" if name else f"'f' || p_partkey || '.{end}' AS name, {path} AS qualified"
            each = ", (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3) n" if "$i" in (name or "") else ""
            out.append(f"SELECT {path} AS path, '{kind}' AS kind, {named}, ({first})::BIGINT AS start_line, ({last})::BIGINT AS end_line FROM (SELECT *, 1 + p_size % 3 AS m FROM part WHERE p_partkey % 5 = {k}) p{each}" + " WHERE i <= m" * bool(each))
    return " UNION ALL ".join(out)


@query("d12_symbol_extraction", _declared_sql())
def _(s):
    """What every source file declares, with kinds, qualified names and lines."""
    found = code.symbols(s.sources.select("path", f.language(F.col("path")).alias("lang"), "content"))
    return found.select("path", "kind", "name", "qualified", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


@query("p10_audit_detail", "SELECT event_id, '{\"action\":\"' || action || '\",\"base\":' || cast(base AS varchar) || '}' AS detail FROM log")
def _(s):
    return s.log.select("event_id", F.to_json(F.struct("action", "base")).alias("detail"))


@query("j21_similarity_moments", QV + """, al AS (SELECT query_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 9) AS c FROM qv, vectors WHERE stale = 0 AND chunk_id <> query_id)
SELECT query_id, count(*) AS n, round(avg(c), 5) AS mean, round(stddev_pop(c), 5) AS sd FROM al GROUP BY query_id""")
def _(s):
    return v.similarity_moments(asked_vectors(s), fresh(s), "chunk_id").select("query_id", "n", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"))


@query("w4_first_seen_chunk", KNN + " SELECT query_id, node_id, arg_min(chunk_id, rank) AS chunk_id FROM kn WHERE rank <= 50 GROUP BY query_id, node_id")
def _(s):
    near = v.knn(asked_vectors(s), fresh(s), 50, "chunk_id").join(s.vectors.select("chunk_id", "node_id"), "chunk_id")
    return near.groupBy("query_id", "node_id").agg(F.min_by("chunk_id", "rank").alias("chunk_id"))


@query("k1_text_candidates", BM25 + " SELECT query_id, count(*) AS n, max(score) AS best FROM tl GROUP BY query_id")
def _(s):
    return search(s.text_index, asked(s), 40).groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query("k2_vector_candidates", KNN + " SELECT query_id, count(*) AS n, min(score) AS least FROM kn WHERE rank <= 100 GROUP BY query_id")
def _(s):
    return v.knn(asked_vectors(s), fresh(s), 100, "chunk_id").groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))


@query("u3_merged_lists", FUSED + " SELECT query_id, id, cast(row_number() OVER (PARTITION BY query_id ORDER BY rank, id, src) AS int) AS place FROM (SELECT query_id, id, rank, 1 AS src FROM tx UNION ALL SELECT query_id, id, rank, 2 FROM vl) z QUALIFY place <= 10")
def _(s):
    text, near = lists(s)
    both = text.select("query_id", "id", "rank", F.lit(1).alias("src")).unionByName(near.select("query_id", "id", "rank", F.lit(2).alias("src")))
    w = Window.partitionBy("query_id").orderBy("rank", "id", "src")
    return both.select("query_id", "id", F.row_number().over(w).alias("place")).where("place <= 10")


@query("u5_lost_anchors", r"""SELECT src, dst, unnest(list_filter(list_distinct_in_order, lambda a: NOT contains(kept, a))[1:40]) AS anchor FROM (SELECT e.src, e.dst, k.content AS kept,
  list_filter(all_, lambda a, i: list_position(all_, a) = i) AS list_distinct_in_order FROM (SELECT node_id, content, list_concat(regexp_extract_all(content, '\[\[[^\]]+\]\]'), regexp_extract_all(content, 'https?://[^\s)\]>]+'), regexp_extract_all(content, '\b\d+(?:\.\d+)?\b'), regexp_extract_all(content, '`[^`\n]+`')) AS all_ FROM current) l
  JOIN (SELECT DISTINCT src, dst FROM edges WHERE type = 'duplicate_of' AND invalidated_ms IS NULL) e ON l.node_id = e.dst JOIN current k ON k.node_id = e.src) p""")
def _(s):
    """The first forty facts of a duplicate that the note which would take its place doesn't hold."""
    e = s.edges.where(t.live() & (F.col("type") == "duplicate_of")).select("src", "dst").distinct()
    e = e.join(s.current.select(F.col("node_id").alias("src"), F.col("content").alias("kept")), "src").join(s.current.select(F.col("node_id").alias("dst"), "content"), "dst")
    every = wr.anchor_list(F.col("content"))
    lost = F.slice(F.filter(every, lambda a: ~F.contains(F.col("kept"), a)), 1, 40)
    return e.select("src", "dst", F.explode(lost).alias("anchor"))


@query("f9_fold_replay")
def _(s):
    shown = e.surfacings(s.log, s.table("documents").count()).select("event_id", "rank", F.concat(F.lit("N"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("node_id"))
    return wr.replay_folds(shown, v.first_vectors(fresh(s)), [0.3, 0.5, 0.9])


@query("f10_result_envelope")
def _(s):
    from tessera.operators import ranking as k

    got = k.diversify(ranked(s), v.first_vectors(fresh(s)), pairs(s, "supersedes"), pairs(s, "duplicate_of"), 10)
    rows = got.join(s.nodes.select("id", "title"), "id").join(s.current.select(F.col("node_id").alias("id"), "content"), "id")
    chunk, summary = F.substring("content", 1, 120), x.derive_summary(F.col("content"))
    return rows.select("query_id", "place", "id", "title", F.when(~x.summary_is_redundant(summary, chunk), summary).alias("summary"), chunk.alias("best_chunk"), "folded")


@query("x11_narrowed", SECTIONS + """, rq AS (SELECT id AS node_id, 'H3: Deep ' || ord % 3 AS request FROM nodes UNION ALL SELECT id, CASE WHEN ord % 4 = 0 THEN 'H2: Nowhere' ELSE '(preamble)' END FROM nodes),
ht AS (SELECT DISTINCT node_id, request, seq, text FROM rq JOIN chunks USING (node_id) WHERE coalesce(section, '(preamble)') = request OR list_contains(string_split(coalesce(section, '(preamble)'), ' > '), request)),
ms AS (SELECT node_id, list_sort(list(request)) AS missing FROM rq WHERE (node_id, request) NOT IN (SELECT (node_id, request) FROM ht) GROUP BY node_id),
nm AS (SELECT node_id, string_agg(section, ', ' ORDER BY first) AS names FROM (SELECT node_id, coalesce(section, '(preamble)') AS section, min(seq) AS first FROM chunks GROUP BY ALL) z GROUP BY node_id),
tx AS (SELECT node_id, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM (SELECT DISTINCT node_id, seq, text FROM ht) z GROUP BY node_id)
SELECT n.id AS node_id, CASE WHEN missing IS NULL THEN coalesce(length(text), 0) END::BIGINT AS chars, CASE WHEN missing IS NOT NULL THEN 'no section named ' || array_to_string(missing, ', ') || '; ' || coalesce('it has: ' || names, 'it has no headings') END AS error
FROM nodes n LEFT JOIN ms ON ms.node_id = n.id LEFT JOIN tx ON tx.node_id = n.id LEFT JOIN nm ON nm.node_id = n.id""")
def _(s):
    """Notes narrowed to two sections each, or an error that names what is missing and what there is."""
    deep = s.nodes.select(F.col("id").alias("node_id"), F.concat(F.lit("H3: Deep "), (F.col("ord") % 3).cast("string")).alias("section"))
    first = s.nodes.select(F.col("id").alias("node_id"), F.when(F.col("ord") % 4 == 0, "H2: Nowhere").otherwise("(preamble)").alias("section"))
    return sec.narrow(deep.unionByName(first), chunks(s), "node_id").select("node_id", F.length("text").cast("bigint").alias("chars"), "error")


@query("x13_merge_notes")
def _(s):
    text = s.current.select("node_id", "content").join(s.nodes.select(F.col("id").alias("node_id"), "title"), "node_id")
    p = duplicate_pairs(s).join(text.select(F.col("node_id").alias("a"), F.col("content").alias("body_a")), "a").join(text.select(F.col("node_id").alias("b"), F.col("content").alias("body_b"), F.col("title").alias("title_b")), "b")
    return wr.merged(p)


@query("c7_episodic_clusters")
def _(s):
    old = s.nodes.where(t.live() & (F.col("memory_kind") == "episodic") & F.col("consolidated_ms").isNull() & (F.col("created_ms") < NOW - DAY)).select(F.col("id").alias("node_id"))
    seeds = v.first_vectors(fresh(s)).join(old, "node_id", "left_semi").withColumnRenamed("node_id", "query_id")
    near = v.seeded_neighbours(seeds, fresh(s).join(old, "node_id", "left_semi"), 20, 10, 0.15)
    project = s.nodes.select("id", "project")
    near = near.join(project.select(F.col("id").alias("query_id"), F.col("project").alias("p")), "query_id").join(project.select(F.col("id").alias("node_id"), F.col("project").alias("q")), "node_id").where(F.col("p").eqNullSafe(F.col("q")) | t.same_family(F.col("p"), F.col("q")))
    return g.components(near.select(F.col("query_id").alias("a"), F.col("node_id").alias("b"))).groupBy("root").agg(F.count("*").alias("members"))


@query("z12_dangler_titles", RESOLVED + f""", dg AS (SELECT DISTINCT slug FROM wk JOIN rs USING (slug) WHERE rs.kind = 'ambiguous') SELECT dg.slug, count(*) AS candidates, min(n.title) AS first_title FROM dg JOIN ti ON contains(dg.slug, '-') AND (starts_with(ti.ts, dg.slug || '-') OR ti.ts = dg.slug) OR ti.ts = dg.slug JOIN nodes n ON n.id = ti.id GROUP BY dg.slug""")
def _(s):
    lost = links(s).select("slug").distinct().join(resolved(s).where("kind = 'ambiguous'"), "slug").select("slug")
    known = s.nodes.where(t.live()).select("id", "title", x.slugify(F.col("title")).alias("ts")).where("ts <> ''")
    w = known.withColumn("w", F.split("ts", "-"))
    cuts = F.expr("filter(transform(sequence(1, size(w)), i -> array_join(slice(w, 1, i), '-')), c -> contains(c, '-') OR c = ts)")
    return w.select("id", "title", F.explode(cuts).alias("slug")).distinct().join(lost, "slug").groupBy("slug").agg(F.count("*").alias("candidates"), F.min("title").alias("first_title"))


