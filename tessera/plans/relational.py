"""Scans, projections, joins, aggregations, windows and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import relational as r
from tessera.operators import sections as sec
from tessera.operators import temporal as t
from tessera.operators import text as x
from tessera.sources.corpus import DAY, HOUR, NOW, T0

from .registry import query

LIVE_AUTHORED = "invalidated_ms IS NULL AND memory_kind IN ('semantic', 'episodic')"
ENVELOPE = ["id", "memory_kind", "type", "title", "project", "rev", "edge_count", "updated_ms"]
SUMMARY = """coalesce(list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#'))[1], '')"""


def summary_sql(c: str) -> str:
    line = SUMMARY.format(c=c)
    return f"CASE WHEN length({line}) > 160 THEN rtrim(substr({line}, 1, 160)) || '…' ELSE {line} END"


def live_authored(s):
    return s.nodes.where(t.live() & t.authored())


# --- scans


@query("s1_enriched_scan", f"SELECT {', '.join(ENVELOPE)} FROM enriched")
def _(s):
    return s.enriched.select(*ENVELOPE)


@query("s2_batch_lookup", "SELECT id, title, rev FROM enriched WHERE id IN (SELECT src FROM edges WHERE type = 'supersedes')")
def _(s):
    return s.enriched.join(s.edges.where("type = 'supersedes'").select(F.col("src").alias("id")), "id", "left_semi").select("id", "title", "rev")


@query(
    "s3_filtered_scan",
    f"""SELECT id, memory_kind, project FROM nodes WHERE created_ms <= {NOW} AND (invalidated_ms IS NULL OR invalidated_ms > {NOW})
  AND (event_from_ms IS NULL OR event_from_ms <= {NOW}) AND (event_to_ms IS NULL OR event_to_ms > {NOW}) AND memory_kind IN ('semantic', 'episodic')
  AND (project IS NULL OR split_part(project, '-', 1) = 'src1')""",
)
def _(s):
    family = F.col("project").isNull() | (t.project_family(F.col("project")) == "src1")
    return s.nodes.where(t.as_of(NOW) & t.valid_at(NOW) & t.authored() & family).select("id", "memory_kind", "project")


@query("s4_authored_bodies", f"SELECT id, title, content FROM enriched WHERE {LIVE_AUTHORED}")
def _(s):
    return live_authored(s).join(s.current.withColumnRenamed("node_id", "id"), "id").select("id", "title", "content")


GRAPH_NODES = f""", la AS (SELECT id FROM nodes WHERE {LIVE_AUTHORED}),
gn AS (SELECT id, invalidated_ms IS NOT NULL AS retired FROM nodes WHERE id IN (SELECT id FROM la) OR (invalidated_ms IS NOT NULL AND memory_kind IN ('semantic', 'episodic')
  AND id IN (SELECT dst FROM edges WHERE invalidated_ms IS NULL AND type <> 'supersedes' AND src IN (SELECT id FROM la))))"""


def graph_nodes(s):
    live = live_authored(s).select("id")
    hit = s.edges.where(t.live() & (F.col("type") != "supersedes")).join(live.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    retired = s.nodes.where(~t.live() & t.authored()).join(hit, "id", "left_semi").select("id")
    return live.withColumn("retired", F.lit(False)).unionByName(retired.withColumn("retired", F.lit(True)))


@query("s5_graph_nodes", GRAPH_NODES + " SELECT id, retired FROM gn")
def _(s):
    return graph_nodes(s)


@query("s5_graph_edges", GRAPH_NODES + " SELECT src, dst, type, weight FROM edges WHERE invalidated_ms IS NULL AND src IN (SELECT id FROM gn) AND dst IN (SELECT id FROM gn)")
def _(s):
    ids = graph_nodes(s).select("id")
    e = s.edges.where(t.live()).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.select("src", "dst", "type", "weight")


@query(
    "s6_full_node",
    """, st AS (SELECT src AS id, 'out' AS direction, dst AS other, type FROM edges WHERE invalidated_ms IS NULL UNION ALL SELECT dst, 'in', src, type FROM edges WHERE invalidated_ms IS NULL)
SELECT e.id, e.rev, length(e.content) AS chars, coalesce(string_agg(st.direction || ':' || st.type || ':' || st.other, ',' ORDER BY st.direction, st.type, st.other), '') AS stubs
FROM enriched e LEFT JOIN st USING (id) GROUP BY e.id, e.rev, e.content""",
)
def _(s):
    live = s.edges.where(t.live())
    stubs = live.select(F.col("src").alias("id"), F.lit("out").alias("d"), F.col("dst").alias("o"), "type").unionByName(live.select(F.col("dst").alias("id"), F.lit("in").alias("d"), F.col("src").alias("o"), "type"))
    joined = stubs.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("d", "type", "o"))), lambda z: F.concat_ws(":", z["d"], z["type"], z["o"])), ",").alias("stubs"))
    return s.enriched.join(joined, "id", "left").select("id", "rev", F.length("content").cast("bigint").alias("chars"), F.coalesce("stubs", F.lit("")).alias("stubs"))


@query("s7_revisions", "SELECT node_id, rev, ts_ms, length(content) AS chars FROM revisions WHERE rev >= 2")
def _(s):
    return s.revisions.where("rev >= 2").select("node_id", "rev", "ts_ms", F.length("content").cast("bigint").alias("chars"))


@query("s11_event_detail", "SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events")
def _(s):
    return s.table("events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("s12_missing_units", "SELECT DISTINCT unit_id FROM files WHERE branch = 'dev' AND unit_id NOT IN (SELECT unit_id FROM files WHERE branch = 'main')")
def _(s):
    return s.files.where("branch = 'dev'").select("unit_id").join(s.files.where("branch = 'main'"), "unit_id", "left_anti").distinct()


@query(
    "s14_upsert",
    "SELECT id, use_count FROM nodes WHERE ord % 10 <> 3 UNION ALL SELECT id, use_count + 100 FROM nodes WHERE ord % 10 = 3",
)
def _(s):
    base = s.nodes.select("id", "use_count")
    return r.upsert(base, s.nodes.where("ord % 10 = 3").select("id", (F.col("use_count") + 100).alias("use_count")), ["id"])


@query(
    "s15_encoding_sizes",
    "SELECT memory_kind, cast(sum(length(id) + length(title)) AS bigint) AS plain_chars, cast(sum(length(title)) AS bigint) AS trimmed_chars, count(*) AS n FROM nodes GROUP BY memory_kind",
)
def _(s):
    return s.nodes.groupBy("memory_kind").agg(F.sum(F.length("id") + F.length("title")).alias("plain_chars"), F.sum(F.length("title")).cast("bigint").alias("trimmed_chars"), F.count("*").alias("n"))


# --- projections


@query("p1_summary", f"SELECT node_id, {summary_sql('content')} AS summary FROM current")
def _(s):
    return s.current.select("node_id", x.derive_summary(F.col("content")).alias("summary"))


@query(
    "p2_redundant_summary",
    f""", p AS (SELECT node_id, {summary_sql("content")} AS a, substr(content, 1, 120) AS b FROM current),
q AS (SELECT node_id, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS short, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS long FROM p)
SELECT node_id, short <> '' AND starts_with(long, regexp_replace(short, '…$', '')) AS redundant FROM q""",
)
def _(s):
    return s.current.select("node_id", x.summary_is_redundant(x.derive_summary(F.col("content")), F.substring("content", 1, 120)).alias("redundant"))


@query("p3_envelope", f"SELECT id, memory_kind AS kind, type, title, {summary_sql('content')} AS summary, project, updated_ms, rev, edge_count AS edges, invalidated_ms IS NOT NULL AS invalidated FROM enriched")
def _(s):
    return s.enriched.select("id", F.col("memory_kind").alias("kind"), "type", "title", x.derive_summary(F.col("content")).alias("summary"), "project", "updated_ms", "rev", F.col("edge_count").alias("edges"), (~t.live()).alias("invalidated"))


@query("p4_project_family", "SELECT id, split_part(project, '-', 1) AS family FROM nodes")
def _(s):
    return s.nodes.select("id", t.project_family(F.col("project")).alias("family"))


@query("p5_tokens", "SELECT node_id, cast(ceil(length(content) / 4.0) AS bigint) AS tokens FROM current")
def _(s):
    return s.current.select("node_id", x.estimate_tokens(F.col("content")).alias("tokens"))


@query("p6_symbol_rows", "SELECT id, 'mirror' AS memory_kind, 'symbol' AS type, qualified AS title, 1 AS rev, 0 AS edge_count FROM symbols")
def _(s):
    return s.symbols.select("id", F.lit("mirror").alias("memory_kind"), F.lit("symbol").alias("type"), F.col("qualified").alias("title"), F.lit(1).alias("rev"), F.lit(0).alias("edge_count"))


@query("p7_symbol_titles", "SELECT id, CASE WHEN t = '' THEN q ELSE t END AS title FROM (SELECT id, qualified || ':' || name AS q, string_split(qualified || ':' || name, ':')[-1] AS t FROM symbols) z")
def _(s):
    q = F.concat("qualified", F.lit(":"), "name")
    last = F.element_at(F.split(q, ":"), -1)
    return s.symbols.select("id", F.when(last == "", q).otherwise(last).alias("title"))


@query("p8_activity", "SELECT event_id, json_extract_string(props, '$.error') IS NULL AS ok FROM events")
def _(s):
    return s.table("events").select("event_id", F.get_json_object("props", "$.error").isNull().alias("ok"))


@query("p9_run_summary", "SELECT id, json_extract_string(proposal, '$.recommendation') AS recommendation, json_extract_string(proposal, '$.note') AS note FROM candidates")
def _(s):
    return s.candidates.select("id", F.get_json_object("proposal", "$.recommendation").alias("recommendation"), F.get_json_object("proposal", "$.note").alias("note"))


@query("p11_checkpoint_body", "SELECT id, '## Summary' || chr(10) || title || CASE WHEN ord % 2 = 0 THEN chr(10) || chr(10) || '## Decisions' || chr(10) || '- ' || type ELSE '' END AS body FROM nodes WHERE type = 'checkpoint' OR type = 'event_note'")
def _(s):
    parts = F.concat_ws("\n\n", F.concat(F.lit("## Summary\n"), "title"), F.when(F.col("ord") % 2 == 0, F.concat(F.lit("## Decisions\n- "), "type")))
    return s.nodes.where("type = 'checkpoint' OR type = 'event_note'").select("id", parts.alias("body"))


# --- joins


@query("j1_chunk_nodes", "SELECT chunk_id, v.node_id, title FROM vectors v JOIN nodes n ON n.id = v.node_id")
def _(s):
    return s.vectors.join(s.nodes.withColumnRenamed("id", "node_id"), "node_id").select("chunk_id", "node_id", "title")


REVIEWS = ", decided AS (SELECT src, dst, type FROM edges WHERE provenance = 'system' AND cast(round(weight * 100) AS bigint) % 3 = 0)"


def decided(s):
    return s.edges.where("provenance = 'system' AND cast(round(weight * 100) AS bigint) % 3 = 0").select("src", "dst", "type")


@query("j2_pending_reviews", REVIEWS + " SELECT e.src, e.dst, e.type FROM edges e LEFT JOIN decided d USING (src, dst, type) WHERE e.provenance = 'system' AND e.invalidated_ms IS NULL AND NOT EXISTS (SELECT 1 FROM decided x WHERE x.src = e.src AND x.dst = e.dst AND x.type = e.type)")
def _(s):
    return s.edges.where(t.live() & (F.col("provenance") == "system")).select("src", "dst", "type").join(decided(s), ["src", "dst", "type"], "left_anti")


@query("j3_coverage", "SELECT count(*) AS nodes, count(v.node_id) AS embedded FROM nodes n LEFT JOIN (SELECT DISTINCT node_id FROM vectors WHERE stale = 0) v ON v.node_id = n.id")
def _(s):
    v = s.vectors.where("stale = 0").select(F.col("node_id").alias("id")).distinct().withColumn("has", F.lit(1))
    return s.nodes.join(v, "id", "left").agg(F.count("*").alias("nodes"), F.count("has").alias("embedded"))


@query("j4_unembedded", f"SELECT id FROM nodes n WHERE {LIVE_AUTHORED} AND NOT EXISTS (SELECT 1 FROM vectors v WHERE v.node_id = n.id AND v.stale = 0)")
def _(s):
    return live_authored(s).select("id").join(s.vectors.where("stale = 0").select(F.col("node_id").alias("id")), "id", "left_anti")


@query("j5_incidence", "SELECT n.id, e.src, e.dst, e.type FROM nodes n JOIN edges e ON (e.src = n.id OR e.dst = n.id)")
def _(s):
    both = r.symmetrise(s.edges, "src", "dst", "type").withColumnRenamed("a", "id")
    return s.nodes.select("id").join(both, "id").select("id", "src", "dst", "type")


@query("j6_undirected_pairs", "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst")
def _(s):
    return r.undirected_pairs(s.edges)


@query("j7_nullsafe_project", "SELECT a.id AS x, b.id AS y FROM nodes a JOIN nodes b ON a.project IS NOT DISTINCT FROM b.project AND b.ord = a.ord + 18")
def _(s):
    b = s.nodes.select(F.col("id").alias("y"), F.col("project").alias("q"), (F.col("ord") - 18).alias("ord"))
    return s.nodes.join(b, "ord").where(F.col("project").eqNullSafe(F.col("q"))).select(F.col("id").alias("x"), "y")


def _ends(s, edges):
    p = s.nodes.select("id", "project", "invalidated_ms", "memory_kind")
    e = edges
    for end in ("src", "dst"):
        e = e.join(p.select(F.col("id").alias(end), F.col("project").alias(f"{end}_project"), F.col("invalidated_ms").alias(f"{end}_gone"), F.col("memory_kind").alias(f"{end}_kind")), end)
    return e


ENDS = ", ends AS (SELECT e.*, a.project AS src_project, b.project AS dst_project, a.invalidated_ms AS src_gone, b.invalidated_ms AS dst_gone, a.memory_kind AS src_kind, b.memory_kind AS dst_kind FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst)"
SAME = "(src_project IS NULL OR dst_project IS NULL OR split_part(src_project, '-', 1) = split_part(dst_project, '-', 1))"


@query("j8_same_family_links", ENDS + f" SELECT src, dst, type FROM ends WHERE {SAME}")
def _(s):
    return _ends(s, s.edges).where(t.same_family(F.col("src_project"), F.col("dst_project"))).select("src", "dst", "type")


@query("j9_asof_revision", f"SELECT node_id, max(rev) AS rev, length(max_by(content, rev)) AS chars FROM revisions WHERE ts_ms <= {NOW - 400 * HOUR} GROUP BY node_id")
def _(s):
    return r.as_of_revision(s.revisions, NOW - 400 * HOUR).select("node_id", "rev", F.length("content").cast("bigint").alias("chars"))


@query("j9_asof_many", "SELECT p.node_id, p.at_ms, max(rev) AS rev FROM (SELECT dst AS node_id, valid_from_ms AS at_ms FROM edges GROUP BY 1, 2) p JOIN revisions r ON r.node_id = p.node_id AND r.ts_ms <= p.at_ms GROUP BY p.node_id, p.at_ms")
def _(s):
    return r.as_of_join(s.edges.select(F.col("dst").alias("node_id"), F.col("valid_from_ms").alias("at_ms")).distinct(), s.revisions)


@query("j10_revised_links", "SELECT src, dst, type FROM edges e WHERE provenance = 'system' AND invalidated_ms IS NULL AND EXISTS (SELECT 1 FROM revisions r WHERE r.node_id = e.src AND r.rev > 1 AND r.ts_ms > e.valid_from_ms)")
def _(s):
    rev = s.revisions.where("rev > 1").groupBy(F.col("node_id").alias("src")).agg(F.max("ts_ms").alias("last"))
    return s.edges.where(t.live() & (F.col("provenance") == "system")).join(rev, "src").where("last > valid_from_ms").select("src", "dst", "type")


@query("j13_two_way_hop", "SELECT id, other, direction FROM (SELECT src AS id, dst AS other, 'out' AS direction FROM edges WHERE invalidated_ms IS NULL UNION ALL SELECT dst, src, 'in' FROM edges WHERE invalidated_ms IS NULL) h WHERE id IN (SELECT id FROM nodes)")
def _(s):
    e = s.edges.where(t.live())
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("out").alias("direction")).unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("in").alias("direction")))
    return both.join(s.nodes.select("id"), "id", "left_semi").select("id", "other", "direction")


@query("j17_suffix_paths", "SELECT DISTINCT f.path, p.tail FROM files f JOIN (SELECT DISTINCT substr(path, length(path) - 7) AS raw, string_split(path, '/')[-1] AS tail FROM files WHERE branch = 'main') p ON f.path = p.tail OR ends_with(f.path, '/' || p.tail)")
def _(s):
    # every suffix at a slash, met by equality instead of a nested loop
    parts = F.expr("transform(sequence(1, size(w)), i -> array_join(slice(w, i, size(w) - i + 1), '/'))")
    tails = s.files.where("branch = 'main'").select(F.element_at(F.split("path", "/"), -1).alias("tail")).distinct()
    return s.files.select("path").distinct().withColumn("w", F.split("path", "/")).select("path", F.explode(parts).alias("tail")).join(tails, "tail").select("path", "tail").distinct()


@query("j18_retired_members", "SELECT id FROM candidates WHERE status = 'pending' AND (a IN (SELECT id FROM nodes WHERE invalidated_ms IS NOT NULL) OR b IN (SELECT id FROM nodes WHERE invalidated_ms IS NOT NULL))")
def _(s):
    gone = s.nodes.where(~t.live()).select(F.col("id").alias("member"))
    return s.candidates.where("status = 'pending'").select("id", F.explode(F.array("a", "b")).alias("member")).join(gone, "member", "left_semi").select("id").distinct()


@query("j19_anchor_checkpoint", f"""SELECT n.id, arg_max(c.id, c.created_ms) AS anchor FROM nodes n JOIN nodes c ON c.created_by_session = n.created_by_session AND c.id <> n.id
 AND c.type = 'checkpoint' AND c.invalidated_ms IS NULL WHERE n.{LIVE_AUTHORED.replace(" AND m", " AND n.m")} GROUP BY n.id""")
def _(s):
    c = s.nodes.where(t.live() & (F.col("type") == "checkpoint")).select("id", "created_by_session", "created_ms")
    return r.latest_other(live_authored(s).select("id", "created_by_session"), c, "created_by_session", "id", "created_ms", "anchor")


@query("j20_first_candidate", "SELECT unit_id, arg_min(candidate, pos) AS path FROM imports WHERE candidate IN (SELECT path FROM files WHERE branch = 'main' AND invalidated_ms IS NULL) GROUP BY unit_id")
def _(s):
    paths = s.files.where((F.col("branch") == "main") & t.live()).select(F.col("path").alias("candidate"))
    return s.imports.join(paths, "candidate", "left_semi").groupBy("unit_id").agg(F.min_by("candidate", "pos").alias("path"))


@query("j16_importers", "SELECT DISTINCT unit_id, candidate FROM imports WHERE candidate IN (SELECT path FROM files WHERE path LIKE '%/m7/%')")
def _(s):
    return s.imports.join(s.files.where("path LIKE '%/m7/%'").select(F.col("path").alias("candidate")), "candidate", "left_semi").select("unit_id", "candidate").distinct()


@query("j15_scope_files", f"SELECT branch, path, unit_id FROM files WHERE branch = 'dev' AND valid_from_ms <= {T0 + 60 * HOUR} AND (invalidated_ms IS NULL OR invalidated_ms > {T0 + 60 * HOUR})")
def _(s):
    scopes = s.spark.createDataFrame([("r1", "dev")], "repo_id string, branch string")  # one row for each scope asked for
    return s.files.join(F.broadcast(scopes), ["repo_id", "branch"]).where(t.edge_as_of(T0 + 60 * HOUR)).select("branch", "path", "unit_id")


# --- aggregations

KINDS = ("episodic", "semantic", "mirror", "imported")


@query("a1_kind_counts", "SELECT k.kind, count(n.id) AS n FROM (VALUES ('episodic'), ('semantic'), ('mirror'), ('imported')) k(kind) LEFT JOIN nodes n ON n.memory_kind = k.kind AND n.invalidated_ms IS NULL GROUP BY k.kind")
def _(s):
    vocabulary = s.spark.createDataFrame([(k,) for k in KINDS], "kind string")
    counted = s.nodes.where(t.live()).groupBy(F.col("memory_kind").alias("kind")).agg(F.count("*").alias("n"))
    return vocabulary.join(counted, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("a2_queue_health", "SELECT count(*) FILTER (attempts < 5) AS backlog, count(*) FILTER (attempts >= 5) AS parked FROM queue")
def _(s):
    return s.queue.agg(F.count_if(F.col("attempts") < 5).alias("backlog"), F.count_if(F.col("attempts") >= 5).alias("parked"))


@query("a3_attempts_hist", "SELECT attempts, count(*) AS n FROM queue GROUP BY attempts")
def _(s):
    return s.queue.groupBy("attempts").agg(F.count("*").alias("n"))


@query("a4_queue_totals", "SELECT count(*) AS total, count(last_error) AS with_errors, min(enqueued_ms) AS oldest FROM queue")
def _(s):
    return s.queue.agg(F.count("*").alias("total"), F.count("last_error").alias("with_errors"), F.min("enqueued_ms").alias("oldest"))


@query("a5_chunk_coverage", "SELECT count(*) FILTER (stale = 0) AS active, count(*) FILTER (stale = 1) AS stale, count(DISTINCT node_id) FILTER (stale = 0) AS nodes FROM vectors")
def _(s):
    return s.vectors.agg(F.count_if(F.col("stale") == 0).alias("active"), F.count_if(F.col("stale") == 1).alias("stale"), F.count_distinct(F.when(F.col("stale") == 0, F.col("node_id"))).alias("nodes"))


@query("a6_distinct_hashes", "SELECT count(DISTINCT embed_hash) AS hashes FROM symbols")
def _(s):
    return s.symbols.agg(F.count_distinct("embed_hash").alias("hashes"))


@query("a7_link_degree", "SELECT n.id, cast(coalesce(d.n, 0) AS bigint) AS degree FROM nodes n LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges WHERE type = 'similar_to' AND invalidated_ms IS NULL UNION ALL SELECT dst FROM edges WHERE type = 'similar_to' AND invalidated_ms IS NULL AND src <> dst) z GROUP BY id) d USING (id)")
def _(s):
    d = r.degree(s.edges.where(t.live() & (F.col("type") == "similar_to")))
    return s.nodes.select("id").join(d, "id", "left").select("id", F.coalesce("edge_count", F.lit(0)).cast("bigint").alias("degree"))


RANKED = """, inc AS (SELECT src AS id, dst AS other, src, dst, weight FROM edges WHERE type = 'similar_to' AND invalidated_ms IS NULL UNION ALL SELECT dst, src, src, dst, weight FROM edges WHERE type = 'similar_to' AND invalidated_ms IS NULL AND src <> dst),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, other) AS rank FROM inc)"""


def ranked_links(s):
    """The links at each node by weight. Links both ways between two nodes can weigh the same, which the SQL leaves open;
    here the one with the smaller source comes first at both of its ends, so reruns agree."""
    both = r.symmetrise(s.edges.where(t.live() & (F.col("type") == "similar_to")), "src", "dst", "weight")
    w = Window.partitionBy("a").orderBy(F.desc("weight"), "b", "src")
    return both.withColumn("rank", F.row_number().over(w))


@query("a8_over_cap", RANKED + " SELECT src, dst FROM rk GROUP BY src, dst HAVING min(rank) > 1")
def _(s):
    return ranked_links(s).groupBy("src", "dst").agg(F.min("rank").alias("best")).where("best > 1").select("src", "dst")


@query("w1_degree_rank", RANKED + " SELECT id, other, cast(rank AS int) AS rank FROM rk")
def _(s):
    return ranked_links(s).select(F.col("a").alias("id"), F.col("b").alias("other"), "rank")


@query("a10_job_counts", "SELECT state, count(*) AS n FROM jobs GROUP BY state")
def _(s):
    return s.jobs.groupBy("state").agg(F.count("*").alias("n"))


@query("a11_review_counts", REVIEWS + " SELECT (SELECT count(*) FROM decided) AS decided, (SELECT count(*) FROM edges e WHERE provenance = 'system' AND invalidated_ms IS NULL AND NOT EXISTS (SELECT 1 FROM decided x WHERE x.src = e.src AND x.dst = e.dst AND x.type = e.type)) AS pending")
def _(s):
    pending = s.edges.where(t.live() & (F.col("provenance") == "system")).select("src", "dst", "type").join(decided(s), ["src", "dst", "type"], "left_anti")
    return decided(s).agg(F.count("*").alias("decided")).crossJoin(pending.agg(F.count("*").alias("pending")))  # one row each


@query("a12_principals", "SELECT n.id, string_agg(DISTINCT z.principal_id, ',' ORDER BY z.principal_id) AS principals FROM nodes n JOIN (SELECT node_id AS id, session_id FROM revisions UNION SELECT id, created_by_session FROM nodes) w USING (id) JOIN sessions z ON z.id = w.session_id GROUP BY n.id")
def _(s):
    who = s.revisions.select(F.col("node_id").alias("id"), "session_id").union(s.nodes.select("id", "created_by_session"))
    named = who.join(s.sessions.withColumnRenamed("id", "session_id"), "session_id")
    return named.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("principal_id")), ",").alias("principals"))


WEIGHTS = ", weights(principal_id, weight) AS (VALUES ('P0', 0.5), ('P1', 1.0), ('P2', 0.8), ('P3', 0.0))"


def weights(s):
    return s.spark.createDataFrame([("P0", 0.5), ("P1", 1.0), ("P2", 0.8), ("P3", 0.0)], "principal_id string, weight double")


@query("a13_weakest_principal", WEIGHTS + " SELECT n.id, cast(min(w.weight) AS double) AS weight, arg_min(w.principal_id, w.weight) AS principal_id FROM nodes n JOIN sessions z ON z.id = n.created_by_session JOIN weights w ON w.principal_id = z.principal_id WHERE w.weight <> 1 GROUP BY n.id")
def _(s):
    rows = s.nodes.select("id", F.col("created_by_session").alias("sid")).join(s.sessions.withColumnRenamed("id", "sid"), "sid").join(weights(s).where("weight <> 1"), "principal_id")
    return rows.groupBy("id").agg(F.min(F.struct("weight", "principal_id")).alias("w")).select("id", "w.weight", "w.principal_id")


#: Notes in slices of 200 characters, to their end.
LEVELS = range(1, 6)
#: ``chunks``: the stretches of notes between headings, with the path of headings above them.
SECTIONS = r""", ln AS (SELECT node_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pt FROM outlined),
lf AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY pt) % 2 = 1 AS code FROM ln),
lv AS (SELECT *, CASE WHEN NOT code AND regexp_matches(line, '^#{1,6}\s+\S') THEN length(regexp_extract(line, '^#+')) END AS level FROM lf), lq AS (SELECT *, count(level) OVER (PARTITION BY node_id ORDER BY pt) AS seq FROM lv),
hd AS (SELECT node_id, seq, level, 'H' || level || ': ' || regexp_extract(line, '^#+\s+(.*\S)', 1) AS name FROM lq WHERE level IS NOT NULL),
hp AS (SELECT node_id, seq, level, name, """ + ", ".join(f"max(CASE WHEN level <= {k} THEN seq END) OVER w AS le{k}, max(CASE WHEN level = {k} THEN seq END) OVER w AS eq{k}, last_value(CASE WHEN level = {k} THEN name END IGNORE NULLS) OVER w AS n{k}" for k in LEVELS) + r""" FROM hd WINDOW w AS (PARTITION BY node_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
pa AS (SELECT node_id, seq, array_to_string(list_filter([""" + ", ".join(f"CASE WHEN level > {k} AND eq{k} = le{k} THEN n{k} END" for k in LEVELS) + r""", name], lambda z: z IS NOT NULL), ' > ') AS section FROM hp),
chunks AS (SELECT t.node_id, t.seq::INT AS seq, section, text FROM (SELECT node_id, seq, string_agg(line, chr(10) ORDER BY pt) AS text FROM lq GROUP BY ALL) t LEFT JOIN pa USING (node_id, seq) WHERE NOT regexp_full_match(text, '\s*'))"""
DETAILS = "list_contains(string_split(coalesce(section, '(preamble)'), ' > '), 'H2: Details')"


def chunks(s):
    return sec.split(s.outlined, "node_id", "body")


@query("a14_section_sizes", SECTIONS + " SELECT node_id, cast(row_number() OVER (PARTITION BY node_id ORDER BY first) AS int) AS place, section, chars FROM (SELECT node_id, coalesce(section, '(preamble)') AS section, min(seq) AS first, cast(sum(length(text)) AS bigint) AS chars FROM chunks GROUP BY ALL) z")
def _(s):
    return sec.outline(chunks(s), "node_id")


@query("a15_section_text", SECTIONS + " SELECT node_id, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS body FROM chunks WHERE " + DETAILS + " GROUP BY node_id")
def _(s):
    asked = s.nodes.select(F.col("id").alias("node_id"), F.lit("H2: Details").alias("section"))
    return sec.narrow(asked, chunks(s), "node_id").where("error IS NULL").select("node_id", F.col("text").alias("body"))


@query("a17_watermark", "SELECT cast(count(*) AS varchar) || ':' || cast(count(invalidated_ms) AS varchar) AS mark FROM files")
def _(s):
    return s.files.agg(F.concat(F.count("*").cast("string"), F.lit(":"), F.count("invalidated_ms").cast("string")).alias("mark"))


@query("a18_instrumentation", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 100) AS instrumented, min(CASE WHEN value > 100 THEN event_id END) AS first FROM events GROUP BY event_type")
def _(s):
    return s.table("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("instrumented"), F.min(F.when(F.col("value") > 100, F.col("event_id"))).alias("first"))


@query("a19_writer_counts", "SELECT coalesce(z.client, '(unnamed)') AS writer, count(*) AS n FROM revisions r JOIN sessions z ON z.id = r.session_id GROUP BY 1")
def _(s):
    return s.revisions.join(s.sessions.select(F.col("id").alias("session_id"), "client"), "session_id").groupBy(F.coalesce("client", F.lit("(unnamed)")).alias("writer")).agg(F.count("*").alias("n"))


@query("a20_percentiles", "SELECT type, round(avg(weight), 6) AS mean, round(stddev_pop(weight), 6) AS sd, list_sort(list(weight))[1 + cast(floor(0.9 * count(*)) AS bigint)] AS p90 FROM edges GROUP BY type")
def _(s):
    # nearest rank by value counts: weights repeat, so the sorted list is never gathered in one task
    counts = s.edges.groupBy("type", "weight").agg(F.count("*").alias("n"))
    w = Window.partitionBy("type").orderBy("weight").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(Window.partitionBy("type"))
    p = counts.withColumn("upto", F.sum("n").over(w)).where(F.col("upto") > F.lit(0)).withColumn("total", total).where("upto > floor(0.9 * total)").groupBy("type").agg(F.min("weight").alias("p90"))
    stats = s.edges.groupBy("type").agg(F.round(F.avg("weight"), 6).alias("mean"), F.round(F.stddev_pop("weight"), 6).alias("sd"))
    return stats.join(p, "type")


AUC = ", z AS (SELECT weight, provenance = 'agent' AS pos FROM edges), rk AS (SELECT pos, rank() OVER (ORDER BY weight) + (count(*) OVER (PARTITION BY weight) - 1) / 2.0 AS r FROM z)"


def auc(rows, score: str, positive: str):
    """Mann-Whitney from value counts: ties count one half; nothing is sorted but distinct scores."""
    by = rows.groupBy(score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return by.withColumn("below", below).agg(F.round(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n")), 6).alias("auc"))


@query("a21_auc", AUC + " SELECT round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * 1.0 * count(*) FILTER (NOT pos)), 6) AS auc FROM rk")
def _(s):
    return auc(s.edges.select("weight", (F.col("provenance") == "agent").alias("pos")), "weight", "pos")


@query("a22_cohens_d", "SELECT round((avg(weight) FILTER (provenance = 'agent') - avg(weight) FILTER (provenance = 'system')) / sqrt((var_pop(weight) FILTER (provenance = 'agent') + var_pop(weight) FILTER (provenance = 'system')) / 2), 6) AS d FROM edges")
def _(s):
    of = lambda p: F.when(F.col("provenance") == p, F.col("weight"))
    return s.edges.agg(F.round((F.avg(of("agent")) - F.avg(of("system"))) / F.sqrt((F.var_pop(of("agent")) + F.var_pop(of("system"))) / 2), 6).alias("d"))


@query("a23_principal_usage", "SELECT z.principal_id, count(*) AS calls, count(*) FILTER (action = 'get') AS gets FROM log l JOIN sessions z ON z.id = l.session_id WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' GROUP BY z.principal_id")
def _(s):
    recent = s.log.where("ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00'")
    return recent.join(s.sessions.withColumnRenamed("id", "session_id"), "session_id").groupBy("principal_id").agg(F.count("*").alias("calls"), F.count_if(F.col("action") == "get").alias("gets"))


@query("a25_majority_rate", "SELECT round(greatest(count(*) FILTER (provenance = 'agent'), count(*) FILTER (provenance <> 'agent')) * 1.0 / count(*), 6) AS rate FROM edges")
def _(s):
    n = F.count_if(F.col("provenance") == "agent")
    return s.edges.agg(F.round(F.greatest(n, F.count("*") - n) / F.count("*"), 6).alias("rate"))


# --- windows and top k


@query("w3_first_per_key", "SELECT name, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY kind, qualified, id) AS n FROM symbols) z WHERE n = 1")
def _(s):
    return r.first_per_key(s.symbols, ["name"], [F.col("kind"), F.col("qualified"), F.col("id")]).select("name", "id")


@query("w5_minmax", "SELECT src, dst, type, round(CASE WHEN hi > lo THEN (weight - lo) / (hi - lo) ELSE 1 END, 6) AS scaled FROM (SELECT *, min(weight) OVER (PARTITION BY type) AS lo, max(weight) OVER (PARTITION BY type) AS hi FROM edges) z")
def _(s):
    low = s.edges.groupBy("type").agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))  # six types: aggregated, then joined back
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("weight") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return s.edges.join(low, "type").select("src", "dst", "type", F.round(scaled, 6).alias("scaled"))


@query("w6_budget", """, it AS (SELECT session, id, tokens, row_number() OVER (PARTITION BY session ORDER BY moment DESC, id) AS n FROM (SELECT created_by_session AS session, node_id AS id, ts_ms AS moment, cast(ceil(length(content) / 4.0) AS bigint) AS tokens
  FROM current JOIN nodes ON id = node_id) r WHERE tokens > 0),
walk(session, n, used, id, taken) AS (SELECT DISTINCT session, cast(0 AS bigint), cast(0 AS bigint), cast(NULL AS varchar), false FROM it
  UNION ALL SELECT w.session, it.n, CASE WHEN used + tokens <= 1500 THEN used + tokens ELSE used END, it.id, used + tokens <= 1500 FROM walk w JOIN it ON it.session = w.session AND it.n = w.n + 1)
SELECT session, id FROM walk WHERE taken UNION ALL SELECT created_by_session, node_id FROM current JOIN nodes ON id = node_id WHERE length(content) = 0""")
def _(s):
    rows = s.current.join(s.nodes.select(F.col("id").alias("node_id"), "created_by_session"), "node_id").select(F.col("created_by_session").alias("session"), (-F.col("ts_ms")).alias("newest"), F.col("node_id").alias("id"), x.estimate_tokens(F.col("content")).alias("tokens"))
    return r.within_budget(rows, "session", ["newest"], "tokens", 1500, "id")


@query("w8_backlog_trend", """, h AS (SELECT event_id, user_id, ts, value, lag(value) OVER w AS prev, lag(value, 5) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, min(CASE WHEN value >= prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS up FROM h)
SELECT event_id FROM g WHERE up = 1 AND first IS NOT NULL AND value > first""")
def _(s):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")  # one series for each user
    h = s.table("events").select("event_id", "user_id", "ts", "value", F.lag("value").over(w).alias("prev"), F.lag("value", 5).over(w).alias("first"))
    up = F.min(F.when(F.col("value") >= F.col("prev"), 1).otherwise(0)).over(w.rowsBetween(-4, 0))
    return h.withColumn("up", up).where("up = 1 AND first IS NOT NULL AND value > first").select("event_id")


@query("w9_sliding_quota", "SELECT event_id, count(*) OVER (PARTITION BY session_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS calls FROM log")
def _(s):
    ms = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("session_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return s.log.withColumn("us", ms).select("event_id", F.count("*").over(w).alias("calls"))


@query("k3_recent", f"SELECT id, 'task' AS list FROM (SELECT id FROM enriched WHERE {LIVE_AUTHORED} AND type = 'task' ORDER BY updated_ms DESC, id DESC LIMIT 10) a UNION ALL SELECT id, 'checkpoint' FROM (SELECT id FROM enriched WHERE {LIVE_AUTHORED} AND type = 'checkpoint' ORDER BY updated_ms DESC, id DESC LIMIT 2) b UNION ALL SELECT id, 'semantic' FROM (SELECT id FROM enriched WHERE {LIVE_AUTHORED} AND memory_kind = 'semantic' ORDER BY updated_ms DESC, id DESC LIMIT 15) c")
def _(s):
    rows = live_authored(s).join(s.current.select(F.col("node_id").alias("id"), F.col("ts_ms").alias("updated_ms")), "id")
    top = lambda cond, n, name: rows.where(cond).orderBy(F.desc("updated_ms"), F.desc("id")).limit(n).select("id", F.lit(name).alias("list"))
    return top("type = 'task'", 10, "task").unionByName(top("type = 'checkpoint'", 2, "checkpoint")).unionByName(top("memory_kind = 'semantic'", 15, "semantic"))


@query("k4_keyset_page", "SELECT id, score, detected_ms FROM candidates WHERE status = 'pending' AND (score < 0.65 OR (score = 0.65 AND (detected_ms > 1704100000000 OR (detected_ms = 1704100000000 AND id > 'K')))) ORDER BY score DESC, detected_ms, id LIMIT 26")
def _(s):
    return r.keyset_page(s.candidates.where("status = 'pending'"), (0.65, 1704100000000, "K"), 25).select("id", "score", "detected_ms")


@query("k7_largest_projects", "SELECT project, count(*) AS n FROM nodes WHERE invalidated_ms IS NULL AND project IS NOT NULL GROUP BY project ORDER BY n DESC, project LIMIT 7")
def _(s):
    return s.nodes.where(t.live() & F.col("project").isNotNull()).groupBy("project").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project").limit(7)


@query("k5_hash_sample", """SELECT item_id, list_reduce(list_prepend(cast(2166136261 AS bigint), list_transform(regexp_extract_all(text, '(?s).'), lambda c: cast(unicode(c) AS bigint))), lambda h, u: (xor(h, u) * 16777619) & 4294967295) AS h
FROM benchmark ORDER BY h, item_id LIMIT 20""")
def _(s):
    return s.table("benchmark").select("item_id", x.fnv1a(F.col("text")).alias("h")).orderBy("h", "item_id").limit(20)


# --- sets


@query("u1_principal_union", "SELECT created_by_session AS session_id FROM nodes UNION SELECT session_id FROM revisions")
def _(s):
    return s.nodes.select(F.col("created_by_session").alias("session_id")).union(s.revisions.select("session_id")).distinct()


@query("u2_incident_edges", "SELECT src AS id, type FROM edges WHERE invalidated_ms IS NULL UNION ALL SELECT dst, type FROM edges WHERE invalidated_ms IS NULL AND src <> dst")
def _(s):
    return r.symmetrise(s.edges.where(t.live()), "type").select(F.col("a").alias("id"), "type")


@query("u4_commit_delta", """, b AS (SELECT path, unit_id FROM files WHERE branch = 'main' AND invalidated_ms IS NULL), a AS (SELECT path, unit_id FROM files WHERE branch = 'dev' AND invalidated_ms IS NULL)
SELECT path, CASE WHEN b.unit_id IS NULL THEN 'added' WHEN a.unit_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (path) WHERE b.unit_id IS DISTINCT FROM a.unit_id""")
def _(s):
    live = s.files.where(t.live())
    return r.branch_delta(live.where("branch = 'main'"), live.where("branch = 'dev'"))


@query("d2_scd2_commit", f""", m AS (SELECT path, unit_id, valid_from_ms, invalidated_ms FROM files WHERE branch = 'main'), a AS (SELECT path, unit_id FROM files WHERE branch = 'dev' AND invalidated_ms IS NULL)
SELECT path, unit_id, valid_from_ms, CASE WHEN invalidated_ms IS NULL AND (path, unit_id) NOT IN (SELECT (path, unit_id) FROM a) THEN {NOW} ELSE invalidated_ms END AS invalidated_ms FROM m
UNION ALL SELECT path, unit_id, {NOW}, NULL FROM a WHERE (path, unit_id) NOT IN (SELECT (path, unit_id) FROM m WHERE invalidated_ms IS NULL)""")
def _(s):
    return r.scd2_commit(s.files.where("branch = 'main'").select("path", "unit_id", "valid_from_ms", "invalidated_ms"), s.files.where((F.col("branch") == "dev") & t.live()).select("path", "unit_id"), NOW)


@query("st9_active_episodic", f"SELECT id FROM nodes WHERE memory_kind <> 'episodic' OR (consolidated_ms IS NULL AND created_ms >= {NOW - 7 * DAY})")
def _(s):
    return s.nodes.where(t.active_episodic(t.active_since(NOW))).select("id")
