"""Consolidation, links and citations, the code index, and remaining reads and checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import graph as g
from tessera.operators import lifecycle as lc
from tessera.operators import sections as sec
from tessera.operators import relational as r
from tessera.operators import temporal as t
from tessera.operators import text as x
from tessera.operators import vector as v
from tessera.operators import writing as wr
from tessera.sources.corpus import DAY, NOW

from .registry import query
from .relational import ENDS, LIVE_AUTHORED, RANKED, SECTIONS, _ends, chunks, decided, live_authored, ranked_links
from .retrieval import KNN, TOK, asked_vectors, bm25_sql, fresh

SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


# --- text functions


@query("x1_slugify", f"SELECT id, {SLUG.format('title')} AS slug FROM nodes")
def _(s):
    return s.nodes.select("id", x.slugify(F.col("title")).alias("slug"))


LINKS = rf""", bare AS (SELECT id, regexp_replace(body, '```[\s\S]*?(?:```|$)|`[^`\n]*`', ' ', 'g') AS b FROM linked),
raws AS (SELECT id, unnest(regexp_extract_all(b, '\[\[([^\]|#]+)', 1)) AS raw, generate_subscripts(regexp_extract_all(b, '\[\[([^\]|#]+)', 1), 1) - 1 AS pos FROM bare),
wl AS (SELECT id, pos, trim(raw) AS raw, {SLUG.format("trim(raw)")} AS slug FROM raws),
wk AS (SELECT id, slug, cast(min(pos) AS int) AS pos FROM wl WHERE length(slug) >= 2 AND slug NOT IN ('id', 'ids', 'ulid', 'node', 'node-id', 'name', 'title', 'slug', 'link', 'links', 'wikilink', 'wikilinks', 'target', 'x', 'y', 'foo', 'bar') AND NOT regexp_matches(raw, '[<>…]|\.\.\.') GROUP BY id, slug)"""

RESOLVED = LINKS + f""", ti AS (SELECT DISTINCT id, {SLUG.format("title")} AS ts FROM nodes WHERE invalidated_ms IS NULL), ask AS (SELECT DISTINCT slug FROM wk),
ex AS (SELECT slug, count(*) AS n, min(id) AS id FROM ask JOIN ti ON ts = slug GROUP BY slug),
pf AS (SELECT slug, count(*) AS n, min(id) AS id FROM ask JOIN ti ON contains(slug, '-') AND starts_with(ts, slug || '-') GROUP BY slug),
rs AS (SELECT slug, CASE WHEN ex.n = 1 THEN 'exact' WHEN ex.n > 1 THEN 'ambiguous' WHEN pf.n = 1 THEN 'prefix' WHEN pf.n > 1 THEN 'ambiguous' ELSE 'unknown' END AS kind,
  CASE WHEN ex.n = 1 THEN ex.id WHEN ex.n IS NULL AND pf.n = 1 THEN pf.id END AS target FROM ask LEFT JOIN ex USING (slug) LEFT JOIN pf USING (slug))"""


def links(s):
    return x.wikilinks(s.linked, "id", "body")


def resolved(s):
    return x.resolve_slugs(links(s), s.nodes.where(t.live()).select("id", "title"))


@query("x2_wikilinks", LINKS + " SELECT id, slug, pos FROM wk")
def _(s):
    return links(s).select("id", "slug", "pos")


@query("x4_link_context", "SELECT id, substr(body, greatest(1, instr(body, '[[') - 20), 60) AS context FROM linked")
def _(s):
    return s.linked.select("id", F.expr("substr(body, greatest(1, instr(body, '[[') - 20), 60)").alias("context"))


@query("x5_id_targets", "SELECT id, regexp_matches(lower(id || id || '0123456'), '^[0-7][0-9a-hjkmnp-tv-z]{25}$') AS is_id FROM nodes")
def _(s):
    return s.nodes.select("id", x.id_target(F.lower(F.concat("id", "id", F.lit("0123456")))).isNotNull().alias("is_id"))


@query("x6_resolve", RESOLVED + " SELECT slug, kind, target FROM rs")
def _(s):
    return resolved(s)


@query("j22_slug_prefix", RESOLVED + " SELECT kind, count(*) AS n FROM rs GROUP BY kind")
def _(s):
    return resolved(s).groupBy("kind").agg(F.count("*").alias("n"))


CITED = r""", cr AS (SELECT id, trim(unnest(regexp_extract_all(body, '`([^`\n]{2,80})`', 1))) AS raw FROM linked), cn AS (SELECT id, raw, regexp_extract(regexp_extract(raw, '([^:]*)$', 1), '^([^(]*)', 1) AS name FROM cr),
ct AS (SELECT DISTINCT id, name FROM cn WHERE regexp_matches(name, '[a-z0-9][A-Z]') OR contains(name, '_') OR regexp_matches(raw, '[./:]'))"""


@query("x7_citations", CITED + " SELECT id, name FROM ct")
def _(s):
    return x.cited_symbols(s.linked, "id", "body")


@query("x8_own_repo", "SELECT id, project IS NOT NULL AND (project = 'src1' OR starts_with('src1', project || '-')) AS own FROM nodes")
def _(s):
    p = F.col("project")
    return s.nodes.select("id", F.coalesce((p == "src1") | F.startswith(F.lit("src1"), F.concat(p, F.lit("-"))), F.lit(False)).alias("own"))


SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
NAME = "split_part(split_part(substr(p, 3, length(p) - 4), '|', 1), '#', 1)"
FIRST = r"split_part(split_part(regexp_extract(body, '\[\[([^\]]+)\]\]', 1), '|', 1), '#', 1)"
MEANT = f"starts_with(p, '[[') AND {SLUG.format(NAME)} = want"


@query("x3_rewrite_links", rf""", pc AS (SELECT id, regexp_extract_all(body, '{wr.PIECES}') AS ps, {SLUG.format(FIRST)} AS want FROM linked)
SELECT id, sha256(array_to_string(list_transform(ps, lambda p: CASE WHEN {MEANT} THEN '[[' || id || substr(p, 3 + length({NAME})) ELSE p END), '')) AS text_sha, cast(len(list_filter(ps, lambda p: {MEANT})) AS int) AS n FROM pc""")
def _(s):
    return wr.rewrite_links(s.linked, "id", "body", F.col("id"))


@query("x9_chunks")
def _(s):
    return wr.chunk(s.current.select("node_id", "content"), "node_id", "content")


@query("x10_sections", SECTIONS + " SELECT node_id, seq, coalesce(section, '(preamble)') AS section FROM chunks")
def _(s):
    return chunks(s).select("node_id", "seq", sec.section_name(F.col("section")).alias("section"))


@query("x12_anchors", r"""SELECT id, anchor FROM (SELECT id, unnest(list_distinct(list_concat(list_concat(regexp_extract_all(body, '\[\[[^\]]+\]\]'), regexp_extract_all(body, 'https?://[^\s)\]>]+')),
  list_concat(regexp_extract_all(body, '\b\d+(?:\.\d+)?\b'), regexp_extract_all(body, '`[^`\n]+`'))))) AS anchor FROM linked) a""")
def _(s):
    return wr.anchors(s.linked, "id", "body")


LINT = r""", w AS (SELECT id, trim(title) AS t, body FROM linked), sm AS (SELECT id, t, body, coalesce(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#'))[1], '') AS line,
  list_filter(regexp_split_to_array(t, '\s+'), lambda x: regexp_matches(x, '^\p{L}') AND length(x) > 3) AS ws FROM (SELECT l.id, trim(n.title) AS t, l.body FROM linked l JOIN nodes n USING (id)) q),
li AS (SELECT id, 'title_long' AS rule FROM sm WHERE length(t) > 100
  UNION ALL SELECT id, 'title_label' FROM sm WHERE NOT contains(t, ':') AND len(ws) >= 3 AND len(list_filter(ws, lambda x: regexp_matches(x, '^\p{Lu}'))) >= 0.75 * len(ws)
  UNION ALL SELECT id, 'summary_not_standalone' FROM sm WHERE length(line) < 40 OR regexp_matches(line, '(?i)^(this|that|it|these|those|they|see|above|below|here|это|этот|эта|он|она|оно|они|см\.?)([^\p{L}]|$)') OR starts_with(line, '[[')
  UNION ALL SELECT id, 'relative_date' FROM sm WHERE regexp_matches(t || chr(10) || body, '(?i)(^|[^\p{L}])(today|yesterday|tomorrow|tonight|this week|last week|next week)([^\p{L}]|$)') AND NOT regexp_matches(t || chr(10) || body, '\d{4}-\d{2}-\d{2}'))"""
LINT = LINT.replace(", w AS (SELECT id, trim(title) AS t, body FROM linked)", "")


def linted(s):
    return x.lint(s.linked.join(s.nodes.select("id", "title"), "id"), "id", "title", "body")


@query("x14_lint", LINT + " SELECT id, rule FROM li")
def _(s):
    return linted(s)


@query("z14_lint_report", LINT + " SELECT rule, count(*) AS n FROM li GROUP BY rule")
def _(s):
    return linted(s).groupBy("rule").agg(F.count("*").alias("n"))


@query("x15_remote", "SELECT DISTINCT lower('Host' || cast(p_size % 5 AS varchar) || '.org/' || p_brand || '/repo') AS remote FROM part")
def _(s):
    url = F.concat(F.lit("git@Host"), (F.col("p_size") % 5).cast("string"), F.lit(".org:"), "p_brand", F.lit("/repo.git"))
    return s.table("part").select(x.normalize_remote(url).alias("remote")).distinct()


@query("x17_candidate_hash", "SELECT id, substr(sha256(kind || chr(0) || least(a, b) || chr(0) || greatest(a, b)), 1, 24) AS hash FROM candidates")
def _(s):
    return s.candidates.select("id", x.member_hash(F.col("kind"), F.array("a", "b")).alias("hash"))


@query("x16_ulid_shaped", """, hx AS (SELECT id, '00' || array_to_string(list_transform(range(1, 33), lambda i: format('{:04b}', strpos('0123456789abcdef', substr(sha256(id), i, 1)) - 1)), '') AS bits FROM nodes)
SELECT id, array_to_string(list_transform(range(26), lambda i: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', cast(1 + list_sum(list_transform(range(5), lambda j: cast(substr(bits, cast(5 * i + j + 1 AS bigint), 1) AS int) * (16 >> j))) AS bigint), 1)), '') AS ulid FROM hx""")
def _(s):
    return wr.ulid_shaped(s.nodes.select("id"), "id")


@query("x18_age_buckets", f"SELECT CASE WHEN d < 7 THEN '<7d' WHEN d < 30 THEN '7-30d' WHEN d < 90 THEN '30-90d' ELSE '>90d' END AS bucket, count(*) AS n FROM (SELECT ({NOW} - created_ms) / 86400000.0 AS d FROM nodes) z GROUP BY 1")
def _(s):
    return s.nodes.groupBy(x.age_bucket((NOW - F.col("created_ms")) / 86_400_000.0).alias("bucket")).agg(F.count("*").alias("n"))


@query("x19_merged_queries", r"SELECT regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS q, count(*) AS n, cast(count(DISTINCT lang) AS bigint) AS labels FROM documents GROUP BY 1")
def _(s):
    q = x.normalize_query(F.col("text"))
    return s.table("documents").groupBy(q.alias("q")).agg(F.count("*").alias("n"), F.size(F.collect_set("lang")).cast("bigint").alias("labels"))


@query("x20_long_body", "SELECT node_id, CASE WHEN length(content) > 4000 THEN CASE WHEN ceil(length(content) / 2000.0) >= 2 THEN 'sections' ELSE 'split' END END AS note FROM current")
def _(s):
    n = F.length("content")
    return s.current.select("node_id", F.when(n > 4000, F.when(F.ceil(n / 2000) >= 2, "sections").otherwise("split")).alias("note"))


@query("x21_job_tone", "SELECT id, CASE WHEN regexp_matches(state, 'fail|dead') THEN 'bad' WHEN regexp_matches(state, 'run|pend') THEN 'busy' ELSE 'good' END AS tone FROM jobs")
def _(s):
    return s.jobs.select("id", F.when(F.col("state").rlike("fail|dead"), "bad").when(F.col("state").rlike("run|pend"), "busy").otherwise("good").alias("tone"))


@query("x22_edge_rank", "SELECT src, dst, type, CASE WHEN type = 'supersedes' THEN 5 WHEN provenance = 'agent' AND type <> 'similar_to' THEN 4 WHEN type = 'derived_from' THEN 3 WHEN type = 'similar_to' THEN 1 ELSE 2 END AS strength FROM edges")
def _(s):
    strength = F.when(F.col("type") == "supersedes", 5).when((F.col("provenance") == "agent") & (F.col("type") != "similar_to"), 4).when(F.col("type") == "derived_from", 3).when(F.col("type") == "similar_to", 1).otherwise(2)
    return s.edges.select("src", "dst", "type", strength.alias("strength"))


BACKOFF = "cast(least(1000 * pow(2, attempts - 1), 60000) AS bigint)"


@query("x23_backoff", f"SELECT node_id, CASE WHEN attempts > 0 THEN {BACKOFF} END AS wait_ms FROM queue")
def _(s):
    return s.queue.select("node_id", F.when(F.col("attempts") > 0, F.expr(BACKOFF)).alias("wait_ms"))


@query("x24_confidence", "SELECT id, round(score, 3) AS score, CASE WHEN score >= 0.6 THEN 'high' ELSE 'moderate' END AS confidence FROM candidates")
def _(s):
    return s.candidates.select("id", F.round("score", 3).alias("score"), F.when(F.col("score") >= 0.6, "high").otherwise("moderate").alias("confidence"))


# --- consolidation


@query("c1_seeds", f"SELECT id, cast(row_number() OVER (ORDER BY created_ms DESC, id) - 1 AS int) AS ordinal FROM nodes WHERE {LIVE_AUTHORED} AND memory_kind = 'semantic' AND id IN (SELECT node_id FROM vectors WHERE stale = 0) ORDER BY ordinal LIMIT 100")
def _(s):
    embedded = fresh(s).select(F.col("node_id").alias("id"))
    top = s.nodes.where(t.live() & (F.col("memory_kind") == "semantic")).join(embedded, "id", "left_semi").orderBy(F.desc("created_ms"), "id").limit(100)
    return top.select("id", (F.row_number().over(Window.orderBy(F.desc("created_ms"), "id")) - 1).alias("ordinal"))  # of 100 rows


PAIRS = KNN + """, np AS (SELECT least(q.node_id, kn.node_id) AS a, greatest(q.node_id, kn.node_id) AS b, max(score) AS score FROM kn JOIN (SELECT chunk_id AS query_id, node_id FROM vectors) q USING (query_id) WHERE rank <= 20 AND q.node_id <> kn.node_id AND score >= 0.2 GROUP BY ALL)"""


def near_pairs(s):
    near = v.knn(asked_vectors(s), fresh(s), 20, "chunk_id").join(s.vectors.select("chunk_id", "node_id"), "chunk_id")
    near = near.join(s.vectors.select(F.col("chunk_id").alias("query_id"), F.col("node_id").alias("q")), "query_id").where("q <> node_id AND score >= 0.2")
    return near.groupBy(F.least("q", "node_id").alias("a"), F.greatest("q", "node_id").alias("b")).agg(F.max("score").alias("score"))


@query("c2_pairs", PAIRS + " SELECT a, b, score FROM np")
def _(s):
    return near_pairs(s)


@query("c3_capped_links")
def _(s):
    return wr.capped_matching(near_pairs(s), cap=5)


@query("c4_prune", RANKED + " SELECT src, dst FROM rk JOIN (SELECT src, dst, provenance FROM edges WHERE type = 'similar_to') p USING (src, dst) WHERE provenance = 'system' GROUP BY src, dst HAVING min(rank) > 1")
def _(s):
    system = s.edges.where("type = 'similar_to' AND provenance = 'system'").select("src", "dst")
    return ranked_links(s).join(system, ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min("rank").alias("best")).where("best > 1").select("src", "dst")


@query("c5_citation_edges", RESOLVED + """, pr AS (SELECT DISTINCT wk.id AS src, rs.target AS dst FROM wk JOIN rs USING (slug) WHERE rs.target IS NOT NULL AND rs.target <> wk.id)
SELECT src, dst FROM pr JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.invalidated_ms IS NULL AND b.invalidated_ms IS NULL AND (a.project IS NULL OR b.project IS NULL OR split_part(a.project, '-', 1) = split_part(b.project, '-', 1))
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.invalidated_ms IS NULL AND ((e.src = pr.src AND e.dst = pr.dst) OR (e.src = pr.dst AND e.dst = pr.src)))""")
def _(s):
    found = links(s).join(resolved(s).where("target IS NOT NULL"), "slug").where("target <> id").select(F.col("id").alias("src"), F.col("target").alias("dst")).distinct()
    e = _ends(s, found).where("src_gone IS NULL AND dst_gone IS NULL").where(t.same_family(F.col("src_project"), F.col("dst_project"))).select("src", "dst")
    taken = r.undirected_pairs(s.edges.where(t.live()))
    return e.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(taken, ["a", "b"], "left_anti").select("src", "dst")


@query("c6_symbol_proposals", CITED + " , one AS (SELECT unit_id AS name, min(id) AS symbol FROM symbols WHERE kind = 'class' GROUP BY unit_id HAVING count(*) = 1) SELECT q.id, one.symbol FROM (SELECT DISTINCT l.id, concat('u', cast(l.ord AS varchar)) AS name FROM linked l JOIN ct ON ct.id = l.id) q JOIN one USING (name)")
def _(s):
    cites = x.cited_symbols(s.linked, "id", "body").select("id").distinct().join(s.linked.select("id", "ord"), "id").select("id", F.concat(F.lit("u"), F.col("ord").cast("string")).alias("name"))
    one = s.symbols.where("kind = 'class'").groupBy(F.col("unit_id").alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("symbol")).where("n = 1")
    return cites.join(one, "name").select("id", "symbol")


SURVIVOR = """, dp AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE type = 'duplicate_of' AND src <> dst),
ok AS (SELECT a, b FROM dp WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.type = 'supersedes' AND least(e.src, e.dst) = dp.a AND greatest(e.src, e.dst) = dp.b)),
sv AS (SELECT a, b, arg_max(id, (edge_count, created_ms, -ord)) AS survivor FROM ok JOIN enriched n ON n.id IN (a, b) GROUP BY a, b)"""


def duplicate_pairs(s):
    pairs = r.undirected_pairs(s.edges.where("type = 'duplicate_of'"))
    return pairs.join(r.undirected_pairs(s.edges.where("type = 'supersedes'")), ["a", "b"], "left_anti")


def survivors(s):
    both = duplicate_pairs(s).withColumn("id", F.explode(F.array("a", "b")))
    known = s.enriched.select("id", "edge_count", "created_ms", "ord")
    return both.join(known, "id").groupBy("a", "b").agg(F.max_by("id", F.struct("edge_count", "created_ms", -F.col("ord"))).alias("survivor"))


@query("c8_survivor", SURVIVOR + " SELECT a, b, survivor FROM sv")
def _(s):
    return survivors(s)


@query("c9_protected", "SELECT n.id, coalesce(r.n, 0) >= 3 OR coalesce(i.n, 0) >= 3 AS protected FROM nodes n LEFT JOIN (SELECT node_id AS id, count(*) AS n FROM revisions GROUP BY 1) r USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS n FROM edges WHERE provenance = 'agent' AND invalidated_ms IS NULL GROUP BY 1) i USING (id)")
def _(s):
    revs = s.revisions.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("r"))
    inbound = s.edges.where(t.live() & (F.col("provenance") == "agent")).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    return s.nodes.select("id").join(revs, "id", "left").join(inbound, "id", "left").select("id", (F.coalesce("r", F.lit(0)).__ge__(3) | (F.coalesce("i", F.lit(0)) >= 3)).alias("protected"))


@query("c10_insert_if_new", SURVIVOR + " SELECT a, b FROM sv WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.kind = 'merge' AND c.status <> 'pending' AND least(c.a, c.b) = sv.a AND greatest(c.a, c.b) = sv.b)")
def _(s):
    known = s.candidates.where("kind = 'merge' AND status <> 'pending'").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return survivors(s).join(known, ["a", "b"], "left_anti").select("a", "b")


LIFE = """SELECT concat('K', cast(user_id AS string), '-', cast(event_id % 3 AS string)) AS candidate, {ms} AS at_ms, event_id AS seq,
  CASE event_id % 10 WHEN 0 THEN 'detect' WHEN 1 THEN 'propose' WHEN 2 THEN 'apply' WHEN 3 THEN 'detect' WHEN 4 THEN 'undo' WHEN 5 THEN 'dismiss' WHEN 6 THEN 'reopen' WHEN 7 THEN 'propose' WHEN 8 THEN 'apply' ELSE (CASE WHEN event_id % 3 = 0 THEN 'undo' ELSE 'dismiss' END) END AS op,
  concat('note ', cast(event_id AS string)) AS note, {changes} AS changes FROM {events}"""
LIFE_SQL = ", le AS (" + LIFE.format(ms="epoch_us(ts) // 1000", changes="['A' || event_id % 40, 'B' || user_id]", events="events") + """), ls AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY at_ms, seq) AS n FROM le),
walk(candidate, n, status, proposal, decided_ms, changed, reopened, undone) AS (SELECT DISTINCT candidate, cast(0 AS bigint), 'none', cast(NULL AS varchar), cast(NULL AS bigint), cast([] AS varchar[]), cast(0 AS bigint), cast(0 AS bigint) FROM le
  UNION ALL SELECT w.candidate, h.n,
    CASE WHEN h.op = 'detect' AND w.status = 'none' OR h.op = 'undo' AND w.status = 'applied' OR h.op = 'reopen' AND w.status = 'dismissed' THEN 'pending' WHEN w.status = 'pending' AND h.op = 'apply' THEN 'applied' WHEN w.status = 'pending' AND h.op = 'dismiss' THEN 'dismissed' ELSE w.status END,
    CASE WHEN h.op = 'propose' AND w.status = 'pending' THEN h.note WHEN h.op = 'reopen' AND w.status = 'dismissed' THEN NULL ELSE w.proposal END,
    CASE WHEN w.status = 'pending' AND h.op IN ('apply', 'dismiss') THEN h.at_ms WHEN h.op = 'undo' AND w.status = 'applied' OR h.op = 'reopen' AND w.status = 'dismissed' THEN NULL ELSE w.decided_ms END,
    CASE WHEN w.status = 'pending' AND h.op = 'apply' THEN h.changes WHEN h.op = 'undo' AND w.status = 'applied' THEN [] ELSE w.changed END,
    w.reopened + CASE WHEN h.op = 'reopen' AND w.status = 'dismissed' THEN 1 ELSE 0 END, w.undone + CASE WHEN h.op = 'undo' AND w.status = 'applied' THEN 1 ELSE 0 END
  FROM walk w JOIN ls h ON h.candidate = w.candidate AND h.n = w.n + 1),
fin AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY n DESC) = 1),
eff AS (SELECT h.* FROM walk w JOIN ls h ON h.candidate = w.candidate AND h.n = w.n + 1 WHERE h.op = 'apply' AND w.status = 'pending')"""


def life(s):
    """The events of candidates, and those of them that change something."""
    changes = "array(concat('A', cast(event_id % 40 AS string)), concat('B', cast(user_id AS string)))"
    every = s.spark.sql(LIFE.format(ms="unix_millis(cast(ts AS timestamp))", changes=changes, events="{events}"), events=s.table("events"))
    return every, lc.effective(every)


@query("c10_candidate_states", LIFE_SQL + " SELECT candidate, status, proposal, decided_ms FROM fin")
def _(s):
    every, done = life(s)
    return lc.candidate_states(done, every).select("candidate", "status", "proposal", "decided_ms")


@query("z18_reopen_counts", LIFE_SQL + " SELECT candidate, reopened, undone, proposal IS NULL AS unproposed FROM fin WHERE status = 'pending'")
def _(s):
    every, done = life(s)
    return lc.candidate_states(done, every).where("status = 'pending'").select("candidate", "reopened", "undone", F.col("proposal").isNull().alias("unproposed"))


@query("z2_artifact_states", LIFE_SQL + """, st0 AS (SELECT unnest(changed) AS artifact, decided_ms, candidate FROM fin WHERE status = 'applied'), ev AS (SELECT artifact, count(*) AS decisions FROM (SELECT unnest(changes) AS artifact FROM eff) z GROUP BY artifact)
SELECT artifact, min(st0.decided_ms) AS retired_ms, arg_min(st0.candidate, (st0.decided_ms, st0.candidate)) AS by, any_value(decisions) AS decisions FROM ev LEFT JOIN st0 USING (artifact) GROUP BY artifact""")
def _(s):
    """What decisions have retired, and what undoing them has revived."""
    return lc.artifact_states(life(s)[1])


@query("c11_dismissed", "SELECT id, CASE WHEN status = 'pending' AND (a IN (SELECT id FROM nodes WHERE invalidated_ms IS NOT NULL) OR b IN (SELECT id FROM nodes WHERE invalidated_ms IS NOT NULL)) THEN 'dismissed' ELSE status END AS status FROM candidates")
def _(s):
    gone = s.nodes.where(~t.live()).select(F.col("id").alias("m"))
    hit = s.candidates.where("status = 'pending'").select("id", F.explode(F.array("a", "b")).alias("m")).join(gone, "m", "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
    return s.candidates.join(hit, "id", "left").select("id", F.when(F.col("hit"), "dismissed").otherwise(F.col("status")).alias("status"))


@query("c12_without_proposal", "SELECT id FROM candidates WHERE status = 'pending' AND json_extract_string(proposal, '$.recommendation') IS NULL")
def _(s):
    return s.candidates.where("status = 'pending'").where(F.get_json_object("proposal", "$.recommendation").isNull()).select("id")


STRANDED = """, gone AS (SELECT id FROM nodes WHERE invalidated_ms IS NOT NULL), s1 AS (SELECT dst AS id, src AS nx FROM edges WHERE type = 'supersedes' AND invalidated_ms IS NULL),
one AS (SELECT id, min(nx) AS successor FROM s1 WHERE nx NOT IN (SELECT id FROM gone) GROUP BY id HAVING count(DISTINCT nx) = 1 AND id NOT IN (SELECT id FROM s1 WHERE nx IN (SELECT id FROM gone)))"""


@query("c13_stranded", STRANDED + " SELECT e.src, e.dst, e.type, one.successor FROM edges e JOIN one ON one.id = e.dst WHERE e.provenance = 'system' AND e.invalidated_ms IS NULL AND e.type <> 'supersedes' AND e.dst IN (SELECT id FROM gone) AND e.src IN (SELECT id FROM nodes WHERE invalidated_ms IS NULL)")
def _(s):
    gone, live = s.nodes.where(~t.live()).select("id"), s.nodes.where(t.live()).select("id")
    step = s.edges.where(t.live() & (F.col("type") == "supersedes")).select(F.col("dst").alias("id"), F.col("src").alias("nx"))
    longer = step.join(gone.withColumnRenamed("id", "nx"), "nx", "left_semi").select("id").distinct()
    one = step.join(live.withColumnRenamed("id", "nx"), "nx", "left_semi").groupBy("id").agg(F.count_distinct("nx").alias("n"), F.min("nx").alias("successor")).where("n = 1").join(longer, "id", "left_anti")
    e = s.edges.where(t.live() & (F.col("provenance") == "system") & (F.col("type") != "supersedes")).join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.join(one.withColumnRenamed("id", "dst"), "dst").select("src", "dst", "type", "successor")


@query("c14_cross_family", ENDS + " SELECT src, dst, type FROM ends WHERE provenance = 'system' AND invalidated_ms IS NULL AND split_part(src_project, '-', 1) <> split_part(dst_project, '-', 1)")
def _(s):
    e = _ends(s, s.edges.where(t.live() & (F.col("provenance") == "system")))
    return e.where(~t.same_family(F.col("src_project"), F.col("dst_project"))).select("src", "dst", "type")


@query("c16_untyped", "SELECT e.src, e.dst, EXISTS (SELECT 1 FROM edges o WHERE o.invalidated_ms IS NULL AND o.type <> 'similar_to' AND least(o.src, o.dst) = least(e.src, e.dst) AND greatest(o.src, o.dst) = greatest(e.src, e.dst)) AS connected FROM edges e WHERE e.type = 'similar_to' AND e.invalidated_ms IS NULL")
def _(s):
    pair = {"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}
    typed = s.edges.where(t.live() & (F.col("type") != "similar_to")).withColumns(pair).select("a", "b").distinct().withColumn("c", F.lit(True))
    return s.edges.where(t.live() & (F.col("type") == "similar_to")).withColumns(pair).join(typed, ["a", "b"], "left").select("src", "dst", F.col("c").isNotNull().alias("connected"))


@query("c17_recheck", "SELECT src, dst, type FROM edges e WHERE provenance = 'system' AND invalidated_ms IS NULL AND (EXISTS (SELECT 1 FROM revisions r WHERE r.node_id = e.src AND r.ts_ms > e.valid_from_ms) OR EXISTS (SELECT 1 FROM revisions r WHERE r.node_id = e.dst AND r.ts_ms > e.valid_from_ms))")
def _(s):
    last = s.revisions.groupBy("node_id").agg(F.max("ts_ms").alias("last"))
    e = s.edges.where(t.live() & (F.col("provenance") == "system"))
    e = e.join(last.select(F.col("node_id").alias("src"), F.col("last").alias("l1")), "src").join(last.select(F.col("node_id").alias("dst"), F.col("last").alias("l2")), "dst")
    return e.where("l1 > valid_from_ms OR l2 > valid_from_ms").select("src", "dst", "type")


@query("c18_danglers", RESOLVED + " SELECT wk.id, wk.slug, rs.kind FROM wk JOIN rs USING (slug) WHERE rs.kind IN ('unknown', 'ambiguous')")
def _(s):
    return links(s).join(resolved(s).where("kind IN ('unknown', 'ambiguous')"), "slug").select("id", "slug", "kind")


@query("c19_unannotated", f"SELECT id FROM enriched WHERE {LIVE_AUTHORED} AND memory_kind = 'semantic' AND NOT (ord % 4 = 0 AND rev = 1)")
def _(s):
    done = s.nodes.where("ord % 4 = 0").select("id", F.lit(1).alias("rev"))
    rows = s.nodes.where(t.live() & (F.col("memory_kind") == "semantic")).join(s.current.select(F.col("node_id").alias("id"), "rev"), "id")
    return rows.join(done, ["id", "rev"], "left_anti").select("id")


MERGED = SURVIVOR + ", mp AS (SELECT CASE WHEN survivor = a THEN b ELSE a END AS loser, min(survivor) AS survivor FROM sv GROUP BY 1)"


def merge_map(s):
    return survivors(s).select(F.when(F.col("survivor") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("loser"), "survivor").groupBy("loser").agg(F.min("survivor").alias("survivor"))


def moved(edges, mapping):
    """Edges with each end that lost replaced by its survivor; loops go, equal edges become one."""
    m = mapping.select(F.col("loser").alias("src"), F.col("survivor").alias("s2")), mapping.select(F.col("loser").alias("dst"), F.col("survivor").alias("d2"))
    e = edges.join(m[0], "src", "left").join(m[1], "dst", "left").select(F.coalesce("s2", "src").alias("src"), F.coalesce("d2", "dst").alias("dst"), "type", "weight")
    return e.where("src <> dst").groupBy("src", "dst", "type").agg(F.max("weight").alias("weight"))


@query("c20_merge_edges", MERGED + " SELECT coalesce(x.survivor, src) AS src, coalesce(y.survivor, dst) AS dst, type, max(weight) AS weight FROM edges LEFT JOIN mp x ON x.loser = src LEFT JOIN mp y ON y.loser = dst WHERE invalidated_ms IS NULL AND provenance = 'agent' AND coalesce(x.survivor, src) <> coalesce(y.survivor, dst) GROUP BY 1, 2, 3")
def _(s):
    return moved(s.edges.where(t.live() & (F.col("provenance") == "agent")), merge_map(s))


@query("c21_supersede_repoint", STRANDED + " SELECT e.src, coalesce(one.successor, e.dst) AS dst, e.type FROM edges e LEFT JOIN one ON one.id = e.dst WHERE e.invalidated_ms IS NULL AND e.type = 'references'")
def _(s):
    gone, live = s.nodes.where(~t.live()).select("id"), s.nodes.where(t.live()).select("id")
    step = s.edges.where(t.live() & (F.col("type") == "supersedes")).select(F.col("dst").alias("id"), F.col("src").alias("nx"))
    longer = step.join(gone.withColumnRenamed("id", "nx"), "nx", "left_semi").select("id").distinct()
    one = step.join(live.withColumnRenamed("id", "nx"), "nx", "left_semi").groupBy("id").agg(F.count_distinct("nx").alias("n"), F.min("nx").alias("successor")).where("n = 1").join(longer, "id", "left_anti")
    return s.edges.where(t.live() & (F.col("type") == "references")).join(one.withColumnRenamed("id", "dst"), "dst", "left").select("src", F.coalesce("successor", "dst").alias("dst"), "type")


@query("c22_distilled", f"SELECT id, consolidated_ms, CASE WHEN memory_kind = 'episodic' AND consolidated_ms IS NULL AND created_ms < {NOW - 7 * DAY} AND invalidated_ms IS NULL THEN {NOW} ELSE consolidated_ms END AS after_ms FROM nodes")
def _(s):
    due = (F.col("memory_kind") == "episodic") & F.col("consolidated_ms").isNull() & (F.col("created_ms") < NOW - 7 * DAY) & t.live()
    return s.nodes.select("id", "consolidated_ms", F.when(due, F.lit(NOW)).otherwise(F.col("consolidated_ms")).alias("after_ms"))


@query("c23_dedup_probe", KNN + " SELECT query_id, chunk_id, score FROM kn WHERE rank <= 5 AND score >= 0.2 AND chunk_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 3")
def _(s):
    near = v.knn(asked_vectors(s), fresh(s), 5, "chunk_id").where("score >= 0.2 AND chunk_id <> query_id")
    return r.first_per_key(near, ["query_id"], [F.desc("score"), F.col("chunk_id")], 3).select("query_id", "chunk_id", "score")


@query("c15_reattach", f""", el AS (SELECT id, created_by_session FROM nodes WHERE {LIVE_AUTHORED} AND id NOT IN (SELECT src FROM edges WHERE invalidated_ms IS NULL UNION SELECT dst FROM edges WHERE invalidated_ms IS NULL))
SELECT el.id, arg_max(c.id, c.created_ms) AS anchor FROM el JOIN nodes c ON c.created_by_session = el.created_by_session AND c.type = 'checkpoint' AND c.invalidated_ms IS NULL AND c.id <> el.id GROUP BY el.id""")
def _(s):
    lone = g.edgeless(s.nodes, s.edges).join(s.nodes.select("id", "created_by_session"), "id")
    c = s.nodes.where(t.live() & (F.col("type") == "checkpoint")).select("id", "created_by_session", "created_ms")
    return r.latest_other(lone, c, "created_by_session", "id", "created_ms", "anchor")


# --- code index

SCOPE = ", sf AS (SELECT path, unit_id, branch FROM files WHERE branch = 'main' AND invalidated_ms IS NULL)"


def scope(s, branch="main"):
    return s.files.where(t.live() & (F.col("branch") == branch)).select("path", "unit_id")


REPOS = "SELECT n_nationkey AS repo_id, n_name AS display_name, concat('host/', lower(n_name)) AS remote_key, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'dev' ELSE 'main' END AS default_branch FROM nation"
BRANCHES = "SELECT n_nationkey AS repo_id, 'main' AS branch, cast(NULL AS bigint) AS retired_ms FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT n_nationkey, 'dev', CASE WHEN n_nationkey % 5 = 0 THEN 1 END FROM nation"
REQUESTS = """SELECT id AS request_id, CASE WHEN ord % 3 = 0 THEN coalesce(a.n_name, 'NOWHERE') END AS repo, CASE ord % 5 WHEN 0 THEN 'dev' WHEN 1 THEN 'feature' END AS branch,
  CASE WHEN ord % 2 = 0 THEN concat('host/', coalesce(lower(b.n_name), 'nowhere')) END AS remote, CASE WHEN ord % 2 = 0 THEN (CASE WHEN ord % 7 < 3 THEN 'dev' ELSE 'main' END) END AS ctx_branch
  FROM nodes LEFT JOIN nation a ON a.n_nationkey = ord % 27 LEFT JOIN nation b ON b.n_nationkey = ord % 26"""


@query("d1_scope", f""", rp AS ({REPOS}), br AS ({BRANCHES}), rq AS ({REQUESTS}),
ch AS (SELECT rq.*, rp.* FROM rq LEFT JOIN rp ON rq.repo = rp.display_name WHERE rq.repo IS NOT NULL UNION ALL SELECT rq.*, rp.* FROM rq LEFT JOIN rp ON rq.remote = rp.remote_key WHERE rq.repo IS NULL AND rq.remote IS NOT NULL
  UNION ALL SELECT rq.*, rp.* FROM rq, rp WHERE rq.repo IS NULL AND rq.remote IS NULL),
wa AS (SELECT *, coalesce(branch, CASE WHEN remote = remote_key THEN ctx_branch END) AS wanted FROM ch),
li AS (SELECT *, EXISTS (SELECT 1 FROM br WHERE br.repo_id = wa.repo_id AND br.branch = wa.wanted AND retired_ms IS NULL) AS w, EXISTS (SELECT 1 FROM br WHERE br.repo_id = wa.repo_id AND br.branch = wa.default_branch AND retired_ms IS NULL) AS d FROM wa),
nt AS (SELECT *, CASE WHEN repo_id IS NULL AND repo IS NOT NULL THEN 'unknown repository' WHEN repo_id IS NULL THEN 'remote not indexed' WHEN w THEN NULL
  WHEN wanted IS NOT NULL AND (branch IS NOT NULL OR default_branch IS NULL OR default_branch = wanted) THEN 'branch not indexed' WHEN default_branch IS NULL THEN 'no default branch' WHEN NOT d THEN 'default branch not indexed' WHEN wanted IS NOT NULL THEN 'default branch instead' END AS note FROM li)
SELECT request_id, repo_id, CASE WHEN w THEN wanted WHEN note IS NULL OR note = 'default branch instead' THEN default_branch END AS branch, note FROM nt""")
def _(s):
    nation = s.table("nation")
    repos, branches = (s.spark.sql(q.replace("FROM nation", "FROM {nation}"), nation=nation) for q in (REPOS, BRANCHES))
    requests = s.spark.sql(REQUESTS.replace("FROM nodes", "FROM {nodes}").replace("JOIN nation", "JOIN {nation}"), nodes=s.nodes, nation=nation)
    return r.resolve_scopes(requests, repos, branches)


@query("d3_retired_branches", f"SELECT branch, max(valid_from_ms) AS seen FROM files GROUP BY branch HAVING max(valid_from_ms) < {NOW - 14 * DAY} AND branch <> 'main'")
def _(s):
    seen = s.files.groupBy("branch").agg(F.max("valid_from_ms").alias("seen"))
    return seen.where((F.col("seen") < NOW - 14 * DAY) & (F.col("branch") != "main"))


@query("d4_symbol_lookup", SCOPE + " SELECT y.name, min(sf.path) AS path, count(*) AS n FROM symbols y JOIN sf USING (unit_id) WHERE y.kind = 'class' GROUP BY y.name")
def _(s):
    return s.symbols.where("kind = 'class'").join(scope(s), "unit_id").groupBy("name").agg(F.min("path").alias("path"), F.count("*").alias("n"))


@query("d5_unit_branches", "SELECT unit_id, string_agg(DISTINCT branch, ',' ORDER BY branch) AS branches FROM files WHERE invalidated_ms IS NULL GROUP BY unit_id")
def _(s):
    return s.files.where(t.live()).groupBy("unit_id").agg(F.array_join(F.sort_array(F.collect_set("branch")), ",").alias("branches"))


@query("d6_directory", SCOPE + " SELECT name, id FROM (SELECT y.name, y.id, row_number() OVER (PARTITION BY y.name ORDER BY sf.path, y.qualified, y.id) AS n FROM symbols y JOIN sf USING (unit_id)) z WHERE n = 1")
def _(s):
    return r.first_per_key(s.symbols.join(scope(s), "unit_id"), ["name"], [F.col("path"), F.col("qualified"), F.col("id")]).select("name", "id")


@query("d7_imports", SCOPE + ", pk AS (SELECT i.unit_id, i.name, arg_min(sf.unit_id, i.pos) AS target FROM imports i JOIN sf ON sf.path = i.candidate GROUP BY ALL) SELECT unit_id, name, target FROM pk")
def _(s):
    return s.imports.join(scope(s).select(F.col("path").alias("candidate"), F.col("unit_id").alias("t")), "candidate").groupBy("unit_id", "name").agg(F.min_by("t", "pos").alias("target"))


CALLS = SCOPE + """, calls AS (SELECT DISTINCT unit_id, name AS callee FROM imports), own AS (SELECT c.unit_id, c.callee, min(y.id) AS id FROM calls c JOIN symbols y ON y.unit_id = c.unit_id AND y.name = c.callee GROUP BY ALL),
im AS (SELECT i.unit_id, i.name AS callee, arg_min(y.id, (i.pos, y.id)) AS id FROM imports i JOIN sf ON sf.path = i.candidate JOIN symbols y ON y.unit_id = sf.unit_id AND y.name = i.name GROUP BY ALL),
wide AS (SELECT c.callee, min(y.id) AS id FROM (SELECT DISTINCT callee FROM calls) c JOIN symbols y ON y.name = c.callee JOIN sf ON sf.unit_id = y.unit_id GROUP BY ALL),
rc AS (SELECT c.unit_id, c.callee, coalesce(own.id, im.id, wide.id) AS target FROM calls c LEFT JOIN own USING (unit_id, callee) LEFT JOIN im USING (unit_id, callee) LEFT JOIN wide USING (callee))"""


def resolved_calls(s):
    """The same file first, then imported files in order, then the whole scope by name."""
    calls = s.imports.select("unit_id", F.col("name").alias("callee")).distinct()
    y = s.symbols.select("unit_id", F.col("name").alias("callee"), "id")
    own = calls.join(y, ["unit_id", "callee"]).groupBy("unit_id", "callee").agg(F.min("id").alias("own"))
    files = scope(s).select(F.col("path").alias("candidate"), F.col("unit_id").alias("u"))
    im = s.imports.withColumnRenamed("name", "callee").join(files, "candidate").join(y.select(F.col("unit_id").alias("u"), "callee", "id"), ["u", "callee"]).groupBy("unit_id", "callee").agg(F.min_by("id", F.struct("pos", "id")).alias("imported"))
    wide = y.join(scope(s), "unit_id", "left_semi").groupBy("callee").agg(F.min("id").alias("wide"))
    return calls.join(own, ["unit_id", "callee"], "left").join(im, ["unit_id", "callee"], "left").join(wide, "callee", "left").select("unit_id", "callee", F.coalesce("own", "imported", "wide").alias("target"))


@query("d8_calls", CALLS + " SELECT unit_id, callee, target FROM rc")
def _(s):
    return resolved_calls(s)


@query("d9_callers", CALLS + " SELECT target, count(DISTINCT unit_id) AS callers FROM rc WHERE target IS NOT NULL GROUP BY target")
def _(s):
    return resolved_calls(s).where("target IS NOT NULL").groupBy("target").agg(F.count_distinct("unit_id").alias("callers"))


@query("d10_citable", "SELECT path, qualified, id FROM (SELECT f.path, y.qualified, y.id, row_number() OVER (PARTITION BY f.path, y.qualified ORDER BY CASE WHEN f.branch = 'main' THEN 0 ELSE 1 END, f.valid_from_ms DESC, y.id) AS n FROM symbols y JOIN files f USING (unit_id) WHERE f.invalidated_ms IS NULL) z WHERE n = 1")
def _(s):
    rows = s.symbols.join(s.files.where(t.live()), "unit_id").withColumn("other", (F.col("branch") != "main").cast("int"))
    return r.first_per_key(rows, ["path", "qualified"], [F.col("other"), F.desc("valid_from_ms"), F.col("id")]).select("path", "qualified", "id")


@query("d11_pending_hashes", SCOPE + " SELECT embed_hash, min(y.id) AS id FROM symbols y JOIN sf USING (unit_id) WHERE embed_hash NOT IN (SELECT embed_hash FROM symbols WHERE kind = 'class') GROUP BY embed_hash")
def _(s):
    done = s.symbols.where("kind = 'class'").select("embed_hash")
    return s.symbols.join(scope(s), "unit_id", "left_semi").join(done, "embed_hash", "left_anti").groupBy("embed_hash").agg(F.min("id").alias("id"))


@query("j14_code_refs", SCOPE + ", refs AS (SELECT id, concat('cold', cast(ord % 30 AS varchar)) AS name FROM nodes) SELECT refs.id, arg_min(y.id, (CASE WHEN y.kind = 'class' THEN 0 ELSE 1 END, y.id)) AS symbol FROM refs JOIN symbols y USING (name) JOIN sf USING (unit_id) GROUP BY refs.id")
def _(s):
    refs = s.nodes.select("id", F.concat(F.lit("cold"), (F.col("ord") % 30).cast("string")).alias("name"))
    y = s.symbols.join(scope(s), "unit_id", "left_semi").select("name", F.col("id").alias("symbol"), (F.col("kind") != "class").cast("int").alias("late"))
    best = y.groupBy("name").agg(F.min_by("symbol", F.struct("late", "symbol")).alias("symbol"))
    return refs.join(best, "name").select("id", "symbol")


@query("t5_symbol_search", SCOPE + bm25_sql(", q AS (SELECT DISTINCT split_part(qualified, '.', 1) AS query_id, lower(split_part(qualified, '.', 1)) AS term FROM symbols)",
  f"SELECT id, 'qualified' AS field, {TOK.format('qualified')} AS toks FROM symbols UNION ALL SELECT id, 'summary', {TOK.format('name')} FROM symbols") + """,
un AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5000)
SELECT query_id, id, score FROM un JOIN symbols USING (id) WHERE unit_id IN (SELECT unit_id FROM sf) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 40""")
def _(s):
    """The 5,000 best of all symbols, then those of the scope, then 40 of them."""
    word = F.split_part("qualified", F.lit("."), F.lit(1))
    asked = s.symbols.select(word.alias("query_id"), F.lower(word).alias("term")).distinct()
    hits = x.top_k(x.bm25(asked, s.symbols.select("id", "qualified", F.col("name").alias("summary")), "id", ("qualified", "summary")), 5000, "id").drop("rank")
    mine = s.symbols.join(scope(s), "unit_id", "left_semi").select("id")
    return x.top_k(hits.join(mine, "id", "left_semi"), 40, "id").select("query_id", "id", "score")


# --- reads, mutations and checks


@query("z1_review_list", "SELECT src || '>' || dst AS item, 'edge' AS kind, valid_from_ms AS at_ms FROM edges WHERE provenance = 'system' UNION ALL SELECT id, 'node', created_ms FROM nodes WHERE memory_kind = 'mirror' ORDER BY at_ms DESC, item, kind LIMIT 50")
def _(s):
    e = s.edges.where("provenance = 'system'").select(F.concat("src", F.lit(">"), "dst").alias("item"), F.lit("edge").alias("kind"), F.col("valid_from_ms").alias("at_ms"))
    return e.unionByName(s.nodes.where("memory_kind = 'mirror'").select(F.col("id").alias("item"), F.lit("node").alias("kind"), F.col("created_ms").alias("at_ms"))).orderBy(F.desc("at_ms"), "item", "kind").limit(50)


@query("z2_decisions", "SELECT e.src, e.dst, e.type, cast(round(weight * 100) AS bigint) % 3 = 0 AS decided FROM edges e WHERE provenance = 'system'")
def _(s):
    done = decided(s).withColumn("decided", F.lit(True))
    return s.edges.where("provenance = 'system'").select("src", "dst", "type").join(done, ["src", "dst", "type"], "left").select("src", "dst", "type", F.coalesce("decided", F.lit(False)).alias("decided"))


@query("z3_use_counts", "SELECT n.id, n.use_count + coalesce(g.n, 0) AS use_count FROM nodes n LEFT JOIN (SELECT base, count(*) AS n FROM log WHERE action = 'get' GROUP BY base) g ON g.base = n.ord")
def _(s):
    gets = s.log.where("action = 'get'").groupBy(F.col("base").alias("ord")).agg(F.count("*").alias("n"))
    return s.nodes.join(gets, "ord", "left").select("id", (F.col("use_count") + F.coalesce("n", F.lit(0))).alias("use_count"))


@query("z4_principals", "SELECT principal_id, CASE WHEN principal_id = 'P0' THEN 'system' WHEN count(client) = 0 THEN 'unattributed' ELSE 'agent' END AS kind, count(*) AS sessions FROM sessions GROUP BY principal_id")
def _(s):
    kind = F.when(F.col("principal_id") == "P0", "system").when(F.count("client") == 0, "unattributed").otherwise("agent")
    return s.sessions.groupBy("principal_id").agg(kind.alias("kind"), F.count("*").alias("sessions"))


@query("z5_token_lookup", "SELECT id FROM sessions WHERE sha256(id) IN (SELECT sha256(created_by_session) FROM nodes)")
def _(s):
    hashes = s.nodes.select(F.sha2("created_by_session", 256).alias("h")).distinct()
    return s.sessions.withColumn("h", F.sha2("id", 256)).join(hashes, "h", "left_semi").select("id")


@query("z6_posture", "SELECT z.id, coalesce(CASE z.principal_id WHEN 'P1' THEN 'ask' WHEN 'P2' THEN 'deny' END, CASE WHEN z.client = 'client1' THEN 'ask' END, 'auto') AS posture FROM sessions z")
def _(s):
    named = s.spark.createDataFrame([("P1", "ask"), ("P2", "deny")], "principal_id string, named string")
    return s.sessions.join(named, "principal_id", "left").select("id", F.coalesce("named", F.when(F.col("client") == "client1", "ask"), F.lit("auto")).alias("posture"))


@query("z7_former_titles", "SELECT DISTINCT r.node_id, substr(split_part(r.content, chr(10), 1), 1, 60) AS title FROM revisions r JOIN current c USING (node_id) WHERE substr(split_part(r.content, chr(10), 1), 1, 60) <> substr(split_part(c.content, chr(10), 1), 1, 60)")
def _(s):
    title = F.substring(F.split_part("content", F.lit("\n"), F.lit(1)), 1, 60)
    now = s.current.select("node_id", title.alias("now"))
    return s.revisions.select("node_id", title.alias("title")).distinct().join(now, "node_id").where("title <> now").select("node_id", "title")


@query("z8_event_windows", "SELECT id, event_from_ms, event_to_ms, event_to_ms IS NULL OR event_from_ms IS NULL OR event_to_ms >= event_from_ms AS valid FROM nodes")
def _(s):
    return s.nodes.select("id", "event_from_ms", "event_to_ms", (F.col("event_to_ms").isNull() | F.col("event_from_ms").isNull() | (F.col("event_to_ms") >= F.col("event_from_ms"))).alias("valid"))


@query("z9_guarded_insert", PAIRS + " SELECT a, b FROM np WHERE a IN (SELECT id FROM nodes WHERE invalidated_ms IS NULL) AND b IN (SELECT id FROM nodes WHERE invalidated_ms IS NULL) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.invalidated_ms IS NULL AND least(e.src, e.dst) = np.a AND greatest(e.src, e.dst) = np.b)")
def _(s):
    live = s.nodes.where(t.live()).select("id")
    new = near_pairs(s).join(live.withColumnRenamed("id", "a"), "a", "left_semi").join(live.withColumnRenamed("id", "b"), "b", "left_semi")
    return new.join(r.undirected_pairs(s.edges.where(t.live())), ["a", "b"], "left_anti").select("a", "b")


@query("z10_similar_closed", f"SELECT src, dst, CASE WHEN invalidated_ms IS NULL AND (src IN (SELECT id FROM nodes WHERE invalidated_ms IS NOT NULL) OR dst IN (SELECT id FROM nodes WHERE invalidated_ms IS NOT NULL)) THEN {NOW} ELSE invalidated_ms END AS invalidated_ms FROM edges WHERE type = 'similar_to'")
def _(s):
    e = _ends(s, s.edges.where("type = 'similar_to'"))
    return e.select("src", "dst", F.when(t.live() & (F.col("src_gone").isNotNull() | F.col("dst_gone").isNotNull()), F.lit(NOW)).otherwise(F.col("invalidated_ms")).alias("invalidated_ms"))


@query("z11_reference_state", "SELECT q.id, CASE WHEN n.id IS NULL THEN 'missing' WHEN n.invalidated_ms IS NULL THEN 'live' ELSE 'invalidated' END AS state FROM (SELECT DISTINCT concat('N', lpad(cast(ord * 2 AS string), 9, '0')) AS id FROM nodes) q LEFT JOIN nodes n USING (id)")
def _(s):
    asked = s.nodes.select(F.concat(F.lit("N"), F.lpad((F.col("ord") * 2).cast("string"), 9, "0")).alias("id")).distinct()
    found = s.nodes.select("id", F.when(t.live(), "live").otherwise("invalidated").alias("state"))
    return asked.join(found, "id", "left").select("id", F.coalesce("state", F.lit("missing")).alias("state"))


@query("z13_processes", "SELECT session_id, event_id FROM log QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) = 1")
def _(s):
    return s.log.groupBy("session_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("z15_health_issues", ", st AS (SELECT (SELECT count(*) FROM queue WHERE attempts >= 5) AS parked, (SELECT count(*) FROM jobs WHERE state = 'failed') AS failed, (SELECT count(*) FROM candidates WHERE status = 'pending') AS pending) SELECT unnest(list_filter([CASE WHEN parked > 0 THEN 'parked' END, CASE WHEN failed > 0 THEN 'failed' END, CASE WHEN pending > 1000000000 THEN 'pending' END], lambda x: x IS NOT NULL)) AS issue FROM st")
def _(s):
    one = s.queue.agg(F.count_if(F.col("attempts") >= 5).alias("parked")).crossJoin(s.jobs.agg(F.count_if(F.col("state") == "failed").alias("failed"))).crossJoin(s.candidates.agg(F.count_if(F.col("status") == "pending").alias("pending")))
    return one.select(F.explode(F.array_compact(F.array(F.when(F.col("parked") > 0, "parked"), F.when(F.col("failed") > 0, "failed"), F.when(F.col("pending") > 1_000_000_000, "pending")))).alias("issue"))


@query("z17_candidate_previews", "SELECT c.id, n.id AS member, n.title FROM candidates c JOIN nodes n ON n.id IN (c.a, c.b) WHERE c.status = 'pending'")
def _(s):
    return s.candidates.where("status = 'pending'").select("id", F.explode(F.array("a", "b")).alias("member")).join(s.nodes.select(F.col("id").alias("member"), "title"), "member").select("id", "member", "title")


@query("z18_reopened", "SELECT id, CASE WHEN status = 'dismissed' AND score > 0.35 THEN 'pending' ELSE status END AS status, CASE WHEN status = 'dismissed' AND score > 0.35 THEN NULL ELSE proposal END AS proposal FROM candidates")
def _(s):
    again = (F.col("status") == "dismissed") & (F.col("score") > 0.35)
    return s.candidates.select("id", F.when(again, "pending").otherwise(F.col("status")).alias("status"), F.when(~again, F.col("proposal")).alias("proposal"))


@query("z19_verdicts", "SELECT id, CASE WHEN json_extract_string(proposal, '$.recommendation') IN ('merge', 'update', 'noop') THEN json_extract_string(proposal, '$.recommendation') ELSE 'noop' END AS action FROM candidates")
def _(s):
    a = F.get_json_object("proposal", "$.recommendation")
    return s.candidates.select("id", F.when(a.isin("merge", "update", "noop"), a).otherwise("noop").alias("action"))


@query("z22_judge_gate", "SELECT kind, count(*) AS n, round(avg(CASE WHEN (score > 0.5) = (status = 'applied') THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(greatest(avg(CASE WHEN status = 'applied' THEN 1.0 ELSE 0.0 END), 1 - avg(CASE WHEN status = 'applied' THEN 1.0 ELSE 0.0 END)), 6) AS majority FROM candidates GROUP BY kind")
def _(s):
    yes = (F.col("status") == "applied").cast("double")
    right = ((F.col("score") > 0.5) == (F.col("status") == "applied")).cast("double")
    return s.candidates.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.greatest(F.avg(yes), 1 - F.avg(yes)), 6).alias("majority"))


