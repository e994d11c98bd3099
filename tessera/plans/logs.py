"""Retrieval-log analytics, evaluation, health reports, and state derived from events."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import calibration as cal
from tessera.operators import evaluation as e
from tessera.operators import graph as g
from tessera.operators import lifecycle as lc
from tessera.operators import temporal as t
from tessera.operators import text as x
from tessera.operators import vector as v
from tessera.sources.corpus import HOUR, NOW

from .registry import query
from .relational import LIVE_AUTHORED, WEIGHTS, auc, live_authored
from .retrieval import KNN, REACHED, TOK, asked_vectors, dangling, fresh

SHOWN = """, sh AS (SELECT event_id, session_id, ts, r.r AS rank, (base + r.r) % n AS id FROM log CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) r CROSS JOIN (SELECT count(*) AS n FROM documents) c WHERE action = 'search'),
ft AS (SELECT sh.*, EXISTS (SELECT 1 FROM log g WHERE g.action = 'get' AND g.session_id = sh.session_id AND g.base = sh.id AND g.ts > sh.ts) AS hit FROM sh)"""


def shown(s):
    n = s.table("documents").count()
    return e.fetched_after(e.surfacings(s.log, n), s.log)


@query("e1_follow_through", SHOWN + """, pe AS (SELECT event_id, max(CASE WHEN hit THEN 1 ELSE 0 END) AS own FROM ft GROUP BY event_id)
SELECT (SELECT count(*) FROM pe) AS searches, (SELECT count(*) FROM log l WHERE action = 'search' AND EXISTS (SELECT 1 FROM log g WHERE g.action = 'get' AND g.session_id = l.session_id AND g.ts > l.ts)) AS any_get,
 (SELECT cast(sum(own) AS bigint) FROM pe) AS own_result, (SELECT cast(sum(1 - own) AS bigint) FROM pe) AS envelope_only""")
def _(s):
    own = shown(s).groupBy("event_id").agg(F.max(F.col("hit").cast("int")).alias("own"))
    got = e.any_get_after(s.log).agg(F.count_if("any_get").alias("any_get"))
    return own.agg(F.count("*").alias("searches"), F.sum("own").alias("own_result"), F.sum(1 - F.col("own")).alias("envelope_only")).crossJoin(got).select("searches", "any_get", "own_result", "envelope_only")


@query("j11_fetch_after_search", SHOWN + " SELECT event_id, id FROM ft WHERE hit")
def _(s):
    return shown(s).where("hit").select("event_id", "id")


@query("e2_rank_curve", SHOWN + " SELECT rank, count(*) AS shown, count(*) FILTER (hit) AS fetched FROM ft GROUP BY rank HAVING count(*) >= 5")
def _(s):
    return shown(s).groupBy("rank").agg(F.count("*").alias("shown"), F.count_if("hit").alias("fetched")).where("shown >= 5")


@query("e3_path_curve", SHOWN + " SELECT CASE WHEN (event_id + rank) % 3 = 0 THEN 'both' WHEN (event_id + rank) % 3 = 1 THEN 'text' ELSE 'vector' END AS matched, count(*) AS shown, count(*) FILTER (hit) AS fetched FROM ft GROUP BY 1")
def _(s):
    k = (F.col("event_id") + F.col("rank")) % 3
    return shown(s).groupBy(F.when(k == 0, "both").when(k == 1, "text").otherwise("vector").alias("matched")).agg(F.count("*").alias("shown"), F.count_if("hit").alias("fetched"))


@query("e4_writer_curve", SHOWN + """, wr AS (SELECT coalesce(z.client, '(unnamed)') AS writer, count(*) AS writes FROM revisions r JOIN sessions z ON z.id = r.session_id GROUP BY 1),
se AS (SELECT coalesce(z.client, '(unnamed)') AS writer, count(DISTINCT ft.session_id) AS sessions, count(DISTINCT event_id) AS searches, count(DISTINCT CASE WHEN hit THEN event_id END) AS own FROM ft LEFT JOIN sessions z ON z.id = ft.session_id GROUP BY 1)
SELECT writer, coalesce(sessions, 0) AS sessions, coalesce(searches, 0) AS searches, coalesce(own, 0) AS own_result, coalesce(writes, 0) AS writes FROM wr FULL JOIN se USING (writer)""")
def _(s):
    z = s.sessions.select(F.col("id").alias("session_id"), "client")
    name = F.coalesce("client", F.lit("(unnamed)")).alias("writer")
    writes = s.revisions.join(z, "session_id").groupBy(name).agg(F.count("*").alias("writes"))
    per = shown(s).groupBy("session_id", "event_id").agg(F.max("hit").alias("own")).join(z, "session_id", "left")
    read = per.groupBy(name).agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("searches"), F.count_if("own").alias("own_result"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return writes.join(read, "writer", "full").select("writer", zero("sessions"), zero("searches"), zero("own_result"), zero("writes"))


@query("e5_fold_outcome", SHOWN + """, fo AS (SELECT event_id, id, hit, id % 2 = 0 AS recorded FROM ft WHERE rank = 4 AND event_id % 3 = 0)
SELECT count(DISTINCT event_id) AS searches, count(*) AS folds, count(*) FILTER (recorded) AS recorded, count(*) FILTER (hit) AS fetched_afterwards, count(*) FILTER (id NOT IN (SELECT base FROM log WHERE action = 'get')) AS never_fetched FROM fo""")
def _(s):
    got = s.log.where("action = 'get'").select(F.col("base").alias("id")).distinct().withColumn("got", F.lit(True))
    fo = shown(s).where("rank = 4 AND event_id % 3 = 0").join(got, "id", "left")
    return fo.agg(F.count_distinct("event_id").alias("searches"), F.count("*").alias("folds"), F.count_if(F.col("id") % 2 == 0).alias("recorded"), F.count_if("hit").alias("fetched_afterwards"), F.count_if(F.col("got").isNull()).alias("never_fetched"))


@query("e6_node_split", SHOWN + """ SELECT memory_kind, count(*) AS total, count(*) FILTER (ord NOT IN (SELECT base FROM log WHERE action = 'get') AND ord NOT IN (SELECT id FROM sh)) AS never_surfaced,
 count(*) FILTER (ord NOT IN (SELECT base FROM log WHERE action = 'get') AND ord IN (SELECT id FROM sh)) AS surfaced_not_fetched, count(*) FILTER (ord IN (SELECT base FROM log WHERE action = 'get')) AS fetched FROM nodes GROUP BY memory_kind""")
def _(s):
    got = s.log.where("action = 'get'").select(F.col("base").alias("ord")).distinct().withColumn("got", F.lit(True))
    seen = e.surfacings(s.log, s.table("documents").count()).select(F.col("id").alias("ord")).distinct().withColumn("seen", F.lit(True))
    rows = s.nodes.join(got, "ord", "left").join(seen, "ord", "left")
    no = F.col("got").isNull()
    return rows.groupBy("memory_kind").agg(F.count("*").alias("total"), F.count_if(no & F.col("seen").isNull()).alias("never_surfaced"), F.count_if(no & F.col("seen").isNotNull()).alias("surfaced_not_fetched"), F.count_if(~no).alias("fetched"))


@query("k6_top_surfaced", SHOWN + " SELECT id, count(*) AS surfaced FROM sh GROUP BY id ORDER BY surfaced DESC, id LIMIT 10")
def _(s):
    return e.surfacings(s.log, s.table("documents").count()).groupBy("id").agg(F.count("*").alias("surfaced")).orderBy(F.desc("surfaced"), "id").limit(10)


SEGMENTS = ", sg AS (SELECT *, sum(CASE WHEN action = 'search' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM log)"


@query("w7_segments", SEGMENTS + " SELECT event_id, cast(g AS bigint) AS segment FROM sg")
def _(s):
    w = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.log.select("event_id", F.sum((F.col("action") == "search").cast("int")).over(w).alias("segment"))


GOLD = SHOWN + SEGMENTS + """, gd AS (SELECT DISTINCT h.event_id AS query_id, q.base AS id FROM sg q JOIN sg h ON h.session_id = q.session_id AND h.g = q.g AND h.action = 'search' WHERE q.action = 'get' AND q.g > 0 AND EXISTS (SELECT 1 FROM sh WHERE sh.event_id = h.event_id AND sh.id = q.base))"""


@query("e15_gold_mining", GOLD + " SELECT query_id, id FROM gd")
def _(s):
    return e.gold_from_log(s.log, s.table("documents").count())


SPANS = """, sp AS (SELECT ord AS id, created_ms AS from_ms, invalidated_ms AS to_ms FROM nodes UNION ALL SELECT ord, invalidated_ms + 432000000, NULL FROM nodes WHERE invalidated_ms IS NOT NULL AND ord % 22 = 3)"""


@query("e15_pruned_labels", GOLD + SPANS + """, lb AS (SELECT gd.query_id, gd.id, epoch_us(l.ts) // 1000 AS at_ms FROM gd JOIN log l ON l.event_id = gd.query_id), vd AS (SELECT lb.*, CASE
  WHEN EXISTS (SELECT 1 FROM sp WHERE sp.id = lb.id AND lb.at_ms >= from_ms AND (to_ms IS NULL OR lb.at_ms < to_ms)) THEN 'kept' WHEN lb.at_ms < (SELECT min(from_ms) FROM sp WHERE sp.id = lb.id) THEN 'early' ELSE 'retired' END AS verdict FROM lb)
SELECT id, count(*) FILTER (verdict = 'kept') AS kept, count(*) FILTER (verdict = 'early') AS early, count(*) FILTER (verdict = 'retired') AS retired FROM vd GROUP BY id""")
def _(s):
    """Labels that held when they were given: notes are live from creation to retirement, and again once restored."""
    first = s.nodes.select(F.col("ord").alias("id"), F.col("created_ms").alias("from_ms"), F.col("invalidated_ms").alias("to_ms"))
    again = s.nodes.where("invalidated_ms IS NOT NULL AND ord % 22 = 3").select(F.col("ord").alias("id"), (F.col("invalidated_ms") + 432_000_000).alias("from_ms"), F.lit(None).cast("bigint").alias("to_ms"))
    asked = s.log.select(F.col("event_id").alias("query_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    labels = e.gold_from_log(s.log, s.table("documents").count()).join(asked, "query_id")
    told = cal.prune_labels(labels, first.unionByName(again))
    return told.groupBy("id").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("kept", "early", "retired")])


@query("j12_search_segments", GOLD + " SELECT id, count(*) AS labels FROM gd GROUP BY id")
def _(s):
    return e.gold_from_log(s.log, s.table("documents").count()).groupBy("id").agg(F.count("*").alias("labels"))


METRICS = GOLD + """, rk AS (SELECT event_id AS query_id, id, rank + 1 AS rank FROM sh), sz AS (SELECT query_id, count(*) AS n FROM gd GROUP BY query_id),
mt AS (SELECT sz.query_id, sz.n, min(rk.rank) AS first, count(rk.rank) AS hits, sum(1 / log2(rk.rank + 1)) AS dcg FROM sz LEFT JOIN (SELECT rk.* FROM rk JOIN gd USING (query_id, id)) rk USING (query_id) GROUP BY sz.query_id, sz.n),
me AS (SELECT query_id, round(coalesce(hits * 1.0 / n, 0), 6) AS recall, CASE WHEN first = 1 THEN 1 ELSE 0 END AS p1, round(coalesce(1.0 / first, 0), 6) AS rr, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) z(i) WHERE i <= n), 6) AS ndcg FROM mt)"""


def measured(s):
    n = s.table("documents").count()
    ranked = e.surfacings(s.log, n).select(F.col("event_id").alias("query_id"), "id", (F.col("rank") + 1).alias("rank"))
    return e.ir_metrics(ranked, e.gold_from_log(s.log, n))


@query("e7_ir_metrics", METRICS + " SELECT query_id, recall, p1, rr, ndcg FROM me")
def _(s):
    return measured(s)


@query("e8_facet_coverage", METRICS + " SELECT query_id, count(DISTINCT n.type) AS facets FROM rk JOIN nodes n ON n.ord = rk.id WHERE rank <= 3 GROUP BY query_id")
def _(s):
    top = e.surfacings(s.log, s.table("documents").count()).where("rank < 3")
    return top.join(s.nodes.select(F.col("ord").alias("id"), "type"), "id").groupBy(F.col("event_id").alias("query_id")).agg(F.count_distinct("type").alias("facets"))


@query("e16_ndcg_by_age", METRICS + f""", ag AS (SELECT gd.query_id, max(n.created_ms) AS youngest FROM gd JOIN nodes n ON n.ord = gd.id GROUP BY gd.query_id)
SELECT CASE WHEN ({NOW} - youngest) / 86400000.0 < 7 THEN '<7d' WHEN ({NOW} - youngest) / 86400000.0 < 30 THEN '7-30d' WHEN ({NOW} - youngest) / 86400000.0 < 90 THEN '30-90d' ELSE '>90d' END AS bucket, count(*) AS n, round(avg(ndcg), 5) AS ndcg FROM me JOIN ag USING (query_id) GROUP BY 1""")
def _(s):
    gold = e.gold_from_log(s.log, s.table("documents").count())
    age = gold.join(s.nodes.select(F.col("ord").alias("id"), "created_ms"), "id").groupBy("query_id").agg(F.max("created_ms").alias("youngest"))
    return measured(s).join(age, "query_id").groupBy(x.age_bucket((NOW - F.col("youngest")) / 86_400_000.0).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 5).alias("ndcg"))


@query("e9_bootstrap")
def _(s):
    rows = measured(s).select("query_id", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("arm"), F.col("rr").alias("a"), F.col("ndcg").alias("b"))
    return cal.bootstrap(rows.select("arm", F.lit("b").alias("side"), "query_id", (F.col("b") - F.col("a")).alias("value")))


@query("e9_unpaired")
def _(s):
    rows = measured(s).select("query_id", F.when(F.col("query_id") % 3 == 0, "a").otherwise("b").alias("side"), F.lit("thirds").alias("arm"), F.col("ndcg").alias("value"))
    return cal.bootstrap(rows)


SWEEP = [0.35 + 0.05 * i for i in range(12)]


def labelled(s):
    return s.candidates.select("score", (F.col("status") == "applied").alias("positive"))


SWEPT = f""", th(threshold) AS (VALUES {", ".join(f"({x!r}::DOUBLE)" for x in SWEEP)}), tp AS (SELECT threshold, count(*) AS kept, count(*) FILTER (status = 'applied') AS tp FROM th JOIN candidates ON score >= threshold GROUP BY threshold),
sw AS (SELECT threshold, coalesce(kept, 0) AS kept, round(CASE WHEN kept > 0 THEN tp * 1.0 / kept ELSE 0 END, 6) AS "precision", round(coalesce(tp, 0) * 1.0 / (SELECT count(*) FROM candidates WHERE status = 'applied'), 6) AS recall, coalesce(kept - tp, 0) AS admitted_negatives FROM th LEFT JOIN tp USING (threshold))"""


@query("e10_threshold_sweep", SWEPT + ' SELECT threshold, kept, "precision", recall, admitted_negatives FROM sw')
def _(s):
    return e.threshold_sweep(labelled(s), SWEEP)


@query("e12_fold_sweep", f""", th(threshold) AS (VALUES {", ".join(f"({x!r}::DOUBLE)" for x in SWEEP)}) SELECT threshold, count(c.id) AS kept FROM th LEFT JOIN candidates c ON c.score >= threshold AND c.detected_ms % 7200000 <> 0 GROUP BY threshold""")
def _(s):
    calm = s.candidates.where("detected_ms % 7200000 <> 0").select("score", (F.col("status") == "applied").alias("positive"))
    return e.threshold_sweep(calm, SWEEP).select("threshold", "kept")


@query("e11_density", KNN + " SELECT round(avg(CASE WHEN score >= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(score), 6) AS mean, max(score) AS best FROM (SELECT query_id, max(score) AS score FROM kn WHERE rank <= 2 AND chunk_id <> query_id GROUP BY query_id) z")
def _(s):
    best = v.knn(asked_vectors(s), fresh(s), 2, "chunk_id").where("chunk_id <> query_id").groupBy("query_id").agg(F.max("score").alias("score"))
    return best.agg(F.round(F.avg((F.col("score") >= 0.3).cast("double")), 6).alias("hit_rate"), F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("best"))


DENSITY = f"""{KNN}, th(threshold) AS (VALUES {", ".join(f"({round(0.05 * k, 2)!r}::DOUBLE)" for k in range(2, 14))}), hp AS (SELECT query_id AS probe, score FROM kn WHERE rank <= 10 AND chunk_id <> query_id),
dd AS (SELECT th.threshold, p.query_id AS probe, least(count(hp.score), 3) AS n FROM th CROSS JOIN qv p LEFT JOIN hp ON hp.probe = p.query_id AND hp.score >= th.threshold GROUP BY ALL),
ds AS (SELECT threshold, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(n), 6) AS mean_shown, list_sort(list(n))[greatest(1, cast(ceil(0.9 * count(*)) AS bigint))] AS p90_shown, max(n) AS max_shown FROM dd GROUP BY threshold)"""
DENSITY_CUTS = [round(0.05 * k, 2) for k in range(2, 14)]


def densities(s):
    near = v.knn(asked_vectors(s), fresh(s), 10, "chunk_id").where("chunk_id <> query_id").select(F.col("query_id").alias("probe"), "score")
    return cal.density(near, asked_vectors(s).select(F.col("query_id").alias("probe")), DENSITY_CUTS)


@query("e11_dedup_density", DENSITY + " SELECT threshold, hit_rate, mean_shown, p90_shown, max_shown FROM ds")
def _(s):
    """What a gate of each threshold would show of the nearest ten, three at most."""
    return densities(s)


@query("e13_gates", DENSITY + """, gt AS (SELECT min(threshold) FILTER (mean_shown < 2.5) AS link, min(threshold) FILTER (mean_shown < 1) AS merge, min(threshold) FILTER (mean_shown < 1.5) AS dedup FROM ds)
SELECT link, greatest(link, merge) AS merge, greatest(link, merge, dedup) AS dedup, dedup < merge OR merge < link AS was_out_of_order FROM gt""")
def _(s):
    """Thresholds for three gates by density, which must not fall from one to the next."""
    g3 = densities(s).agg(cal.first_under(2.5).alias("link"), cal.first_under(1.0).alias("merge"), cal.first_under(1.5).alias("dedup"))
    link, merge, dedup = cal.repaired(F.col("link"), F.col("merge"), F.col("dedup"))
    wrong = (F.col("dedup") < F.col("merge")) | (F.col("merge") < F.col("link"))
    return g3.select(link.alias("link"), merge.alias("merge"), dedup.alias("dedup"), wrong.alias("was_out_of_order"))


@query("e13_recommend", SWEPT + ' SELECT arg_max(threshold, (recall, -threshold)) AS threshold FROM sw WHERE "precision" >= 0.2 AND kept > 0')
def _(s):
    ok = e.threshold_sweep(labelled(s), SWEEP).where("precision >= 0.2 AND kept > 0")
    return ok.agg(F.max_by("threshold", F.struct("recall", -F.col("threshold"))).alias("threshold"))


@query("e14_centred_cosine", """, ex AS (SELECT chunk_id, unnest(embedding)::DOUBLE AS val, generate_subscripts(embedding, 1) AS i FROM vectors), mn AS (SELECT i, avg(val) AS m FROM ex GROUP BY i),
ce AS (SELECT chunk_id, sum((val - m) * (val - m)) AS norm FROM ex JOIN mn USING (i) GROUP BY chunk_id) SELECT chunk_id, round(sqrt(norm), 5) AS norm FROM ce""")
def _(s):
    ex = s.vectors.select("chunk_id", F.posexplode("embedding").alias("i", "val")).withColumn("val", F.col("val").cast("double"))
    mean = ex.groupBy("i").agg(F.avg("val").alias("m"))  # one row for each dimension
    return ex.join(mean, "i").groupBy("chunk_id").agg(F.round(F.sqrt(F.sum((F.col("val") - F.col("m")) ** 2)), 5).alias("norm"))


PAIRED = """, pr AS (SELECT DISTINCT a, b, score FROM candidates), fc AS (SELECT node_id, arg_min(embedding, seq) AS e FROM vectors WHERE stale = 0 GROUP BY node_id),
mx AS (SELECT pr.a, pr.b, pr.score, coalesce(max(list_cosine_similarity(fc.e::DOUBLE[], w.embedding::DOUBLE[])), 0) AS sim FROM pr LEFT JOIN fc ON fc.node_id = pr.a LEFT JOIN vectors w ON w.node_id = pr.b AND w.stale = 0 GROUP BY ALL)"""


def scored_pairs(s):
    return s.candidates.select("a", "b", "score").distinct()


@query("e14_max_similarity", PAIRED + " SELECT a, b, round(sim, 6) AS sim FROM mx")
def _(s):
    """The production scorer: the first chunk of one note against every chunk of the other."""
    return cal.max_similarity(scored_pairs(s), fresh(s)).select("a", "b", F.round("sim", 6).alias("sim"))


@query("e14_centred_similarity", """, pr AS (SELECT DISTINCT a, b, score FROM candidates), mn AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM vectors, range(1, 1025) r(i) WHERE stale = 0 AND i <= len(embedding) GROUP BY i) z),
vc AS (SELECT node_id, seq, list_transform(list_zip(embedding, m), lambda z: z[1]::DOUBLE - z[2]) AS e FROM vectors, mn WHERE stale = 0), fc AS (SELECT node_id, arg_min(e, seq) AS e FROM vc GROUP BY node_id)
SELECT pr.a, pr.b, round(coalesce(max(list_cosine_similarity(fc.e, w.e)), 0), 5) AS sim FROM pr LEFT JOIN fc ON fc.node_id = pr.a LEFT JOIN vc w ON w.node_id = pr.b GROUP BY pr.a, pr.b, pr.score""")
def _(s):
    return cal.max_similarity(scored_pairs(s), fresh(s), centre=True).select("a", "b", F.round("sim", 5).alias("sim"))


@query("e14_drift", PAIRED + " SELECT count(*) AS compared, round(avg(abs(score - sim)), 6) AS mean_abs, round(max(abs(score - sim)), 6) AS max_abs FROM mx")
def _(s):
    return cal.drift(cal.max_similarity(scored_pairs(s), fresh(s)), "score", "sim")


@query("e17_tech_stats", """ SELECT (SELECT count(*) FROM nodes WHERE invalidated_ms IS NULL) AS live_nodes, (SELECT count(*) FROM edges WHERE invalidated_ms IS NULL) AS live_edges, (SELECT count(*) FROM revisions) AS revisions,
 (SELECT count(*) FROM queue WHERE attempts < 5) AS backlog, (SELECT count(*) FROM candidates WHERE status = 'pending') AS pending, (SELECT count(*) FROM vectors WHERE stale = 0) AS chunks""")
def _(s):
    rows = (
        s.nodes.agg(F.count_if(t.live()).alias("live_nodes")), s.edges.agg(F.count_if(t.live()).alias("live_edges")), s.revisions.agg(F.count("*").alias("revisions")),
        s.queue.agg(F.count_if(F.col("attempts") < 5).alias("backlog")), s.candidates.agg(F.count_if(F.col("status") == "pending").alias("pending")), s.vectors.agg(F.count_if(F.col("stale") == 0).alias("chunks")),
    )
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(r)  # one row each
    return out


@query("e18_graph_health", REACHED + """, dg AS (SELECT b.id, b.invalidated_ms FROM edges e JOIN nodes a ON a.id = e.src AND a.invalidated_ms IS NULL JOIN nodes b ON b.id = e.dst WHERE e.invalidated_ms IS NULL AND e.type <> 'supersedes' AND b.invalidated_ms IS NOT NULL)
SELECT (SELECT count(*) FROM la) AS nodes, (SELECT count(*) FROM la WHERE id NOT IN (SELECT src FROM edges WHERE invalidated_ms IS NULL UNION SELECT dst FROM edges WHERE invalidated_ms IS NULL)) AS edgeless, (SELECT count(*) FROM la WHERE id NOT IN (SELECT id FROM z25)) AS detached,
 (SELECT count(*) FROM dg) AS dangling, (SELECT count(*) FROM dg WHERE id IN (SELECT dst FROM edges WHERE type = 'supersedes' AND invalidated_ms IS NULL)) AS repointable,
 (SELECT count(*) FROM edges WHERE invalidated_ms IS NULL AND type = 'similar_to') AS untyped, (SELECT count(*) FROM edges WHERE invalidated_ms IS NULL AND type NOT IN ('similar_to', 'relates_to')) AS typed""")
def graph_health(s):
    """One row: live authored notes, those without an edge, those that no hub reaches, edges to what is gone, links with and without a type."""
    live = s.edges.where(t.live())
    rows = (
        live_authored(s).agg(F.count("*").alias("nodes")), g.edgeless(s.nodes, s.edges).agg(F.count("*").alias("edgeless")), g.detached(s.nodes, s.edges).agg(F.count("*").alias("detached")), dangling(s),
        live.agg(F.count_if(F.col("type") == "similar_to").alias("untyped"), F.count_if(~F.col("type").isin("similar_to", "relates_to")).alias("typed")),
    )
    out = rows[0]
    for r in rows[1:]:
        out = out.crossJoin(r)  # one row each
    return out


@query("e20_review_queue", WEIGHTS + ", sy AS (SELECT e.src, e.dst, e.type, z.principal_id FROM edges e JOIN nodes n ON n.id = e.src LEFT JOIN sessions z ON z.id = n.created_by_session WHERE e.provenance = 'system' AND e.invalidated_ms IS NULL) SELECT src, dst, type FROM sy WHERE principal_id IS NULL OR principal_id NOT IN (SELECT principal_id FROM weights WHERE weight < 1)")
def _(s):
    from .relational import weights

    rows = s.edges.where(t.live() & (F.col("provenance") == "system")).join(s.nodes.select(F.col("id").alias("src"), F.col("created_by_session").alias("sid")), "src")
    rows = rows.join(s.sessions.select(F.col("id").alias("sid"), "principal_id"), "sid", "left")
    return rows.join(weights(s).where("weight < 1").select("principal_id"), "principal_id", "left_anti").select("src", "dst", "type")


@query("e19_working_set", f""", it AS (SELECT scope, id, tokens, row_number() OVER (PARTITION BY scope ORDER BY moment DESC, id) AS n FROM (SELECT coalesce(project, '(none)') AS scope, id, ts_ms AS moment, cast(ceil(length(content) / 4.0) AS bigint) AS tokens
  FROM nodes JOIN current ON node_id = id WHERE {LIVE_AUTHORED}) r WHERE tokens > 0),
walk(scope, n, used, id, taken) AS (SELECT DISTINCT scope, cast(0 AS bigint), cast(0 AS bigint), cast(NULL AS varchar), false FROM it
  UNION ALL SELECT w.scope, it.n, CASE WHEN used + tokens <= 1500 THEN used + tokens ELSE used END, it.id, used + tokens <= 1500 FROM walk w JOIN it ON it.scope = w.scope AND it.n = w.n + 1)
SELECT scope, id FROM walk WHERE taken UNION ALL SELECT coalesce(project, '(none)'), id FROM nodes JOIN current ON node_id = id WHERE {LIVE_AUTHORED} AND length(content) = 0""")
def _(s):
    from tessera.operators.relational import within_budget

    rows = live_authored(s).join(s.current.select(F.col("node_id").alias("id"), "content", F.col("ts_ms").alias("at")), "id")
    rows = rows.select(F.coalesce("project", F.lit("(none)")).alias("scope"), (-F.col("at")).alias("newest"), "id", x.estimate_tokens(F.col("content")).alias("tokens"))
    return within_budget(rows, "scope", ["newest"], "tokens", 1500, "id")


@query("t9_content_overlap", r""", st(w) AS (VALUES ('the'), ('and'), ('for'), ('with')), qw AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'for', 'with'))) AS a FROM benchmark)
SELECT p.item_id AS x, q.item_id AS y, round(CASE WHEN len(p.a) = 0 THEN 0 ELSE len(list_intersect(p.a, q.a)) * 1.0 / len(p.a) END, 6) AS overlap FROM qw p JOIN qw q ON q.item_id = p.item_id + 1""")
def _(s):
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin("the", "and", "for", "with")))
    b = s.table("benchmark").select("item_id", words.alias("a"))
    n = b.select(F.col("item_id").alias("y"), (F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    share = F.when(F.size("a") == 0, 0.0).otherwise(F.size(F.array_intersect("a", "b")) / F.size("a"))
    return b.join(n, "item_id").select(F.col("item_id").alias("x"), "y", F.round(share, 6).alias("overlap"))


@query("a9_min_distance", KNN + " SELECT query_id, node_id, round(1 - max(score), 6) AS distance FROM kn WHERE rank <= 20 GROUP BY query_id, node_id")
def _(s):
    near = v.knn(asked_vectors(s), fresh(s), 20, "chunk_id").join(s.vectors.select("chunk_id", "node_id"), "chunk_id")
    return near.groupBy("query_id", "node_id").agg(F.round(1 - F.max("score"), 6).alias("distance"))


@query("a16_cluster_mean", "SELECT type, provenance, count(*) AS n, round(avg(weight), 6) AS mean FROM edges WHERE invalidated_ms IS NULL GROUP BY type, provenance HAVING count(*) >= 3")
def _(s):
    return s.edges.where(t.live()).groupBy("type", "provenance").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean")).where("n >= 3")


@query("a16_mean_similarity", """, fc AS (SELECT node_id, arg_min(embedding, seq) AS e FROM vectors WHERE stale = 0 GROUP BY node_id), mb AS (SELECT coalesce(n.project, '') || '/' || n.type AS grp, n.id, e::DOUBLE[] AS e FROM nodes n JOIN fc ON fc.node_id = n.id)
SELECT a.grp AS "group", max(k.members) AS members, round(avg(list_cosine_similarity(a.e, b.e)), 6) AS mean FROM mb a JOIN mb b ON a.grp = b.grp AND a.id < b.id JOIN (SELECT grp, count(*) AS members FROM mb GROUP BY grp) k ON k.grp = a.grp GROUP BY a.grp""")
def _(s):
    """The mean similarity over all pairs of each group, from sums."""
    rows = v.first_vectors(fresh(s)).join(s.nodes.select(F.col("id").alias("node_id"), F.concat(F.coalesce("project", F.lit("")), F.lit("/"), "type").alias("group")), "node_id")
    return v.mean_similarity(rows.select("group", "embedding")).where("members > 1").select("group", "members", F.round("mean", 6).alias("mean"))


@query("a21_auc_by_type", ", z AS (SELECT score, status = 'applied' AS pos FROM candidates), rk AS (SELECT pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM z) SELECT round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * 1.0 * count(*) FILTER (NOT pos)), 6) AS auc FROM rk")
def _(s):
    return auc(labelled(s), "score", "positive")


# --- state from events


@query("st1_feed", "SELECT event_id, event_type, json_extract_string(props, '$.error') IS NULL AS ok FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(s):
    from tessera.streaming import activity_feed

    return activity_feed(s.table("events")).where("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type", "ok")


ELIGIBLE = f"attempts < 5 AND (attempts = 0 OR last_attempt_ms + least(1000 * pow(2, attempts - 1), 60000) <= {NOW - 300 * HOUR})"


@query("st2_eligible", f"SELECT node_id FROM queue WHERE {ELIGIBLE}")
def _(s):
    return s.queue.where(ELIGIBLE).select("node_id")


@query("st2_batch", f"SELECT node_id, attempts, CASE WHEN attempts + 1 >= 5 THEN 'parked' ELSE 'retry' END AS on_failure FROM queue WHERE {ELIGIBLE} ORDER BY last_attempt_ms NULLS FIRST, node_id LIMIT 16")
def _(s):
    """The next batch, longest waiting first, and what becomes of each entry if it fails again."""
    after = F.when(F.col("attempts") + 1 >= 5, "parked").otherwise("retry")
    return s.queue.where(ELIGIBLE).orderBy(F.asc_nulls_first("last_attempt_ms"), "node_id").limit(16).select("node_id", "attempts", after.alias("on_failure"))


@query("st3_reconcile", f"SELECT id FROM nodes WHERE {LIVE_AUTHORED} AND id NOT IN (SELECT node_id FROM vectors WHERE stale = 0) AND id NOT IN (SELECT node_id FROM queue)")
def _(s):
    known = fresh(s).select(F.col("node_id").alias("id")).union(s.queue.select("node_id"))
    return live_authored(s).select("id").join(known, "id", "left_anti")


@query("st4_leases", f"SELECT id, lease_expires_ms IS NULL OR lease_expires_ms < {NOW - 100 * HOUR} AS claimable FROM jobs WHERE state = 'running'")
def _(s):
    return s.jobs.where("state = 'running'").select("id", (F.col("lease_expires_ms").isNull() | (F.col("lease_expires_ms") < NOW - 100 * HOUR)).alias("claimable"))


LEASES = """SELECT concat('role', cast(event_id % 7 AS string)) AS role, {ms} AS at_ms, event_id AS seq, CASE WHEN event_id % 11 = 3 THEN 'release' ELSE 'hold' END AS op, concat('w', cast(user_id % 3 AS string)) AS owner FROM {events}"""


@query("st4_lease_history", ", le AS (" + LEASES.format(ms="epoch_us(ts) // 1000", events="events") + f"""), ls AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY at_ms, seq) AS n FROM le),
walk(role, n, holder, until_ms, granted) AS (SELECT DISTINCT role, cast(0 AS bigint), cast(NULL AS varchar), cast(0 AS bigint), false FROM le
  UNION ALL SELECT w.role, h.n, CASE WHEN h.op = 'release' THEN (CASE WHEN w.holder = h.owner THEN NULL ELSE w.holder END) WHEN w.holder IS NULL OR w.holder = h.owner OR w.until_ms <= h.at_ms THEN h.owner ELSE w.holder END,
    CASE WHEN h.op = 'hold' AND (w.holder IS NULL OR w.holder = h.owner OR w.until_ms <= h.at_ms) THEN h.at_ms + {HOUR} ELSE w.until_ms END, h.op = 'hold' AND (w.holder IS NULL OR w.holder = h.owner OR w.until_ms <= h.at_ms)
  FROM walk w JOIN ls h ON h.role = w.role AND h.n = w.n + 1)
SELECT h.role, h.at_ms, h.seq, h.owner, w.granted, w.until_ms AS expires_ms FROM walk w JOIN ls h USING (role, n) WHERE h.op = 'hold'""")
def _(s):
    """Every attempt to hold a worker's lease."""
    rows = s.spark.sql(LEASES.format(ms="unix_millis(cast(ts AS timestamp))", events="{events}"), events=s.table("events"))
    return lc.leases(rows, HOUR)


@query("st5_claimable", f"SELECT kind, arg_min(id, (scheduled_ms, id)) AS id FROM jobs WHERE (state = 'pending' AND scheduled_ms <= {NOW}) OR (state = 'running' AND lease_expires_ms < {NOW} AND attempts < max_attempts) GROUP BY kind")
def _(s):
    ready = ((F.col("state") == "pending") & (F.col("scheduled_ms") <= NOW)) | ((F.col("state") == "running") & (F.col("lease_expires_ms") < NOW) & (F.col("attempts") < F.col("max_attempts")))
    return s.jobs.where(ready).groupBy("kind").agg(F.min_by("id", F.struct("scheduled_ms", "id")).alias("id"))


JOB_EVENTS = """SELECT concat(cast(user_id AS string), '-', cast(event_id % 4 AS string)) AS job, {ms} AS at_ms, event_id AS seq,
  CASE event_id % 9 WHEN 3 THEN 'renew' WHEN 4 THEN 'succeed' WHEN 5 THEN 'fail' WHEN 6 THEN 'fail' WHEN 7 THEN (CASE WHEN event_id % 36 = 7 THEN 'cancel' ELSE 'renew' END) WHEN 8 THEN (CASE WHEN event_id % 27 = 8 THEN 'reconcile' ELSE 'claim' END) ELSE 'claim' END AS op,
  concat('w', cast(event_id % 2 AS string)) AS owner FROM {events}"""


@query("st5_job_states", ", je AS (" + JOB_EVENTS.format(ms="epoch_us(ts) // 1000", events="events") + f"""), hs AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY at_ms, seq) AS n FROM je),
walk(job, n, state, owner, expires_ms, attempts, ended_ms) AS (SELECT DISTINCT job, cast(0 AS bigint), 'pending', cast(NULL AS varchar), cast(NULL AS bigint), cast(0 AS bigint), cast(NULL AS bigint) FROM je
  UNION ALL SELECT w.job, h.n, c.s.state, c.s.owner, c.s.expires_ms, c.s.attempts, c.s.ended_ms FROM walk w JOIN hs h ON h.job = w.job AND h.n = w.n + 1, LATERAL (SELECT CASE
    WHEN h.op = 'claim' AND (w.state = 'pending' OR (w.state = 'running' AND w.expires_ms <= h.at_ms)) AND w.attempts < 3 THEN {{'state': 'running', 'owner': h.owner, 'expires_ms': h.at_ms + {HOUR}, 'attempts': w.attempts + 1, 'ended_ms': cast(NULL AS bigint)}}
    WHEN h.op = 'renew' AND w.state = 'running' AND w.owner = h.owner THEN {{'state': 'running', 'owner': w.owner, 'expires_ms': h.at_ms + {HOUR}, 'attempts': w.attempts, 'ended_ms': cast(NULL AS bigint)}}
    WHEN h.op = 'succeed' AND w.state = 'running' AND w.owner = h.owner THEN {{'state': 'done', 'owner': cast(NULL AS varchar), 'expires_ms': cast(NULL AS bigint), 'attempts': w.attempts, 'ended_ms': h.at_ms}}
    WHEN w.state = 'running' AND ((h.op = 'fail' AND w.owner = h.owner) OR h.op = 'reconcile') THEN {{'state': CASE WHEN w.attempts >= 3 THEN 'failed' ELSE 'pending' END, 'owner': cast(NULL AS varchar), 'expires_ms': cast(NULL AS bigint), 'attempts': w.attempts, 'ended_ms': CASE WHEN w.attempts >= 3 THEN h.at_ms END}}
    WHEN h.op = 'cancel' AND w.state NOT IN ('done', 'failed', 'cancelled') THEN {{'state': 'cancelled', 'owner': cast(NULL AS varchar), 'expires_ms': cast(NULL AS bigint), 'attempts': w.attempts, 'ended_ms': h.at_ms}}
    ELSE {{'state': w.state, 'owner': w.owner, 'expires_ms': w.expires_ms, 'attempts': w.attempts, 'ended_ms': w.ended_ms}} END AS s) c)
SELECT job, state, owner, expires_ms, attempts, ended_ms FROM walk QUALIFY row_number() OVER (PARTITION BY job ORDER BY n DESC) = 1""")
def _(s):
    from tessera.operators.relational import fold_jobs

    rows = s.spark.sql(JOB_EVENTS.format(ms="unix_millis(cast(ts AS timestamp))", events="{events}"), events=s.table("events"))
    return fold_jobs(rows, HOUR, 3)


@query("st6_due", f"SELECT kind, max(ended_ms) IS NULL OR max(ended_ms) + {6 * HOUR} <= {NOW} AS due FROM jobs GROUP BY kind")
def _(s):
    return s.jobs.groupBy("kind").agg((F.max("ended_ms").isNull() | (F.max("ended_ms") + 6 * HOUR <= NOW)).alias("due"))


@query("st7_quota", "SELECT user_id, time_bucket(INTERVAL 10 MINUTE, ts) - k * INTERVAL 10 MINUTE AS start, count(*) AS calls FROM events CROSS JOIN (SELECT unnest(range(6)) AS k) s GROUP BY 1, 2")
def _(s):
    from tessera.streaming import quota_windows

    return quota_windows(s.table("events"), slide="10 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "calls")


@query("st8_burst", "SELECT e.src, e.dst, e.type FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst WHERE a.created_by_session = b.created_by_session AND abs(a.created_ms - b.created_ms) < 360000000")
def _(s):
    n = s.nodes.select("id", "created_by_session", "created_ms")
    rows = s.edges.join(n.select(F.col("id").alias("src"), F.col("created_by_session").alias("s1"), F.col("created_ms").alias("c1")), "src").join(n.select(F.col("id").alias("dst"), F.col("created_by_session").alias("s2"), F.col("created_ms").alias("c2")), "dst")
    return rows.where((F.col("s1") == F.col("s2")) & (F.abs(F.col("c1") - F.col("c2")) < 100 * HOUR)).select("src", "dst", "type")


@query("st10_sessions", """, gp AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
gs AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM gp) SELECT user_id, min(ts) AS start, count(*) AS events FROM gs GROUP BY user_id, k""")
def _(s):
    from tessera.streaming import sessions

    return sessions(s.table("events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "events")


@query("st11_notices", "SELECT event_id, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS news FROM events")
def _(s):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return s.table("events").select("event_id", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w))).alias("news"))


@query("st12_stage_times", "SELECT event_type, count(d) AS n, cast(sum(d) AS bigint) AS micros FROM (SELECT event_type, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS d FROM events) z GROUP BY event_type")
def _(s):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return s.table("events").select("event_type", (F.lead(us).over(w) - us).alias("d")).groupBy("event_type").agg(F.count("d").alias("n"), F.sum("d").alias("micros"))


@query("st13_abandoned", f"SELECT id, CASE WHEN state = 'running' AND lease_expires_ms < {NOW} THEN 'abandoned' ELSE state END AS state, coalesce(ended_ms, CASE WHEN state = 'running' AND lease_expires_ms < {NOW} THEN lease_expires_ms END) AS ended_ms FROM jobs")
def _(s):
    lost = (F.col("state") == "running") & (F.col("lease_expires_ms") < NOW)
    return s.jobs.select("id", F.when(lost, "abandoned").otherwise(F.col("state")).alias("state"), F.coalesce("ended_ms", F.when(lost, F.col("lease_expires_ms"))).alias("ended_ms"))


@query("z16_sequence_audit", "SELECT g.event_id, CASE WHEN f.first IS NULL OR f.first > g.ts THEN 'no' WHEN f.first = g.ts THEN 'unknown' ELSE 'yes' END AS searched_before FROM log g LEFT JOIN (SELECT session_id, min(ts) AS first FROM log WHERE action = 'search' GROUP BY session_id) f USING (session_id) WHERE action = 'get'")
def _(s):
    first = s.log.where("action = 'search'").groupBy("session_id").agg(F.min("ts").alias("first"))
    v_ = F.when(F.col("first").isNull() | (F.col("first") > F.col("ts")), "no").when(F.col("first") == F.col("ts"), "unknown").otherwise("yes")
    return s.log.where("action = 'get'").join(first, "session_id", "left").select("event_id", v_.alias("searched_before"))


@query("z20_role_agreement", rf""", tx AS (SELECT node_id, list_distinct(list_filter({TOK.format("content")}, lambda w: regexp_matches(w, '^[a-z]{{{{3,}}}}$'))) AS w, list_distinct(regexp_extract_all(content, '\b\d+(?:\.\d+)?\b')) AS nums FROM current),
mj AS (SELECT type, max(n) * 1.0 / sum(n) AS majority FROM (SELECT type, provenance, count(*) AS n FROM edges GROUP BY ALL) c GROUP BY type)
SELECT type, count(*) AS n, round(avg(CASE WHEN (weight > 0.75) = (provenance = 'agent') THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(any_value(majority), 6) AS majority,
  round(avg(CASE WHEN len(a.w) = 0 THEN 1 ELSE len(list_intersect(a.w, b.w)) * 1.0 / len(a.w) END), 5) AS coverage, cast(sum(len(b.nums) - len(list_intersect(a.nums, b.nums))) AS bigint) AS invented_numbers
FROM edges e JOIN mj USING (type) JOIN tx a ON a.node_id = e.src JOIN tx b ON b.node_id = e.dst GROUP BY type""".replace("{{", "{").replace("}}", "}"))
def _(s):
    """Verdicts against labels and their majority; what the second text keeps of the first one's words, and numbers that only it has."""
    words = F.array_distinct(F.filter(x.tokens(F.col("content")), lambda w: w.rlike("^[a-z]{3,}$")))
    numbers = F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0)))
    nums = s.current.select("node_id", numbers.alias("nums"))
    sets = x.coded(s.current.select("node_id", words.alias("w")), "node_id", "w").join(nums, "node_id")
    rows = x.met(s.edges, sets)
    right = ((F.col("weight") > 0.75) == (F.col("provenance") == "agent")).cast("double")
    common = s.edges.groupBy("type", "provenance").agg(F.count("*").alias("c")).groupBy("type").agg(F.round(F.max("c") / F.sum("c"), 6).alias("majority"))
    out = rows.groupBy("type").agg(
        F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(x.shared_coverage(F.col("n_src"), F.col("both"))), 5).alias("coverage"), F.sum(F.size(F.array_except("nums_dst", "nums_src"))).cast("long").alias("invented_numbers")
    )
    return out.join(common, "type")


@query("z21_logged_queries", "SELECT json_extract_string(props, '$.k') AS q, max(ts) AS last FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def _(s):
    k = F.get_json_object("props", "$.k")
    return s.table("events").where(k.isNotNull()).groupBy(k.alias("q")).agg(F.max("ts").alias("last"))


@query("z23_lifecycle", "SELECT session_id, CASE WHEN count(*) FILTER (ts = f) > 1 THEN 'unknown' WHEN max(CASE WHEN ts = f THEN action END) = 'search' THEN 'yes' ELSE 'no' END AS opens_with_search FROM (SELECT *, min(ts) OVER (PARTITION BY session_id) AS f FROM log) z GROUP BY session_id")
def _(s):
    first = s.log.groupBy("session_id").agg(F.min("ts").alias("f"))
    rows = s.log.join(first, "session_id").where("ts = f").groupBy("session_id").agg(F.count("*").alias("n"), F.max("action").alias("a"))
    return rows.select("session_id", F.when(F.col("n") > 1, "unknown").when(F.col("a") == "search", "yes").otherwise("no").alias("opens_with_search"))


COUNTED = """, ct AS (SELECT conv_id, 'chars:' || role AS name, coalesce(length(text), 0) AS n FROM conversations UNION ALL SELECT conv_id, 'lines', len(string_split(coalesce(text, ''), chr(10))) - 1 FROM conversations
  UNION ALL SELECT conv_id, 'questions', len(regexp_extract_all(text, '[?]')) FROM conversations WHERE contains(text, '?')), tc AS (SELECT conv_id, name, sum(n)::BIGINT AS n FROM ct GROUP BY ALL)"""


@query("a24_trace_counters", COUNTED + " SELECT name, count(*) AS traces, count(*) FILTER (n = 0) AS zero, (SELECT count(DISTINCT conv_id) FROM conversations) - count(*) AS missing, sum(n)::BIGINT AS total, max(n) AS most FROM tc GROUP BY name")
def _(s):
    """Counters of each trace merged by name, then over traces: which have a name, which have it as zero, which lack it."""
    text = F.coalesce("text", F.lit(""))
    asks = F.when(F.contains("text", F.lit("?")), F.create_map(F.lit("questions"), F.regexp_count("text", F.lit("[?]")).cast("bigint"))).otherwise(F.create_map().cast("map<string,bigint>"))
    counters = F.map_concat(F.create_map(F.concat(F.lit("chars:"), "role"), F.length(text).cast("bigint"), F.lit("lines"), (F.size(F.split(text, "\n")) - 1).cast("bigint")), asks)
    traces = cal.merged_counters(s.table("conversations").select("conv_id", counters.alias("counters")), ["conv_id"], "counters")
    n = traces.count()
    flat = traces.select(F.explode("counters").alias("name", "n"))
    return flat.groupBy("name").agg(F.count("*").alias("traces"), F.count_if(F.col("n") == 0).alias("zero"), (F.lit(n) - F.count("*")).alias("missing"), F.sum("n").alias("total"), F.max("n").alias("most"))


@query("a24_trace_audit", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS traces, cast(sum(length(text)) AS bigint) AS chars FROM conversations GROUP BY role")
def _(s):
    return s.table("conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("traces"), F.sum(F.length("text")).cast("bigint").alias("chars"))


