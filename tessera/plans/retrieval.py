"""Text and vector search, fusion, re-scoring, graph expansion, diversification."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import calibration as cal
from tessera.operators import graph as g
from tessera.operators import ranking as k
from tessera.operators import relational as r
from tessera.operators import sections as sec
from tessera.operators import temporal as t
from tessera.operators import text as x
from tessera.operators import vector as v
from tessera.operators.search import search, search_with_totals
from tessera.sources.corpus import NOW

from .registry import query
from .relational import LIVE_AUTHORED, SECTIONS, WEIGHTS, chunks, live_authored, weights

TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
#: Every benchmark item as a query: its first three words as a phrase, the others one by one.
RAW = rf""", raw AS (SELECT item_id AS query_id, {TOK.format("text")} AS w FROM benchmark), rq AS (SELECT query_id, w, CASE WHEN len(w) >= 3 THEN array_to_string(w[1:3], ' ') END AS phrase, CASE WHEN len(w) >= 3 THEN w[4:] ELSE w END AS bare FROM raw)"""
TERMS = RAW + ", q AS (SELECT query_id, unnest(list_distinct(bare)) AS term FROM rq)"
#: The same items word by word.
WORDS = rf""", q AS (SELECT item_id AS query_id, unnest(list_distinct({TOK.format("text")})) AS term FROM benchmark)"""


def raw_queries(s):
    """query_id, raw: every benchmark item as it might be typed, its first three words in quotation marks."""
    w = x.tokens(F.col("text"))
    quoted = F.concat(F.lit('"'), F.array_join(F.slice(w, 1, 3), " "), F.lit('" '), F.array_join(F.slice(w, 4, F.greatest(F.size(w), F.lit(1))), " "))
    return s.table("benchmark").select(F.col("item_id").alias("query_id"), F.when(F.size(w) >= 3, quoted).otherwise(F.array_join(w, " ")).alias("raw"))


def asked(s):
    """The terms of every query, phrases as words apart by a space."""
    return x.query_terms(raw_queries(s), "query_id", "raw").select("query_id", "term").distinct()


def asked_words(s):
    terms = F.array_distinct(x.tokens(F.col("text")))
    return s.table("benchmark").select(F.col("item_id").alias("query_id"), F.explode(terms).alias("term"))


def documents(s):
    """Title and current body of every node, invalidated ones too."""
    return s.nodes.select("id", "title").join(s.current.select(F.col("node_id").alias("id"), F.col("content").alias("body")), "id")


#: A word without the commonest English endings.
STEM = r"CASE WHEN length({0}) <= 3 THEN {0} ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, 'sses$', 'ss'), 'ies$', 'i'), '([^su])s$', '\1'), '([aeiouy][a-z]*[^aeiou])(?:ing|ed)$', '\1') END"


def bm25_sql(terms: str, index: str, phrases: str = "") -> str:
    """From the terms ``q`` (query_id, term) and the index ``idx`` (id, field, toks) to scores ``bm``; ``phrases`` are rows
    (query_id, phrase) of three words each, which count where they stand one after another."""
    held = rf""",
ph0 AS ({phrases}), ph1 AS (SELECT DISTINCT query_id, list_transform(string_split(phrase, ' '), lambda z: {STEM.format("z")}) AS p FROM ph0),
sx AS (SELECT id, field, dl, list_transform(toks, lambda z: {STEM.format("z")}) AS sw FROM (SELECT id, field, len(toks) AS dl, toks FROM idx) y),
pw AS (SELECT DISTINCT unnest(p) AS term FROM ph1), wd AS (SELECT field, term, count(*) AS df FROM (SELECT DISTINCT id, field, unnest(sw) AS term FROM sx) z WHERE term IN (SELECT term FROM pw) GROUP BY ALL),
pi AS (SELECT p, field, sum(idf) AS idf FROM (SELECT p, field, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT p, unnest(p) AS term FROM (SELECT DISTINCT p FROM ph1) u) v JOIN wd USING (term) JOIN st USING (field)) z GROUP BY ALL),
pf AS (SELECT p, id, field, dl, len(list_filter(range(1, len(sw) - 1), lambda i: sw[i] = p[1] AND sw[i + 1] = p[2] AND sw[i + 2] = p[3])) AS tf FROM (SELECT DISTINCT p FROM ph1) u JOIN sx ON contains(' ' || array_to_string(sw, ' ') || ' ', ' ' || array_to_string(p, ' ') || ' ')),
ps AS (SELECT query_id, id, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM ph1 JOIN pf USING (p) JOIN pi USING (p, field) JOIN st USING (field) WHERE tf > 0)"""
    return rf"""{terms}, qs AS (SELECT DISTINCT query_id, {STEM.format("term")} AS term FROM q), idx AS ({index}),
st AS (SELECT field, count(*) AS n, avg(len(toks)) AS avgdl FROM idx GROUP BY field),
tf AS (SELECT id, field, dl, term, count(*) AS tf FROM (SELECT id, field, dl, {STEM.format("term")} AS term FROM (SELECT id, field, len(toks) AS dl, unnest(toks) AS term FROM idx) y) z WHERE term IN (SELECT term FROM qs) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL){held if phrases else ""},
bm AS (SELECT query_id, id, round(sum(score), 6) AS score FROM (SELECT qs.query_id, tf.id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score
  FROM qs JOIN tf USING (term) JOIN df USING (field, term) JOIN st USING (field){" UNION ALL SELECT query_id, id, score FROM ps" if phrases else ""}) z GROUP BY query_id, id)"""


NOTES = f"""SELECT n.id, 'title' AS field, {TOK.format("n.title")} AS toks FROM nodes n JOIN current c ON c.node_id = n.id
  UNION ALL SELECT n.id, 'body', {TOK.format("c.content")} FROM nodes n JOIN current c ON c.node_id = n.id"""
BM25 = f"""{bm25_sql(TERMS, NOTES, "SELECT query_id, phrase FROM rq WHERE phrase IS NOT NULL")},
tl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 40)"""

def text_list(s, cap=40):
    return search(s.text_index, asked(s), cap)


@query("t1_query_terms", RAW + """ SELECT query_id, 0 AS pos, phrase AS term, 3 AS words FROM rq WHERE phrase IS NOT NULL
  UNION ALL SELECT query_id, i - CASE WHEN phrase IS NULL THEN 1 ELSE 0 END, bare[i], 1 FROM rq, LATERAL (SELECT unnest(range(1, len(bare) + 1)) AS i) u""")
def _(s):
    return x.query_terms(raw_queries(s), "query_id", "raw")


@query("t2_bm25_topk", BM25 + " SELECT query_id, id, score, total FROM tl JOIN (SELECT query_id, count(*) AS total FROM bm GROUP BY query_id) n USING (query_id) WHERE rank <= 10")
def _(s):
    """The best ten of queries with a phrase each, with the exact number of all hits."""
    return search_with_totals(s.text_index, asked(s), 10).select("query_id", "id", "score", "total")


PHRASE = rf""", p AS (SELECT item_id AS phrase_id, {TOK.format("text")} AS w FROM benchmark)"""


@query("t3_phrase", PHRASE + rf""" SELECT DISTINCT p.phrase_id, c.node_id AS id FROM p JOIN (SELECT node_id, ' ' || array_to_string({TOK.format("content")}, ' ') || ' ' AS body FROM current) c
  ON len(w) > 0 AND contains(c.body, ' ' || array_to_string(w, ' ') || ' ')""")
def _(s):
    phrases = s.table("benchmark").select(F.col("item_id").alias("phrase_id"), F.array_join(x.tokens(F.col("text")), " ").alias("phrase"))
    return x.phrase_hits(documents(s), "id", "body", phrases)


@query("t4_best_chunk", rf"""{WORDS}{SECTIONS}, ch AS (SELECT node_id, seq, {TOK.format("text")} AS toks FROM chunks),
hit AS (SELECT q.query_id, ch.node_id, ch.seq, count(DISTINCT q.term) AS n FROM (SELECT node_id, seq, unnest(toks) AS term FROM ch) ch JOIN q USING (term) GROUP BY ALL)
SELECT query_id, node_id, seq, n FROM hit QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY n DESC, seq) = 1""")
def _(s):
    return x.best_parts(sec.stretches(s.outlined, "node_id", "body"), "node_id", asked_words(s)).select("query_id", "node_id", "seq", "n")


@query("t6_text_rank", BM25 + f""" SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id)
  * CASE WHEN memory_kind = 'episodic' THEN exp(-greatest(({NOW} - created_ms) / 86400000.0, 0) / 3) ELSE 1 END * CASE WHEN type = 'symbol' THEN 0.5 ELSE 1 END
  * CASE WHEN use_count > 0 THEN 1 + 0.25 * least(1, ln(1 + use_count) / ln(21)) ELSE 1 END, 6) AS score FROM tl JOIN nodes USING (id)""")
def _(s):
    rows = text_list(s).join(s.nodes.select("id", "memory_kind", "type", "created_ms", "use_count"), "id")
    top = F.max("score").over(Window.partitionBy("query_id"))
    factor = k.memory_factor(F.col("memory_kind"), F.col("created_ms"), NOW) * k.symbol_factor(F.col("type"), 0.5) * k.strength_factor(F.col("use_count"), 0.25)
    return rows.select("query_id", "id", F.round(F.col("score") / top * factor, 6).alias("score"))


@query("t7_jaccard", rf""", tk AS (SELECT node_id, list_distinct({TOK.format("content")}) AS w FROM current)
SELECT e.src, e.dst, e.type, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) * 1.0 / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 6) AS jaccard
FROM edges e JOIN tk a ON a.node_id = e.src JOIN tk b ON b.node_id = e.dst""")
def _(s):
    e = x.met(s.edges, x.coded(s.current.select("node_id", F.array_distinct(x.tokens(F.col("content"))).alias("w")), "node_id", "w"))
    return e.select("src", "dst", "type", F.round(x.shared_jaccard(F.col("n_src"), F.col("n_dst"), F.col("both")), 6).alias("jaccard"))


@query("t8_coverage", rf""", tk AS (SELECT node_id, list_distinct({TOK.format("content")}) AS w FROM current)
SELECT e.src, e.dst, e.type, round(CASE WHEN len(a.w) = 0 THEN 1 ELSE len(list_intersect(a.w, b.w)) * 1.0 / len(a.w) END, 6) AS coverage FROM edges e JOIN tk a ON a.node_id = e.src JOIN tk b ON b.node_id = e.dst""")
def _(s):
    e = x.met(s.edges, x.coded(s.current.select("node_id", F.array_distinct(x.tokens(F.col("content"))).alias("w")), "node_id", "w"))
    return e.select("src", "dst", "type", F.round(x.shared_coverage(F.col("n_src"), F.col("both")), 6).alias("coverage"))


@query("t10_annotated_index", "SELECT n.id, n.title || CASE WHEN n.ord % 4 = 0 THEN ' ' || n.type || ' ' || n.memory_kind ELSE '' END AS indexed FROM nodes n")
def _(s):
    notes = s.nodes.where("ord % 4 = 0").select("id", F.concat_ws(" ", "type", "memory_kind").alias("terms"))
    return s.nodes.select("id", "title").join(notes, "id", "left").select("id", F.concat_ws(" ", "title", "terms").alias("indexed"))


# --- vectors. The query set of searches: every chunk whose id is divisible by 20, against all.

QV = ", qv AS (SELECT chunk_id AS query_id, embedding AS e FROM vectors WHERE cast(substr(chunk_id, 2) AS bigint) % 20 = 0)"
KNN = QV + """, nn AS (SELECT query_id, chunk_id, node_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM qv, vectors WHERE stale = 0),
kn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM nn)"""


def asked_vectors(s):
    return s.vectors.where("cast(substr(chunk_id, 2) AS bigint) % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")


def fresh(s):
    return s.vectors.where("stale = 0")


@query("v1_cosine", "SELECT a.chunk_id AS x, b.chunk_id AS y, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM vectors a JOIN vectors b ON cast(substr(b.chunk_id, 2) AS bigint) = cast(substr(a.chunk_id, 2) AS bigint) + 1")
def _(s):
    n = F.expr("cast(substr(chunk_id, 2) AS bigint)")
    a = s.vectors.select(F.col("chunk_id").alias("x"), F.col("embedding").alias("a"), (n + 1).alias("n"))
    return a.join(s.vectors.select(F.col("chunk_id").alias("y"), F.col("embedding").alias("b"), n.alias("n")), "n").select("x", "y", F.round(v.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query("v2_knn_topk", KNN + " SELECT query_id, chunk_id, score FROM kn WHERE rank <= 10")
def _(s):
    return v.knn(asked_vectors(s), fresh(s), 10, "chunk_id").select("query_id", "chunk_id", "score")


@query("v2_knn_topk_then_filter", KNN + f""", b AS (SELECT query_id, node_id, max(score) AS score FROM kn WHERE rank <= 1000 AND node_id IN (SELECT id FROM nodes WHERE {LIVE_AUTHORED}) GROUP BY ALL)
SELECT query_id, node_id, score FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 40""")
def _(s):
    return v.knn_then_filter(asked_vectors(s), fresh(s), live_authored(s).select("id"), 1000, 40).select("query_id", "node_id", "score")


@query("v3_scoped_knn", KNN + """, sc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r2 FROM nn WHERE node_id IN (SELECT id FROM nodes WHERE memory_kind = 'mirror'))
SELECT query_id, chunk_id, score FROM sc WHERE r2 <= 5""")
def _(s):
    scope = fresh(s).join(s.nodes.where("memory_kind = 'mirror'").select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return v.knn(asked_vectors(s), scope, 5, "chunk_id").select("query_id", "chunk_id", "score")


SEEDS = ", sd AS (SELECT node_id AS query_id, arg_min(embedding, seq) AS e FROM vectors WHERE stale = 0 AND cast(substr(node_id, 2) AS bigint) % 20 = 0 GROUP BY node_id)"


@query("v4_seeded_neighbours", SEEDS + """, nn AS (SELECT query_id, chunk_id, node_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM sd, vectors WHERE stale = 0),
kn AS (SELECT * FROM nn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20), m AS (SELECT query_id, node_id, max(score) AS score FROM kn WHERE node_id <> query_id GROUP BY ALL HAVING max(score) >= 0.2)
SELECT query_id, node_id, score FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 10""")
def _(s):
    seeds = v.first_vectors(fresh(s)).where("cast(substr(node_id, 2) AS bigint) % 20 = 0").withColumnRenamed("node_id", "query_id")
    return v.seeded_neighbours(seeds, fresh(s), 20, 10, 0.2).select("query_id", "node_id", "score")


@query("v5_first_vector", "SELECT node_id, round(arg_min(embedding[1], seq), 6) AS first FROM vectors GROUP BY node_id")
def _(s):
    return v.first_vectors(s.vectors).select("node_id", F.round(F.col("embedding")[0], 6).alias("first"))


@query("v6_space_coverage", "SELECT len(embedding) AS dim, count(*) AS chunks, count(*) FILTER (stale = 0) AS active FROM vectors GROUP BY 1")
def _(s):
    return s.vectors.groupBy(F.size("embedding").cast("bigint").alias("dim")).agg(F.count("*").alias("chunks"), F.count_if(F.col("stale") == 0).alias("active"))


@query("v7_hashed_embedding")
def _(s):
    e = s.table("benchmark").select("item_id", v.hashed_embedding(64)(F.col("text")).alias("e"))
    return e.select("item_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, b: a + b.cast("double") * b), 4).alias("norm"))


@query("v8_agreement", """, p AS (SELECT round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS c FROM vectors a JOIN vectors b ON cast(substr(b.chunk_id, 2) AS bigint) = cast(substr(a.chunk_id, 2) AS bigint) + 1)
SELECT min(c) AS low, list_sort(list(c))[1 + cast(floor(0.1 * count(*)) AS bigint)] AS p10, list_sort(list(c))[1 + cast(floor(0.5 * count(*)) AS bigint)] AS p50, round(avg(c), 6) AS mean, avg(c) >= 0.99 AS passes FROM p""")
def _(s):
    n = F.expr("cast(substr(chunk_id, 2) AS bigint)")
    a = s.vectors.select(F.col("embedding").alias("a"), (n + 1).alias("n"))
    c = a.join(s.vectors.select(F.col("embedding").alias("b"), n.alias("n")), "n").select(F.round(v.cosine(F.col("a"), F.col("b")), 6).alias("c"))
    # over counts of rounded values, which are bounded, not over all of them
    w = Window.orderBy("c")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = c.groupBy("c").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(whole))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(p * F.col("all")), F.col("c")))
    mean = F.sum(F.col("c") * F.col("n")) / F.sum("n")
    return counts.agg(F.min("c").alias("low"), at(0.1).alias("p10"), at(0.5).alias("p50"), F.round(mean, 6).alias("mean"), (mean >= 0.99).alias("passes"))


@query("v9_space_report", """, f AS (SELECT node_id, arg_min(embedding, seq) AS e FROM vectors GROUP BY node_id)
SELECT d.type, count(*) AS pairs, round(avg(round(list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]), 6)), 5) AS mean FROM edges d JOIN f a ON a.node_id = d.src JOIN f b ON b.node_id = d.dst GROUP BY d.type""")
def _(s):
    f = v.first_vectors(s.vectors)
    e = s.edges.join(f.select(F.col("node_id").alias("src"), F.col("embedding").alias("a")), "src").join(f.select(F.col("node_id").alias("dst"), F.col("embedding").alias("b")), "dst")
    return e.groupBy("type").agg(F.count("*").alias("pairs"), F.round(F.avg(F.round(v.cosine(F.col("a"), F.col("b")), 6)), 5).alias("mean"))


@query("v9_separation", f""", f AS (SELECT v.node_id, arg_min(v.embedding, v.seq)::DOUBLE[] AS e FROM vectors v JOIN nodes n ON n.id = v.node_id WHERE v.stale = 0 AND n.invalidated_ms IS NULL AND n.memory_kind IN ('semantic', 'episodic') GROUP BY v.node_id),
c AS (SELECT count(*) AS n FROM nodes), rp AS (SELECT a.id AS a, b.id AS b FROM nodes a CROSS JOIN c JOIN nodes b ON b.ord = (a.ord * 1000003 + 12345) % c.n WHERE a.id <> b.id),
lp AS (SELECT src AS a, dst AS b FROM edges WHERE invalidated_ms IS NULL AND provenance = 'agent' AND src <> dst), ap AS (SELECT a, b, false AS linked FROM rp UNION ALL SELECT a, b, true FROM lp),
sv AS (SELECT linked, round(round(list_cosine_similarity(x.e, y.e), 6), 4) AS value FROM ap JOIN f x ON x.node_id = a JOIN f y ON y.node_id = b), q AS (SELECT value FROM sv WHERE NOT linked),
rk AS (SELECT linked, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM sv)
SELECT (SELECT count(*) FROM q) AS random_pairs, (SELECT count(*) FROM sv WHERE linked) AS linked_pairs, (SELECT round(avg(value), 5) FROM q) AS random_mean, (SELECT list_sort(list(value))[greatest(1, cast(ceil(0.9 * count(*)) AS bigint))] FROM q) AS random_p90,
 (SELECT round(avg(value), 5) FROM sv WHERE linked) AS linked_mean, (SELECT round((sum(r) FILTER (linked) - count(*) FILTER (linked) * (count(*) FILTER (linked) + 1) / 2.0) / (count(*) FILTER (linked) * 1.0 * count(*) FILTER (NOT linked)), 6) FROM rk) AS auc""")
def _(s):
    """How far the space tells linked notes from random ones."""
    f = v.first_vectors(fresh(s).join(live_authored(s).select(F.col("id").alias("node_id")), "node_id", "left_semi"))
    random = cal.permuted_pairs(s.nodes, "ord", s.nodes.count()).withColumn("linked", F.lit(False))
    linked = s.edges.where(t.live() & (F.col("provenance") == "agent") & (F.col("src") != F.col("dst"))).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("linked"))
    both = random.unionByName(linked).join(f.select(F.col("node_id").alias("a"), F.col("embedding").alias("x")), "a").join(f.select(F.col("node_id").alias("b"), F.col("embedding").alias("y")), "b")
    return cal.separation(both.select("linked", F.round(v.cosine(F.col("x"), F.col("y")), 6).alias("value")))


# --- fusion. Queries of both branches are numbered alike: query k is text item k and vector chunk 20 k.

FUSED = BM25 + ", qv AS (SELECT cast(substr(chunk_id, 2) AS bigint) // 20 AS query_id, embedding AS e FROM vectors WHERE cast(substr(chunk_id, 2) AS bigint) % 20 = 0)" + """,
nn AS (SELECT query_id, chunk_id, node_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM qv, vectors WHERE stale = 0),
kn AS (SELECT * FROM nn QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 1000),
vb AS (SELECT query_id, node_id AS id, max(score) AS score FROM kn WHERE node_id IN (SELECT id FROM nodes WHERE invalidated_ms IS NULL) GROUP BY ALL),
vl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vb QUALIFY rank <= 40),
tx AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm WHERE id IN (SELECT id FROM nodes WHERE invalidated_ms IS NULL) QUALIFY rank <= 40),
fu AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score, CASE sum(t) WHEN 3 THEN 'both' WHEN 1 THEN 'text' ELSE 'vector' END AS matched FROM (SELECT query_id, id, rank, 1 AS t FROM tx UNION ALL SELECT query_id, id, rank, 2 FROM vl) z GROUP BY ALL)"""

SCORED = FUSED + f""", rescored AS (SELECT fu.query_id, id, matched, score * CASE WHEN memory_kind = 'episodic' THEN exp(-greatest(({NOW} - created_ms) / 86400000.0, 0) / 3) ELSE 1 END
  * CASE WHEN type = 'symbol' THEN 0.5 ELSE 1 END * CASE WHEN use_count > 0 THEN 1 + 0.25 * least(1, ln(1 + use_count) / ln(21)) ELSE 1 END AS score FROM fu JOIN nodes USING (id))"""


def lists(s):
    live = s.nodes.where(t.live()).select("id")
    text = search(s.text_index, asked(s), 40, live)
    queries = s.vectors.where("cast(substr(chunk_id, 2) AS bigint) % 20 = 0").select(F.expr("cast(substr(chunk_id, 2) AS bigint) div 20").alias("query_id"), "embedding")
    near = v.knn_then_filter(queries, fresh(s), live, 1000, 40).withColumnRenamed("node_id", "id")
    return text, near


def fused(s):
    return k.rrf(*lists(s), "id")


def rescored(s):
    rows = fused(s).join(s.nodes.select("id", "memory_kind", "type", "created_ms", "use_count", "created_by_session"), "id")
    factor = k.memory_factor(F.col("memory_kind"), F.col("created_ms"), NOW) * k.symbol_factor(F.col("type"), 0.5) * k.strength_factor(F.col("use_count"), 0.25)
    return rows.withColumn("score", F.col("score") * factor)


@query("f1_rrf", FUSED + " SELECT query_id, id, round(score, 6) AS score, matched FROM fu")
def _(s):
    return fused(s).select("query_id", "id", F.round("score", 6).alias("score"), "matched")


@query("f2_decay", f"SELECT id, round(CASE WHEN memory_kind = 'episodic' THEN exp(-greatest(({NOW} - created_ms) / 86400000.0, 0) / 3) ELSE 1 END, 6) AS factor FROM nodes")
def _(s):
    return s.nodes.select("id", F.round(k.memory_factor(F.col("memory_kind"), F.col("created_ms"), NOW), 6).alias("factor"))


@query("f3_strength", "SELECT id, round(CASE WHEN use_count > 0 THEN 1 + 0.25 * least(1, ln(1 + use_count) / ln(21)) ELSE 1 END, 6) AS factor FROM nodes")
def _(s):
    return s.nodes.select("id", F.round(k.strength_factor(F.col("use_count"), 0.25), 6).alias("factor"))


@query("f4_symbol_penalty", "SELECT id, CASE WHEN type = 'symbol' THEN 0.5 ELSE 1.0 END::DOUBLE AS factor FROM nodes")
def _(s):
    return s.nodes.select("id", k.symbol_factor(F.col("type"), 0.5).alias("factor"))


@query("f5_trust", WEIGHTS + """, wk AS (SELECT n.id, min(w.weight) AS w FROM nodes n JOIN sessions z ON z.id = n.created_by_session JOIN weights w USING (principal_id) WHERE w.weight <> 1 GROUP BY n.id)
SELECT id, round(use_count * coalesce(w, 1), 6)::DOUBLE AS score FROM nodes LEFT JOIN wk USING (id) WHERE coalesce(w, 1) > 0""")
def _(s):
    origins = s.nodes.select("id", F.col("created_by_session").alias("sid")).join(s.sessions.withColumnRenamed("id", "sid"), "sid").select("id", "principal_id")
    return k.trust(s.nodes.select("id", F.col("use_count").cast("double").alias("score")), origins, weights(s), "id").select("id", F.round("score", 6).alias("score"))


@query("f6_final_order", SCORED + " SELECT query_id, id, cast(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS int) AS place FROM rescored QUALIFY place <= 10")
def _(s):
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return rescored(s).select("query_id", "id", F.row_number().over(w).alias("place")).where("place <= 10")


def ranked(s):
    """The capped list of each query, best first."""
    updated = s.current.select(F.col("node_id").alias("id"), F.col("ts_ms").alias("updated_ms"))
    return rescored(s).select("query_id", "id", F.round("score", 9).alias("score")).join(updated, "id")


def pairs(s, kind):
    return r.undirected_pairs(s.edges.where(t.live() & (F.col("type") == kind)))


@query("f7_mmr")
def _(s):
    none = pairs(s, "supersedes").limit(0)
    return k.diversify(ranked(s), v.first_vectors(fresh(s)), none, none, 10, fold=1.0)


@query("f8_fold")
def _(s):
    return k.diversify(ranked(s), v.first_vectors(fresh(s)), pairs(s, "supersedes"), pairs(s, "duplicate_of"), 10, lam=1.0)


def seeds_and_hops(s, rows):
    live = s.nodes.where(t.live()).select("id")
    hops = g.subgraph(rows.select("query_id", "id"), s.edges.where(t.live()), live)
    return g.pagerank_within(hops, rows.select("query_id", "id", "score"))


@query("f12_hybrid_search")
def hybrid_search(s):
    """Text and vector lists, fused, re-scored, expanded over the graph, diversified and folded."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rows = g.settle(ranked(s))
    direct = rows.withColumn("n", F.row_number().over(w)).where("n <= 10").drop("n")
    hits = g.graph_hits(seeds_and_hops(s, direct), rows)
    updated = s.current.select(F.col("node_id").alias("id"), F.col("ts_ms").alias("updated_ms"))
    both = rows.unionByName(hits.join(updated, "id").select("id", "query_id", F.round("score", 9).alias("score"), "updated_ms"))
    out = k.diversify(both, v.first_vectors(fresh(s)), pairs(s, "supersedes"), pairs(s, "duplicate_of"), 10)
    title = s.nodes.select("id", "title")
    return out.join(title, "id").select("query_id", "place", "id", "title", "folded")


@query("f13_code_hop", FUSED + """, refs AS (SELECT l.id, y.id AS symbol FROM (SELECT DISTINCT id, regexp_extract(regexp_extract(raw, '([^:]*)$', 1), '^([^(]*)', 1) AS name FROM (SELECT id, trim(unnest(regexp_extract_all(body, '`([^`\n]{2,80})`', 1))) AS raw FROM linked) z) l JOIN symbols y USING (name)),
wt AS (SELECT src AS id, max(weight) AS weight FROM edges WHERE type = 'references' AND invalidated_ms IS NULL GROUP BY src)
SELECT query_id, symbol, round(max(0.3 * score * coalesce(weight, 0.5)), 6)::DOUBLE AS score FROM fu JOIN refs USING (id) LEFT JOIN wt USING (id) GROUP BY query_id, symbol""")
def _(s):
    """What a search finds leads one hop on to the symbols it cites."""
    cites = x.cited_symbols(s.linked, "id", "body")
    weights = s.edges.where(t.live() & (F.col("type") == "references")).groupBy(F.col("src").alias("id")).agg(F.max("weight").alias("weight"))
    rows = fused(s).select("query_id", "id", "score").join(weights, "id", "left").join(cites, "id")
    hits = rows.select("query_id", "name", (0.3 * F.col("score") * F.coalesce("weight", F.lit(0.5))).alias("score"))
    return x.hop_to_symbols(hits, s.symbols).select("query_id", "symbol", F.round("score", 6).alias("score"))


@query("f11_superseded_by", "SELECT e.dst AS id, e.src AS by, n.title FROM edges e JOIN nodes n ON n.id = e.src WHERE e.type = 'supersedes' AND e.invalidated_ms IS NULL")
def _(s):
    e = s.edges.where(t.live() & (F.col("type") == "supersedes")).select(F.col("dst").alias("id"), F.col("src").alias("by"))
    return e.join(s.nodes.select(F.col("id").alias("by"), "title"), "by").select("id", "by", "title")


# --- graph

TYPES = "('derived_from', 'documents', 'references', 'relates_to', 'similar_to')"
HOPS = f""", us AS (SELECT src, dst, type, weight FROM edges WHERE invalidated_ms IS NULL AND type IN {TYPES} AND src IN (SELECT id FROM nodes WHERE invalidated_ms IS NULL) AND dst IN (SELECT id FROM nodes WHERE invalidated_ms IS NULL)),
hp AS (SELECT src AS a, dst AS b FROM us UNION SELECT dst, src FROM us),
d0 AS (SELECT id AS query_id, id, 0 AS depth FROM nodes WHERE ord % 20 = 0), d1 AS (SELECT query_id, b AS id, 1 AS depth FROM d0 JOIN hp ON a = id), d2 AS (SELECT query_id, b AS id, 2 AS depth FROM d1 JOIN hp ON a = id),
rc AS (SELECT query_id, id, min(depth) AS depth FROM (SELECT * FROM d0 UNION SELECT * FROM d1 UNION SELECT * FROM d2) z GROUP BY ALL),
fr AS (SELECT query_id, id FROM rc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY depth, id) <= 500)"""


def start_nodes(s):
    return s.nodes.where("ord % 20 = 0").select(F.col("id").alias("query_id"), "id")


def local_edges(s):
    return g.subgraph(start_nodes(s), s.edges.where(t.live()), s.nodes.where(t.live()).select("id"), cap=500)


@query("g1_subgraph", HOPS + " SELECT x.query_id, src, dst, type FROM us JOIN fr x ON x.id = src JOIN fr y ON y.id = dst AND y.query_id = x.query_id")
def _(s):
    return local_edges(s).select("query_id", "src", "dst", "type")


PPR = HOPS + """, ed AS (SELECT x.query_id, src, dst, CASE type WHEN 'derived_from' THEN 0.5 WHEN 'documents' THEN 0.7 WHEN 'references' THEN 0.7 WHEN 'relates_to' THEN 0.5 ELSE 0.3 END * CASE weight WHEN 0 THEN 1 ELSE weight END AS c
  FROM us JOIN fr x ON x.id = src JOIN fr y ON y.id = dst AND y.query_id = x.query_id WHERE src <> dst),
mv0 AS (SELECT query_id, src AS a, dst AS b, c FROM ed UNION ALL SELECT query_id, dst, src, c FROM ed), mv AS (SELECT query_id, a, b, c / sum(c) OVER (PARTITION BY query_id, a) AS w FROM mv0),
p AS (SELECT query_id, id AS a, 1.0::DOUBLE AS p FROM d0), r0 AS (SELECT query_id, a, p AS r FROM p)""" + "".join(
    f""", r{i} AS (SELECT query_id, a, sum(m) AS r FROM (SELECT r{i - 1}.query_id, b AS a, 0.5 * r * w AS m FROM r{i - 1} JOIN mv USING (query_id, a) UNION ALL SELECT query_id, a, 0.5 * p FROM p) z GROUP BY ALL)"""
    for i in range(1, 21)
)


@query("g2_ppr", PPR + " SELECT query_id, a AS id, round(r, 4) AS rank FROM r20")
def _(s):
    seeds = start_nodes(s).withColumn("score", F.lit(1.0))
    return g.pagerank_within(local_edges(s), seeds).select("query_id", "id", F.round("rank", 4).alias("rank"))


@query("g3_graph_hits", PPR + ", nw AS (SELECT query_id, a AS id, r FROM r20 WHERE a <> query_id) SELECT query_id, id, round(0.3 * r / max(r) OVER (PARTITION BY query_id), 3) AS score FROM nw")
def _(s):
    seeds = start_nodes(s).withColumn("score", F.lit(1.0))
    return g.graph_hits(g.pagerank_within(local_edges(s), seeds), seeds).select("query_id", "id", F.round("score", 3).alias("score"))


@query("g4_neighbours", "SELECT src AS id, 'out' AS direction, dst AS other, type FROM edges WHERE invalidated_ms IS NULL UNION ALL SELECT dst, 'in', src, type FROM edges WHERE invalidated_ms IS NULL")
def _(s):
    e = s.edges.where(t.live())
    return e.select(F.col("src").alias("id"), F.lit("out").alias("direction"), F.col("dst").alias("other"), "type").unionByName(e.select(F.col("dst").alias("id"), F.lit("in").alias("direction"), F.col("src").alias("other"), "type"))


@query("g5_pair_sets", "SELECT DISTINCT type, least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE invalidated_ms IS NULL AND type IN ('supersedes', 'duplicate_of') AND src <> dst")
def _(s):
    kinds = [pairs(s, kind).withColumn("type", F.lit(kind)) for kind in ("supersedes", "duplicate_of")]
    return kinds[0].unionByName(kinds[1]).select("type", "a", "b")


@query("g6_terminal_successors", """, st AS (SELECT dst AS pt, src AS nx FROM edges WHERE type = 'supersedes' AND invalidated_ms IS NULL), gone AS (SELECT id FROM nodes WHERE invalidated_ms IS NOT NULL),
walk(id, pt) AS (SELECT g.id, nx FROM gone g JOIN st ON st.pt = g.id UNION SELECT walk.id, nx FROM walk JOIN gone g ON g.id = walk.pt JOIN st ON st.pt = walk.pt)
SELECT DISTINCT id, pt AS successor FROM walk WHERE pt IN (SELECT id FROM nodes WHERE invalidated_ms IS NULL)""")
def _(s):
    return g.terminal_successors(s.nodes.where(~t.live()).select("id"), s.nodes, s.edges)


@query("g7_origin_principals", """, st AS (SELECT DISTINCT src AS pt, dst AS nx FROM edges WHERE invalidated_ms IS NULL AND type IN ('derived_from', 'supersedes')),
o0 AS (SELECT id, id AS pt FROM nodes), o1 AS (SELECT o0.id, nx AS pt FROM o0 JOIN st USING (pt)), o2 AS (SELECT o1.id, nx AS pt FROM o1 JOIN st USING (pt)), o3 AS (SELECT o2.id, nx AS pt FROM o2 JOIN st USING (pt)),
al AS (SELECT * FROM o0 UNION SELECT * FROM o1 UNION SELECT * FROM o2 UNION SELECT * FROM o3), wh AS (SELECT id AS pt, created_by_session AS sid FROM nodes UNION SELECT node_id, session_id FROM revisions WHERE reason IS NULL OR reason = 'edit')
SELECT DISTINCT al.id, z.principal_id FROM al JOIN wh USING (pt) JOIN sessions z ON z.id = wh.sid""")
def _(s):
    return g.origin_principals(s.nodes.select("id"), s.nodes, s.edges, s.revisions, s.sessions)


LINKS = f""", la AS (SELECT id, split_part(project, '-', 1) AS family FROM nodes WHERE {LIVE_AUTHORED}),
lk AS (SELECT src AS a, dst AS b FROM edges WHERE invalidated_ms IS NULL AND src IN (SELECT id FROM la) AND dst IN (SELECT id FROM la) UNION SELECT dst, src FROM edges WHERE invalidated_ms IS NULL AND src IN (SELECT id FROM la) AND dst IN (SELECT id FROM la)),
hb AS (SELECT family, id, n FROM (SELECT a AS id, count(*) AS n FROM lk GROUP BY a) c JOIN la USING (id) QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC, id) = 1)"""


@query("w2_family_hub", LINKS + " SELECT family, id, n FROM hb")
def _(s):
    return g.family_hubs(s.nodes, s.edges)


#: ``z25`` is what the hubs reach.
REACHED = LINKS + "".join(
    f", z{i} AS (SELECT id FROM {'hb' if i == 1 else f'z{i - 1}'} UNION SELECT b FROM lk JOIN {'hb' if i == 1 else f'z{i - 1}'} q ON q.id = a)" for i in range(1, 26)
)


@query("g8_detached", REACHED + " SELECT id FROM la WHERE id NOT IN (SELECT id FROM z25) AND EXISTS (SELECT 1 FROM lk)")
def _(s):
    return g.detached(s.nodes, s.edges)


@query("g9_dangling", "SELECT count(*) FILTER (b.invalidated_ms IS NOT NULL) AS dangling, count(*) FILTER (b.invalidated_ms IS NOT NULL AND b.id IN (SELECT dst FROM edges WHERE type = 'supersedes' AND invalidated_ms IS NULL)) AS repointable FROM edges e JOIN nodes a ON a.id = e.src AND a.invalidated_ms IS NULL JOIN nodes b ON b.id = e.dst WHERE e.invalidated_ms IS NULL AND e.type <> 'supersedes'")
def dangling(s):
    replaced = s.edges.where(t.live() & (F.col("type") == "supersedes")).select("dst").distinct().withColumn("replaced", F.lit(True))
    e = s.edges.where(t.live() & (F.col("type") != "supersedes")).join(s.nodes.where(t.live()).select(F.col("id").alias("src")), "src", "left_semi")
    e = e.join(s.nodes.select(F.col("id").alias("dst"), F.col("invalidated_ms").isNotNull().alias("gone")), "dst").join(replaced, "dst", "left")
    return e.agg(F.count_if("gone").alias("dangling"), F.count_if(F.col("gone") & F.col("replaced")).alias("repointable"))


@query("g10_edgeless", f"SELECT id FROM nodes WHERE {LIVE_AUTHORED} AND id NOT IN (SELECT src FROM edges WHERE invalidated_ms IS NULL UNION SELECT dst FROM edges WHERE invalidated_ms IS NULL)")
def _(s):
    return g.edgeless(s.nodes, s.edges)


@query("g10_typed_links", "SELECT count(*) FILTER (type NOT IN ('similar_to', 'relates_to')) AS typed, count(*) FILTER (type IN ('similar_to', 'relates_to')) AS untyped FROM edges WHERE invalidated_ms IS NULL")
def _(s):
    loose = F.col("type").isin("similar_to", "relates_to")
    return s.edges.where(t.live()).agg(F.count_if(~loose).alias("typed"), F.count_if(loose).alias("untyped"))


@query("g11_backbone")
def _(s):
    return g.backbone(s.edges.where(t.live()))


@query("g12_clusters")
def _(s):
    stale = s.nodes.where(t.live() & (F.col("memory_kind") == "episodic")).select("id")
    seeds = v.first_vectors(fresh(s)).join(stale.withColumnRenamed("id", "node_id"), "node_id", "left_semi")
    chunks = fresh(s).join(stale.withColumnRenamed("id", "node_id"), "node_id", "left_semi")
    links = v.seeded_neighbours(seeds.withColumnRenamed("node_id", "query_id"), chunks, 20, 10, 0.2)
    roots = g.components(links.select(F.col("query_id").alias("a"), F.col("node_id").alias("b")))
    member = v.first_vectors(chunks).withColumnRenamed("node_id", "id").join(roots, "id")
    return v.mean_similarity(member.select(F.col("root").alias("group"), "embedding")).where("members >= 3").select(F.col("group").alias("root"), "members", F.round("mean", 6).alias("mean"))
