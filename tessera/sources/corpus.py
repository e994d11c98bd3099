"""The memory store as tables, projected from the analytics tables.

The SQL runs unchanged on Spark and on DuckDB; times are epoch milliseconds, ids fixed-width ASCII,
so both engines order them alike. ``Store`` gives each table as a DataFrame; nothing is cached."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph, search

BASE = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"}
T0 = 1_704_067_200_000
HOUR, DAY = 3_600_000, 86_400_000
#: Raised when what ``Store.kept`` writes changes.
INDEX_FORMAT = 5
#: The clock of all queries: a result never depends on when it is computed.
NOW = T0 + 600 * HOUR

NODES = """
SELECT concat('N', lpad(cast(doc_id AS string), 9, '0')) AS id, doc_id AS ord,
 CASE WHEN doc_id % 20 = 19 THEN 'mirror' WHEN doc_id % 5 = 0 THEN 'episodic' ELSE 'semantic' END AS memory_kind,
 CASE WHEN doc_id % 20 = 19 THEN 'symbol' WHEN doc_id % 5 = 0 THEN (CASE WHEN doc_id % 2 = 0 THEN 'checkpoint' ELSE 'event_note' END)
      WHEN doc_id % 4 = 0 THEN 'fact' WHEN doc_id % 4 = 1 THEN 'decision' WHEN doc_id % 4 = 2 THEN 'howto' ELSE 'task' END AS type,
 substr(split_part(text, chr(10), 1), 1, 60) AS title,
 CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN source ELSE concat(source, '-', lang) END AS project,
 1704067200000 + doc_id * 3600000 AS created_ms,
 CASE WHEN doc_id % 11 = 3 THEN 1704067200000 + doc_id * 3600000 + 864000000 END AS invalidated_ms,
 CASE WHEN doc_id % 15 = 0 THEN 1704067200000 + doc_id * 3600000 + 172800000 END AS consolidated_ms,
 CASE WHEN doc_id % 4 = 1 THEN 1704067200000 + doc_id * 3600000 - 86400000 END AS event_from_ms,
 CASE WHEN doc_id % 8 = 1 THEN 1704067200000 + doc_id * 3600000 + 86400000 END AS event_to_ms,
 concat('S', lpad(cast(doc_id % 37 AS string), 4, '0')) AS created_by_session, (doc_id * 7) % 25 AS use_count
FROM documents"""

REVISIONS = """
SELECT concat('N', lpad(cast(doc_id AS string), 9, '0')) AS node_id, r.rev AS rev,
 CASE WHEN r.rev = 1 + doc_id % 3 THEN text ELSE substr(text, 1, 40 * r.rev) END AS content,
 concat('S', lpad(cast((doc_id + r.rev) % 37 AS string), 4, '0')) AS session_id,
 CASE WHEN r.rev = 1 THEN NULL WHEN doc_id % 7 = 0 THEN 'merge' WHEN doc_id % 7 = 1 THEN 'wikilink [[x]] -> [[y]]' ELSE 'edit' END AS reason,
 1704067200000 + doc_id * 3600000 + (r.rev - 1) * 43200000 AS ts_ms
FROM documents CROSS JOIN (SELECT 1 AS rev UNION ALL SELECT 2 UNION ALL SELECT 3) r WHERE r.rev <= 1 + doc_id % 3"""

#: An edge for each order. Targets are skewed, so that a few nodes are hubs; of 23 nodes one has no edge at all and
#: one only a neighbour of its own kind.
EDGES = """
SELECT concat('N', lpad(cast(s AS string), 9, '0')) AS src, concat('N', lpad(cast(t AS string), 9, '0')) AS dst, type,
 min(prov) AS provenance, round(min(w), 2) AS weight, min(vf) AS valid_from_ms, CASE WHEN min(k) % 13 = 0 THEN min(vf) + 604800000 END AS invalidated_ms
FROM (SELECT s, type, prov, w, vf, k,
  CASE WHEN s % 23 <> 17 THEN h - CASE WHEN h % 23 IN (11, 17) THEN 1 ELSE 0 END WHEN floor(s / 23) % 2 = 1 THEN s - 23 WHEN s + 23 < n THEN s + 23 ELSE s END AS t
  FROM (SELECT n, s - CASE WHEN s % 23 = 11 THEN 1 ELSE 0 END AS s, cast(floor(y * y / n) AS bigint) AS h, k,
    CASE (s + k) % 6 WHEN 0 THEN 'similar_to' WHEN 1 THEN 'references' WHEN 2 THEN 'relates_to' WHEN 3 THEN 'derived_from' WHEN 4 THEN 'supersedes' ELSE 'duplicate_of' END AS type,
    CASE WHEN k % 2 = 0 THEN 'agent' ELSE 'system' END AS prov, 0.5 + q / 100 AS w, 1704067200000 + (o % 500) * 3600000 AS vf
    FROM (SELECT n, o_orderkey AS o, o_orderkey % n AS s, (o_orderkey * 31 + o_custkey * 7) % n AS y, o_orderkey + o_custkey AS k, cast(floor(o_totalprice) AS bigint) % 50 + 1 AS q
      FROM orders CROSS JOIN (SELECT count(*) AS n FROM documents) c) a) b) x GROUP BY s, t, type"""

VECTORS = """
SELECT concat('C', lpad(cast(vec_id AS string), 9, '0')) AS chunk_id, concat('N', lpad(cast(vec_id % n AS string), 9, '0')) AS node_id,
 cast(floor(vec_id / n) AS bigint) AS seq, embedding, CASE WHEN vec_id % 17 = 5 THEN 1 ELSE 0 END AS stale
FROM embeddings CROSS JOIN (SELECT count(*) AS n FROM documents) c"""

LOG = """
SELECT event_id, concat('S', lpad(cast(user_id AS string), 4, '0')) AS session_id, ts,
 CASE WHEN event_type IN ('view', 'signup') THEN 'search' ELSE 'get' END AS action,
 CASE WHEN event_type IN ('view', 'signup') THEN (user_id * 13 + event_id % 7) % n ELSE (user_id * 13 + event_id % 11) % n END AS base
FROM events CROSS JOIN (SELECT count(*) AS n FROM documents) c"""

SESSIONS = """
SELECT id, concat('P', cast(num % 5 AS string)) AS principal_id, CASE WHEN num % 7 = 0 THEN NULL ELSE concat('client', cast(num % 4 AS string)) END AS client
FROM (SELECT DISTINCT created_by_session AS id, cast(substr(created_by_session, 2) AS bigint) AS num FROM nodes
      UNION SELECT session_id, cast(substr(session_id, 2) AS bigint) FROM revisions
      UNION SELECT session_id, cast(substr(session_id, 2) AS bigint) FROM log) s"""

CURRENT = """
SELECT node_id, rev, content, session_id, reason, ts_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY rev DESC) AS rn FROM revisions) r WHERE rn = 1"""

DEGREES = """
SELECT id, count(*) AS edge_count FROM (SELECT src AS id FROM edges WHERE invalidated_ms IS NULL
  UNION ALL SELECT dst FROM edges WHERE invalidated_ms IS NULL AND src <> dst) e GROUP BY id"""

ENRICHED = """
SELECT n.*, c.rev, c.content, c.ts_ms AS updated_ms, cast(coalesce(d.edge_count, 0) AS bigint) AS edge_count
FROM nodes n JOIN current c ON c.node_id = n.id LEFT JOIN degrees d ON d.id = n.id"""

CANDIDATES = """
SELECT concat(CASE WHEN type = 'duplicate_of' THEN 'K' ELSE 'L' END, src, dst) AS id, CASE WHEN type = 'duplicate_of' THEN 'merge' ELSE 'link' END AS kind,
 CASE WHEN weight < 0.65 THEN 'dismissed' WHEN weight < 0.8 THEN 'applied' ELSE 'pending' END AS status, src AS a, dst AS b,
 round(weight / 1.5, 4) AS score, valid_from_ms AS detected_ms,
 CASE WHEN weight > 0.9 THEN '{"recommendation":"merge"}' WHEN weight > 0.85 THEN '{"note":"none"}' END AS proposal
FROM edges WHERE type IN ('duplicate_of', 'similar_to') AND src <> dst"""

QUEUE = """
SELECT id AS node_id, cast(ord % 7 AS int) AS attempts, created_ms AS enqueued_ms, CASE WHEN ord % 7 > 0 THEN 'timeout' END AS last_error,
 created_ms + ord % 50 * 60000 AS last_attempt_ms
FROM nodes WHERE ord % 6 = 0"""

JOBS = """
SELECT concat('J', cast(o_orderkey AS string)) AS id, CASE WHEN o_custkey % 3 = 0 THEN 'sweep' WHEN o_custkey % 3 = 1 THEN 'embed' ELSE 'index' END AS kind,
 CASE o_orderstatus WHEN 'F' THEN (CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'succeeded' END) WHEN 'O' THEN 'pending' ELSE 'running' END AS state,
 1704067200000 + o_orderkey % 1000 * 3600000 AS scheduled_ms, cast(o_custkey % 6 AS int) AS attempts, 5 AS max_attempts,
 CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 1704067200000 + o_orderkey % 1000 * 3600000 + 1800000 END AS lease_expires_ms,
 CASE WHEN o_orderstatus = 'F' THEN 1704067200000 + o_orderkey % 1000 * 3600000 + 600000 END AS ended_ms
FROM orders"""

#: Notes that cite others: by slug, by a truncated slug, and by symbol.
LINKED = """
SELECT n.id, n.ord, n.project, concat(n.title, chr(10), 'see [[', t.title, ']] and [[', substr(t.title, 1, 12), '|label]] and [[id]] with `Mod', cast(n.ord % 9 AS string),
  '.runTask_', cast(n.ord % 40 AS string), '(x)` or `plain` near `small', cast(n.ord % 30 AS string), '_1(x)` and `cold', cast(n.ord % 30 AS string), '_2`', CASE WHEN n.ord % 3 = 0 THEN ' yesterday' ELSE ' on 2024-01-01' END) AS body
FROM nodes n CROSS JOIN (SELECT count(*) AS n FROM documents) c JOIN nodes t ON t.ord = (n.ord * 7 + 1) % c.n"""

#: Notes with headings, of which one in ten has none: nested ones, and one in a code block that is none.
OUTLINED = """
SELECT c.node_id, CASE WHEN n.ord % 10 = 0 THEN c.content ELSE concat(substr(c.content, 1, 80), chr(10), '# ', n.type, chr(10), substr(c.content, 81, 300), chr(10), '## Details', chr(10), substr(c.content, 381, 300), chr(10),
 '```', chr(10), '# no heading', chr(10), '```', chr(10), '### Deep ', cast(n.ord % 3 AS string), chr(10), substr(c.content, 681, 200), chr(10), '## Closing', chr(10), substr(c.content, 881)) END AS body
FROM current c JOIN nodes n ON n.id = c.node_id"""

#: A code index of one repository: files with their units on two branches, symbols, imports, calls.
FILES = """
SELECT 'r1' AS repo_id, b.branch, concat('src/', lower(p_type), '/m', cast(p_partkey % 50 AS string), '/f', cast(p_partkey AS string), '.ts') AS path,
 concat('u', cast(p_partkey AS string), CASE WHEN b.branch = 'dev' AND p_partkey % 7 = 0 THEN 'x' ELSE '' END) AS unit_id,
 1704067200000 + p_partkey * 60000 AS valid_from_ms, CASE WHEN p_partkey % 13 = 0 THEN 1704067200000 + p_partkey * 60000 + 86400000 END AS invalidated_ms
FROM part CROSS JOIN (SELECT 'main' AS branch UNION ALL SELECT 'dev') b WHERE NOT (b.branch = 'dev' AND p_partkey % 11 = 0)"""

SYMBOLS = """
SELECT concat('y', unit_id, '-', cast(k.k AS string)) AS id, unit_id, CASE WHEN k.k = 0 THEN 'class' ELSE 'function' END AS kind,
 concat(split_part(p_name, ' ', 1), cast(p_partkey % 30 AS string), CASE WHEN k.k = 0 THEN '' ELSE concat('_', cast(k.k AS string)) END) AS name,
 concat(split_part(p_name, ' ', 2), '.', split_part(p_name, ' ', 1), cast(p_partkey % 30 AS string), '_', cast(k.k AS string)) AS qualified,
 substr(sha2(concat(p_name, cast(p_size AS string), cast(k.k AS string)), 256), 1, 32) AS embed_hash
FROM (SELECT DISTINCT unit_id, cast(regexp_replace(substr(unit_id, 2), 'x', '') AS bigint) AS pk FROM files) f JOIN part ON p_partkey = pk
CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) k"""

IMPORTS = """
SELECT a.unit_id, concat(split_part(p.p_name, ' ', 1), cast(p.p_partkey % 30 AS string)) AS name, a.pos, g.path AS candidate
FROM (SELECT unit_id, pos.pos, (pk * 3 + 1) % (SELECT count(*) FROM part) AS named, (pk * 3 + pos.pos) % (SELECT count(*) FROM part) AS wanted
  FROM (SELECT DISTINCT unit_id, cast(regexp_replace(substr(unit_id, 2), 'x', '') AS bigint) AS pk FROM files) f
  CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2) pos) a
JOIN part p ON p.p_partkey = a.named
JOIN (SELECT DISTINCT path, cast(regexp_replace(substr(unit_id, 2), 'x', '') AS bigint) AS pk FROM files) g ON g.pk = a.wanted"""

#: Source files in five languages, one for each part, whose declarations depend on its row. Comments, strings and
#: patterns hold brackets and keywords that declare nothing.
SOURCE_LINES = {
    "ts": ("// class Ghost$k { }", "export class C$k extends Base<Map<string, number>> {", *["$i  run$i(x: { a: number }): string {", "$i    return \"} class No {\" + `t${x}`;", "$i  }"], "}", "export const LIMIT_$w = /[{]\"/;", "function helper() { if (1) { function inner() { } } }"),
    "php": ("<?php", "# function ghost() { }", "trait T$k {", "$i  public static function run$i(array $a = [~}~]): int { return fn() => 1; }", "}", "function helper_$w() { return \"class X { }\"; }"),
    "rs": ("/* mod ghost { /* fn no() {} */ } */", "pub mod m$k {", "  #[derive(Debug)]", "  pub struct S$k { a: u8 }", "  impl Drop for S$k {", "$i    fn run$i(&mut self) -> Vec<Vec<u8>> { let c = ~{~; }", "  }", "}", "const LIMIT: usize = $z;"),
    "cpp": ("#define MAX_$k ^", "  { $z }", "namespace n$k {", "struct S : Base {", "$i  int run$i(const char* s) const;", "};", "$iint S::run$i(const char* s) const { if (s) { return ~{~; } return 0; }", "}", "int main() { return n$k::S().run1(\"class X {\"); }"),
    "lua": ("--[[ function ghost() end ]]", "local M = {}", "$ifunction M.run$i(a) if a then for i = 1, 2 do print(\"end\") end end end", "M.size_$w = $z", "return M"),
}


def _source(lines: tuple[str, ...]) -> str:
    """SQL for the text of ``lines``: runs of those that begin with $i are there for each i up to m; $k, $z
    and $w are key, size and a word of the part, ~ an apostrophe, ^ a backslash."""
    out, at = [], 0
    while at < len(lines):
        end = at
        while end < len(lines) and lines[end].startswith("$i"):
            end += 1
        texts = [("\n".join(x[2:] for x in lines[at:end]) + "\n", i) for i in (1, 2, 3)] if end > at else [(lines[at] + "\n" * (at + 1 < len(lines)), 0)]
        for text, i in texts:
            parts = re.split(r"(\$[ikzw]\b|\$[ikzw](?=[^\w])|\$[kzw]|\$i|~|\^|\n)", text)
            special = {"$k": "cast(p_partkey AS string)", "$z": "cast(p_size AS string)", "$w": "split_part(p_name, ' ', 1)", "~": "chr(39)", "^": "chr(92)", "\n": "chr(10)", "$i": f"'{i}'"}
            sql = "concat(" + ", ".join(special.get(x, f"'{x}'") for x in parts if x) + ")"
            out.append(f"CASE WHEN p_size % 3 >= {i - 1} THEN {sql} ELSE '' END" if i else sql)
        at = max(end, at + 1)
    return f"concat({', '.join(out)})"


SOURCES = (
    "SELECT p_partkey, p_size, p_name, concat('src/m', cast(p_partkey % 50 AS string), '/f', cast(p_partkey AS string), '.', CASE p_partkey % 5 "
    + " ".join(f"WHEN {k} THEN '{end}'" for k, end in enumerate(SOURCE_LINES))
    + " END) AS path, CASE p_partkey % 5 "
    + " ".join(f"WHEN {k} THEN {_source(x)}" for k, x in enumerate(SOURCE_LINES.values()))
    + " END AS content FROM part"
)

#: For DuckDB: the tables as common table expressions, before a query over them.
PRELUDE = "WITH " + ",\n".join(
    f"{name} AS ({sql})" for name, sql in (("nodes", NODES), ("revisions", REVISIONS), ("edges", EDGES), ("vectors", VECTORS), ("log", LOG), ("sessions", SESSIONS), ("current", CURRENT),
        ("degrees", DEGREES), ("enriched", ENRICHED), ("candidates", CANDIDATES), ("queue", QUEUE), ("jobs", JOBS), ("linked", LINKED), ("outlined", OUTLINED), ("files", FILES), ("symbols", SYMBOLS.replace("sha2(", "sha256(").replace(", 256)", ")")), ("imports", IMPORTS))
)


class Store:
    """The memory-store tables below ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, sql: str, **frames: DataFrame) -> DataFrame:
        """A statement over base tables and the named frames, registered under names of their own."""
        found = set(re.findall(r"\b(?:FROM|JOIN) (\w+)", sql))
        views = {n: self.table(n) for n in found & BASE} | frames
        sql = sql.replace("{", "{{").replace("}", "}}")
        for n in views:
            sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
        return self.spark.sql(sql, **views)

    @cached_property
    def text_index(self) -> search.TextIndex:
        """The index of titles and current bodies, invalidated notes too. It is written below the checkpoint
        folder when it is first asked for and read from then on, until the documents change."""
        docs = self.nodes.select("id", "title").join(self.current.select(F.col("node_id").alias("id"), F.col("content").alias("body")), "id")
        folder = self.kept("text-index", "documents", lambda to: search.build(docs, "id", ("title", "body"), to))
        return search.load(self.spark, folder, "id")

    def kept(self, name: str, source: str, build: Callable[[str], None]) -> str:
        """The folder of what ``build`` makes of a base table, made once for each state of that table. It is
        written under a temporary name and moved, so no reader sees a part of it."""
        sc, hadoop = self.spark.sparkContext, self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.sf_dir}/{source}.parquet")
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        size, changed = fs.getContentSummary(path), fs.getFileStatus(path).getModificationTime()
        state = hashlib.sha256(f"{fs.makeQualified(path)} {size.getLength()} {size.getFileCount()} {changed} {INDEX_FORMAT}".encode()).hexdigest()[:16]
        made, temporary = f"{graph.shared_folder(self.spark)}/tessera-kept/{name}-{state}", uuid.uuid4().hex
        target = hadoop.Path(made)
        out = target.getFileSystem(sc._jsc.hadoopConfiguration())
        if not out.exists(target):
            build(f"{made}.{temporary}")
            if not out.rename(hadoop.Path(f"{made}.{temporary}"), target) or out.exists(hadoop.Path(f"{made}/{target.getName()}.{temporary}")):
                out.delete(hadoop.Path(f"{made}.{temporary}"), True)  # another job was first
        return made

    @cached_property
    def nodes(self) -> DataFrame:
        return self.sql(NODES)

    @cached_property
    def revisions(self) -> DataFrame:
        return self.sql(REVISIONS)

    @cached_property
    def edges(self) -> DataFrame:
        return self.sql(EDGES)

    @cached_property
    def vectors(self) -> DataFrame:
        return self.sql(VECTORS)

    @cached_property
    def log(self) -> DataFrame:
        return self.sql(LOG)

    @cached_property
    def sessions(self) -> DataFrame:
        ids = self.nodes.select(F.col("created_by_session").alias("id")).union(self.revisions.select("session_id")).union(self.log.select("session_id")).distinct()
        num = F.substring("id", 2, 20).cast("bigint")
        return ids.select("id", F.concat(F.lit("P"), (num % 5).cast("string")).alias("principal_id"), F.when(num % 7 != 0, F.concat(F.lit("client"), (num % 4).cast("string"))).alias("client"))

    @cached_property
    def current(self) -> DataFrame:
        from tessera.operators.relational import latest_revision

        return latest_revision(self.revisions)

    @cached_property
    def enriched(self) -> DataFrame:
        from tessera.operators.relational import enriched

        return enriched(self.nodes, self.revisions, self.edges)

    @cached_property
    def candidates(self) -> DataFrame:
        return self.sql(CANDIDATES, edges=self.edges)

    @cached_property
    def queue(self) -> DataFrame:
        return self.sql(QUEUE, nodes=self.nodes)

    @cached_property
    def jobs(self) -> DataFrame:
        return self.sql(JOBS)

    @cached_property
    def linked(self) -> DataFrame:
        return self.sql(LINKED, nodes=self.nodes)

    @cached_property
    def outlined(self) -> DataFrame:
        return self.sql(OUTLINED, nodes=self.nodes, current=self.current)

    @cached_property
    def sources(self) -> DataFrame:
        """Parts are dealt before their texts are composed: a part is a few bytes, so one task may read millions."""
        parts = self.table("part").select("p_partkey", "p_size", "p_name").repartition(4 * self.spark.sparkContext.defaultParallelism, "p_partkey")
        return self.sql(SOURCES, part=parts)

    @cached_property
    def files(self) -> DataFrame:
        return self.sql(FILES)

    @cached_property
    def symbols(self) -> DataFrame:
        return self.sql(SYMBOLS, files=self.files)

    @cached_property
    def imports(self) -> DataFrame:
        return self.sql(IMPORTS, files=self.files)
