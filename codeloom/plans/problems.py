"""Queries of the general problems: hierarchies, nested records, snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.operators import hierarchy, nested, snapshots
from codeloom.session import Stage
from codeloom.plans.trees import NODES
from codeloom.sources.tables import table


def _forest(spark: SparkSession, d: str, name_col: str | None = None) -> DataFrame:
    t = table(spark, d, "symbols")
    return hierarchy.euler_forest(hierarchy.latest_links(t, name_col=name_col), at_most=t.count())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _forest(spark, d).select("id", "root_id", "depth")


def p1_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Descendant counts come from the intervals; entry and exit themselves depend on the order of siblings and are left out of the compared result."""
    return _forest(spark, d).where("depth >= 0").select("id", "root_id", "depth", "descendants")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.full_paths(_forest(spark, d, "name")).select("id", "path")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_forest(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.linked_rows(table(spark, d, "ast_records"), time_col="received_at", fields=False).select("record_id", "entity", "owner_no", "item_no")


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    r = nested.linked_rows(table(spark, d, "ast_records"), time_col="received_at").where("entity = 'node'")
    return r.select("record_id", F.col("item_no").alias("node_no"), F.col("owner_no").alias("parent_no"), "node_type", "name", F.col("start_line").try_cast("int").alias("start_line"), F.col("end_line").try_cast("int").alias("end_line"))


def p4_items(spark: SparkSession, d: str) -> DataFrame:
    r = nested.linked_rows(table(spark, d, "ast_records"), time_col="received_at").where("entity <> 'node'")
    return r.select("record_id", F.col("owner_no").alias("node_no"), "entity", "item_no", F.get_json_object("value", "$.name").alias("name"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    s, keys = table(spark, d, "snapshots"), Stage(spark, "keys").root
    files = snapshots.file_changes(table(spark, d, "file_snapshot"), s, store=snapshots.KeyStore(spark, f"{keys}/files"))
    return files.unionByName(snapshots.symbol_changes(table(spark, d, "symbol_snapshot"), s, store=snapshots.KeyStore(spark, f"{keys}/symbols")))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many changes of each kind each snapshot brought."""
    return p5_found(spark, d).groupBy("snapshot_id", "entity", "change_type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_intervals, p1_paths, p1_descendants, p4_found, p4_nodes, p4_items, p5_found, p5_counts)}

_LINKS = """
WITH RECURSIVE clean AS (
  SELECT id, nullif(parent, '') AS parent, name, indexed_at FROM (
    SELECT lower(regexp_replace(id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS id, lower(regexp_replace(parent_id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS parent, name, indexed_at FROM symbols)
  WHERE id <> ''
), node AS (
  SELECT id, parent, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, parent DESC NULLS LAST, name DESC NULLS LAST) AS k FROM clean) WHERE k = 1
), link AS (
  SELECT a.id, b.id AS parent, a.name FROM node a LEFT JOIN node b ON a.parent = b.id
), up AS (
  SELECT id, parent AS above FROM link WHERE parent IS NOT NULL
  UNION
  SELECT up.id, link.parent FROM up JOIN link ON up.above = link.id WHERE link.parent IS NOT NULL
), looped AS (SELECT id FROM up WHERE id = above),
bad AS (SELECT up.id, min(above) AS root_id FROM up WHERE above IN (SELECT id FROM looped) GROUP BY up.id),
good AS (
  SELECT l.id, coalesce(max(u.above) FILTER (WHERE u.above IN (SELECT id FROM link WHERE parent IS NULL)), l.id) AS root_id, count(u.above) AS depth
  FROM link l LEFT JOIN up u ON u.id = l.id WHERE l.id NOT IN (SELECT id FROM bad) GROUP BY l.id
)
"""

_P5 = """
WITH s AS (
  SELECT snapshot_id, repo, lag(snapshot_id) OVER (PARTITION BY repo ORDER BY taken_at, snapshot_id) AS before FROM snapshots
), f AS (
  SELECT snapshot_id, path, content_hash, modified_time, size FROM (
    SELECT snapshot_id, regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') AS path, lower(content_hash) AS content_hash, modified_time, size, ingested_at FROM file_snapshot)
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, path ORDER BY ingested_at DESC, content_hash DESC NULLS LAST, modified_time DESC, size DESC) = 1
), y AS (
  SELECT snapshot_id, path, symbol_type, name, signature, body_hash FROM (
    SELECT snapshot_id, regexp_replace(replace(file_path, '\\', '/'), '^(\\./)+', '') AS path, symbol_type, name, signature, lower(body_hash) AS body_hash, ingested_at FROM symbol_snapshot)
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, path, symbol_type, name ORDER BY ingested_at DESC, signature DESC, body_hash DESC) = 1
), fa AS (SELECT f.*, s.before FROM f JOIN s USING (snapshot_id) WHERE s.before IS NOT NULL),
fb AS (SELECT s.snapshot_id, f.path, f.content_hash, f.modified_time, f.size FROM f JOIN s ON s.before = f.snapshot_id),
ya AS (SELECT y.* FROM y JOIN s USING (snapshot_id) WHERE s.before IS NOT NULL),
yb AS (SELECT s.snapshot_id, y.path, y.symbol_type, y.name, y.signature, y.body_hash FROM y JOIN s ON s.before = y.snapshot_id),
found AS (
SELECT coalesce(a.snapshot_id, b.snapshot_id) AS snapshot_id, 'file' AS entity, coalesce(a.path, b.path) AS path, '' AS name,
  CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS change_type
FROM fa a FULL JOIN fb b ON a.snapshot_id = b.snapshot_id AND a.path = b.path
WHERE a.path IS NULL OR b.path IS NULL OR a.content_hash IS DISTINCT FROM b.content_hash OR a.modified_time IS DISTINCT FROM b.modified_time OR a.size IS DISTINCT FROM b.size
UNION ALL
SELECT coalesce(a.snapshot_id, b.snapshot_id), coalesce(a.symbol_type, b.symbol_type), coalesce(a.path, b.path), coalesce(a.name, b.name),
  CASE WHEN b.path IS NULL THEN a.symbol_type || '_added' WHEN a.path IS NULL THEN b.symbol_type || '_removed' WHEN a.signature IS DISTINCT FROM b.signature THEN 'signature_changed' ELSE a.symbol_type || '_modified' END
FROM ya a FULL JOIN yb b ON a.snapshot_id = b.snapshot_id AND a.path = b.path AND a.symbol_type = b.symbol_type AND a.name = b.name
WHERE a.path IS NULL OR b.path IS NULL OR a.signature IS DISTINCT FROM b.signature OR a.body_hash IS DISTINCT FROM b.body_hash
)
"""

SQL = {
    "p1_found": _LINKS + """
SELECT id, root_id, CAST(depth AS INTEGER) AS depth FROM good
UNION ALL SELECT id, root_id, CASE WHEN id IN (SELECT id FROM looped) THEN -1 ELSE -2 END FROM bad""",
    "p1_intervals": _LINKS + """
SELECT g.id, g.root_id, CAST(g.depth AS INTEGER) AS depth, (SELECT count(*) FROM up WHERE up.above = g.id) AS descendants FROM good g""",
    "p1_paths": _LINKS + """, chain AS (
  SELECT id, coalesce(nullif(name, ''), id) AS path FROM link WHERE parent IS NULL
  UNION ALL
  SELECT link.id, chain.path || '/' || coalesce(nullif(link.name, ''), link.id) FROM chain JOIN link ON link.parent = chain.id
) SELECT id, path FROM chain""",
    "p1_descendants": _LINKS + """
SELECT u.above AS ancestor, u.id, CAST(g.depth - a.depth AS INTEGER) AS distance FROM up u JOIN good g ON g.id = u.id JOIN good a ON a.id = u.above""",
    "p4_found": NODES + """SELECT DISTINCT record_id, 'node' AS entity, parent_no AS owner_no, node_no AS item_no FROM own UNION ALL SELECT DISTINCT record_id, entity, node_no, item_no FROM items""",
    "p4_nodes": NODES + "SELECT * FROM nodes",
    "p4_items": NODES + "SELECT record_id, node_no, entity, item_no, name FROM items",
    "p5_found": _P5 + "SELECT * FROM found",
    "p5_counts": _P5 + "SELECT snapshot_id, entity, change_type, count(*) AS n FROM found GROUP BY ALL",
}
