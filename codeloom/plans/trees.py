"""SQL of the syntax trees in JSON records: nodes and the objects of their metadata, for the queries that read them."""

from __future__ import annotations

NODES = """WITH RECURSIVE raw AS (
  SELECT rid, record_id, received_at, CASE WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.ast') THEN j->'ast' ELSE j END AS tree
  FROM (SELECT row_number() OVER () AS rid, record_id, received_at, TRY_CAST(payload AS JSON) AS j FROM ast_records WHERE record_id IS NOT NULL) WHERE j IS NOT NULL
), walk AS (
  SELECT rid, record_id, received_at, [0::BIGINT] AS path, CAST(NULL AS BIGINT[]) AS above, tree AS node FROM raw WHERE json_type(tree) = 'OBJECT'
  UNION ALL SELECT rid, record_id, received_at, [i], CAST(NULL AS BIGINT[]), e FROM (SELECT rid, record_id, received_at, unnest(json_extract(tree, '$[*]')) AS e, generate_subscripts(json_extract(tree, '$[*]'), 1) AS i FROM raw WHERE json_type(tree) = 'ARRAY') WHERE json_type(e) = 'OBJECT'
  UNION ALL SELECT rid, record_id, received_at, list_append(path, i), path, e FROM (
    SELECT rid, record_id, received_at, path, unnest(kids) AS e, generate_subscripts(kids, 1) AS i FROM (
      SELECT rid, record_id, received_at, path, CASE json_type(node->'children') WHEN 'ARRAY' THEN json_extract(node, '$.children[*]') WHEN 'OBJECT' THEN [node->'children'] END AS kids FROM walk)) WHERE json_type(e) = 'OBJECT'
), counted AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY path) - 1 AS no FROM walk),
own AS (
  SELECT a.rid, a.record_id, a.received_at, a.node, CAST(a.no AS INTEGER) AS node_no, CAST(coalesce(b.no, -1) AS INTEGER) AS parent_no,
    coalesce(a.node->>'node_type', a.node->>'type') AS node_type, a.node->>'name' AS name, a.node->>'start_line' AS first_line, a.node->>'end_line' AS last_line
  FROM counted a LEFT JOIN counted b ON a.rid = b.rid AND a.above = b.path
), nodes AS (
  SELECT record_id, node_no, parent_no, node_type, name, TRY_CAST(first_line AS INTEGER) AS start_line, TRY_CAST(last_line AS INTEGER) AS end_line FROM own
  QUALIFY row_number() OVER (PARTITION BY record_id, node_no, parent_no ORDER BY received_at DESC NULLS LAST, node_type DESC NULLS LAST, name DESC NULLS LAST, first_line DESC NULLS LAST, last_line DESC NULLS LAST) = 1
), metas AS (
  SELECT rid, record_id, received_at, node_no, CASE json_type(m) WHEN 'OBJECT' THEN m WHEN 'VARCHAR' THEN TRY_CAST(m->>'$' AS JSON) END AS m
  FROM (SELECT rid, record_id, received_at, node_no, unnest([node->'metadata', node->'attributes']) AS m FROM own)
), listed AS (SELECT *, unnest(json_keys(m)) AS entity FROM metas WHERE json_type(m) = 'OBJECT'),
inner_ AS (SELECT record_id, received_at, node_no, entity, unnest(json_extract(m->entity, '$[*]')) AS e, generate_subscripts(json_extract(m->entity, '$[*]'), 1) - 1 AS item_no FROM listed WHERE json_type(m->entity) = 'ARRAY'),
items AS (
  SELECT record_id, node_no, entity, CAST(item_no AS INTEGER) AS item_no, CAST(e AS VARCHAR) AS value, e->>'name' AS name FROM inner_ WHERE json_type(e) = 'OBJECT'
  QUALIFY row_number() OVER (PARTITION BY record_id, node_no, entity, item_no ORDER BY received_at DESC NULLS LAST, CAST(e AS VARCHAR) DESC) = 1
)
"""

SCOPES = (
    NODES
    + """, scoped AS (
  SELECT *, 0 AS depth, coalesce(name, '') AS scope_path FROM nodes WHERE parent_no < 0
  UNION ALL
  SELECT n.*, s.depth + 1, CASE WHEN coalesce(n.name, '') = '' THEN s.scope_path WHEN s.scope_path = '' THEN n.name ELSE s.scope_path || '::' || n.name END FROM scoped s JOIN nodes n ON n.record_id = s.record_id AND n.parent_no = s.node_no
) """
)
