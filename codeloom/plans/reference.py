"""Queries of the code-analysis operators over the domain tables, each beside the SQL that states it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from codeloom.functions import code
from codeloom.operators import edits, extract, graph, impact, nested, spans, stats, store, tree
from codeloom.plans.trees import NODES, SCOPES
from codeloom.sources.tables import table
from codeloom.sinks import formats
from codeloom.streaming import watch

AS_OF = "2024-03-20 00:00:00"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _q(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _lang(path: str) -> str:
    ext = f"lower(regexp_extract({path}, '(\\.[^./\\\\]*)$', 1))"
    return "CASE " + " ".join(f"WHEN {ext} IN ({_q(v)}) THEN '{k}'" for k, v in code.EXTENSIONS.items()) + " ELSE 'unknown' END"


def _score() -> str:
    n = lambda w: f"((length(text) - length(replace(text, '{w}', ''))) // {len(w)})"
    out = []
    for lang, words in code.KEYWORDS.items():
        s = " + ".join(map(n, words))
        s += f" + ({n('[')} + {n('{')}) // 4" if lang == "python" else ""
        s += "".join(f" + {n(w)} // 2" for w in code.LINQ) if lang == "csharp" else ""
        out.append(f"WHEN '{lang}' THEN 1 + {s}")
    return "CASE language " + " ".join(out) + " ELSE 1 END"


_EDGE = r"'^[\s\p{Z}]+|[\s\p{Z}]+$'"
_SRC = f"""WITH src AS (SELECT file_id, repo, path, {_lang('path')} AS language, regexp_replace(decode(content), '^﻿', '') AS text FROM source_files WHERE content IS NOT NULL),
ls AS (SELECT *, CASE WHEN text = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n') END AS lines FROM src),
one AS (SELECT file_id, repo, path, language, text, unnest(lines) AS line FROM ls),
kinds AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN (CASE WHEN language = 'python' THEN t LIKE '#%' ELSE t LIKE '//%' OR t LIKE '/*%' OR t LIKE '*%' END) THEN 'comment' ELSE 'code' END AS kind
  FROM (SELECT *, regexp_replace(line, {_EDGE}, '', 'g') AS t FROM one)),
per AS (SELECT file_id, count(*) AS total, count(*) FILTER (WHERE kind = 'code') AS code, count(*) FILTER (WHERE kind = 'comment') AS comment, count(*) FILTER (WHERE kind = 'empty') AS empty FROM kinds GROUP BY file_id),
m AS (SELECT s.*, coalesce(total, 0) AS total_lines, coalesce(code, 0) AS code_lines, coalesce(comment, 0) AS comment_lines, coalesce(empty, 0) AS empty_lines, CAST({_score()} AS INTEGER) AS cyclomatic FROM src s LEFT JOIN per USING (file_id)),
r AS (SELECT *, CASE WHEN cyclomatic <= 10 THEN 'simple' WHEN cyclomatic <= 20 THEN 'moderate' WHEN cyclomatic <= 50 THEN 'complex' ELSE 'very_complex' END AS rating FROM m)
"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return extract.source_text(table(spark, d, "source_files"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return extract.text_metrics(_texts(spark, d))


# --- lines, complexity, aggregates


@query(_SRC + "SELECT language, count(*) AS files, sum(total_lines) AS total_lines, sum(code_lines) AS code_lines, sum(comment_lines) AS comment_lines, sum(empty_lines) AS empty_lines, round(CASE WHEN sum(total_lines) > 0 THEN sum(code_lines) / sum(total_lines) ELSE 0.0 END, 6) AS code_ratio FROM m GROUP BY language")
def line_stats_by_language(spark, d):
    return stats.by_language(_metrics(spark, d))


@query(_SRC + "SELECT repo, path, language, total_lines, code_lines, comment_lines, empty_lines, round(CASE WHEN total_lines > 0 THEN code_lines / total_lines ELSE 0.0 END, 9) AS code_ratio, cyclomatic, rating FROM r")
def file_metrics(spark, d):
    return _metrics(spark, d).drop("nesting").withColumn("code_ratio", F.round("code_ratio", 9))


@query(
    _SRC
    + """, b AS (SELECT file_id, generate_subscripts(cs, 1) AS i, unnest(cs) AS ch FROM (SELECT file_id, string_split(regexp_replace(text, '[^{}]', '', 'g'), '') AS cs FROM src)),
s AS (SELECT file_id, i, sum(CASE ch WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY i) AS run FROM b),
low AS (SELECT file_id, run - least(0, min(run) OVER (PARTITION BY file_id ORDER BY i)) AS depth FROM s)
SELECT src.repo, src.path, CAST(coalesce(max(depth), 0) AS INTEGER) AS depth FROM src LEFT JOIN low USING (file_id) GROUP BY src.repo, src.path"""
)
def brace_depth(spark, d):
    return _texts(spark, d).select("repo", "path", code.brace_depth(F.col("text")).alias("depth"))


@query(
    _SRC
    + """SELECT count(*) AS files, sum(total_lines) AS total_lines, sum(code_lines) AS code_lines, count(*) FILTER (WHERE total_lines > 500) AS large_files, count(*) FILTER (WHERE rating IN ('complex', 'very_complex')) AS complex_files,
round(avg(cyclomatic), 6) AS average_complexity, max(cyclomatic) AS max_complexity, (SELECT path FROM r ORDER BY cyclomatic DESC, path LIMIT 1) AS most_complex_file FROM r"""
)
def directory_summary(spark, d):
    return stats.summary(_metrics(spark, d))


@query(
    _SRC
    + """, p AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory FROM m)
SELECT 'language' AS "by", language AS name, count(*) AS files, sum(total_lines) AS lines, language AS languages FROM p GROUP BY language
UNION ALL SELECT 'directory', directory, count(*), sum(total_lines), string_agg(DISTINCT language, ',' ORDER BY language) FROM p GROUP BY directory"""
)
def structure_sets(spark, d):
    return stats.structure(_metrics(spark, d))


_NODE_SQL = "SELECT repo, file_path, count(*) FILTER (WHERE lower(symbol_type) IN ('function', 'method')) AS functions, count(*) AS control FROM symbols WHERE file_path IS NOT NULL GROUP BY repo, file_path"


@query(f"WITH c AS ({_NODE_SQL}), s AS (SELECT *, 1 + control // greatest(functions, 1) AS score FROM c) SELECT CASE WHEN score <= 5 THEN 'low' WHEN score <= 10 THEN 'medium' WHEN score <= 20 THEN 'high' ELSE 'very_high' END AS bucket, sum(functions) AS functions, count(*) AS files FROM s GROUP BY 1")
def complexity_buckets(spark, d):
    s = table(spark, d, "symbols").where("file_path IS NOT NULL").groupBy("repo", "file_path").agg(F.count_if(F.lower("symbol_type").isin("function", "method")).alias("functions"), F.count("*").alias("control"))
    return stats.bucket_counts(stats.spread_complexity(s))


@query()
def control_complexity_buckets(spark, d):
    """complexity_buckets, like its SQL, has a file's rows of symbols in place of its control structures; here they are counted in the text."""
    c = spans.complexity(_texts(spark, d)).groupBy("repo", "path").agg(F.count("*").alias("functions"), F.max("file_control").alias("control"))
    return stats.bucket_counts(stats.spread_complexity(c))


@query()
def function_complexity(spark, d):
    """The true score of each function: 1 and its own control structures."""
    return spans.complexity(_texts(spark, d)).select("repo", "path", "owner_class", "name", "number", "start_line", "end_line", (F.col("control") + 1).alias("score"))


@query(
    """SELECT file_id, repo, path, name, language, size_bytes, total_lines, code_lines, comment_lines, empty_lines, code_ratio FROM files WHERE file_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY analyzed_at DESC NULLS LAST, ingested_at DESC NULLS LAST, repo DESC NULLS LAST, path DESC NULLS LAST, name DESC NULLS LAST, language DESC NULLS LAST, size_bytes DESC NULLS LAST, total_lines DESC NULLS LAST, code_lines DESC NULLS LAST, comment_lines DESC NULLS LAST, empty_lines DESC NULLS LAST, code_ratio DESC NULLS LAST) = 1"""
)
def latest_files(spark, d):
    return stats.latest_files(table(spark, d, "files"))


@query("SELECT coalesce(nullif(lower(trim(language)), ''), 'none') AS language, count(*) AS rows, count(DISTINCT file_id) AS files, sum(total_lines) AS lines, min(size_bytes) AS least, max(size_bytes) AS most FROM files GROUP BY 1")
def files_by_language(spark, d):
    lang = F.coalesce(F.nullif(F.lower(F.trim("language")), F.lit("")), F.lit("none"))
    return table(spark, d, "files").groupBy(lang.alias("language")).agg(F.count("*").alias("rows"), F.count_distinct("file_id").alias("files"), F.sum("total_lines").alias("lines"), F.min("size_bytes").alias("least"), F.max("size_bytes").alias("most"))


# --- paths


def _contains(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_SOURCE = f"lower(regexp_extract(path, '(\\.[^./\\\\]*)$', 1)) IN ({_q([e for v in code.EXTENSIONS.values() for e in v])})"


@query(
    f"""SELECT file_id, {_lang('path')} AS language, {_contains('path', code.EXCLUDED)} AS excluded, {_contains(_NAME.replace('path', 'lower(path)'), code.TEST_NAMES)} OR {_contains("('/' || lower(path))", code.TEST_PATHS)} AS test,
{_SOURCE} AS source, NOT {_contains('path', code.WATCH_EXCLUDED)} AND ({_NAME} IN ({_q(code.WATCH_IMPORTANT)}) OR {_SOURCE}) AS watched FROM source_files"""
)
def path_filters(spark, d):
    p = F.col("path")
    return table(spark, d, "source_files").select("file_id", code.language(p).alias("language"), code.excluded(p).alias("excluded"), code.is_test(p).alias("test"), code.is_source(p).alias("source"), code.is_watched(p).alias("watched"))


@query("SELECT repo, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, count(*) AS files FROM source_files GROUP BY 1, 2")
def files_per_directory(spark, d):
    return table(spark, d, "source_files").groupBy("repo", code.parent_dir(F.col("path")).alias("directory")).agg(F.count("*").alias("files"))


# --- symbols


@query("SELECT 'symbol' AS kind, id AS key, name FROM symbols WHERE contains(lower(name), 'cache') UNION ALL SELECT 'file', CAST(file_id AS VARCHAR), name FROM files WHERE contains(lower(name), 'cache') UNION ALL SELECT 'snapshot', snapshot_id, name FROM symbol_snapshot WHERE contains(lower(name), 'cache')")
def symbol_search(spark, d):
    s = store.search(table(spark, d, "symbols"), "cache", ["name"]).select(F.lit("symbol").alias("kind"), F.col("id").alias("key"), "name")
    f = store.search(table(spark, d, "files"), "cache", ["name"]).select(F.lit("file").alias("kind"), F.col("file_id").cast("string").alias("key"), "name")
    n = store.search(table(spark, d, "symbol_snapshot"), "cache", ["name"]).select(F.lit("snapshot").alias("kind"), F.col("snapshot_id").alias("key"), "name")
    return s.unionByName(f).unionByName(n)


@query("SELECT lower(trim(symbol_type)) AS symbol_type, lower(trim(visibility)) AS visibility, count(*) AS n, sum(greatest(line_end - line_start + 1, 0)) AS lines FROM symbols GROUP BY 1, 2")
def symbol_types(spark, d):
    return table(spark, d, "symbols").groupBy(F.lower(F.trim("symbol_type")).alias("symbol_type"), F.lower(F.trim("visibility")).alias("visibility")).agg(F.count("*").alias("n"), F.sum(F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0))).alias("lines"))


def _sql_found(spec: dict, groups: int, kind: int = 1) -> str:
    out = []
    for lang, rows in spec.items():
        for row in rows:
            cols = ", ".join(f"unnest(regexp_extract_all(text, '{row[0].replace(chr(39), chr(39) * 2)}', {i})) AS g{i}" for i in range(1, groups + 1))
            out.append(f"SELECT repo, path, language, '{row[1]}' AS kind, {cols} FROM src WHERE language = '{lang}'")
    return "(" + " UNION ALL ".join(out) + ")"


_FUN = f"(SELECT repo, path, language, kind, g1 AS name FROM {_sql_found(extract.FUNCTIONS, 1)} WHERE NOT (kind = 'method' AND language IN ('javascript', 'typescript') AND g1 IN ({_q(extract.NOT_METHODS)})))"
_CLS = f"(SELECT repo, path, language, kind, g1 AS name, nullif(trim(string_split(g2, ',')[1]), '') AS parent FROM {_sql_found({k: [(p, kind) for p, kind, _, _ in v] for k, v in extract.CLASSES.items()}, 2)})"
_IMP = f"(SELECT repo, path, language, kind, trim(g1) AS module FROM {_sql_found(extract.IMPORTS, 1)})"
_EXP = f"(SELECT repo, path, language, kind, g1 AS name FROM {_sql_found(extract.EXPORTS, 1)})"
_CAL = f"(SELECT repo, path, language, nullif(g1, '') AS object, g2 AS function, g1 <> '' AS is_method FROM {_sql_found({k: [(extract.CALL, 'call')] for k in extract.FUNCTIONS}, 2)} WHERE g2 NOT IN ({_q(extract.NOT_METHODS)}))"


@query(_SRC + f"SELECT * FROM {_FUN}")
def functions_found(spark, d):
    return extract.functions(_texts(spark, d))


@query(_SRC + f"SELECT * FROM {_CLS}")
def classes_found(spark, d):
    return extract.classes(_texts(spark, d))


@query(_SRC + f"SELECT * FROM {_IMP}")
def imports_found(spark, d):
    return extract.imports(_texts(spark, d))


@query(_SRC + f"SELECT * FROM {_EXP}")
def exports_found(spark, d):
    return extract.exports(_texts(spark, d))


@query(_SRC + f"SELECT CASE WHEN is_method THEN object || '.' || function ELSE function END AS full_name, count(*) AS n, count(DISTINCT path) AS files FROM {_CAL} GROUP BY 1")
def call_frequency(spark, d):
    return stats.call_frequency(extract.calls(_texts(spark, d)))


@query(
    _SRC
    + f""", u AS (SELECT repo, path, 'f' AS kind, name FROM {_FUN} UNION ALL SELECT repo, path, 'c', name FROM {_CLS} UNION ALL SELECT repo, path, 'i', module FROM {_IMP}
UNION ALL SELECT repo, path, 'k', CASE WHEN is_method THEN object || '.' || function ELSE function END FROM {_CAL})
SELECT repo, path, count(*) FILTER (WHERE kind = 'f') AS functions, count(*) FILTER (WHERE kind = 'c') AS classes, count(*) FILTER (WHERE kind = 'i') AS imports, count(*) FILTER (WHERE kind = 'k') AS total_calls, count(DISTINCT CASE WHEN kind = 'k' THEN name END) AS unique_calls FROM u GROUP BY repo, path"""
)
def file_counters(spark, d):
    t = _texts(spark, d)
    return stats.file_counters(extract.functions(t), extract.classes(t), extract.imports(t), extract.calls(t))


@query(_SRC + ", n AS (SELECT repo, path, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM ls) SELECT repo, path, line_no, (length(line) - length(replace(line, 'cache', ''))) // 5 AS hits FROM n WHERE contains(line, 'cache')")
def match_lines(spark, d):
    return extract.matches(_texts(spark, d), "cache").groupBy("repo", "path", "line_no", "line").agg(F.count("*").alias("hits")).drop("line")


# --- graphs

# A file depends on the file of the parent of one of its symbols, whichever repository that is in.
_EDGES = """WITH clean AS (SELECT lower(trim(id)) AS id, lower(trim(parent_id)) AS parent, repo, repo || '/' || file_path AS file FROM symbols WHERE file_path IS NOT NULL AND repo IS NOT NULL),
edge AS (SELECT DISTINCT 'all' AS repo, a.file AS src, b.file AS dst FROM clean a JOIN clean b ON a.parent = b.id WHERE a.file <> b.file),
repo_edge AS (SELECT DISTINCT 'all' AS repo, a.repo AS src, b.repo AS dst FROM clean a JOIN clean b ON a.parent = b.id)
"""


def _edges(spark: SparkSession, d: str, level: str = "file") -> DataFrame:
    s = table(spark, d, "symbols").where("file_path IS NOT NULL AND repo IS NOT NULL")
    s = s.select(F.lower(F.trim("id")).alias("id"), F.lower(F.trim("parent_id")).alias("parent"), "repo", F.concat_ws("/", "repo", "file_path").alias("file"))
    e = s.select("parent", F.col(level).alias("src")).join(s.select(F.col("id").alias("parent"), F.col(level).alias("dst")), "parent")
    return e.select(F.lit("all").alias("repo"), "src", "dst").where(F.col("src") != F.col("dst") if level == "file" else F.lit(True)).distinct()


@query(_EDGES + "SELECT * FROM edge")
def dependency_edges(spark, d):
    return _edges(spark, d)


@query(_EDGES + ", u AS (SELECT repo, src AS path, 1 AS o, 0 AS i FROM edge UNION ALL SELECT repo, dst, 0, 1 FROM edge) SELECT repo, path, sum(o) AS includes, sum(i) AS included_by, sum(o) * sum(i) AS hotspot FROM u GROUP BY repo, path")
def dependency_degrees(spark, d):
    return graph.degrees(_edges(spark, d))


@query("WITH RECURSIVE " + _EDGES[5:] + ", up AS (SELECT repo, src, dst FROM edge UNION SELECT up.repo, up.src, edge.dst FROM up JOIN edge ON up.repo = edge.repo AND up.dst = edge.src), mutual AS (SELECT a.repo, a.src, a.dst FROM up a JOIN up b ON a.repo = b.repo AND a.src = b.dst AND a.dst = b.src) SELECT repo, least(min(dst), src) AS component, src AS path FROM mutual GROUP BY repo, src")
def dependency_cycles(spark, d):
    return graph.cycles(_edges(spark, d))


@query("WITH RECURSIVE " + _EDGES[5:] + ", up AS (SELECT repo, src, dst FROM repo_edge UNION SELECT up.repo, up.src, e.dst FROM up JOIN repo_edge e ON up.dst = e.src) SELECT repo, src AS start, dst AS node FROM up")
def repository_reach(spark, d):
    """Which repositories depend on which, directly or through others; the result has at most as many rows as pairs of repositories."""
    return graph.reachable(_edges(spark, d, "repo")).drop("distance")


@query()
def import_edges(spark, d):
    t = _texts(spark, d)
    return graph.edges(extract.imports(t), t)


@query()
def import_degrees(spark, d):
    t = _texts(spark, d)
    return graph.degrees(graph.edges(extract.imports(t), t))


@query()
def import_cycles(spark, d):
    t = _texts(spark, d)
    return graph.cycles(graph.edges(extract.imports(t), t))


@query()
def import_reach(spark, d):
    """Every file that a file imports, directly or through others, and the fewest steps; from all files."""
    t = _texts(spark, d)
    return graph.reachable(graph.edges(extract.imports(t), t))


@query()
def import_impact(spark, d):
    """Every file that imports a file, directly or through others, and the fewest steps; from all files."""
    t = _texts(spark, d)
    return graph.reachable(graph.edges(extract.imports(t), t), backwards=True)


# --- changes, references, risk

_KIND = "CASE WHEN lower(trim(change_type)) IN ('added', 'modified', 'deleted') THEN lower(trim(change_type)) ELSE 'other' END"


def _logged(spark: SparkSession, d: str) -> DataFrame:
    k = F.lower(F.trim("change_type"))
    return table(spark, d, "file_changes").withColumn("change_type", F.when(k.isin("added", "modified", "deleted"), k).otherwise("other"))


@query(f"SELECT repo, count(*) FILTER (WHERE k = 'added') AS added, count(*) FILTER (WHERE k = 'modified') AS modified, count(*) FILTER (WHERE k = 'deleted') AS deleted, count(*) AS total FROM (SELECT repo, {_KIND} AS k FROM file_changes) GROUP BY repo")
def change_summary(spark, d):
    return stats.change_summary(_logged(spark, d), ["repo"])


@query(f"WITH c AS (SELECT repo, path, {_KIND} AS k FROM file_changes), f AS (SELECT DISTINCT repo, path, size_bytes FROM source_files) SELECT f.repo, f.path, f.size_bytes FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.repo = f.repo AND c.path = f.path) UNION ALL SELECT f.repo, f.path, -f.size_bytes FROM f WHERE EXISTS (SELECT 1 FROM c WHERE c.repo = f.repo AND c.path = f.path AND k <> 'deleted')")
def upserted_files(spark, d):
    """Fresh rows bear negative sizes, so that they can be told from those they replace."""
    f = table(spark, d, "source_files").select("repo", "path", "size_bytes").distinct()
    return store.upsert(f, f.withColumn("size_bytes", -F.col("size_bytes")), _logged(spark, d), ["repo", "path"])


_PATH = r"regexp_replace(replace(path, '\', '/'), '^(\./)+', '')"
_REFRESH = f"""WITH s AS (SELECT snapshot_id, repo, lag(snapshot_id) OVER (PARTITION BY repo ORDER BY taken_at, snapshot_id) AS before, row_number() OVER (PARTITION BY repo ORDER BY taken_at DESC, snapshot_id DESC) AS k FROM snapshots WHERE repo IS NOT NULL),
one AS (SELECT snapshot_id, {_PATH} AS path, max(lower(content_hash)) AS h, max(modified_time) AS m, max(size) AS z FROM file_snapshot WHERE path IS NOT NULL GROUP BY ALL),
a AS (SELECT s.repo || '/' || path AS path, h, m, z, 1 AS i FROM one JOIN s ON s.before = one.snapshot_id WHERE k = 1), b AS (SELECT s.repo || '/' || path AS path, h, m, z, 1 AS i FROM one JOIN s USING (snapshot_id) WHERE k = 1),
chg AS (SELECT path, CASE WHEN a.i IS NULL THEN 'added' WHEN b.i IS NULL THEN 'deleted' ELSE 'modified' END AS change_type, a.h IS DISTINCT FROM b.h AS content_changed FROM a FULL JOIN b USING (path) WHERE a.i IS NULL OR b.i IS NULL OR a.h IS DISTINCT FROM b.h OR a.m IS DISTINCT FROM b.m OR a.z IS DISTINCT FROM b.z)
"""


def _refresh(spark: SparkSession, d: str) -> DataFrame:
    """Changes between the last two snapshots of every repository."""
    s = table(spark, d, "snapshots").where("repo IS NOT NULL")
    w = W.partitionBy("repo").orderBy(F.desc("taken_at"), F.desc("snapshot_id"))
    s = s.select("repo", "snapshot_id", F.row_number().over(w).alias("k"))
    path = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    one = table(spark, d, "file_snapshot").where("path IS NOT NULL").groupBy("snapshot_id", path.alias("path")).agg(F.max(F.lower("content_hash")).alias("content_hash"), F.max("modified_time").alias("modified_time"), F.max("size").alias("size"))
    side = lambda k: one.join(s.where(F.col("k") == k), "snapshot_id").select(F.concat_ws("/", "repo", "path").alias("path"), "content_hash", "modified_time", "size")
    return store.snapshot_changes(side(2), side(1))


@query(_REFRESH + "SELECT * FROM chg")
def refresh_changes(spark, d):
    return _refresh(spark, d).select("path", "change_type", "content_changed")


@query(_REFRESH + "SELECT count(*) FILTER (WHERE change_type = 'added') AS added, count(*) FILTER (WHERE change_type = 'modified') AS modified, count(*) FILTER (WHERE change_type = 'deleted') AS deleted, CASE WHEN count(*) = 0 THEN 'no_changes' ELSE 'updated' END AS status FROM chg")
def refresh_report(spark, d):
    return store.update_report(_refresh(spark, d))


@query(_REFRESH + "SELECT CASE change_type WHEN 'added' THEN '+' WHEN 'deleted' THEN '-' ELSE 'M' END || ' ' || path AS line FROM chg")
def refresh_preview(spark, d):
    return store.dry_run(_refresh(spark, d))


@query(f"SELECT metric, CAST(value AS VARCHAR) AS value FROM (SELECT count(*) FILTER (WHERE k = 'added') AS added, count(*) FILTER (WHERE k = 'modified') AS modified, count(*) FILTER (WHERE k = 'deleted') AS deleted, count(*) AS total FROM (SELECT {_KIND} AS k FROM file_changes)) UNPIVOT (value FOR metric IN (added, modified, deleted, total))")
def change_metrics(spark, d):
    return formats.metrics_rows(stats.change_summary(_logged(spark, d)))


_ENDS = "(SELECT repo, min_by(snapshot_id, (taken_at, snapshot_id)) AS first_id, max_by(snapshot_id, (taken_at, snapshot_id)) AS last_id FROM snapshots GROUP BY repo)"


def _ends(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = F.struct("taken_at", "snapshot_id")
    e = table(spark, d, "snapshots").groupBy("repo").agg(F.min_by("snapshot_id", o).alias("a"), F.max_by("snapshot_id", o).alias("b"))
    s = table(spark, d, "symbol_snapshot").where("symbol_type = 'function'").select("snapshot_id", F.regexp_replace("file_path", r"^(\./)+", "").alias("path"), "name", "signature")
    ids = lambda c: e.select("repo", F.col(c).alias("snapshot_id"))
    return s.join(ids("a"), "snapshot_id"), s.join(ids("b"), "snapshot_id")


@query(
    f"""WITH e AS {_ENDS}, s AS (SELECT snapshot_id, regexp_replace(file_path, '^(\\./)+', '') AS path, name, coalesce(signature, '') AS signature FROM symbol_snapshot WHERE symbol_type = 'function'),
a AS (SELECT e.repo, path, name, min(signature) AS before FROM s JOIN e ON first_id = snapshot_id GROUP BY ALL), b AS (SELECT e.repo, path, name, min(signature) AS after FROM s JOIN e ON last_id = snapshot_id GROUP BY ALL)
SELECT repo, path, name, before, after, CASE WHEN after IS NULL THEN 'function_removed' WHEN before IS NULL THEN 'function_added' ELSE 'signature_changed' END AS change_type FROM a FULL JOIN b USING (repo, path, name) WHERE before IS DISTINCT FROM after"""
)
def function_changes(spark, d):
    a, b = _ends(spark, d)
    return impact.symbol_diff(a, b, ["repo", "path", "name"], "signature").select("repo", "path", "name", "before", "after", "change_type")


@query(
    f"""WITH e AS {_ENDS}, s AS (SELECT snapshot_id, regexp_replace(file_path, '^(\\./)+', '') AS path, name, signature FROM symbol_snapshot WHERE symbol_type = 'function'),
a AS (SELECT path, name, min(signature) AS x, 1 AS ia FROM s JOIN e ON first_id = snapshot_id GROUP BY ALL), b AS (SELECT path, name, min(signature) AS y, 1 AS ib FROM s JOIN e ON last_id = snapshot_id GROUP BY ALL)
SELECT path, name, CASE WHEN ib IS NULL THEN 'removed' WHEN ia IS NULL THEN 'added' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path, name) WHERE ia IS NULL OR ib IS NULL OR x IS DISTINCT FROM y"""
)
def sessions_compared(spark, d):
    a, b = _ends(spark, d)
    return store.compare_sessions(a, b)


@query()
def neighbour_changes(spark, d):
    """Functions and classes that differ between each two neighbouring snapshots of a repository, with the calls of their name in the sources; function_changes and sessions_compared have functions of the first and last snapshot."""
    n = table(spark, d, "snapshots").where("snapshot_id IS NOT NULL").groupBy("repo", "snapshot_id").agg(F.min("taken_at").alias("taken_at"))
    pair = n.select("repo", F.col("snapshot_id").alias("old_id"), F.lead("snapshot_id").over(W.partitionBy("repo").orderBy("taken_at", "snapshot_id")).alias("new_id")).where("new_id IS NOT NULL")
    path = F.regexp_replace(F.replace("file_path", F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    s = table(spark, d, "symbol_snapshot").where("symbol_type IN ('function', 'class')").groupBy("snapshot_id", "symbol_type", path.alias("path"), "name")
    s = s.agg(F.max(F.struct("ingested_at", "signature"))["signature"].alias("signature"))  # the row read last
    side = lambda c: s.join(pair.withColumn("snapshot_id", F.col(c)), "snapshot_id")
    keys = ["repo", "old_id", "new_id", "symbol_type", "path", "name"]
    c = impact.symbol_diff(side("old_id"), side("new_id"), keys, "signature", impact.usage(extract.calls(_texts(spark, d))))
    kind = F.col("change_type")
    of_class = F.replace(kind, F.lit("function_"), F.lit("class_"))
    return c.select(*keys, "before", "after", F.when(F.col("symbol_type") == "class", of_class).otherwise(kind).alias("change_type"), "uses", "breaking")


@query(_EDGES + """SELECT repo, '  "' || replace(replace(src, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) || '" -> "' || replace(replace(dst, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) || '";' AS line FROM edge""")
def graph_lines(spark, d):
    return graph.as_text(_edges(spark, d), "dot")


@query(_SRC + "SELECT repo, path, CAST(coalesce((SELECT max((octet_length(encode(x)) - octet_length(encode(regexp_replace(x, '^\\s+', '')))) // 4) FROM (SELECT unnest(lines) AS x) WHERE trim(x, ' \t') <> '' AND NOT starts_with(ltrim(x, ' \t'), '#')), 0) AS INTEGER) AS depth FROM ls WHERE language = 'python'")
def indentation_depth(spark, d):
    return _texts(spark, d).where("language = 'python'").select("repo", "path", code.nesting(F.col("text"), F.col("language")).alias("depth"))


@query(f"SELECT file_id, CASE {_lang('path')} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in code.DISPLAY.items()) + " ELSE 'Unknown' END AS display, starts_with(regexp_extract(path, '([^/]*)$', 1), '.') AS hidden, CASE WHEN starts_with(path, 'src/') THEN path[5:] ELSE path END AS below_src FROM source_files")
def path_figures(spark, d):
    p = F.col("path")
    return table(spark, d, "source_files").select("file_id", code.display_name(code.language(p)).alias("display"), code.is_hidden(p).alias("hidden"), code.relative(p, "src").alias("below_src"))


@query("SELECT id, name, repo, file_path FROM symbols WHERE lower(trim(symbol_type)) = 'function' AND lower(trim(visibility)) = 'public'")
def public_functions(spark, d):
    s = table(spark, d, "symbols")
    return store.filtered(s, symbol_type="function", visibility="public").select("id", "name", "repo", "file_path")


@query(_SRC + f", u AS (SELECT function AS name, count(*) AS uses FROM {_CAL} GROUP BY 1) SELECT f.repo, f.path, f.name, f.kind, coalesce(uses, 0) AS uses FROM {_FUN} f LEFT JOIN u USING (name)")
def usage_counts(spark, d):
    t = _texts(spark, d)
    return impact.with_usage(extract.functions(t), extract.calls(t)).select("repo", "path", "name", "kind", "uses")


_CHG = """chg AS (SELECT DISTINCT name, regexp_replace(file_path, '^(\\./)+', '') AS path, CASE WHEN starts_with(lower(symbol_type), 'class') THEN 'class' ELSE 'function' END AS symbol_type, lower(trim(change_type)) AS change_type, coalesce(breaking_change, false) AS breaking FROM changed_symbols WHERE length(name) > 0)"""


def _changed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "changed_symbols").where("length(name) > 0")
    kind = F.when(F.lower("symbol_type").startswith("class"), "class").otherwise("function")
    return c.select("name", F.regexp_replace("file_path", r"^(\./)+", "").alias("path"), kind.alias("symbol_type"), F.lower(F.trim("change_type")).alias("change_type"), F.coalesce("breaking_change", F.lit(False)).alias("breaking")).distinct()


def _refs(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d)
    return impact.references(_changed(spark, d), extract.calls(t), extract.imports(t), extract.exports(t), extract.functions(t), extract.classes(t))


_REFS = (
    _SRC
    + ", "
    + _CHG
    + f""", plain AS (SELECT DISTINCT name, path AS symbol_file FROM chg), cls AS (SELECT DISTINCT name, path AS symbol_file, lower(name) AS low FROM chg WHERE symbol_type = 'class'), cal AS {_CAL}, fun AS {_FUN},
used AS (SELECT path, function AS name, 'call' AS usage_type FROM cal UNION ALL SELECT path, object, 'call' FROM cal WHERE object IS NOT NULL AND object <> function
  UNION ALL SELECT path, unnest(list_distinct(string_split_regex(module, '[^\\w]+'))), 'import' FROM {_IMP} UNION ALL SELECT path, name, 'export' FROM {_EXP} UNION ALL SELECT path, parent, 'inheritance' FROM {_CLS}),
cnt AS (SELECT path, name, usage_type, count(*) AS n FROM used WHERE length(name) > 0 GROUP BY ALL), def AS (SELECT path, name, count(*) AS n FROM fun GROUP BY ALL),
made AS (SELECT path, lower(regexp_replace(function, '^(?i:new_?)|(?i:_?new)$', '', 'g')) AS low, count(*) AS n FROM cal WHERE contains(lower(function), 'new') GROUP BY ALL),
ref AS (SELECT name, symbol_file, path AS file, usage_type, n FROM plain JOIN cnt USING (name) UNION ALL SELECT name, symbol_file, path, 'definition', n FROM plain JOIN def USING (name) WHERE path <> symbol_file
  UNION ALL SELECT name, symbol_file, path, 'constructor', n FROM cls JOIN made USING (low))
"""
)
_RISK = ", cr AS (SELECT c.*, coalesce((SELECT sum(n) FROM ref WHERE ref.name = c.name AND ref.symbol_file IS NOT DISTINCT FROM c.path), 0) AS refs FROM chg c), risk AS (SELECT *, CASE WHEN ends_with(change_type, 'removed') AND refs > 0 THEN 'high' WHEN breaking OR refs > 10 THEN 'high' WHEN refs > 3 OR change_type = 'signature_changed' THEN 'medium' ELSE 'low' END AS risk_level FROM cr) "


@query(_REFS + "SELECT * FROM ref")
def symbol_references(spark, d):
    return _refs(spark, d)


@query(_REFS + _RISK + 'SELECT name, path, change_type, breaking, refs AS "references", risk_level FROM risk')
def risk_levels(spark, d):
    return impact.with_risk(_changed(spark, d), _refs(spark, d)).select("name", "path", "change_type", "breaking", F.col("references"), "risk_level")


@query(_REFS + _RISK + "SELECT count(*) AS changes, count(*) FILTER (WHERE breaking) AS breaking, CAST(sum(refs) AS BIGINT) AS \"references\", CASE max(CASE risk_level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS overall_risk FROM risk")
def impact_totals(spark, d):
    return impact.totals(impact.with_risk(_changed(spark, d), _refs(spark, d)))


@query(_REFS + "SELECT DISTINCT path FROM (SELECT path FROM chg UNION ALL SELECT file FROM ref) WHERE path IS NOT NULL")
def affected_files(spark, d):
    return impact.affected_files(_changed(spark, d), _refs(spark, d))


@query(_REFS + ", w AS (SELECT *, row_number() OVER (PARTITION BY name, symbol_file ORDER BY file, usage_type) AS rank, count(*) OVER (PARTITION BY name, symbol_file) AS total FROM ref) SELECT name, symbol_file, file, usage_type, n, rank, greatest(total - 5, 0) AS more FROM w WHERE rank <= 5")
def top_references(spark, d):
    return impact.top_references(_refs(spark, d))


@query(_REFS + _RISK + "SELECT name, path, risk_level FROM risk WHERE risk_level IN ('medium', 'high')")
def risks_from_medium(spark, d):
    return impact.at_least(impact.with_risk(_changed(spark, d), _refs(spark, d)), "medium").select("name", "path", "risk_level")


@query(_REFS + "SELECT DISTINCT file AS path FROM ref WHERE file IS NOT NULL AND file NOT IN (SELECT path FROM chg WHERE path IS NOT NULL) ORDER BY path LIMIT 5")
def untouched_files(spark, d):
    return impact.untouched_files(_changed(spark, d), _refs(spark, d))


@query("""WITH c AS (SELECT repo, lower(trim(id)) AS id, name FROM symbols WHERE lower(trim(symbol_type)) = 'class' AND length(name) > 0 GROUP BY ALL),
m AS (SELECT lower(trim(parent_id)) AS id, count(DISTINCT lower(trim(id))) AS n_methods FROM symbols WHERE lower(trim(symbol_type)) = 'method' GROUP BY 1)
SELECT c.repo, c.id, name, coalesce(n_methods, 0) AS n_methods, coalesce(n_methods, 0) > 0 OR contains(name, 'New') OR contains(name, 'Updated') OR contains(name, 'Manager') AS likely, CASE WHEN contains(name, 'New') THEN 'class_added' ELSE 'class_modified' END AS change_type,
'class ' || name AS signature_after, coalesce(n_methods, 0) > 0 OR contains(name, 'Manager') AS breaking FROM c LEFT JOIN m USING (id)""")
def likely_class_changes(spark, d):
    s = table(spark, d, "symbols").select("repo", F.lower(F.trim("id")).alias("id"), F.lower(F.trim("parent_id")).alias("parent"), "name", F.lower(F.trim("symbol_type")).alias("kind"))
    m = s.where("kind = 'method'").groupBy(F.col("parent").alias("id")).agg(F.count_distinct("id").alias("n_methods"))
    c = s.where("kind = 'class' AND length(name) > 0").select("repo", "id", "name").distinct().join(m, "id", "left").withColumn("n_methods", F.coalesce("n_methods", F.lit(0)))
    return impact.likely_changed_classes(c)


@query("SELECT repo, count(*) AS changes, CASE WHEN count(*) <= 2 THEN 'low' WHEN count(*) <= 10 THEN 'medium' ELSE 'high' END AS risk FROM changed_symbols GROUP BY repo")
def risk_by_count(spark, d):
    return table(spark, d, "changed_symbols").groupBy("repo").agg(F.count("*").alias("changes")).withColumn("risk", code.risk_of_count(F.col("changes")))


# The five queries on references above and their SQL find imports by the words of their modules alone and calls by a part that equals the name; these find all references.


def _all_refs(spark: SparkSession, d: str) -> DataFrame:
    t = _texts(spark, d)
    return impact.references(_changed(spark, d), extract.calls(t), extract.named_imports(t), extract.exports(t), extract.functions(t), extract.classes(t), within=True)


@query()
def symbol_references_all(spark, d):
    return _all_refs(spark, d)


@query()
def risk_levels_all(spark, d):
    return impact.with_risk(_changed(spark, d), _all_refs(spark, d)).select("name", "path", "change_type", "breaking", F.col("references"), "risk_level")


@query()
def impact_totals_all(spark, d):
    return impact.totals(impact.with_risk(_changed(spark, d), _all_refs(spark, d)))


@query()
def affected_files_all(spark, d):
    return impact.affected_files(_changed(spark, d), _all_refs(spark, d))


@query()
def top_references_all(spark, d):
    return impact.top_references(_all_refs(spark, d))


@query("SELECT count(*) FILTER (WHERE l = 'high') AS high, count(*) FILTER (WHERE l = 'medium') AS medium, count(*) FILTER (WHERE l = 'low') AS low, count(*) FILTER (WHERE breaking_change) AS breaking, count(*) AS changes, CASE WHEN count(*) FILTER (WHERE breaking_change) > 5 OR count(*) FILTER (WHERE l = 'high') > 10 THEN 'high' WHEN count(*) FILTER (WHERE breaking_change) > 0 OR count(*) FILTER (WHERE l = 'high') > 0 OR count(*) FILTER (WHERE l = 'medium') > 5 THEN 'medium' ELSE 'low' END AS overall FROM (SELECT *, lower(risk_level) AS l FROM changed_symbols)")
def risk_assessment(spark, d):
    return stats.risk_assessment(table(spark, d, "changed_symbols"))


@query(_SRC + f", f AS (SELECT repo, path, name, count(*) AS n_params FROM {_FUN} GROUP BY ALL), u AS (SELECT function AS name, count(*) AS uses FROM {_CAL} GROUP BY 1), x AS (SELECT f.*, coalesce(uses, 0) AS uses FROM f LEFT JOIN u USING (name)) SELECT *, {_contains('name', impact.LIKELY)} OR ends_with(name, 'New') OR n_params > 2 OR uses >= 2 AS likely, n_params > 3 OR {_contains('name', impact.BREAKING)} OR uses >= 3 AS breaking FROM x")
def likely_changes(spark, d):
    t = _texts(spark, d)
    f = extract.functions(t).groupBy("repo", "path", "name").agg(F.count("*").alias("n_params"))
    return impact.likely_changed(impact.with_usage(f, extract.calls(t))).select("repo", "path", "name", "n_params", "uses", "likely", "breaking")


@query()
def likely_changes_by_parameters(spark, d):
    """The rule over each function's true number of parameters; likely_changes, like its SQL, has the number of same-named matches of a file in that place."""
    t = _texts(spark, d)
    f = spans.signatures(spans.symbols(t)).select("repo", "path", "owner_class", "name", "n_params")
    return impact.likely_changed(impact.with_usage(f, extract.calls(t))).select("repo", "path", "owner_class", "name", "n_params", "uses", "likely", "breaking")


# --- notes and events


@query(f"SELECT event_id, ts, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND event_type = 'view'")
def note_timeline(spark, d):
    e = table(spark, d, "events")
    return store.timeline(e, "ts", str(e.agg(F.max("ts")).first()[0]), 7, "view", "event_type").select("event_id", "ts", "event_type")


@query("SELECT event_id, ts FROM events WHERE NOT ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def notes_cleaned(spark, d):
    e = table(spark, d, "events")
    return store.cleaned(e, "ts", str(e.agg(F.max("ts")).first()[0]), 3).select("event_id", "ts")


@query("SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def note_latest(spark, d):
    return store.latest(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts", "event_id")


@query("SELECT lower(trim(source)) AS source, count(*) AS n, coalesce(sum(octet_length(encode(text))), 0) AS bytes, min(created_at) AS first, max(created_at) AS last FROM documents GROUP BY 1")
def note_stats(spark, d):
    return store.note_stats(table(spark, d, "documents").withColumn("source", F.lower(F.trim("source"))), "source", "text", "created_at")


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(title, '')), 'parser') OR contains(lower(coalesce(text, '')), 'parser')")
def note_search(spark, d):
    return store.search(table(spark, d, "documents"), "parser", ["title", "text"]).select("doc_id")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def latest_edits(spark, d):
    return store.newest(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id", 20)


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first, max(ts) + INTERVAL 30 MINUTE AS fires_at, count(*) AS events FROM s GROUP BY user_id, k")
def debounced_bursts(spark, d):
    return watch.debounce(table(spark, d, "events"), "ts", ("user_id",), "30 minutes", None)


# --- edits

_DOC = "WITH doc AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), ls AS (SELECT doc_id, text, CASE WHEN text = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n') END AS l FROM doc) "


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")


@query(_DOC + "SELECT doc_id, (length(text) - length(replace(text, 'parser', ''))) // 6 AS matches, md5(replace(text, 'parser', 'reader')) AS result FROM doc WHERE contains(text, 'parser')")
def edit_replace(spark, d):
    t = F.col("text")
    return _docs(spark, d).where(t.contains("parser")).select("doc_id", edits.count(t, "parser").alias("matches"), F.md5(edits.replace(t, "parser", "reader")).alias("result"))


@query(_DOC + "SELECT doc_id, md5(regexp_replace(text, '(?i)\\bthe\\b', 'THE', 'g')) AS result FROM doc")
def edit_replace_words(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(edits.replace(F.col("text"), "the", "THE", ignore_case=True, whole_word=True)).alias("result"))


@query(_DOC + "SELECT doc_id, md5(array_to_string(CASE WHEN len(l) < 3 THEN list_append(l, 'inserted') ELSE list_concat(list_append(l[1:2], 'inserted'), l[3:]) END, chr(10))) AS result FROM ls")
def edit_insert(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(edits.insert(F.col("text"), 3, "inserted")).alias("result"))


@query(_DOC + "SELECT doc_id, md5(array_to_string(list_concat(l[1:1], l[4:]), chr(10))) AS result FROM ls")
def edit_delete(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(edits.without(F.col("text"), 2, 2)).alias("result"))


@query(_DOC + "SELECT doc_id, md5(array_to_string(l[2:], chr(10))) AS source, md5(array_to_string(list_concat(['a', l[1]], ['b']), chr(10))) AS target FROM ls WHERE len(l) > 0")
def edit_move(spark, d):
    s, t = edits.move_lines(F.col("text"), 1, 1, F.lit("a\nb"), 2)
    return _docs(spark, d).where(F.length("text") > 0).select("doc_id", F.md5(s).alias("source"), F.md5(t).alias("target"))


@query("SELECT doc_id, length(coalesce(text, '')) // 4 AS tokens, length(coalesce(text, '')) // 4 > 8000 AS too_long FROM documents")
def output_guard(spark, d):
    n = code.estimated_tokens(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", n.alias("tokens"), (n > 8000).alias("too_long"))


# --- syntax trees


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    n = nested.linked_rows(table(spark, d, "ast_records"), time_col="received_at").where("entity = 'node'")
    return n.select("record_id", F.col("item_no").alias("node_no"), F.col("owner_no").alias("parent_no"), "node_type", "name", F.col("start_line").try_cast("int").alias("start_line"), F.col("end_line").try_cast("int").alias("end_line"))


@query(SCOPES + "SELECT record_id, node_no, depth, scope_path FROM scoped")
def ast_scopes(spark, d):
    return tree.with_scope(_nodes(spark, d)).select("record_id", "node_no", "depth", "scope_path")


@query(SCOPES + "SELECT record_id, count(*) AS nodes, max(depth) AS max_depth, " + ", ".join(f"count(*) FILTER (WHERE node_type IN ({_q(v)})) AS {k}" for k, v in tree.CATEGORIES.items()) + " FROM scoped GROUP BY record_id")
def ast_statistics(spark, d):
    return tree.categories(tree.with_scope(_nodes(spark, d)), ["record_id"])


@query(NODES + "SELECT node_type, count(*) AS nodes FROM nodes GROUP BY node_type")
def ast_types(spark, d):
    return tree.type_counts(_nodes(spark, d))


@query(NODES + "SELECT record_id, CAST(sum(CASE WHEN node_type IN ('for_loop', 'while_loop', 'switch_statement', 'match_statement') THEN 2 WHEN node_type IN ('if_statement', 'try_block', 'try_statement') THEN 1 ELSE 0 END) AS BIGINT) AS score, count(*) AS nodes FROM nodes GROUP BY record_id")
def ast_scores(spark, d):
    return stats.ast_score(_nodes(spark, d), ["record_id"])


@query(NODES + "SELECT m.* FROM nodes m WHERE node_type = 'method' AND EXISTS (SELECT 1 FROM nodes c WHERE c.record_id = m.record_id AND c.node_no = m.parent_no AND c.node_type = 'class')")
def ast_methods_of_classes(spark, d):
    return tree.children_of_type(_nodes(spark, d), "class", "method")


@query(SCOPES + "SELECT m.record_id, m.node_no, m.name, m.scope_path FROM scoped m WHERE (m.name = 'cache' OR m.scope_path = 'cache') AND m.parent_no >= 0")
def ast_path_query(spark, d):
    return tree.query(tree.with_scope(_nodes(spark, d)), "*::cache").select("record_id", "node_no", "name", "scope_path")


@query(SCOPES + ", spot AS (SELECT DISTINCT record_id, start_line AS line FROM nodes) SELECT p.record_id, p.line, node_no, node_type, name, depth FROM spot p JOIN scoped s ON s.record_id = p.record_id AND s.start_line <= p.line AND p.line <= s.end_line QUALIFY row_number() OVER (PARTITION BY p.record_id, p.line ORDER BY depth DESC, node_no) = 1")
def ast_scope_at_line(spark, d):
    n = tree.with_scope(_nodes(spark, d))
    return tree.scope_at(n, n.select("record_id", F.col("start_line").alias("line")))


@query(SCOPES + "SELECT record_id, node_no, rtrim(repeat('  ', depth) || coalesce(node_type, 'null') || ' ' || coalesce(name, ''), ' ') AS line FROM scoped")
def ast_dump(spark, d):
    return tree.dump(tree.with_scope(_nodes(spark, d)))


@query()
def symbol_spans(spark, d):
    return spans.symbols(_texts(spark, d))


@query()
def function_signatures(spark, d):
    return spans.signatures(spans.symbols(_texts(spark, d)))


@query()
def source_trees(spark, d):
    return tree.with_scope(spans.ast(spans.symbols(_texts(spark, d))))


@query()
def source_tree_statistics(spark, d):
    return tree.categories(tree.with_scope(spans.ast(spans.symbols(_texts(spark, d)))), ["record_id"])
