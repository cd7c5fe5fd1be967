"""Syntax trees as tables of nodes with numbers in document order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.session import Stage

# fixed values: node types by category
CATEGORIES = {
    "classes": ["class", "struct", "interface"],
    "methods": ["method", "constructor", "destructor"],
    "variables": ["variable", "parameter", "property", "field"],
    "control": ["if_statement", "for_loop", "while_loop", "switch_statement", "try_block"],
}


def with_scope(nodes: DataFrame, key: str = "record_id") -> DataFrame:
    """nodes (key, node_no, parent_no, node_type, name, ...) → plus depth and scope_path.

    Doubling on the parent links: each round joins a node's known part of the path with its ancestor's, so a tree of depth
    d takes log2(d) rounds. Names that are null or empty add no segment to scope_path. Joins are on (key, node number), so
    a record or parent with many nodes is spread by its numbers.
    """
    st = Stage(nodes.sparkSession, "scope")
    nodes = st.put(nodes)  # read several times below
    name = F.coalesce("name", F.lit(""))
    cur = st.put(nodes.select(key, "node_no", F.when(F.col("parent_no") >= 0, F.col("parent_no")).alias("up"), name.alias("path"), F.lit(0).alias("depth")))
    while not cur.where("up IS NOT NULL").isEmpty():
        to = cur.select(key, F.col("node_no").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.col("depth").alias("depth2"))
        both = F.when(F.col("path") == "", F.col("path2")).when(F.col("path2") == "", F.col("path")).otherwise(F.concat("path2", F.lit("::"), "path"))
        step = cur.where("up IS NOT NULL").join(to, [key, "up"]).select(key, "node_no", F.col("up2").alias("up"), both.alias("path"), (F.col("depth") + F.col("depth2") + 1).alias("depth"))
        new = st.put(cur.where("up IS NULL").unionByName(step))
        st.drop(cur)
        cur = new
    return nodes.join(cur.select(key, "node_no", "depth", F.col("path").alias("scope_path")), [key, "node_no"])


def categories(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nodes, greatest depth and counts by category."""
    t = F.col("node_type")
    return nodes.groupBy(*by).agg(F.count("*").alias("nodes"), F.max("depth").alias("max_depth"), *[F.count_if(t.isin(v)).alias(k) for k, v in CATEGORIES.items()])


def type_counts(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return nodes.groupBy(*by, "node_type").agg(F.count("*").alias("nodes"))


def children_of_type(nodes: DataFrame, parent_type: str, child_type: str, key: str = "record_id") -> DataFrame:
    p = nodes.where(F.col("node_type") == parent_type).select(key, F.col("node_no").alias("parent_no"))
    return nodes.where(F.col("node_type") == child_type).join(p, [key, "parent_no"], "left_semi")


def parse_path(text: str) -> tuple[str, ...]:
    """``*``, ``A``, ``A::B`` with ``*`` as a wild part; more than two parts, like none, are one plain name."""
    parts = [p.strip() for p in text.strip().split("::")]
    if parts == [""]:
        return ()
    return tuple(parts) if len(parts) <= 2 else ("::".join(parts),)


def _named(col: str, name: str, fuzzy: bool) -> Column:
    if name == "*":
        return F.lit(True)
    c = F.col(col)
    exact = (c == name) | (F.col(col.replace("name", "scope_path")) == name)
    if fuzzy and "::" not in name:
        return exact | F.contains(F.lower(c), F.lit(name.lower()))
    return exact


def query(nodes: DataFrame, path: str, key: str = "record_id", fuzzy: bool = False) -> DataFrame:
    """Nodes that a path names: ``A::B`` are nodes B directly below a node A. Exact unless fuzzy is asked for. An empty path names none."""
    parts = parse_path(path)
    if not parts:
        return nodes.limit(0)
    if len(parts) == 1:
        return nodes.where(_named("name", parts[0], fuzzy))
    up = nodes.where(_named("name", parts[0], fuzzy)).select(key, F.col("node_no").alias("parent_no"))
    return nodes.where(_named("name", parts[1], fuzzy)).join(up, [key, "parent_no"], "left_semi")


def scope_at(nodes: DataFrame, lines: DataFrame, key: str = "record_id") -> DataFrame:
    """lines (key, line) → the deepest node around each line, the first of equals; lines outside every node have no row."""
    at = lines.select(key, "line").distinct()
    hit = nodes.join(at, key).where("start_line <= line AND line <= end_line")
    best = F.max_by(F.struct("node_no", "node_type", "name", "depth"), F.struct("depth", -F.col("node_no")))
    return hit.groupBy(key, "line").agg(best.alias("n")).select(key, "line", "n.*")


def dump(nodes: DataFrame, style: str = "tree") -> DataFrame:
    """One text line per node, in document order of each record."""
    if style == "tree":
        line = F.format_string("%s%s %s", F.repeat(F.lit("  "), F.col("depth")), F.col("node_type"), F.coalesce("name", F.lit("")))
    elif style == "flat":
        line = F.format_string("%s [%s]", F.col("scope_path"), F.col("node_type"))
    elif style == "json":
        line = F.to_json(F.struct("node_no", "parent_no", "node_type", "name", "depth"))
    else:
        raise ValueError(style)
    return nodes.select("record_id", "node_no", F.rtrim(line).alias("line"))
