"""Aggregates over files, symbols, notes and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import code


def latest_files(files: DataFrame) -> DataFrame:
    """One row per file_id: that of the latest analysis, then of the latest arrival, then the greatest values."""
    rest = [c for c in files.columns if c not in ("file_id", "analyzed_at", "ingested_at", "metadata")]
    v = F.struct(F.col("analyzed_at").alias("_a"), F.col("ingested_at").alias("_i"), *rest)
    return files.where("file_id IS NOT NULL").groupBy("file_id").agg(F.max(v).alias("v")).select("file_id", "v.*").drop("_a", "_i")


def summary(metrics: DataFrame) -> DataFrame:
    """One row: files, lines, large and complex files, average and greatest complexity and its file (the first path of equals); zeros and '' for no rows."""
    top = F.min_by("path", F.struct(-F.col("cyclomatic"), "path"))
    return metrics.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("total_lines"), F.lit(0)).alias("total_lines"), F.coalesce(F.sum("code_lines"), F.lit(0)).alias("code_lines"),
        F.count_if(F.col("total_lines") > 500).alias("large_files"), F.count_if(F.col("rating").isin("complex", "very_complex")).alias("complex_files"),
        F.round(F.coalesce(F.avg("cyclomatic"), F.lit(0.0)), 6).alias("average_complexity"), F.coalesce(F.max("cyclomatic"), F.lit(0)).alias("max_complexity"), F.coalesce(top, F.lit("")).alias("most_complex_file"),
    )


def by_language(metrics: DataFrame) -> DataFrame:
    total = F.sum("total_lines")
    return metrics.groupBy("language").agg(
        F.count("*").alias("files"), total.alias("total_lines"), F.sum("code_lines").alias("code_lines"), F.sum("comment_lines").alias("comment_lines"), F.sum("empty_lines").alias("empty_lines"),
        F.round(F.when(total > 0, F.sum("code_lines") / total).otherwise(0.0), 6).alias("code_ratio"),
    )


def structure(metrics: DataFrame) -> DataFrame:
    """Files and lines per language and per directory, in one pass over two grouping sets."""
    d = metrics.withColumn("directory", code.parent_dir(F.col("path")))
    g = d.groupingSets([["language"], ["directory"]], "language", "directory").agg(F.grouping("language").alias("g"), F.count("*").alias("files"), F.sum("total_lines").alias("lines"), F.sort_array(F.collect_set("language")).alias("languages"))
    return g.select(F.when(F.col("g") == 1, "directory").otherwise("language").alias("by"), F.when(F.col("g") == 1, F.col("directory")).otherwise(F.col("language")).alias("name"), "files", "lines", F.array_join("languages", ",").alias("languages"))


def spread_complexity(control: DataFrame) -> DataFrame:
    """(path, functions, control) → per path the score 1 + control div max(functions, 1) of each function, and its class."""
    each = F.expr("1 + control div greatest(functions, 1)")
    bucket = F.when(F.col("score") <= 5, "low").when(F.col("score") <= 10, "medium").when(F.col("score") <= 20, "high").otherwise("very_high")
    return control.withColumn("score", each).withColumn("bucket", bucket)


def bucket_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("bucket").agg(F.sum("functions").alias("functions"), F.count("*").alias("files"))


def call_frequency(calls: DataFrame) -> DataFrame:
    full = code.full_call(F.col("function"), F.col("object"), F.col("is_method"))
    return calls.groupBy(full.alias("full_name")).agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


def file_counters(functions: DataFrame, classes: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """(repo, path, functions, classes, imports, total_calls, unique_calls) by one aggregation of the tagged union: no chain of joins."""
    tag = lambda df, kind, name: df.select("repo", "path", F.lit(kind).alias("kind"), name.alias("name"))
    u = tag(functions, "f", F.col("name")).unionByName(tag(classes, "c", F.col("name"))).unionByName(tag(imports, "i", F.col("module")))
    u = u.unionByName(tag(calls, "k", code.full_call(F.col("function"), F.col("object"), F.col("is_method"))))
    one = u.groupBy("repo", "path", "kind", "name").count()
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("count"))), F.lit(0))
    return one.groupBy("repo", "path").agg(n("f").alias("functions"), n("c").alias("classes"), n("i").alias("imports"), n("k").alias("total_calls"), F.count_if(F.col("kind") == "k").alias("unique_calls"))


def change_summary(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    c = changes.groupBy(*(by or [])) if by else changes.groupBy()
    kind = F.col("change_type")
    return c.agg(F.count_if(kind == "added").alias("added"), F.count_if(kind == "modified").alias("modified"), F.count_if(kind == "deleted").alias("deleted"), F.count("*").alias("total"))


def speedup(full_ms: float, elapsed_ms: float) -> float:
    """Of a measured full run against an incremental one; 1 where nothing was measured."""
    return full_ms / elapsed_ms if elapsed_ms else 1.0


def risk_assessment(changed: DataFrame) -> DataFrame:
    """Symbols by risk, breaking ones, and the overall risk: high beyond 5 breaking or 10 high ones, medium with any of them or beyond 5 medium ones."""
    level = F.lower("risk_level")
    a = changed.agg(
        F.count_if(level == "high").alias("high"), F.count_if(level == "medium").alias("medium"), F.count_if(level == "low").alias("low"), F.count_if(F.col("breaking_change")).alias("breaking"), F.count("*").alias("changes"),
    )
    return a.withColumn("overall", F.when((F.col("breaking") > 5) | (F.col("high") > 10), "high").when((F.col("breaking") > 0) | (F.col("high") > 0) | (F.col("medium") > 5), "medium").otherwise("low"))


def ast_score(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Weighted control structures: loops and switches count 2, branches and try blocks 1."""
    t = F.col("node_type")
    w: Column = F.when(t.isin("for_loop", "while_loop", "switch_statement", "match_statement"), 2).when(t.isin("if_statement", "try_block", "try_statement"), 1).otherwise(0)
    return nodes.groupBy(*by).agg(F.sum(w).alias("score"), F.count("*").alias("nodes"))
