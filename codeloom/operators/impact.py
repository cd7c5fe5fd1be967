"""What a change touches: symbol differences, references, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions import code

# fixed values: parts of names that make a change likely or breaking
LIKELY = ["new", "update", "modify", "change", "API", "Feature"]
BREAKING = ["API", "new"]


def usage(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.col("function").alias("name")).agg(F.count("*").alias("uses"))


def with_usage(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Symbols with the number of calls of their name, 0 where there is none. The calls are counted before they are joined."""
    return symbols.join(usage(calls), "name", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def _has(name: Column, parts: list[str]) -> Column:
    out = F.contains(name, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(name, F.lit(p))
    return out


def likely_changed(functions: DataFrame) -> DataFrame:
    """functions (name, n_params, uses, ...) → plus likely and breaking, guessed from names, parameters and use."""
    n, p, u = F.col("name"), F.col("n_params"), F.col("uses")
    return functions.withColumn("likely", _has(n, LIKELY) | n.endswith("New") | (p > 2) | (u >= 2)).withColumn("breaking", (p > 3) | _has(n, BREAKING) | (u >= 3))


# fixed values: parts of names of classes that make a change likely
LIKELY_CLASS = ["New", "Updated", "Manager"]


def likely_changed_classes(classes: DataFrame) -> DataFrame:
    """classes (name, n_methods, ...) → plus likely, change_type, signature_after and breaking, guessed from names and methods."""
    n, methods = F.col("name"), F.coalesce(F.col("n_methods"), F.lit(0)) > 0
    kind = F.when(F.contains(n, F.lit("New")), "class_added").otherwise("class_modified")
    return classes.withColumns({"likely": _has(n, LIKELY_CLASS) | methods, "change_type": kind, "signature_after": F.concat(F.lit("class "), n), "breaking": methods | F.contains(n, F.lit("Manager"))})


def symbol_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str, uses: DataFrame | None = None) -> DataFrame:
    """old and new (*keys, value) → (*keys, before, after, change_type, uses, breaking) of removed, added and changed symbols.

    One full outer join instead of two anti joins and an inner one. Of several rows with a key the smallest value counts.
    Removed and changed symbols in use are breaking, added ones never. Null keys are no symbols.
    """
    clean = lambda d, out: d.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.min(F.coalesce(F.col(value), F.lit(""))).alias(out))
    d = clean(old, "before").join(clean(new, "after"), keys, "full_outer")
    d = d.where(F.col("before").isNull() | F.col("after").isNull() | (F.col("before") != F.col("after")))
    kind = F.when(F.col("after").isNull(), "function_removed").when(F.col("before").isNull(), "function_added").otherwise("signature_changed")
    d = d.withColumn("change_type", kind)
    d = d.join(uses.select("name", "uses"), "name", "left").withColumn("uses", F.coalesce("uses", F.lit(0))) if uses is not None else d.withColumn("uses", F.lit(0))
    return d.withColumn("breaking", (F.col("change_type") != "function_added") & (F.col("uses") > 0))


def containing(names: DataFrame, texts: DataFrame) -> DataFrame:
    """names (name) and texts (text) → (text, name): the distinct names that each distinct text contains.

    Each text's substrings of the lengths that names have are equi-joined with the names: no pair is tried in vain.
    """
    n = names.where(F.length("name") > 0).select("name").distinct()
    sizes = n.select(F.length("name").alias("size")).distinct()
    t = texts.where(F.length("text") > 0).select("text").distinct()
    sized = t.select("text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("size")).join(sizes, "size")
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - F.col("size") + 1), lambda i: F.substring(F.col("text"), i, F.col("size"))))
    return sized.select("text", F.explode(parts).alias("name")).join(n, "name").select("text", "name")


def references(symbols: DataFrame, calls: DataFrame, imports: DataFrame, exports: DataFrame, functions: DataFrame, classes: DataFrame, within: bool = False) -> DataFrame:
    """(name, symbol_file, file, usage_type, n): where changed symbols (name, path) are called, imported, exported, defined again, constructed or inherited.

    All are equi-joins: a call counts if one of the parts of its full name is the symbol's name, which a split and an
    explode turn into keys; so there is no nested loop over symbols and calls. Empty names refer to nothing. An import counts
    by the words of its module, and by the names it brings in if it has a column imported_names (extract.named_imports).
    With within, a call also counts if its full name contains the symbol's name anywhere.
    """
    s = symbols.where(F.length("name") > 0).select("name", F.col("path").alias("symbol_file"), "symbol_type").distinct()
    plain = s.select("name", "symbol_file").distinct()
    call = calls.select("path", F.explode(F.array_distinct(F.array_compact(F.array("object", "function")))).alias("name"), F.lit("call").alias("usage_type"))
    brought = F.col("imported_names") if "imported_names" in imports.columns else F.array_distinct(F.split("module", r"[^\w]+"))
    if within:  # the full name contains each of its parts, so this is both branches; calls are counted before they are joined
        full = calls.select("path", code.full_call(F.col("function"), F.col("object"), F.col("is_method")).alias("text")).groupBy("path", "text").agg(F.count("*").alias("n"))
        call = full.join(containing(plain, full), "text").select("path", "name", F.lit("call").alias("usage_type"), "n")
    imp = imports.select("path", F.explode(brought).alias("name"), F.lit("import").alias("usage_type"))
    exp = exports.select("path", "name", F.lit("export").alias("usage_type"))
    base = classes.select("path", F.col("parent").alias("name"), F.lit("inheritance").alias("usage_type"))
    one = imp.unionByName(exp).unionByName(base).withColumn("n", F.lit(1).cast("bigint"))
    used = one.unionByName(call if within else call.withColumn("n", F.lit(1).cast("bigint"))).where(F.length("name") > 0).groupBy("path", "name", "usage_type").agg(F.sum("n").alias("n"))
    r = plain.join(used, "name").select("name", "symbol_file", F.col("path").alias("file"), "usage_type", "n")
    again = functions.select(F.col("path").alias("file"), "name").groupBy("file", "name").agg(F.count("*").alias("n"))
    defined = plain.join(again, "name").where(F.col("file") != F.col("symbol_file")).select("name", "symbol_file", "file", F.lit("definition").alias("usage_type"), "n")
    made = calls.where(F.contains(F.lower("function"), F.lit("new"))).select(F.col("path").alias("file"), F.lower(F.regexp_replace("function", r"(?i)^new_?|_?new$", "")).alias("low")).groupBy("file", "low").agg(F.count("*").alias("n"))
    built = s.where("symbol_type = 'class'").withColumn("low", F.lower("name")).join(made, "low").select("name", "symbol_file", "file", F.lit("constructor").alias("usage_type"), "n")
    return r.unionByName(defined).unionByName(built)


def with_risk(changed: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Adds references (from refs by name and file of the symbol, else uses) and risk_level."""
    if refs is not None:
        n = refs.groupBy(F.col("name").alias("_name"), F.col("symbol_file").alias("_file")).agg(F.sum("n").alias("references"))
        changed = changed.join(n, (F.col("name") == F.col("_name")) & F.col("path").eqNullSafe(F.col("_file")), "left").drop("_name", "_file").withColumn("references", F.coalesce("references", F.lit(0)))
    else:
        changed = changed.withColumn("references", F.col("uses"))
    return changed.withColumn("risk_level", code.risk(F.col("change_type"), F.col("breaking"), F.col("references")))


def at_least(changed: DataFrame, threshold: str) -> DataFrame:
    """Symbols whose risk reaches the threshold (low, medium, high)."""
    return changed.where(code.risk_rank(F.col("risk_level")) >= {"low": 1, "medium": 2, "high": 3}[threshold])


def affected_files(changed: DataFrame, refs: DataFrame) -> DataFrame:
    return changed.select("path").unionByName(refs.select(F.col("file").alias("path"))).where("path IS NOT NULL").distinct()


def untouched_files(changed: DataFrame, refs: DataFrame, k: int = 5) -> DataFrame:
    """The first k files that changes affect without being changed themselves."""
    return affected_files(changed, refs).join(changed.select("path").where("path IS NOT NULL").distinct(), "path", "left_anti").orderBy("path").limit(k)


def top_references(refs: DataFrame, k: int = 5) -> DataFrame:
    """The first k references of each symbol by file and use, and how many more there are. Spark filters ranks before it shuffles."""
    w = W.partitionBy("name", "symbol_file")
    r = refs.withColumn("rank", F.row_number().over(w.orderBy("file", "usage_type"))).where(F.col("rank") <= k)
    total = refs.groupBy("name", "symbol_file").agg(F.count("*").alias("total"))
    return r.join(total, ["name", "symbol_file"]).withColumn("more", F.greatest(F.col("total") - k, F.lit(0))).drop("total")


def totals(changed: DataFrame) -> DataFrame:
    rank = F.coalesce(F.max(code.risk_rank(F.col("risk_level"))), F.lit(1))
    return changed.agg(
        F.count("*").alias("changes"), F.count_if("breaking").alias("breaking"), F.coalesce(F.sum("references"), F.lit(0)).cast("bigint").alias("references"),
        F.when(rank == 3, "high").when(rank == 2, "medium").otherwise("low").alias("overall_risk"),
    )


def complexity_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Average complexity of two sets of metrics and the difference; 0 for no rows."""
    a = lambda d, n: d.agg(F.round(F.coalesce(F.avg("cyclomatic"), F.lit(0.0)), 6).alias(n))
    # two rows of one: the only product in the library
    return a(before, "before").withColumn("k", F.lit(1)).join(a(after, "after").withColumn("k", F.lit(1)), "k").select("before", "after", F.round(F.col("after") - F.col("before"), 6).alias("change"))
