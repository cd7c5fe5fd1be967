"""Mixing sources to target weights under a cap on repetition.

Budgets go down a tree of domains, languages and sources. A node shares its budget among its children by weight; what a
child cannot take (its texts times the allowed repeats) goes to its siblings before it goes back to the ancestors. Each
leaf then takes whole epochs and, of one more epoch in a seeded order, the prefix that comes nearest to the rest.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.session import Stage

#: Which sources are siblings; a parameter of ``mix``. Sources not named form the domain ``other``.
DOMAINS = {
    "readme": "manual", "tutorial": "manual", "design_note": "manual", "api_reference": "manual", "docstring": "manual", "wiki": "manual",
    "issue": "talk", "review": "talk", "forum": "talk", "changelog": "history", "commit_message": "history", "build_log": "history",
}
BUCKET_BITS = 10
#: Leaves below this number are broadcast, and the buckets in which their prefixes end, one a leaf; more are joined by shuffle.
SMALL = 200_000


def source_name(c: Column) -> Column:
    """Trimmed, lower-cased, blanks and hyphens as ``_``; blank is null."""
    t = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\s", " "))), r"[-\s]+", "_")
    return F.when(F.length(t) > 0, t)


def language_name(c: Column) -> Column:
    """The primary subtag in lower case, ``und`` where there is none; so there are at most some thousand."""
    t = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(F.length(t) > 0, t).otherwise(F.lit("und"))


def allocate(tree: dict[tuple, tuple[float, float]], total: float) -> dict[tuple, float]:
    """{path: (weight, capacity)} → {path: budget}; paths are of equal length. Shortages go to siblings first, then up."""

    def capacity(p: tuple) -> float:
        return sum(c for q, (w, c) in tree.items() if q[: len(p)] == p and w > 0)

    def share(parts: list[tuple[object, float, float]], budget: float) -> dict:
        got = dict.fromkeys((k for k, _, _ in parts), 0.0)
        open_ = [x for x in parts if x[1] > 0 and x[2] > 0]
        while open_ and budget > 1e-9:
            weight = sum(w for _, w, _ in open_)
            over = [(k, w, c) for k, w, c in open_ if c - got[k] <= budget * w / weight]
            if not over:
                for k, w, _ in open_:
                    got[k] += budget * w / weight
                return got
            for k, _, c in over:
                budget -= c - got[k]
                got[k] = c
            done = {k for k, _, _ in over}
            open_ = [x for x in open_ if x[0] not in done]
        return got

    out: dict[tuple, float] = {}

    def down(p: tuple, budget: float) -> None:
        if p in tree:
            out[p] = budget
            return
        kids: dict[tuple, float] = defaultdict(float)
        for q, (w, _) in tree.items():
            if q[: len(p)] == p:
                kids[q[: len(p) + 1]] += w
        for k, b in share([(k, w, capacity(k)) for k, w in sorted(kids.items())], budget).items():
            down(k, b)

    down((), total)
    return out


def mix(documents: DataFrame, targets: DataFrame, seed: int = 1, domains: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """documents (doc_id, source, lang, n_tokens) and targets (mix_id, source, target_weight, max_repeats, total_ratio) → (selected, shares).

    selected (mix_id, doc_id, source, lang, tokens, repeats) has a row per chosen document; shares (mix_id, source,
    target_share, actual_share, target_tokens, tokens, documents, max_repeats) one per target.
    Weights of a mix are normalised; null or negative weights and repeats count as 0, a source named twice in a mix has the
    sum of its weights and the greater of its repeats. Texts of size 0 and of sources no mix names are not chosen, but count towards the total. A source
    that can deliver nothing has actual share 0. A document is never chosen more often than max_repeats; equal ids are documents of their own, told apart by their size.
    The number of targets is that of a table written by hand; targets times languages come to the driver.
    """
    spark = documents.sparkSession
    domains = DOMAINS if domains is None else domains
    st = Stage(spark, "mix")
    docs = st.put(documents.select("doc_id", source_name(F.col("source")).alias("source"), language_name(F.col("lang")).alias("lang"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n")))
    wanted: dict[int, dict[str, list]] = defaultdict(dict)
    ratio: dict[int, float] = defaultdict(float)
    for m, s, w, r, q in targets.where("mix_id IS NOT NULL").select("mix_id", source_name(F.col("source")), "target_weight", "max_repeats", "total_ratio").collect():
        x = wanted[m].setdefault(s, [0.0, 0])
        x[0] += max(w or 0.0, 0.0)
        x[1] = max(x[1], r or 0)
        ratio[m] = max(ratio[m], q or 0.0)
    names = spark.createDataFrame([(s,) for s in sorted({s for d in wanted.values() for s in d if s})], "source STRING")
    stock = {(s, lang): n for s, lang, n in docs.join(F.broadcast(names), "source", "left_semi").groupBy("source", "lang").agg(F.sum("n")).collect() if n}
    total = docs.agg(F.sum("n")).first()[0] or 0
    leaves, shares = [], []
    for m, by in wanted.items():
        weight = sum(w for w, _ in by.values()) or 1.0
        tree = {}
        for s, (w, r) in by.items():
            has = {lang: n for (x, lang), n in stock.items() if x == s}
            for lang, n in has.items():
                tree[domains.get(s, "other"), lang, s] = (w * n / sum(has.values()), float(n * r))
        budgets = allocate(tree, ratio[m] * total) if tree else {}
        for (_, lang, s), b in budgets.items():
            n = stock[s, lang]
            whole = min(int(b // n), by[s][1])
            leaves.append((m, s, lang, whole, int(round(b - whole * n)) if whole < by[s][1] else 0))
        shares += [(m, s, w / weight, int(round(w / weight * ratio[m] * total)), r) for s, (w, r) in by.items()]
    small = F.broadcast if len(leaves) < SMALL else lambda d: d
    leaf = small(spark.createDataFrame(leaves, "mix_id INT, source STRING, lang STRING, whole INT, rest BIGINT"))
    order = F.xxhash64("doc_id", "n", F.lit(seed), "mix_id", "whole")
    rows = docs.where("n > 0").join(leaf, ["source", "lang"]).withColumn("h", order).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS).cast("int"))
    # Only the bucket of a leaf's order in which the prefix ends is sorted; those before it are taken whole.
    over = W.partitionBy("mix_id", "source", "lang").orderBy("bucket")
    sums = rows.where("rest > 0").groupBy("mix_id", "source", "lang", "bucket", "rest").agg(F.sum("n").alias("t")).withColumn("upto", F.sum("t").over(over))
    ends = sums.where("upto - t < rest AND upto >= rest").select("mix_id", "source", "lang", F.col("bucket").alias("last"), (F.col("rest") - F.col("upto") + F.col("t")).alias("room"))
    rows = rows.join(small(ends), ["mix_id", "source", "lang"], "left")
    before = rows.where("rest > 0 AND (last IS NULL OR bucket < last)").withColumn("more", F.lit(1))
    run = F.sum("n").over(W.partitionBy("mix_id", "source", "lang").orderBy("h", "doc_id", "n").rowsBetween(W.unboundedPreceding, 0))
    edge = rows.where("bucket = last").withColumn("sofar", run).withColumn("more", F.when(F.col("sofar") - F.col("n") / 2 <= F.col("room"), 1).otherwise(0)).drop("sofar")
    after = rows.where("rest = 0 OR bucket > last").withColumn("more", F.lit(0))
    chosen = before.unionByName(edge).unionByName(after).withColumn("repeats", F.col("whole") + F.col("more")).where("repeats > 0")
    chosen = st.put(chosen.select("mix_id", "doc_id", "source", "lang", F.col("n").alias("tokens"), "repeats"))
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most"))
    want = spark.createDataFrame(shares, "mix_id INT, source STRING, target_share DOUBLE, target_tokens BIGINT, max_repeats INT")
    all_ = got.groupBy("mix_id").agg(F.sum("tokens").alias("_all"))
    rep = want.join(got, ["mix_id", "source"], "left").join(all_, "mix_id", "left").select(
        "mix_id", "source", F.round("target_share", 6).alias("target_share"), F.round(F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)), 6).alias("actual_share"), "target_tokens",
        F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"), F.coalesce("most", F.lit(0)).alias("most_repeats"), "max_repeats",
    )
    return chosen, rep
