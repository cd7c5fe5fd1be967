"""Differences between consecutive full snapshots.

Keys get ordinals that stay: a key's block is a hash of the key, and its place in the block comes from a dictionary
(``KeyStore``) to which later runs only add keys, so that bitmaps of any two runs can be compared. Without a store the key's
rank in its block serves for one run. A snapshot is then a bitmap over
ordinals, stored compressed: only words of 64 ordinals that hold a set bit exist, as rows (block, word). For two
adjacent snapshots ``new & ~old`` are the additions, ``old & ~new`` the removals, and in ``new & old`` the value vectors of
both sides, ordered by ordinal, are compared in place: the partner of a bit is found by counting the bits below it.
Everything is built-in expressions over longs and arrays of at most 64 entries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.errors import AnalysisException

WORD = 64


def normal_path(c: Column) -> Column:
    """``/`` as separator and no leading ``./``, however often it is repeated."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./+)+", "")


def adjacent(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, repo, taken_at) → (snapshot_id, repo, seq, has_next): numbered by taken_at within a repo, equal times by id. Null ids or times are no snapshots."""
    s = snapshots.where("snapshot_id IS NOT NULL AND taken_at IS NOT NULL").select("snapshot_id", "repo", "taken_at").dropDuplicates(["snapshot_id"])
    w = W.partitionBy("repo").orderBy("taken_at", "snapshot_id")
    return s.select("snapshot_id", "repo", F.row_number().over(w).alias("seq"), F.lead("snapshot_id").over(w).alias("next_id"))


def latest_rows(rows: DataFrame, keys: Sequence[str], values: Sequence[str], time_col: str) -> DataFrame:
    """One row per key: the one with the latest time (null is oldest); among equal times the greatest values. Null keys are keys."""
    v = F.struct(F.col(time_col).alias("_t"), *values)
    return rows.select(*keys, v.alias("_v")).groupBy(*keys).agg(F.max("_v").alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def new_keys(records: DataFrame, keys: Sequence[str], blocks: int, known: DataFrame | None = None) -> DataFrame:
    """(block, ordinal, *keys) of the keys in records that known (an earlier output) lacks; their ordinals follow the block's greatest."""
    d = records.select(*keys).distinct().select(F.pmod(F.xxhash64(*keys), F.lit(blocks)).alias("block"), *keys)
    rank = (F.row_number().over(W.partitionBy("block").orderBy(*keys)) - 1).cast("long")
    if known is None:
        return d.select("block", rank.alias("ordinal"), *keys)
    same = d["block"] == known["block"]
    for k in keys:
        same &= d[k].eqNullSafe(known[k])
    new = d.join(known, same, "left_anti").withColumn("_r", rank)
    top = known.groupBy("block").agg((F.max("ordinal") + 1).alias("_from"))
    return new.join(top, "block", "left").select("block", (F.coalesce("_from", F.lit(0)) + F.col("_r")).cast("long").alias("ordinal"), *keys)


def key_dictionary(records: DataFrame, keys: Sequence[str], blocks: int, known: DataFrame | None = None) -> DataFrame:
    """(block, ordinal, *keys) of all keys in records; keys in ``known`` (an earlier output) keep their ordinal."""
    new = new_keys(records, keys, blocks, known)
    return new if known is None else known.select("block", "ordinal", *keys).unionByName(new)


class KeyStore:
    """Ordinals of keys, kept in a folder that all executors share. Runs add keys and never change one.

    The number of blocks belongs to the folder: a key's block must be the same in each run.
    """

    def __init__(self, spark: SparkSession, root: str, blocks: int = 256):
        self.spark, self.blocks, self.path = spark, blocks, f"{root.rstrip('/')}/blocks-{blocks}"

    def load(self) -> DataFrame | None:
        """(block, ordinal, *keys) of all keys so far; None before the first run."""
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return None

    def extend(self, records: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Gives the keys of records that are new an ordinal, and returns all."""
        new_keys(records, keys, self.blocks, self.load()).write.mode("append").parquet(self.path)
        return self.load()


def diff(records: DataFrame, snapshots: DataFrame, keys: Sequence[str], values: Sequence[str], dictionary: DataFrame | None = None, blocks: int | None = None, store: KeyStore | None = None) -> DataFrame:
    """records (snapshot_id, *keys, *values), one row per snapshot and key → (snapshot_id, *keys, old, new, change).

    snapshot_id is the later of two adjacent snapshots; change is ``added``, ``removed`` or ``changed`` (some value
    differs, two nulls being equal); old and new are structs of the values, null on the side that has no row. Records of
    unknown snapshots are left out. A repo's first snapshot adds nothing; a snapshot without rows is a full removal.
    With a store the ordinals are those of the keys (repo, *keys) kept there, new ones being added; without it and a dictionary they hold for this call only.
    """
    blocks = store.blocks if store else blocks or 4 * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Each record is the newer side of the pair named by its own snapshot and the older side of the next one's. repo leads the order of ordinals, so that words are dense.
    r = records.join(adjacent(snapshots).withColumnRenamed("repo", "_repo"), "snapshot_id")
    if store:
        # The kept keys are sorted in among the records, each before its records: one shuffle by block gives ordinals, and words are gathered where they are.
        named = ["_repo", *keys]
        kept = store.extend(r.select(*named), named)
        b = r.withColumn("block", F.pmod(F.xxhash64(*named), F.lit(blocks))).withColumn("_o", F.lit(None).cast("long")).withColumn("_rec", F.lit(1))
        u = b.unionByName(kept.select("block", *named, F.col("ordinal").alias("_o"), F.lit(0).alias("_rec")), allowMissingColumns=True)
        r = u.withColumn("ordinal", F.last("_o", True).over(W.partitionBy("block").orderBy(*named, "_rec").rowsBetween(W.unboundedPreceding, 0))).where("_rec = 1").drop("_o", "_rec")
    elif dictionary is None:
        r = r.withColumn("block", F.pmod(F.xxhash64("_repo", *keys), F.lit(blocks)))
        r = r.withColumn("ordinal", F.dense_rank().over(W.partitionBy("block").orderBy("_repo", *keys)) - 1)
    else:
        on = None
        d = dictionary.select("block", "ordinal", *[F.col(k).alias(f"_d_{k}") for k in keys])
        for k in keys:
            e = F.col(k).eqNullSafe(F.col(f"_d_{k}"))
            on = e if on is None else on & e
        r = r.join(d, on)
    named = [F.lit("bit"), (F.col("ordinal") % WORD).cast("int")] + [x for k in keys for x in (F.lit(k), F.col(k))]
    entry = F.named_struct(*named, F.lit("v"), F.named_struct(*[x for v in values for x in (F.lit(v), F.col(v))]))
    sides = F.array(
        F.named_struct(F.lit("pair"), F.col("snapshot_id"), F.lit("newer"), F.lit(True), F.lit("ok"), F.col("seq") > 1),
        F.named_struct(F.lit("pair"), F.col("next_id"), F.lit("newer"), F.lit(False), F.lit("ok"), F.col("next_id").isNotNull()),
    )
    s = r.select("block", F.floor(F.col("ordinal") / WORD).alias("word"), entry.alias("e"), F.explode(sides).alias("s")).where("s.ok")
    bit = F.expr("shiftleft(1L, e.bit)")
    words = s.select("block", "word", "e", "s.pair", "s.newer", bit.alias("b")).groupBy("block", "word", "pair").agg(
        F.coalesce(F.bit_or(F.when(F.col("newer"), F.col("b"))), F.lit(0).cast("long")).alias("new_bits"),
        F.coalesce(F.bit_or(F.when(~F.col("newer"), F.col("b"))), F.lit(0).cast("long")).alias("old_bits"),
        F.array_sort(F.collect_list(F.when(F.col("newer"), F.col("e")))).alias("new_vec"),
        F.array_sort(F.collect_list(F.when(~F.col("newer"), F.col("e")))).alias("old_vec"),
    )
    words = words.withColumn("added", F.expr("new_bits & ~old_bits")).withColumn("removed", F.expr("old_bits & ~new_bits")).withColumn("both", F.expr("new_bits & old_bits"))
    gone = F.expr("transform(filter(old_vec, x -> (shiftright(removed, x.bit) & 1) = 1), x -> struct(x AS e, x.v AS old, cast(null AS {v}) AS new, 'removed' AS change))".format(v=_ddl(records, values)))
    came = F.expr("transform(filter(new_vec, x -> (shiftright(added, x.bit) & 1) = 1), x -> struct(x AS e, cast(null AS {v}) AS old, x.v AS new, 'added' AS change))".format(v=_ddl(records, values)))
    partner = "old_vec[cast(bit_count(old_bits & ~shiftleft(-1L, x.bit)) AS int)].v"
    moved = F.expr(f"transform(filter(new_vec, x -> (shiftright(both, x.bit) & 1) = 1 AND NOT ({partner} <=> x.v)), x -> struct(x AS e, {partner} AS old, x.v AS new, 'changed' AS change))")
    rows = words.select("pair", F.explode(F.concat(came, gone, moved)).alias("x"))
    return rows.select(F.col("pair").alias("snapshot_id"), *[F.col(f"x.e.{k}").alias(k) for k in keys], "x.old", "x.new", "x.change")


def _ddl(records: DataFrame, values: Sequence[str]) -> str:
    return records.select(F.struct(*values).alias("v")).schema["v"].dataType.simpleString()


def file_changes(file_snapshot: DataFrame, snapshots: DataFrame, **kw) -> DataFrame:
    """(snapshot_id, entity, path, name, change_type) of files: added, deleted, modified (content_hash, modified_time or size differs). Null paths are no files."""
    f = file_snapshot.where("path IS NOT NULL").select("snapshot_id", normal_path(F.col("path")).alias("path"), F.lower("content_hash").alias("content_hash"), "modified_time", "size", "ingested_at")
    vals = ["content_hash", "modified_time", "size"]
    d = diff(latest_rows(f, ["snapshot_id", "path"], vals, "ingested_at"), snapshots, ["path"], vals, **kw)
    kind = F.when(F.col("change") == "removed", "deleted").when(F.col("change") == "changed", "modified").otherwise(F.col("change"))
    return d.select("snapshot_id", F.lit("file").alias("entity"), "path", F.lit("").alias("name"), kind.alias("change_type"))


def symbol_changes(symbol_snapshot: DataFrame, snapshots: DataFrame, **kw) -> DataFrame:
    """The same of functions and classes, identified by path, symbol_type and name; other lines alone are no change."""
    s = symbol_snapshot.where("file_path IS NOT NULL").select("snapshot_id", normal_path(F.col("file_path")).alias("path"), "symbol_type", "name", "signature", F.lower("body_hash").alias("body_hash"), "ingested_at")
    keys, vals = ["path", "symbol_type", "name"], ["signature", "body_hash"]
    d = diff(latest_rows(s, ["snapshot_id", *keys], vals, "ingested_at"), snapshots, keys, vals, **kw)
    kind = (
        F.when(F.col("change") == "added", F.concat("symbol_type", F.lit("_added")))
        .when(F.col("change") == "removed", F.concat("symbol_type", F.lit("_removed")))
        .when(~F.col("old.signature").eqNullSafe(F.col("new.signature")), F.lit("signature_changed"))
        .otherwise(F.concat("symbol_type", F.lit("_modified")))
    )
    return d.select("snapshot_id", F.col("symbol_type").alias("entity"), "path", "name", kind.alias("change_type"))
