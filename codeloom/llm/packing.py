"""Filling containers of fixed capacity with documents.

Planning sees only how many items there are of each length, never the items: lengths in descending order are put where the
least room remains (best fit), all items of a length and all containers of equal room at once. The plan is a list of slots
(length, ranks from-to, items per container, first container); an item finds its slot by its rank within its length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window as W, functions as F

from codeloom.session import Stage

#: Ranks within a length are numbered in this many parts, so that a length with a third of all items is no hot group.
PARTS = 1024


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """{length: items}, lengths from 1 to capacity → slots (length, first rank, end rank, items per container, first container) and the number of containers."""
    rooms: list[tuple[int, int, int]] = []  # (room, first container, containers), sorted
    slots: list[tuple[int, int, int, int, int]] = []
    used = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(rooms, (length, -1, -1))
            if i < len(rooms):
                room, first, n = rooms.pop(i)
            else:
                room, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            each = min(room // length, left)
            take = min(n, left // each)
            slots.append((length, rank, rank + take * each, each, first))
            left -= take * each
            rank += take * each
            if room > each * length:
                insort(rooms, (room - each * length, first, take))
            if n > take:
                insort(rooms, (room, first + take, n - take))
    return slots, used


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Numbers rows from 0 within keys; in parts by hash of the order columns, so that no key is sorted in one task."""
    d = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)).cast("int"))
    sizes = d.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(*keys).orderBy("_part")) - F.col("_n")).drop("_n")
    inside = d.withColumn("_in", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    return inside.join(before, [*keys, "_part"]).withColumn(out, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def pack(sizes: DataFrame, capacities: dict[int, int], id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """sizes (id, size) → (spec_id, capacity, doc_id, piece, start, tokens, container).

    A text longer than the capacity is cut into pieces that fill a container each and a rest; no other is cut. piece counts
    from 0, start is its first token. container is ``f`` and a number for full pieces, ``m`` and a number for planned ones.
    Texts of size 0 or null need no room and have no row; equal ids are items of their own. The same rows give the same
    containers, whatever their order.
    """
    spark = sizes.sparkSession
    for c in capacities.values():
        if c < 1:
            raise ValueError("capacities must be positive")
    st = Stage(spark, "pack")
    base = st.put(sizes.where(F.col(size_col) > 0).select(F.col(id_col).alias("doc_id"), F.col(size_col).cast("bigint").alias("n")))
    specs = F.explode(F.array(*[F.struct(F.lit(s).alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for s, c in capacities.items()]))
    cut = base.select("doc_id", "n", specs.alias("s")).select("doc_id", "n", "s.*")
    whole = F.floor(F.col("n") / F.col("capacity"))
    items = cut.withColumn("length", F.col("n") % F.col("capacity")).where("length > 0")
    # At most one row for each length below each capacity comes to the driver.
    counted: dict[int, dict[int, int]] = {}
    for s, length, n in items.groupBy("spec_id", "length").count().collect():
        counted.setdefault(s, {})[length] = n
    rows = [(s, *slot) for s, h in counted.items() for slot in plan(h, capacities[s])[0]]
    slots = spark.createDataFrame(rows, "spec_id INT, length BIGINT, lo BIGINT, hi BIGINT, each BIGINT, first BIGINT")
    if len(rows) < 200_000:
        slots = F.broadcast(slots)
    at = ranked(items, ["spec_id", "length"], ["doc_id"], "rank")
    s = slots.withColumnRenamed("spec_id", "_s").withColumnRenamed("length", "_l")
    placed = at.join(s, (F.col("spec_id") == F.col("_s")) & (F.col("length") == F.col("_l")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    rest = placed.select(
        "spec_id", "capacity", "doc_id", F.floor(F.col("n") / F.col("capacity")).cast("int").alias("piece"), (F.col("n") - F.col("length")).alias("start"), F.col("length").alias("tokens"),
        F.concat(F.lit("m"), (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).cast("string")).alias("container"),
    )
    long = ranked(cut.where("n >= capacity").withColumn("pieces", whole), ["spec_id", "pieces"], ["doc_id"], "nth")
    full = long.select("spec_id", "capacity", "doc_id", "pieces", "nth", F.posexplode(F.sequence(F.lit(1), F.col("pieces").cast("int"))).alias("piece", "_k")).select(
        "spec_id", "capacity", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("tokens"),
        F.concat(F.lit("f"), F.col("pieces").cast("string"), F.lit("."), F.col("nth").cast("string"), F.lit("."), F.col("piece").cast("string")).alias("container"),
    )
    return rest.unionByName(full)


def fill(packed: DataFrame) -> DataFrame:
    """(spec_id, capacity, containers, least_containers, tokens, fill): least_containers is what no packing can go below."""
    each = packed.groupBy("spec_id", "capacity", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"))
    r = each.groupBy("spec_id", "capacity").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.sum("k").alias("pieces"), F.max("t").alias("fullest"))
    return r.select("spec_id", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), "pieces", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))
