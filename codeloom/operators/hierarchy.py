"""Forests and loops from parent links: Euler tours ranked in parallel.

Nodes are cut into blocks by a hash of their ids, and all steps but the last are numpy over one block at a time
(``operators/tours.py``); blocks send each other packed numbers (``operators/blocks.py``), so shuffles hold one row for a
pair of blocks and not one for a node. Ids are sent only to find parents by them, and at the end.

Leaves are peeled first; they never enter a tour and get their place from their parent at the end. Every other node v
has two tour elements, 2v (entered) and 2v+1 (left). The successor of each element depends only on the first child, the
next sibling and the parent, so the successors are a permutation of the elements: an element gets one message at most
from either side, whatever the shape of the trees. A parent, a root or a loop hears from a block of its children or
nodes once and not from each, so a node with a third of all rows below it is no hot key.

List ranking contracts the tours: in each round a third of the elements, no two of them neighbours, is spliced out, and
told its sums in reverse order once the rest is ranked. So all rounds together move a few times the elements, not their
number times the logarithm of the longest tour. Distances to the tour's end give entry and exit numbers, the number of
open nodes gives the depth, and the end itself the root. Elements without an end belong to components with a loop. There
the tour closes into two circles, one around the loop and one inside it: a node is on the loop if and only if its two
elements lie on different circles. No walk along the loop is needed and peeling one layer is enough; peeling trees layer
by layer would take as many rounds as they are deep.

Ancestors, paths and descendants come from the intervals of entry and exit. A tree's visits are cut into chunks of equal
size; a node is noted in each chunk its interval meets, and all ancestors of a node are noted in the chunk it is entered in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions.text import canonical_id
from codeloom.operators import tours
from codeloom.operators.blocks import SENT, grouped, inbox, sent, step, together
from codeloom.session import Stage

#: Nodes in one block, about. Below SPREAD blocks they are smaller, down to LEAST nodes, so that all cores have some.
BLOCK, SPREAD, LEAST = 1 << 18, 12, 1 << 15
#: Contraction ends with so many elements at most, which one task ranks: five numbers each.
SMALL = 1 << 18
#: Visits of a tree in one chunk of its intervals.
CHUNK = 64


def latest_links(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id", time_col: str = "indexed_at", name_col: str | None = None) -> DataFrame:
    """One row (id, parent, name) per canonical id, from the row with the latest time.

    Ids and parents are trimmed and lower-cased. Rows with a null or blank id are no nodes. A null time is older than any
    other; among equal times the greatest (parent, name) counts, a null parent being smaller than any other.
    """
    name = [F.col(name_col).cast("string").alias("name")] if name_col else []
    v = F.struct(F.col(time_col).alias("t"), canonical_id(F.col(parent_col)).alias("parent"), *name)
    return (
        rows.select(canonical_id(F.col(id_col)).alias("id"), v.alias("v"))
        .where("id IS NOT NULL")
        .groupBy(F.xxhash64("id"), "id")  # sorted by a number first: ids with one prefix are slow to compare
        .agg(F.max("v").alias("v"))
        .select("id", "v.parent", (F.col("v.name") if name_col else F.lit(None).cast("string")).alias("name"))
    )


def euler_forest(links: DataFrame, small: int = SMALL, at_most: int | None = None, blocks: int | None = None) -> DataFrame:
    """links (id, parent, name) with distinct ids → (id, parent, name, root_id, depth, entry, exit, descendants, on_loop).

    * A node whose parent is null or not among the ids is a root: depth 0, root_id itself.
    * entry and exit number the visits of each tree from 0; ``a.entry < b.entry AND b.exit < a.exit`` within one root_id
      says that a is an ancestor of b. descendants = (exit - entry - 1) / 2.
    * On a loop depth is -1, on a chain that runs into one -2; root_id is the smallest id on that loop, and entry, exit
      and descendants are null. A node that is its own parent is a loop of one.
    * No rows give no rows.

    at_most: no fewer than the rows of links, where that is known; it saves writing and counting them. The number of
    blocks follows from it, unless given; the result is the same for any.
    """
    st = Stage(links.sparkSession, "forest", tidy=True)
    links = links.select("id", "parent", "name")
    if blocks is None and at_most is None:
        links = st.put(links)
        at_most = links.count()
    n = blocks or max(1, -(-at_most // BLOCK), min(SPREAD, -(-at_most // LEAST)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    numbered = grouped(links.select("id", "parent", "name", block("id").alias("dst"), F.when(F.col("parent").isNotNull(), block("parent")).alias("up")), n)
    nodes = st.put(numbered.applyInArrow(lambda t: sent(tours.number(t.column("dst")[0].as_py(), t)), SENT), by="kind")
    of = lambda t, *kinds: t.where(F.col("kind").isin(*kinds))
    d = step(tours.resolve, n, nodes)
    for f in (tours.siblings, tours.link, tours.tour):
        d = step(f, n, d)
    start = st.put(d, by="kind")
    st.drop_part(nodes, "kind=ask")

    rounds, moving = [start], ("cur", "after", "ahead", "lone")
    left = lambda t: of(t, "cur").agg(F.sum("n")).first()[0] or 0
    while left(rounds[-1]) > small:
        rounds.append(st.put(step(tours.contract(len(rounds) - 1), n, of(rounds[-1], *moving)), by="kind"))
        for kind in moving:
            st.drop_part(rounds[-2], f"kind={kind}")
    ended = st.put(step(tours.gather, n, of(rounds[-1], *moving)), by="kind")
    sums = step(tours.last, n, of(ended, "last"))  # at most small elements, whatever the input's size
    ranked, owes = step(tours.begin, n, of(start, "nodes"), of(ended, "lone"), sums), ended
    for t in reversed(rounds[1:]):
        due = [] if owes is ended else [of(owes, "gone")]
        new = st.put(step(tours.restore, n, ranked, *due, of(owes, "owes")))
        st.drop(ranked, owes)
        ranked, owes = new, t
    names = of(nodes, "names")
    asked = step(tours.ask, n, ranked, names, *([of(owes, "gone")] if len(rounds) > 1 else []))
    placed = st.put(step(tours.place, n, step(tours.answer, n, asked, names), of(start, "spread")))
    st.drop(ranked, owes)
    st.drop_part(start, "kind=spread")
    rows = "id STRING, parent STRING, name STRING, root_id STRING, depth INT, entry BIGINT, exit BIGINT"
    all_ = together(n, placed, names, of(start, "nodes")).applyInArrow(lambda t: tours.rows(inbox(t)), rows)
    return all_.withColumns({"descendants": ((F.col("exit") - F.col("entry") - 1) / 2).cast("long"), "on_loop": F.col("depth") == -1})


def _chunked(forest: DataFrame, chunk: int, *more: Column) -> DataFrame:
    """Each node of a tree once for each chunk of visits that its interval meets; own marks the chunk in which it is entered.

    That is one row a node and 2 / chunk of a row for each pair of a node and one below it.
    """
    at = lambda c: F.floor(F.col(c) / chunk).cast("long")
    d = forest.where("depth >= 0").select("id", *more, "root_id", "depth", "entry", "exit", F.explode(F.sequence(at("entry"), at("exit"))).alias("chunk"))
    return d.withColumn("own", at("entry") == F.col("chunk"))


def descendants(forest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(ancestor, id, distance) for every pair of a node and one above it, from the output of ``euler_forest`` or ``full_paths``: an interval join within the chunk of the lower node's entry. Nodes on or below loops have none."""
    d = _chunked(forest, chunk)
    up = d.select("root_id", "chunk", F.col("id").alias("ancestor"), F.col("depth").alias("_depth"), F.col("entry").alias("_entry"), F.col("exit").alias("_exit"))
    pairs = d.where("own").join(up, ["root_id", "chunk"]).where("_entry < entry AND exit < _exit")
    return pairs.select("ancestor", "id", (F.col("depth") - F.col("_depth")).cast("int").alias("distance"))


def full_paths(forest: DataFrame, sep: str = "/", chunk: int = CHUNK) -> DataFrame:
    """(id, path, ids, root_id, depth, entry, exit): names from the root down, joined by sep, and the ids of the ancestors and the node itself, from the output of ``euler_forest``.

    A chunk's nodes are gathered once, in order of entry; the path of a node entered there is what of them encloses its
    interval. Nodes on or below loops have no path and are left out. An empty or null name shows the id. A row is as wide as
    its path is long.
    """
    name = F.when(F.length(F.coalesce("name", F.lit(""))) > 0, F.col("name")).otherwise(F.col("id"))
    d = _chunked(forest, chunk, name.alias("name"))
    g = d.groupBy("root_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("entry", "exit", "id", "name", "own", "depth"))).alias("all"))
    v = g.select("root_id", "all", F.explode(F.filter("all", lambda x: x["own"])).alias("v"))
    above = F.filter("all", lambda u: (u["entry"] <= F.col("v.entry")) & (u["exit"] >= F.col("v.exit")))
    v = v.select("root_id", "v.id", "v.depth", "v.entry", "v.exit", above.alias("up"))
    return v.select("id", F.array_join(F.transform("up", lambda u: u["name"]), sep).alias("path"), F.transform("up", lambda u: u["id"]).alias("ids"), "root_id", "depth", "entry", "exit")
