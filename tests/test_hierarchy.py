import random

import pytest

from codeloom.operators import hierarchy as h

DDL = "id STRING, parent STRING, name STRING"


def model(pairs):
    """Walks each chain up: id → (root, depth)."""
    up = {i: (p if p in dict(pairs) else None) for i, p in pairs}
    out = {}
    for i in up:
        seen, x = [], i
        while x is not None and x not in seen:
            seen.append(x)
            x = up[x]
        if x is None:
            out[i] = (seen[-1], len(seen) - 1)
        else:
            loop = seen[seen.index(x) :]
            out[i] = (min(loop), -1 if i in loop else -2)
    return out


@pytest.mark.parametrize("seed,n,shape", [(1, 60, "any"), (2, 200, "any"), (3, 120, "chain"), (4, 150, "wide"), (5, 40, "loops")])
def test_forest_like_model(spark, seed, n, shape):
    r = random.Random(seed)
    ids = [f"s{i}" for i in range(n)]
    r.shuffle(ids)
    parent = {
        "any": lambda k: r.choice([None, "gone", *ids]),
        "chain": lambda k: ids[k - 1] if k else None,
        "wide": lambda k: ids[0] if 0 < k < n * 0.8 else (ids[k - 1] if k else None),
        "loops": lambda k: ids[(k + r.choice([1, 2])) % n],
    }[shape]
    pairs = [(i, parent(k)) for k, i in enumerate(ids)]
    got = h.euler_forest(spark.createDataFrame([(i, p, i) for i, p in pairs], DDL)).collect()
    assert {x.id: (x.root_id, x.depth) for x in got} == model(pairs)
    at = {x.id: x for x in got if x.depth >= 0}
    up = {i: p for i, p in pairs}
    for x in at.values():  # intervals nest exactly along the parent links
        below = {y.id for y in at.values() if y.root_id == x.root_id and x.entry < y.entry and y.exit < x.exit}
        assert len(below) == x.descendants
        for y in below:
            z = y
            while z != x.id:
                z = up[z]
    assert len({(x.root_id, x.entry) for x in at.values()}) == len(at)


def test_links_clean_and_latest(spark, rows):
    t = spark.createDataFrame([(" A ", "x", "2024-01-01", 1), ("a", " B", "2024-01-02", 2), ("a", "b ", "2024-01-02", 3), ("b", "  ", None, 4), (None, "a", "2024-01-01", 5), (" ", "a", "2024-01-01", 6)], "id STRING, parent_id STRING, indexed_at STRING, parent INT")
    assert rows(h.latest_links(t).select("id", "parent")) == [("a", "b"), ("b", None)]


def test_paths_and_descendants(spark, rows):
    f = h.euler_forest(spark.createDataFrame([("a", None, "A"), ("b", "a", ""), ("c", "b", "C"), ("x", "x", "X"), ("y", "x", "Y")], DDL))
    p = h.full_paths(f)
    assert rows(p.select("id", "path")) == [("a", "A"), ("b", "A/b"), ("c", "A/b/C")]
    assert rows(h.descendants(p)) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def test_empty(spark):
    e = spark.createDataFrame([], DDL)
    assert h.euler_forest(e).count() == 0 and h.full_paths(h.euler_forest(e)).count() == 0


@pytest.mark.parametrize("small", [70, 120])
def test_contracted_tours(spark, small):
    r = random.Random(small)
    ids = [f"s{i}" for i in range(150)]
    pairs = [(i, r.choice([None, ids[max(0, k - 1)], ids[(k + 1) % 150], ids[k // 2]]) if k else None) for k, i in enumerate(ids)]
    forest = h.euler_forest(spark.createDataFrame([(i, p, i) for i, p in pairs], DDL), small=small)
    want = model(pairs)
    assert {x.id: (x.root_id, x.depth) for x in forest.collect()} == want
    up, above = dict(pairs), {}
    for i, (_, depth) in want.items():
        if depth >= 0:
            chain = [i]
            while len(chain) <= depth:
                chain.append(up[chain[-1]])
            above[i] = chain[::-1]
    for chunk in (2, 64):
        assert {x.id: (x.path, x.ids) for x in h.full_paths(forest, chunk=chunk).collect()} == {i: ("/".join(c), c) for i, c in above.items()}
        got = {(x.ancestor, x.id): x.distance for x in h.descendants(forest, chunk=chunk).collect()}
        assert got == {(a, i): len(c) - 1 - k for i, c in above.items() for k, a in enumerate(c[:-1])}


@pytest.mark.parametrize("blocks,small,shape", [(1, 10, "mixed"), (5, 10, "mixed"), (7, 1, "circle"), (3, 1 << 18, "mixed")])
def test_blocks(spark, blocks, small, shape):
    r = random.Random(blocks)
    ids = [f"s{i}" for i in range(300)]
    up = lambda k: r.choice([None, "gone", ids[k - 1], ids[k - 1], ids[k // 3], ids[7], ids[7], ids[(k + 1) % 300], ids[k]]) if shape == "mixed" else ids[(k + 1) % 200]
    pairs = [(i, up(k)) for k, i in enumerate(ids)]
    got = h.euler_forest(spark.createDataFrame([(i, p, i.upper()) for i, p in pairs], DDL), small=small, blocks=blocks).collect()
    want = model(pairs)
    assert sorted(x.id for x in got) == sorted(ids)
    assert {x.id: (x.root_id, x.depth) for x in got} == want
    known = set(ids)
    assert {x.id: (x.parent, x.name, x.on_loop) for x in got} == {i: (p if p in known else None, i.upper(), want[i][1] == -1) for i, p in pairs}
    at, up = {x.id: x for x in got if x.depth >= 0}, dict(pairs)
    assert all(x.entry is None and x.exit is None and x.descendants is None for x in got if x.depth < 0)
    for x in at.values():  # visits of a tree are numbered without gaps, and intervals nest along the parent links
        if x.depth:
            y = at[up[x.id]]
            assert y.entry < x.entry < x.exit < y.exit
        below = [y for y in at.values() if y.root_id == x.root_id and x.entry < y.entry and y.exit < x.exit]
        assert len(below) == x.descendants and all(y.depth > x.depth for y in below)
    visits = [(x.root_id, v) for x in at.values() for v in (x.entry, x.exit)]
    assert len(set(visits)) == len(visits) and all(v < 2 * (1 + at[root].descendants) for root, v in visits)


def test_rows_are_not_joined(spark):
    f = h.euler_forest(spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C")], DDL))
    assert "Join" not in f._jdf.queryExecution().optimizedPlan().toString()


def test_ids_are_trimmed_whatever_surrounds_them(spark):
    from pyspark.sql import functions as F
    from codeloom.functions.text import canonical_id, trim_white

    ids = ["A", " A", "A\t", "\u00a0A", "A\u3000", "\u00c9 ", "~a!", "a b", "", " ", "\x7fa", "\u00e9", None, "\u2003a b\u2003"]
    d = spark.createDataFrame([(i,) for i in ids], "id STRING")
    t = F.lower(trim_white(F.col("id")))
    got = d.select(canonical_id(F.col("id")).alias("a"), F.when(F.length(t) > 0, t).alias("b")).collect()
    assert [x.a for x in got] == [x.b for x in got] and got[3].a == "a" and got[8].a is None
