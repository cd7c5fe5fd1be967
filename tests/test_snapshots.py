import random

from codeloom.operators import snapshots as s

SNAP = "snapshot_id STRING, repo STRING, taken_at TIMESTAMP"


def _snaps(spark, n, repos=("r", "q")):
    from datetime import datetime

    return spark.createDataFrame([(f"{r}{i}", r, datetime(2024, 1, 1 + i)) for r in repos for i in range(n)], SNAP)


def test_diff_like_model(spark):
    r = random.Random(3)
    recs, want = [], set()
    for repo in "rq":
        before = None
        for i in range(4):
            now = {f"p{k}": r.choice([None, "a", "b"]) for k in range(150) if r.random() < 0.7}
            recs += [(f"{repo}{i}", k, v) for k, v in now.items()]
            if before is not None:
                want |= {(f"{repo}{i}", k, "added") for k in now.keys() - before.keys()} | {(f"{repo}{i}", k, "removed") for k in before.keys() - now.keys()}
                want |= {(f"{repo}{i}", k, "changed") for k in now.keys() & before.keys() if now[k] != before[k]}
            before = now
    df = spark.createDataFrame(recs, "snapshot_id STRING, k STRING, v STRING")
    for blocks in (1, 7):
        got = s.diff(df, _snaps(spark, 4), ["k"], ["v"], blocks=blocks).collect()
        assert {(x.snapshot_id, x.k, x.change) for x in got} == want and len(got) == len(want)
    d = s.key_dictionary(df.where("k < 'p5'"), ["k"], 3)
    d2 = s.key_dictionary(df, ["k"], 3, d)
    assert {tuple(x) for x in d.collect()} <= {tuple(x) for x in d2.collect()}
    assert d2.select("block", "ordinal").distinct().count() == d2.count() == df.select("k").distinct().count()
    got = s.diff(df, _snaps(spark, 4), ["k"], ["v"], dictionary=d2).collect()
    assert {(x.snapshot_id, x.k, x.change) for x in got} == want


def test_files_normalised_latest_and_null(spark, rows):
    f = spark.createDataFrame(
        [("r0", "x", "./a\\b.c", None, "AB", 1, "2024-01-01", 9), ("r0", "x", "a/b.c", None, "cd", 1, "2024-01-02", 9), ("r1", None, "a/b.c", None, "CD", 1, "2024-01-01", 9), ("r1", "x", "n.c", None, None, None, None, 9), ("zz", "x", "n.c", None, None, None, None, 9), ("r1", "x", None, None, None, None, None, 9)],
        "snapshot_id STRING, repo STRING, path STRING, modified_time TIMESTAMP, content_hash STRING, size BIGINT, ingested_at STRING, word INT",
    )
    assert rows(s.file_changes(f, _snaps(spark, 2))) == [("r1", "file", "n.c", "", "added")]


def test_empty_tables_and_removal_of_all(spark, rows):
    ddl = "snapshot_id STRING, k STRING, v STRING"
    assert s.diff(spark.createDataFrame([], ddl), _snaps(spark, 2), ["k"], ["v"]).count() == 0
    got = s.diff(spark.createDataFrame([("r0", "a", None), ("r0", None, None)], ddl), _snaps(spark, 2), ["k"], ["v"])
    assert rows(got.select("snapshot_id", "k", "change")) == [("r1", "a", "removed"), ("r1", None, "removed")]


def test_kept_ordinals(spark, rows, tmp_path):
    snaps = spark.createDataFrame([("s1", "r", 1), ("s2", "r", 2), ("s3", "r", 3), ("t1", None, 1), ("t2", None, 2)], "snapshot_id STRING, repo STRING, taken_at INT")
    data = [("s1", "b", 1), ("s1", "d", 1), ("s1", None, 1), ("s2", "b", 2), ("s2", "d", 1), ("s2", None, 1), ("t1", "b", 1), ("t2", "c", 1)]
    new = [*data, ("s3", "a", 1), ("s3", "d", 1), ("s3", None, 5)]
    ddl = "snapshot_id STRING, path STRING, v INT"
    store = s.KeyStore(spark, f"file://{tmp_path}/keys", blocks=3)
    for part in (data, new):
        df = spark.createDataFrame(part, ddl)
        with_store = s.diff(df, snaps, ["path"], ["v"], store=store).select("snapshot_id", "path", "change")
        assert rows(with_store) == rows(s.diff(df, snaps, ["path"], ["v"]).select("snapshot_id", "path", "change"))
        kept = {(r._repo, r.path): (r.block, r.ordinal) for r in store.load().collect()}
        if part is data:
            first = kept
    assert len(kept) == len(set(kept.values())) == 6 and all(kept[k] == v for k, v in first.items())
