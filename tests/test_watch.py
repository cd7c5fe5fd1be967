from datetime import datetime, timedelta

from codeloom.streaming import watch

T0 = datetime(2024, 1, 1)
EVENTS = [(0, "create", "a.py"), (100, "modify", "a.py"), (300, "modify", "b.py"), (900, "modify", "a.py"), (1400, "modify", "Makefile"), (3000, "modify", "node_modules/x.js"), (5000, "rename", "a.py"), (9000, "remove", "c.rs"), (9000, None, "c.rs"), (9000, "modify", None)]
DDL = "ts TIMESTAMP, kind STRING, path STRING, session_id STRING"


def _rows():
    return [(T0 + timedelta(milliseconds=m), k, p, "s") for m, k, p in EVENTS]


def test_batch(spark):
    got = watch.debounce(watch.relevant(spark.createDataFrame(_rows(), DDL))).orderBy("first").collect()
    # an event exactly a gap after the last joins its burst
    assert [(r.first, r.events) for r in got] == [(T0, 3), (T0 + timedelta(milliseconds=900), 2), (T0 + timedelta(milliseconds=9000), 1)]


def test_stream_like_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame(_rows() + [(T0 + timedelta(hours=1), "modify", "z.py", "s")], DDL).coalesce(1).write.parquet(src)
    stream = watch.debounce(watch.relevant(spark.readStream.schema(DDL).parquet(src)))
    out = []
    q = watch.start(stream, lambda df, i: out.extend(df.collect()), "bursts", str(tmp_path / "cp"))
    q.processAllAvailable()
    assert any(s["name"] == "bursts" for s in watch.status(spark))
    assert watch.stop(spark, "bursts") == 1
    batch = watch.debounce(watch.relevant(spark.createDataFrame(_rows(), DDL))).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, batch))
