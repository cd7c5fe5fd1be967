import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import code
from codeloom.operators import edits, extract, graph, impact, stats, store, tree


def test_lines_and_kinds(spark):
    cases = {"": 0, "a": 1, "a\n": 1, "a\r\nb": 2, "\n": 1, "\n\n": 2, "a\r\n\r\n": 2, " x\n// c\n\n": 3}
    df = spark.createDataFrame([(t,) for t in cases], "t STRING")
    assert {r.t: r.n for r in df.select("t", F.size(code.lines(F.col("t"))).alias("n")).collect()} == cases
    k = spark.createDataFrame([("  ",), ("// x",), (" * y",), ("# z",), ("q",)], "l STRING").select(code.line_kind(F.col("l"), F.lit("c")).alias("c"), code.line_kind(F.col("l"), F.lit("python")).alias("p")).collect()
    assert [tuple(r) for r in k] == [("empty", "empty"), ("comment", "code"), ("comment", "code"), ("code", "comment"), ("code", "code")]


def test_depths(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("{}ab\n ") for _ in range(r.randint(0, 60))) for _ in range(100)] + [""]
    for row in spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", code.brace_depth(F.col("t")).alias("d")).collect():
        d = m = 0
        for c in row.t:
            d = d + 1 if c == "{" else max(0, d - 1) if c == "}" else d
            m = max(m, d)
        assert row.d == m


def test_paths(spark):
    p = {"a/./b/../c": "a/c", "../x": "x", "/a//b/": "/a/b", "a/../../b": "b"}
    assert {r[0]: r[1] for r in spark.createDataFrame([(x,) for x in p], "p STRING").select("p", code.normal_path(F.col("p"))).collect()} == p
    t = spark.createDataFrame([("a.test.js",), ("spec/x.py",), ("contest.js",), ("tests/y.rs",), ("src/a.C",), ("distribution.js",), ("Makefile",), (None,)], "path STRING")
    q = F.col("path")
    got = [tuple(r) for r in t.select(code.is_test(q), code.language(q), code.excluded(q), code.is_watched(q)).collect()]
    assert [g[0] for g in got] == [True, True, True, True, False, False, False, None]
    assert [g[1] for g in got] == ["javascript", "python", "javascript", "rust", "c", "javascript", "unknown", None]
    assert got[5][2] and got[6][3]


@pytest.mark.parametrize("change,breaking,refs,level", [("function_removed", False, 1, "high"), ("x", True, 0, "high"), ("x", False, 11, "high"), ("x", False, 4, "medium"), ("signature_changed", False, 0, "medium"), ("x", False, 3, "low"), ("function_removed", False, 0, "low")])
def test_risk(spark, change, breaking, refs, level):
    assert spark.range(1).select(code.risk(F.lit(change), F.lit(breaking), F.lit(refs))).first()[0] == level


def _src(spark, files):
    df = spark.createDataFrame([("r", p, bytearray(t.encode()) if t is not None else None) for p, t in files.items()], "repo STRING, path STRING, content BINARY")
    return extract.source_text(df)


def test_extraction(spark, rows):
    s = _src(spark, {"a.py": "import os\nfrom b import c\nclass K(Base, X):\n    async def m(self):\n        return c(os.path())\nf = lambda: 1\n", "b.js": "import x from './c';\nexport function go(a) { run(a); }\nclass Z extends Y {\n  m(a) {\n  }\n}\nconst h = (q) => 1;\n", "e.go": "", "n.py": None})
    assert rows(extract.functions(s).select("path", "kind", "name")) == [("a.py", "function", "m"), ("a.py", "lambda", "f"), ("b.js", "arrow", "h"), ("b.js", "export", "go"), ("b.js", "method", "m")]
    assert rows(extract.classes(s).select("path", "name", "parent")) == [("a.py", "K", "Base"), ("b.js", "Z", "Y")]
    assert rows(extract.imports(s).select("path", "module")) == [("a.py", "b"), ("a.py", "os"), ("b.js", "./c")]
    assert ("a.py", "os", "path", True) in rows(extract.calls(s).select("path", "object", "function", "is_method"))
    assert stats.summary(extract.text_metrics(s)).first().files == 3
    assert stats.summary(extract.text_metrics(s.limit(0))).first().max_complexity == 0


def test_edges_and_cycles(spark, rows):
    s = _src(spark, {"src/a.js": "import b from './b';", "src/b.js": "const a = require('./a');", "src/c.ts": "import d from '../lib';", "lib/index.js": "", "p/m.py": "import p.n\n", "p/n.py": "from m import x\n", "q.c": '#include "h.h"\n#include <stdio.h>\n', "h.h": '#include "h.h"\n', "l.rs": "use crate::net::Conn;\n", "src/net.rs": ""})
    e = graph.edges(extract.imports(s), s)
    assert {(r.src, r.dst) for r in e.collect()} >= {("src/a.js", "src/b.js"), ("src/b.js", "src/a.js"), ("src/c.ts", "lib/index.js"), ("p/m.py", "p/n.py"), ("p/n.py", "p/m.py"), ("q.c", "h.h"), ("h.h", "h.h"), ("l.rs", "src/net.rs")}
    assert rows(graph.cycles(e)) == [("r", "h.h", "h.h"), ("r", "p/m.py", "p/m.py"), ("r", "p/m.py", "p/n.py"), ("r", "src/a.js", "src/a.js"), ("r", "src/a.js", "src/b.js")]


def test_cycles_like_model(spark):
    r = random.Random(5)
    pairs = {(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(60)}
    reach = {}
    for a in {x for p in pairs for x in p}:
        todo, seen = [a], set()
        while todo:
            x = todo.pop()
            for u, v in pairs:
                if u == x and v not in seen:
                    seen.add(v)
                    todo.append(v)
        reach[a] = seen
    want = {(min(b for b in reach if b in reach[a] and a in reach[b]), a) for a in reach if a in reach[a]}
    e = spark.createDataFrame([("r", a, b) for a, b in pairs], "repo STRING, src STRING, dst STRING")
    assert {(x.component, x.path) for x in graph.cycles(e).collect()} == want
    got = graph.reachable(e).collect()
    assert {(x.start, x.node) for x in got} == {(a, b) for a in reach for b in reach[a]} and len(got) == len({(x.start, x.node) for x in got})


def test_impact(spark, rows):
    a = spark.createDataFrame([("f", "f(a)"), ("g", "g()"), ("same", "s()"), (None, "x")], "name STRING, signature STRING")
    b = spark.createDataFrame([("g", "g(b)"), ("h", "h()"), ("same", "s()")], "name STRING, signature STRING")
    uses = spark.createDataFrame([("f", 2), ("h", 5)], "name STRING, uses BIGINT")
    d = impact.symbol_diff(a, b, ["name"], "signature", uses)
    assert rows(impact.with_risk(d).select("name", "change_type", "breaking", "risk_level")) == [("f", "function_removed", True, "high"), ("g", "signature_changed", False, "medium"), ("h", "function_added", False, "medium")]
    assert impact.at_least(impact.with_risk(d), "high").count() == 1
    assert impact.symbol_diff(a.limit(0), b.limit(0), ["name"], "signature").count() == 0


def test_upsert_and_changes(spark, rows):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path STRING, v STRING")
    new = spark.createDataFrame([("a", "2"), ("c", "1"), ("d", "1")], "path STRING, v STRING")
    snap = lambda d: d.select("path", F.col("v").alias("content_hash"), F.lit(None).cast("timestamp").alias("modified_time"), F.lit(1).alias("size"))
    ch = store.snapshot_changes(snap(old), snap(new))
    assert rows(ch.select("path", "change_type", "content_changed")) == [("a", "modified", True), ("b", "deleted", True), ("d", "added", True)]
    assert rows(store.upsert(old, new, ch, ["path"])) == [("a", "2"), ("c", "1"), ("d", "1")]
    assert store.update_report(ch.limit(0)).first().status == "no_changes"
    assert stats.speedup(30000, 1000) == 30 and stats.speedup(1, 0) == 1


def test_session_refresh(spark, rows, tmp_path):
    st = store.SessionStore(spark, str(tmp_path))
    snap = lambda *p: spark.createDataFrame([(x, None, h, 1) for x, h in p], "path STRING, modified_time TIMESTAMP, content_hash STRING, size BIGINT")
    st.save("s1", "file_snapshot", snap(("a", "1"), ("b", "1")))
    st.save("s2", "file_snapshot", snap(("z", "1")))
    st.save("s1", "files", spark.createDataFrame([("a", 1), ("b", 1)], "path STRING, n INT"))
    ch = st.refresh("s1", snap(("a", "2"), ("c", "1")), lambda p: p.withColumn("n", F.lit(7)))
    assert ch.count() == 3
    assert rows(st.load("files", "s1").select("path", "n")) == [("a", 7), ("c", 7)]
    assert st.load("file_snapshot", "s2").count() == 1


def test_edits(spark):
    t = "one\ntwo\nthree\n"
    e = lambda c: spark.createDataFrame([(t,)], "t STRING").select(c).first()[0]
    c = F.col("t")
    assert e(edits.replace(c, "o", "0")) == "0ne\ntw0\nthree\n"
    assert e(edits.replace(c, "ONE", "$1", ignore_case=True, whole_word=True)) == "$1\ntwo\nthree\n"
    assert e(edits.replace(c, "t(w|h)", "T$1", regex=True)) == "one\nTwo\nThree\n"
    assert e(edits.insert(c, 2, "x")) == "one\nx\ntwo\nthree" and e(edits.insert(c, 0, "x")) == e(edits.insert(c, 9, "x")) == "one\ntwo\nthree\nx"
    assert e(edits.insert_beside(c, "two", "x", False)) == "one\nx\ntwo\nthree" and e(edits.insert_beside(c, "zz", "x")) == t
    assert e(edits.without(c, 2, 9)) == "one"
    s, g = edits.move_lines(c, 2, 9, F.lit("a\nb"), 2)
    assert (e(s), e(g)) == ("one", "a\ntwo\nthree\nb")
    with pytest.raises(Exception):
        e(edits.move_lines(c, 9, 1, F.lit("a"), 1)[0])
    with pytest.raises(ValueError):
        edits.taken(c, 0, 1)
    assert spark.createDataFrame([("aaa",)], "t STRING").select(edits.count(c, "aa")).first()[0] == 1
    p = spark.createDataFrame([("x", False)], "id STRING, confirmed BOOLEAN")
    done = edits.confirm(p, "x")
    with pytest.raises(ValueError):
        edits.confirm(done, "x")


def test_tree(spark, rows):
    n = spark.createDataFrame([(1, 0, -1, "namespace", "N", 1, 9), (1, 1, 0, "class", "A", 2, 8), (1, 2, 1, "method", "B", 3, 4), (1, 3, 1, "block", None, 5, 6), (1, 4, 3, "method", "B", 5, 5)], "record_id INT, node_no INT, parent_no INT, node_type STRING, name STRING, start_line INT, end_line INT")
    t = tree.with_scope(n)
    assert rows(t.select("node_no", "depth", "scope_path")) == [(0, 0, "N"), (1, 1, "N::A"), (2, 2, "N::A::B"), (3, 2, "N::A"), (4, 3, "N::A::B")]
    assert [r.node_no for r in tree.query(t, "A::B").collect()] == [2] and tree.query(t, "").count() == 0 and tree.query(t, "*").count() == 5
    assert rows(tree.scope_at(t, spark.createDataFrame([(1, 5), (1, 99)], "record_id INT, line INT")).select("line", "node_no")) == [(5, 4)]
    assert tree.categories(t).first().methods == 2
    assert tree.children_of_type(t, "class", "method").count() == 1
    assert sorted(r.line for r in tree.dump(t).collect())[0] == "      method B"
