"""Registered queries against brute force over small tables of their own."""

import os

import pytest

import __spark_entry__ as entry


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables by name and returns their folder."""

    def write(**frames):
        for name, (rows, ddl) in frames.items():
            spark.createDataFrame(rows, ddl).write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
        return str(tmp_path)

    return write


def _files(texts):
    return [(i, "r", p, bytearray(t.encode())) for i, (p, t) in enumerate(texts.items())], "file_id BIGINT, repo STRING, path STRING, content BINARY"


def test_likely_changes_take_parameters(spark, rows, tables):
    texts = {
        "a.py": "def four(a, b, c, d):\n    pass\nthree = lambda a, b=(1, 2), c=[0, 1]: 0\n" + "".join(f"class K{i}:\n    def same():\n        pass\n" for i in range(4)),
        "b.rs": "fn two<F: Fn(i32, i32, i32, i32) -> i32>(f: F, x: i32) {}\n",
    }
    got = entry.queries()["likely_changes_by_parameters"](spark, tables(source_files=_files(texts)))
    # every head before a bracket counts as a call of its name
    want = [("a.py", "four", 4, 1, True, True), ("a.py", "three", 3, 0, True, False), *[("a.py", "same", 0, 4, True, True)] * 4, ("b.rs", "two", 2, 0, False, False)]
    assert rows(got.select("path", "name", "n_params", "uses", "likely", "breaking")) == sorted(want, key=str)


CHANGED = "name STRING, file_path STRING, symbol_type STRING, change_type STRING, breaking_change BOOLEAN"


def test_imported_names_are_references(spark, rows, tables):
    texts = {
        "a.py": "from cli import split_timer\nfrom .m import (one,  # two\n    three as four)\nfrom m import five, \\\n    six\nimport os.path as seven, eight\n",
        "b.js": "import nine, { ten as eleven, type Twelve } from './m'\nimport * as thirteen from './fourteen'\nconst { a15, b16: c17 } = require('./m')\nimport{d18}from'./m'\nimport type { E19 } from './m'\n",
    }
    yes = ["split_timer", "one", "three", "five", "six", "path", "eight", "nine", "ten", "Twelve", "fourteen", "a15", "b16", "d18", "E19"]
    no = ["two", "four", "seven", "eleven", "thirteen", "c17", "type", "as"]
    d = tables(source_files=_files(texts), changed_symbols=([(n, "x.py", "function", "function_removed", False) for n in yes + no], CHANGED))
    q = entry.queries()
    got = q["symbol_references_all"](spark, d).where("usage_type = 'import'")
    assert rows(got.select("name", "n")) == sorted([(n, 1) for n in yes], key=str)
    assert {r.name for r in q["risk_levels_all"](spark, d).where("risk_level = 'high'").collect()} == set(yes)
    assert {r.path for r in q["affected_files_all"](spark, d).collect()} == {"a.py", "b.js", "x.py"}
    assert q["impact_totals_all"](spark, d).first().references == len(yes) and q["top_references_all"](spark, d).count() == len(yes)


def test_calls_whose_full_name_contains_the_symbol(spark, rows, tables):
    texts = {"a.py": "split_timer(1)\npool.timers(2)\nx.y(split_timer(3))\ntimer()\ntimer.go()\nTimer()\n", "b.js": "aaaa(aa());\n"}
    names = ["timer", "l.t", "a", "aa", "x.y", "", "none", "x.y.z"]
    d = tables(source_files=_files(texts), changed_symbols=([(n, "x.py", "function", "function_added", False) for n in names], CHANGED))
    full = {"a.py": ["split_timer", "pool.timers", "x.y", "split_timer", "timer", "timer.go", "Timer"], "b.js": ["aaaa", "aa"]}
    want = [(n, f, k) for n in names if n for f, calls in full.items() if (k := sum(n in c for c in calls))]
    got = entry.queries()["symbol_references_all"](spark, d).where("usage_type = 'call'")
    assert rows(got.select("name", "file", "n")) == sorted(want, key=str)
    risk = {r.name: r.risk_level for r in entry.queries()["risk_levels_all"](spark, d).collect()}
    assert risk["timer"] == "medium" and risk["none"] == "low"


def test_complexity_counts_control_structures(spark, rows, tables):
    py = 'def f(a):\n    "if this"\n    if a:  # for\n        for x in [\n            y\n            for y in a\n            if y\n        ]:\n            pass\n    elif b if c else d:\n        try:\n            pass\n        except E:\n            pass\n    def g():\n        while 1:\n            pass\n    match a:\n        case 1: pass\n\nwhile 0:\n    match = 1\n'
    texts = {
        "a.py": py,
        "b.js": 'function f(x) {\n  // if (a) {\n  if (x) { x.for(1); } else if (y) { "while (1)"; }\n  for (;;) { switch (x) { } }\n  try { } catch (e) { }\n  do { } while (x);\n}\n',
        "c.rs": "impl A for B {\n    fn f(x: i32) {\n        for i in 0..3 { loop { match i { _ => {} } } }\n        if x > 1 { } else if x > 0 { }\n    }\n}\n",
        "d.cpp": "#if X\n#endif\nint f(int a) {\n  if (a) {\n  } else if (b) {\n  }\n  return 1;\n}\n",
        "e.go": "func F() {\n\tfor {\n\t}\n\tif a {\n\t}\n}\nfunc G() {\n}\n",
        "f.py": "".join(f"A{i} = {i}\n" for i in range(99)) + "def f(): pass\n",
        "g.py": "def f(a):\n" + "    if a: pass\n" * 25,
    }
    d = tables(source_files=_files(texts))
    got = rows(entry.queries()["function_complexity"](spark, d).select("path", "name", "score"))
    want = [("a.py", "f", 6), ("a.py", "g", 2), ("b.js", "f", 7), ("c.rs", "f", 6), ("d.cpp", "f", 3), ("e.go", "F", 3), ("e.go", "G", 1), ("f.py", "f", 1), ("g.py", "f", 26)]
    assert got == sorted(want, key=str)
    # 7 // 2, 6, 5, 2, 2 // 2, 0 and 25 structures a function
    assert rows(entry.queries()["control_complexity_buckets"](spark, d).select("bucket", "functions", "files")) == [("low", 6, 4), ("medium", 2, 2), ("very_high", 1, 1)]


def test_graph_of_imports(spark, rows, tables):
    names = {"a": "bx", "b": "c", "c": "ad", "d": "e", "e": "", "f": "f"}
    d = tables(source_files=_files({f"{k}.py": "".join(f"import {x}\n" for x in v) for k, v in names.items()}))
    edge = {(k, x) for k, v in names.items() for x in v if x in names}
    far, front = {}, {(a, b) for a, b in edge}
    for k in range(1, 9):
        for p in front:
            far.setdefault(p, k)
        front = {(a, c) for a, b in front for x, c in edge if x == b}
    want = sorted(((f"{a}.py", f"{b}.py", k) for (a, b), k in far.items()), key=str)
    q = entry.queries()
    assert rows(q["import_reach"](spark, d).select("start", "node", "distance")) == want
    assert rows(q["import_impact"](spark, d).select("node", "start", "distance")) == want
    assert rows(q["import_cycles"](spark, d).select("component", "path")) == [("a.py", "a.py"), ("a.py", "b.py"), ("a.py", "c.py"), ("f.py", "f.py")]
    assert {(r.path, r.includes, r.included_by) for r in q["import_degrees"](spark, d).collect()} == {(f"{k}.py", sum(a == k for a, _ in edge), sum(b == k for _, b in edge)) for k in names}


def test_neighbouring_snapshots(spark, rows, tables):
    snaps = [("r", "s3", 3), ("r", "s1", 1), ("r", "s2", 2), ("q", "t1", 1)]
    sym = {"s1": {("function", "f"): "f(a)", ("class", "K"): "K", ("function", "gone"): "gone()"}, "s2": {("function", "f"): "f(b)", ("class", "K"): "K(B)"}, "s3": {("function", "f"): "f(a)", ("class", "L"): "L"}, "t1": {("function", "f"): "f()"}}
    d = tables(
        snapshots=(snaps, "repo STRING, snapshot_id STRING, taken_at INT"),
        symbol_snapshot=([(s, t, "./a.py" if s == "s2" else "a.py", n, x, k) for s, m in sym.items() for (t, n), v in m.items() for x, k in ((v, 2), ("A stale", 1))], "snapshot_id STRING, symbol_type STRING, file_path STRING, name STRING, signature STRING, ingested_at INT"),
        source_files=_files({"b.py": "x = f(1) + f(2)\nL()\n"}),
    )
    uses = {"f": 2, "L": 1}
    want = []
    for a, b in (("s1", "s2"), ("s2", "s3")):
        for t, n in {*sym[a], *sym[b]}:
            x, y = sym[a].get((t, n)), sym[b].get((t, n))
            if x != y:
                kind = f"{t}_removed" if y is None else f"{t}_added" if x is None else "signature_changed"
                want.append((a, b, t, n, kind, uses.get(n, 0), x is not None and uses.get(n, 0) > 0))
    got = entry.queries()["neighbour_changes"](spark, d)
    assert rows(got.select("old_id", "new_id", "symbol_type", "name", "change_type", "uses", "breaking")) == sorted(want, key=str)


def test_too_many_packing_specifications(spark, tables):
    catalogue = pytest.importorskip("codeloom.llm.catalogue")
    d = tables(documents=([(1, "a b")], "doc_id BIGINT, text STRING"), pack_specs=([(f"s{i}", i) for i in range(1002)], "spec_id STRING, capacity_tokens INT"))
    with pytest.raises(ValueError):
        catalogue.p6_packed(spark, d)
    assert len(catalogue._capacities(spark, d, 1001)) == 1001
