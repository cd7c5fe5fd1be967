from codeloom.operators import extract, spans, tree

PY = 'import os\n\n@d\nclass K(B):\n    """doc: def no():"""\n    async def m(self, a=(1, 2)):\n        if a:\n            pass\n\n        return 1\n\ndef f():\n    def g(): pass\n    return g\n'
JS = 'export class A extends B {\n  constructor(a, b) {\n    this.s = "}";\n  }\n  run() { /* } */ }\n}\nasync function go(x, y = [1, 2]) {\n  if (x) { return; }\n}\nconst h = (q) => { q(); };\n'
GO = "package a\ntype S struct {\n\tA int\n}\nfunc (s *S) M(a int, b string) int {\n\treturn 1\n}\nfunc F() {\n}\n"
RS = "struct P { x: i32 }\nimpl P {\n    pub async fn new(x: i32) -> Self {\n        P { x }\n    }\n}\nfn main() {}\n"
CPP = "class Q : public R {\npublic:\n  int f(int a, std::map<int, int> b) {\n    return a;\n  }\n};\n"


def _of(text, lang):
    return [(s["symbol_type"], s["name"], s["start_line"], s["end_line"], s["owner_class"]) for s in spans.symbols_of(text, lang)]


def test_spans():
    assert _of(PY, "python") == [("class", "K", 4, 10, None), ("function", "m", 6, 10, "K"), ("function", "f", 12, 14, None), ("function", "g", 13, 13, None)]
    m = spans.symbols_of(PY, "python")
    assert m[0]["parent_class"] == "B" and m[1]["parameters"] == ["self", "a=(1, 2)"] and m[1]["is_async"] and m[3]["parent"] == 2
    js = _of(JS, "javascript")
    assert ("class", "A", 1, 6, None) in js and ("function", "constructor", 2, 4, "A") in js and ("function", "run", 5, 5, "A") in js and ("function", "go", 7, 9, None) in js and ("function", "h", 10, 10, None) in js
    assert [s["parameters"] for s in spans.symbols_of(JS, "javascript") if s["name"] == "go"] == [["x", "y = [1, 2]"]]
    assert _of(GO, "go") == [("class", "S", 2, 4, None), ("function", "M", 5, 7, "S"), ("function", "F", 8, 9, None)]
    assert ("function", "new", 3, 5, "P") in _of(RS, "rust") and ("function", "main", 7, 7, None) in _of(RS, "rust")
    assert ("function", "f", 3, 5, "Q") in _of(CPP, "cpp") and spans.symbols_of(CPP, "cpp")[0]["parent_class"] == "R"
    assert spans.symbols_of("", "python") == [] and spans.symbols_of("class A {", "javascript")[0]["end_line"] == 1


def test_tree_of_files(spark, rows):
    df = spark.createDataFrame([("r", "a.py", bytearray(PY.encode())), ("r", "x.txt", bytearray(b"def f(): 1")), ("r", "n.py", None)], "repo STRING, path STRING, content BINARY")
    s = spans.symbols(extract.source_text(df))
    t = tree.with_scope(spans.ast(s))
    assert rows(t.select("node_no", "node_type", "depth", "scope_path")) == [(0, "file_root", 0, ""), (1, "class", 1, "K"), (2, "method", 2, "K::m"), (3, "function", 1, "f"), (4, "function", 2, "f::g")]
    assert rows(spans.signatures(s).select("name", "signature"))[0] == ("f", "f()")
    assert [r.name for r in tree.query(t, "K::*").collect()] == ["m"]
    assert spans.symbols(extract.source_text(df.limit(0))).count() == 0
