from codeloom.api import Analysis, Sessions


def test_folder_session_and_impact(spark, rows, tmp_path):
    r = tmp_path / "tree"
    r.mkdir()
    (r / "a.py").write_text("import b\n\ndef go(x):\n    return b.run(x)\n")
    (r / "b.py").write_text("import a\n\nclass K:\n    def run(self, x):\n        if x:\n            return 1\n")
    a = Analysis.of_folder(spark, str(r))
    assert a.summary().first().files == 2 and "python" in a.text()
    assert rows(a.find("RUN").select("name", "owner_class")) == [("run", "K")]
    assert {x.path for x in a.cycles().collect()} == {"a.py", "b.py"}
    assert [x.name for x in a.query("K::run").collect()] == ["run"]
    s = Sessions(spark, str(tmp_path / "sessions"))
    sid = s.create(str(r))
    assert s.update(sid).first().status == "no_changes"
    before = Analysis(spark.createDataFrame(a.sources.collect(), a.sources.schema))
    (r / "b.py").write_text("import a\n\nclass K:\n    def run(self, x, y):\n        return 2\n")
    (r / "c.js").write_text("function f() {\n}\n")
    assert rows(s.dry_run(sid)) == [("+ c.js",), ("M b.py",)]
    got = s.update(sid).first()
    assert (got.added, got.modified, got.deleted, got.status) == (1, 1, 0, "updated")
    assert {x.language for x in s.stats(sid).collect()} == {"python", "javascript"} and s.list().count() == 1
    changed, refs = Analysis.of_folder(spark, str(r)).impact(before)
    assert rows(changed.select("name", "change_type", "risk_level")) == [("f", "function_added", "low"), ("run", "signature_changed", "high")]
    assert ("run", "call") in {(x.name, x.usage_type) for x in refs.collect()}
