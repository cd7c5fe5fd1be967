import subprocess

from codeloom.operators import store
from codeloom.sinks import formats
from codeloom.sources import scan


def test_tree_and_git(spark, rows, tmp_path):
    for p, t in {"a.js": "x", "sub/b.PY": "y", "a.test.js": "t", "node_modules/m.js": "n", "note.txt": "n", "c.rs": ""}.items():
        f = tmp_path / "r" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    r = str(tmp_path / "r")
    assert rows(scan.tree(spark, r).select("path", "language")) == [("a.js", "javascript"), ("c.rs", "rust"), ("sub/b.PY", "python")]
    assert scan.tree(spark, r, tests=True).count() == 4
    before = scan.snapshot(scan.tree(spark, r)).collect()
    git = lambda *a: subprocess.run(["git", "-C", r, "-c", "user.name=a", "-c", "user.email=b@c", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "x")
    (tmp_path / "r/a.js").write_text("longer")
    (tmp_path / "r/c.rs").unlink()
    ch = store.snapshot_changes(spark.createDataFrame(before, "path STRING, modified_time TIMESTAMP, content_hash STRING, size BIGINT"), scan.snapshot(scan.tree(spark, r)))
    assert rows(ch.where("content_changed").select("path", "change_type")) == [("a.js", "modified"), ("c.rs", "deleted")]
    g = scan.git_changed(spark, r, "HEAD")
    assert rows(g) == [("a.js", "M"), ("c.rs", "D")]
    assert rows(scan.git_blobs(g, r, "HEAD")) == [("a.js", bytearray(b"x")), ("c.rs", bytearray(b""))]


def test_settings(tmp_path):
    p = str(tmp_path / "c.json")
    assert scan.settings(p)["debounce_ms"] == 500
    scan.save_setting(p, "debounce_ms", 9)
    assert scan.settings(p)["debounce_ms"] == 9
    (tmp_path / "c.json").write_text("{")
    assert scan.settings(p)["debounce_ms"] == 500


def test_formats(spark):
    t = spark.createDataFrame([(2, 1, 3, "high")], "changes INT, breaking INT, references INT, overall_risk STRING")
    c = spark.createDataFrame([("f", "function_removed", "high", 3, True)], "name STRING, change_type STRING, risk_level STRING, references INT, breaking BOOLEAN")
    assert "and 1 more" in formats.impact_report(t, c) and "Function removed" in formats.impact_report(t, c, "markdown") and '"f"' in formats.impact_report(t, c, "json")
    assert formats.metrics_rows(t).count() == 4
    assert formats.guarded("x" * 100, 10).startswith("x" * 40 + "\n[cut") and formats.guarded("abc") == "abc"
