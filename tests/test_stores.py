import os
import subprocess
import time

import pytest

from codeloom import __main__ as cli
from codeloom.api import Analysis, Sessions
from codeloom.operators import store
from codeloom.sources import scan


def _write(folder, **files):
    for name, text in files.items():
        path = os.path.join(folder, name.replace("__", "/").replace("_py", ".py"))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)


def test_sessions_refresh_only_what_changed(spark, rows, tmp_path, monkeypatch):
    src = str(tmp_path / "src")
    _write(src, a_py="def f(x):\n    return g(x)\n", b_py="from a import f\nclass K:\n    def m(self): pass\n", c_py="")
    s = Sessions(spark, str(tmp_path / "kept"))
    sid = s.create(src)
    assert rows(s.export(sid)) == [("a.py", "python", 1, 0, 2), ("b.py", "python", 1, 1, 3), ("c.py", "python", 0, 0, 0)]
    assert s.update(sid).first().status == "no_changes" and rows(s.dry_run(sid)) == []
    time.sleep(0.05)
    _write(src, a_py="def f(x, y):\n    return h(x)\ndef z(): pass\n", d_py="x = 1\n")
    os.remove(os.path.join(src, "b.py"))
    read = []
    plain = scan.tree
    monkeypatch.setattr(scan, "tree", lambda *a, **k: read.append(k.get("only")) or plain(*a, **k))
    assert rows(s.dry_run(sid)) == [("+ d.py",), ("- b.py",), ("M a.py",)]
    r = s.update(sid).first()
    assert (r.added, r.modified, r.deleted, r.status) == (1, 1, 1, "updated")
    assert all(o is None or sorted(o) == ["a.py", "d.py"] for o in read)
    assert rows(s.load(sid, "symbols").select("path", "name")) == [("a.py", "f"), ("a.py", "z")]
    assert rows(s.load(sid, "calls").select("path", "function")) == [("a.py", "f"), ("a.py", "h"), ("a.py", "z")]
    assert s.load(sid, "nodes").where("path = 'b.py'").isEmpty() and s.load(sid, "files").count() == 3
    with pytest.raises(KeyError):
        s.update("none")
    assert s.clean(1) == [] and s.clean(1, "2999-01-01 00:00:00") == [sid]
    with pytest.raises(KeyError):
        s.stats(sid) if s.folder(sid) else None
    with pytest.raises(FileNotFoundError):
        os.makedirs(tmp_path / "none") or s.create(str(tmp_path / "none"))


def test_impact_since_a_revision(spark, tmp_path):
    src = str(tmp_path)
    git = lambda *a: subprocess.run(["git", "-C", src, "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    _write(src, a_py="def f(x):\n    pass\ndef gone():\n    pass\n", b_py="from a import f, gone\nf(1)\n")
    git("add", ".")
    git("commit", "-qm", "one")
    _write(src, a_py="def f(x, y):\n    pass\n")
    a = Analysis.of_folder(spark, src)
    changed, refs = a.impact_since(src, "HEAD")
    got = {r.name: (r.change_type, r.risk_level) for r in changed.collect()}
    assert got == {"f": ("signature_changed", "high"), "gone": ("function_removed", "high")}
    text = a.report(changed, refs)
    assert "### Function removed" in text and "- `gone` in `a.py` (high, " in text and "`b.py` (import, 1)" in text and text.index("Function removed") < text.index("Signature changed")
    assert "### Affected without being changed" in text and text.rstrip().endswith("- `b.py`")


def test_notes_and_previews(spark, rows, tmp_path, capsys):
    n = store.NoteStore(spark, str(tmp_path))
    assert n.all().count() == 0
    first = n.save("plan", "one", " Memo ")
    second = n.save("plan", "two", "api")
    assert n.of_type("MEMO").first().id == first and n.named("plan").first().id == second and n.of_type("other").count() == 0
    with pytest.raises(ValueError):
        n.save("x", "y", "other")
    p = store.PreviewStore(spark, str(tmp_path))
    key = p.save(spark.createDataFrame([("a.py", "x", "y")], "path STRING, before STRING, after STRING"))
    assert [(r.files, r.confirmed) for r in p.all().collect()] == [(1, False)]
    assert rows(p.confirm(key)) == [("a.py", "y")]
    with pytest.raises(ValueError):
        p.confirm(key)
    with pytest.raises(KeyError):
        p.confirm("none")
    cli.main(["notes", str(tmp_path), "api"])
    assert '"content":"two"' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["no-such-verb"])
