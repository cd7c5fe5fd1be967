"""Command line: python -m codeloom VERB ... Results are JSON lines or text on standard output."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.api import Analysis, Sessions
from codeloom.operators import edits, stats, store
from codeloom.session import get_session
from codeloom.sinks import formats
from codeloom.sources import scan


def _show(df: DataFrame) -> None:
    """Rows one by one, a partition at a time."""
    for r in formats.json_lines(df).toLocalIterator():
        print(r[0])


def _impact(spark: SparkSession, a: argparse.Namespace) -> None:
    x = Analysis.of_folder(spark, a.folder)
    changed, refs = x.impact_since(a.folder, a.ref)
    print(x.report(changed, refs) if a.format == "comment" else formats.impact_report(x.totals(changed), changed, a.format))


VERBS: dict = {
    "analyze": (["folder"], lambda s, a: print(Analysis.of_folder(s, a.folder).text())),
    "metrics": (["folder"], lambda s, a: _show(Analysis.of_folder(s, a.folder).metrics())),
    "structure": (["folder"], lambda s, a: _show(Analysis.of_folder(s, a.folder).structure())),
    "symbols": (["folder"], lambda s, a: _show(Analysis.of_folder(s, a.folder).symbols())),
    "complexity": (["folder"], lambda s, a: _show(Analysis.of_folder(s, a.folder).complexity())),
    "calls": (["folder"], lambda s, a: _show(stats.call_frequency(Analysis.of_folder(s, a.folder).calls()))),
    "find": (["folder", "term"], lambda s, a: _show(Analysis.of_folder(s, a.folder).find(a.term))),
    "ast-query": (["folder", "path"], lambda s, a: _show(Analysis.of_folder(s, a.folder).query(a.path))),
    "ast-dump": (["folder"], lambda s, a: _show(Analysis.of_folder(s, a.folder).nodes())),
    "dependencies": (["folder"], lambda s, a: _show(Analysis.of_folder(s, a.folder).edges())),
    "cycles": (["folder"], lambda s, a: _show(Analysis.of_folder(s, a.folder).cycles())),
    "impact": (["folder", "ref", "format"], _impact),
    "session-create": (["store", "folder"], lambda s, a: print(Sessions(s, a.store).create(a.folder))),
    "session-update": (["store", "session"], lambda s, a: _show(Sessions(s, a.store).update(a.session))),
    "session-preview": (["store", "session"], lambda s, a: _show(Sessions(s, a.store).dry_run(a.session))),
    "session-stats": (["store", "session"], lambda s, a: _show(Sessions(s, a.store).stats(a.session))),
    "session-export": (["store", "session"], lambda s, a: _show(Sessions(s, a.store).export(a.session))),
    "session-delete": (["store", "session"], lambda s, a: Sessions(s, a.store).delete(a.session)),
    "sessions": (["store"], lambda s, a: _show(Sessions(s, a.store).list())),
    "note-save": (["store", "kind", "name", "text"], lambda s, a: print(store.NoteStore(s, a.store).save(a.name, a.text, a.kind))),
    "notes": (["store", "kind"], lambda s, a: _show(store.NoteStore(s, a.store).of_type(a.kind))),
    "note-search": (["store", "term"], lambda s, a: _show(store.search(store.NoteStore(s, a.store).all(), a.term, ["name", "content"]))),
    "replace-preview": (["store", "folder", "pattern", "text"], lambda s, a: print(_preview(s, a))),
    "previews": (["store"], lambda s, a: _show(store.PreviewStore(s, a.store).all())),
    "settings": (["file"], lambda s, a: print(scan.settings(a.file))),
}


def _preview(spark: SparkSession, a: argparse.Namespace) -> str:
    t = Analysis.of_folder(spark, a.folder).sources.where(F.contains("text", F.lit(a.pattern)))
    return store.PreviewStore(spark, a.store).save(t.select("path", F.col("text").alias("before"), edits.replace(F.col("text"), a.pattern, a.text).alias("after")))


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="codeloom")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, (names, _) in VERBS.items():
        q = sub.add_parser(verb)
        for n in names:
            q.add_argument(n)
    a = p.parse_args(args)
    VERBS[a.verb][1](get_session(), a)


if __name__ == "__main__":
    main()
