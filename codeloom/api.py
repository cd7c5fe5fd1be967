"""The verbs of the tool as methods: analyse a tree, keep it as a session, refresh it, ask it questions."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.functions import code
from codeloom.operators import extract, graph, impact, spans, stats, store, tree
from codeloom.sinks import formats
from codeloom.sources import scan
from codeloom.streaming import watch

ENTITIES = ("files", "symbols", "imports", "calls", "nodes")


@dataclass
class Analysis:
    """Lazy tables of one set of sources (repo, path, language, text)."""

    sources: DataFrame

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, tests: bool = False) -> Analysis:
        files = scan.tree(spark, folder, tests).withColumn("repo", F.lit(folder))
        return cls(extract.source_text(files.select("repo", "path", "content")))

    @classmethod
    def of_revision(cls, spark: SparkSession, folder: str, ref: str, paths: DataFrame) -> Analysis:
        """The files of the paths as of a revision."""
        blobs = scan.git_blobs(paths, folder, ref).where("content IS NOT NULL")
        return cls(extract.source_text(blobs.select(F.lit(folder).alias("repo"), "path", "content")))

    def impact_since(self, folder: str, ref: str) -> tuple[DataFrame, DataFrame]:
        """The impact of what differs from a revision of the folder's repository: symbols are compared in the files that differ, references are searched in all."""
        spark = self.sources.sparkSession
        paths = scan.git_changed(spark, folder, ref).select("path")
        now = Analysis(self.sources.join(paths, "path", "left_semi"))
        return self.impact(Analysis.of_revision(spark, folder, ref, paths), now)

    def report(self, changed: DataFrame, refs: DataFrame) -> str:
        """A Markdown comment on changed symbols and their references, with the cycles of the sources' imports."""
        body = formats.comment(impact.totals(changed), changed, impact.top_references(refs), impact.untouched_files(changed, refs))
        loops = [r["path"] for r in self.cycles().orderBy("component", "path").limit(formats.REPORT_ROWS + 1).collect()]
        more = ["- ... and more"] if len(loops) > formats.REPORT_ROWS else []
        return "\n".join([body, *(["", "### Files on import cycles", "", *[f"- `{p}`" for p in loops[: formats.REPORT_ROWS]], *more] if loops else [])])

    def metrics(self) -> DataFrame:
        return extract.text_metrics(self.sources)

    def summary(self) -> DataFrame:
        return stats.summary(self.metrics())

    def languages(self) -> DataFrame:
        return stats.by_language(self.metrics())

    def structure(self) -> DataFrame:
        return stats.structure(self.metrics())

    def symbols(self) -> DataFrame:
        return spans.symbols(self.sources)

    def signatures(self) -> DataFrame:
        return spans.signatures(self.symbols())

    def complexity(self) -> DataFrame:
        return spans.complexity(self.sources)

    def calls(self) -> DataFrame:
        return extract.calls(self.sources)

    def totals(self, changed: DataFrame) -> DataFrame:
        return impact.totals(changed)

    def find(self, term: str) -> DataFrame:
        return store.search(self.symbols(), term, ["name"])

    def nodes(self) -> DataFrame:
        return tree.with_scope(spans.ast(self.symbols()))

    def query(self, path: str, fuzzy: bool = False) -> DataFrame:
        return tree.query(self.nodes(), path, fuzzy=fuzzy)

    def edges(self) -> DataFrame:
        return graph.edges(extract.imports(self.sources), self.sources)

    def cycles(self) -> DataFrame:
        return graph.cycles(self.edges())

    def text(self) -> str:
        return formats.guarded(formats.stats_text(self.summary(), self.languages()))

    def impact(self, before: Analysis, now: Analysis | None = None) -> tuple[DataFrame, DataFrame]:
        """(changed symbols with risk, their references) against an earlier state of the same sources, or of those of them in now."""
        calls = extract.calls(self.sources)
        keys = ["repo", "path", "name"]
        sig = lambda a: a.signatures().select(*keys, "signature")
        changed = impact.symbol_diff(sig(before), sig(now or self), keys, "signature", impact.usage(calls))
        changed = changed.withColumn("symbol_type", F.lit("function"))
        refs = impact.references(changed, calls, extract.named_imports(self.sources), extract.exports(self.sources), extract.functions(self.sources), extract.classes(self.sources), within=True)
        return impact.with_risk(changed, refs), refs


class Sessions:
    """Analyses kept in a folder: create, refresh after changes, preview a refresh, list, read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, store.SessionStore(spark, root)

    def create(self, folder: str, session_id: str | None = None) -> str:
        """Keeps the snapshot, metrics, symbols, imports, calls and syntax nodes of a tree; a tree without a source file is an error."""
        sid = session_id or uuid.uuid4().hex[:8]
        files = scan.tree(self.spark, folder)
        if files.select("path").isEmpty():
            raise FileNotFoundError(folder)
        self.store.save(sid, "file_snapshot", scan.snapshot(files))
        for entity, df in self._entities(folder).items():
            self.store.save(sid, entity, df)
        now = F.current_timestamp()
        self.store.save(sid, "sessions", self.spark.range(1).select(F.lit(folder).alias("folder"), now.alias("created_at"), now.alias("last_accessed")))
        return sid

    def _entities(self, folder: str, only: list[str] | None = None) -> dict[str, DataFrame]:
        files = scan.tree(self.spark, folder, only=only).withColumn("repo", F.lit(folder))
        a = Analysis(extract.source_text(files.select("repo", "path", "content")))
        nodes = spans.ast(a.symbols()).withColumn("path", F.substring("record_id", len(folder) + 2, 1 << 20))
        return {"files": a.metrics().drop("repo"), "symbols": a.symbols().drop("repo"), "imports": extract.named_imports(a.sources).drop("repo"), "calls": extract.calls(a.sources).drop("repo"), "nodes": nodes}

    def folder(self, sid: str) -> str:
        return self.store.header(sid)["folder"]

    def _changes(self, sid: str) -> tuple[DataFrame, DataFrame, list[str]]:
        """(new snapshot, changes, paths read): only files whose time or size differs from the stored snapshot are opened. The listing of a tree and the names of its changed files are the driver's, as for any file source."""
        folder = self.folder(sid)
        old = self.store.load("file_snapshot", sid).drop("session_id")
        seen = scan.tree(self.spark, folder).select("path", "modified_time", "size")
        same = seen.join(old, ["path", "modified_time", "size"], "left_semi").select("path")
        moved = [r[0] for r in seen.join(same, "path", "left_anti").select("path").collect()]
        kept = old.join(same, "path", "left_semi")
        new = kept.unionByName(scan.snapshot(scan.tree(self.spark, folder, only=moved))) if moved else kept
        return new, store.snapshot_changes(old, new), moved

    def dry_run(self, sid: str) -> DataFrame:
        return store.dry_run(self._changes(sid)[1])

    def update(self, sid: str) -> DataFrame:
        """Re-analyses what changed and returns the report; only the changed files' contents are read. An unknown id is a KeyError."""
        folder = self.store.touch(sid)["folder"]
        new, changes, moved = self._changes(sid)
        fresh = self._entities(folder, moved) if moved else {}
        of = {e: (lambda paths, e=e: fresh[e].join(paths, "path", "left_semi")) if moved else (lambda paths, e=e: self.store.load(e, sid).drop("session_id").limit(0)) for e in ENTITIES}
        return store.update_report(self.store.refresh(sid, new, of, changes=changes))

    def load(self, sid: str, entity: str) -> DataFrame:
        """One of ENTITIES or file_snapshot, as kept."""
        self.folder(sid)
        return self.store.load(entity, sid).drop("session_id")

    def export(self, sid: str) -> DataFrame:
        """(file, language, functions, classes, lines), one row a file."""
        n = self.load(sid, "symbols").groupBy("path").agg(F.count_if(F.col("symbol_type") == "function").alias("functions"), F.count_if(F.col("symbol_type") == "class").alias("classes"))
        f = self.load(sid, "files").join(n, "path", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return f.select(F.col("path").alias("file"), "language", zero("functions"), zero("classes"), F.col("total_lines").alias("lines"))

    def delete(self, sid: str) -> None:
        self.store.delete(sid)

    def clean(self, days: int, as_of: str | None = None) -> list[str]:
        return self.store.clean(days, as_of)

    def watch(self, sid: str, checkpoint: str, gap: str = watch.DEBOUNCE):
        """A streaming query that refreshes the session after each burst of changed source files."""
        events = watch.file_stream(self.spark, self.folder(sid)).select(F.col("modificationTime").alias("ts"), F.lit("modify").alias("kind"), "path", F.lit(sid).alias("session_id"))
        return watch.start(watch.debounce(watch.relevant(events), gap=gap), lambda due, _: None if due.isEmpty() else self.update(sid).collect(), f"watch-{sid}", checkpoint)

    def stats(self, sid: str) -> DataFrame:
        return stats.by_language(self.store.load("files", sid))

    def list(self) -> DataFrame:
        return self.store.sessions()


LANGUAGES = sorted(code.EXTENSIONS)
