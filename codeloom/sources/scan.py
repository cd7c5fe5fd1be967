"""File trees, version-control history and configuration as DataFrames."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.functions import code


def tree(spark: SparkSession, folder: str, tests: bool = False, exclude: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """(path, modified_time, size, content, language) of the source files below a folder, or of one file.

    Symbolic links to folders are not followed. Path filters run on the listing; contents are read only where they are selected.
    With only, paths below the folder, no other file is opened.
    """
    read = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    d = read.option("recursiveFileLookup", "true").load(folder) if only is None else read.load([f"{folder.rstrip('/')}/{p}" for p in only])
    if empty := _empty_files(spark, folder):  # which the reader leaves out
        e = spark.createDataFrame(empty, "path STRING, t BIGINT").select("path", F.timestamp_millis("t").alias("modificationTime"), F.lit(0).cast("bigint").alias("length"), F.lit(b"").alias("content"))
        d = d.unionByName(e)
    p = F.regexp_replace("path", r"^\w+:/*(?=/)", "")
    base = os.path.abspath(folder.removeprefix("file://")).rstrip("/")
    rel = F.when(p == base, code.file_name(p)).otherwise(F.substring(p, len(base) + 2, 1 << 20))
    d = d.select(rel.alias("path"), F.col("modificationTime").alias("modified_time"), F.col("length").alias("size"), "content")
    d = d.where(F.col("path").isin(only)) if only is not None else d
    d = d.where(code.is_source(F.col("path")) & ~code.excluded(F.col("path"), exclude))
    d = d if tests else d.where(~code.is_test(F.col("path")))
    return d.withColumn("language", code.language(F.col("path")))


def _empty_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Paths and times of files without content, from the listing that the driver makes for any file source."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0:
            out.append((f.getPath().toString(), f.getModificationTime()))
    return out


def snapshot(files: DataFrame) -> DataFrame:
    """(path, modified_time, content_hash, size)."""
    return files.select("path", "modified_time", F.sha2("content", 256).alias("content_hash"), "size")


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def git_changed(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    """(path, status) of source files that differ from a revision, deleted ones included. A listing: it is read on the driver."""
    out = _git(repo, "diff", "--name-status", "--no-renames", "-z", ref).decode().split("\0")
    rows = [(p, s) for s, p in zip(out[::2], out[1::2]) if p]
    d = spark.createDataFrame(rows, "path STRING, status STRING")
    return d.where(code.is_source(F.col("path")))


def git_blobs(paths: DataFrame, repo: str, ref: str) -> DataFrame:
    """(path, content) as of a revision, read by the executors, which need the repository at the same place; paths the revision lacks have null content. Extensions are kept, so languages are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one process for all paths of a task; it is asked for one object after the other
        git = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for b in batches:
                got = []
                for p in b["path"]:
                    if "\n" in p:  # the protocol has a line for each object
                        r = subprocess.run(["git", "-C", repo, "show", f"{ref}:{p}"], capture_output=True)
                        got.append(r.stdout if r.returncode == 0 else None)
                        continue
                    git.stdin.write(f"{ref}:{p}\n".encode())
                    git.stdin.flush()
                    head = git.stdout.readline().rsplit(b" ", 2)
                    if head[-1].strip() == b"missing":
                        got.append(None)
                        continue
                    body = git.stdout.read(int(head[-1]) + 1)[:-1]
                    got.append(body if head[-2] == b"blob" else None)
                yield pd.DataFrame({"path": b["path"], "content": got})
        finally:
            git.stdin.close()
            git.wait()

    return paths.select("path").mapInPandas(run, "path STRING, content BINARY")


# fixed values: settings and what they are without a file
WATCH_DEFAULTS = {"debounce_ms": 500, "max_events_per_second": 1000, "exclude_patterns": code.WATCH_EXCLUDED, "include_important_files": code.WATCH_IMPORTANT}


def settings(path: str, defaults: dict | None = None) -> dict:
    """A JSON file's settings over the defaults, key by key; the defaults alone where it is missing or unreadable."""
    out = dict(defaults or WATCH_DEFAULTS)
    try:
        with open(path, encoding="utf-8") as f:
            out |= {k: v for k, v in json.load(f).items() if v is not None}
    except (OSError, ValueError, AttributeError):
        pass
    return out


def save_setting(path: str, key: str, value) -> dict:
    now = settings(path, {}) | {key: value}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(now, f, indent=2, sort_keys=True)
    return now
