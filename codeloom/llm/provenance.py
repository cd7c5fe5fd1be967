"""Files that nobody wrote by hand: generated, minified or bundled, third-party copies, data stored as code.

A random forest decides. It learns from files whose head comment says that a tool made them and from texts that are
literals for the most part (data bears no notice). What labels a file is hidden from the features: head comments and tail
notices are cut off before they are taken, and the share of literals is not among them. Features are compression, token
entropy, identifiers, comments, line shapes, the ratios and sizes of the analysis, marks of the path, and the share of
five-word shingles known from library files.

Only part of the files that are not hand-written say so; those that do not are among the files without a label. So the
forest is grown twice: for the first one a fifth of the labelled files is hidden among the others, and the second one learns
labelled files against those of the others that bear no mark and score less than a tenth of what these spies do. Third-party files look like any hand-written source; so that
the forest learns what tells them whatever their text, some of that half are shown to it once more with a label, as they
would look in a third-party or tool's directory or among the library's files.

A file that says of itself that it is made by a tool or comes from elsewhere has score 1; the second forest decides on all
others, from one half on.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from codeloom.session import Stage

#: Rows the forest is fitted on at most: a share of all that a hash of file_id picks.
TRAINING_ROWS = 6000
#: Share of literals from which a file is data.
DATA = 0.6
#: Library shingles that are sent to every task as a sorted array of eight bytes each; with more of them files are joined with them.
MAX_SHINGLES = 1_000_000
#: Share of the labelled files hidden among the others (spies), and the part of their mean score that sure hand-written files stay below.
SPIES, LOW = 0.2, 0.1
#: Share of a library's shingles from which a file is shown as a copy.
COPY = 0.8
#: Share of the hand-written training rows shown again under each mark.
SHOWN = 0.15

_NOTICE = re.compile(
    r"^\W*(?:(?:this|the) (?:file|code|module) (?:is|was|has been) )?(?:code |file )?(?:automatically |auto-?\s?|machine[- ])?(?:generated|created|produced) (?:by|from|with|using)\b"
    r"|^\W*(?:auto-?\s?|machine[- ])generated\b|<auto-generated|^\W*@generated\b|^\W*(?:please )?do not (?:edit|modify|change)\b",
    re.I,
)
_UPSTREAM = re.compile(r"^\W*(?:(?:bundled|vendored|copied|imported)\b.*\b(?:third[- ]party|upstream)\b|vendored from\b|(?:\S+ v?\d+(?:\.\d+)+\W+)?upstream (?:copy|source)\b)", re.I)
_BANNER = re.compile(r"^\s*/\*!\s*\S+ v?\d+\.\d+")
_MAP = re.compile(r"\n?\s*(?://|/\*)[#@]\s*sourceMappingURL=[^\n]*\s*$")
_LINE_COMMENT = re.compile(r"^\s*(?://|#(?!include|define|if|endif|pragma|\[)|--)")
_VENDOR = re.compile(r"(?:^|/)(?:node_modules|vendor(?:ed|s)?|_vendor|third[_-]?party|3rd[_-]?party|extern(?:al|als)?|deps|bower_components|godeps|pods|site-packages|contrib)/[^/]+/", re.I)
_GEN_NAME = re.compile(r"(?:[._-](?:g|designer|pb|pb2|pb-c|gen|generated|bindings|tab|yy|min|bundle|chunk|prod)\.[a-z]+|_pb2(?:_grpc)?\.py|_generated\.\w+|\.pb\.\w+)$", re.I)
_GEN_DIR = re.compile(r"(?:^|/)(?:__generated__|generated|gen|autogen|obj)/", re.I)
_IDENT = re.compile(r"[^\W\d]\w*")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\b0[xX][0-9a-fA-F]+|\b\d[\d._]*\w*")
_COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|^\s*#(?!include|define|if|endif|pragma|\[)[^\n]*|\"\"\"[\s\S]*?\"\"\"", re.M)


def says(text: str) -> tuple[bool, bool, str]:
    """Whether the file's head or tail names a tool, whether it names an upstream project, and the text without head comments and tail notices."""
    t = text.lstrip("﻿")
    label, foreign = bool(_BANNER.match(t)), False
    if m := _MAP.search(t):
        label, t = True, t[: m.start()]
    lines = t.split("\n")
    i, block = 0, ""
    while i < len(lines):
        s = lines[i].strip()
        if block:
            label |= bool(_NOTICE.match(s))
            foreign |= bool(_UPSTREAM.match(s))
            block = "" if block in s else block
        elif not s:
            pass
        elif s[:2] == "/*":
            label |= bool(_NOTICE.match(s))
            foreign |= bool(_UPSTREAM.match(s))
            block = "" if "*/" in s[2:] else "*/"
        elif s[:3] == '"""' or s[:3] == "'''":
            label |= bool(_NOTICE.match(s))
            foreign |= bool(_UPSTREAM.match(s))
            block = "" if s[:3] in s[3:] else s[:3]
        elif s[:2] == "#!" or _LINE_COMMENT.match(s):
            label |= bool(_NOTICE.match(s))
            foreign |= bool(_UPSTREAM.match(s))
        else:
            break
        i += 1
    return label, foreign, "\n".join(lines[i:])


def _entropy(counts: Counter) -> float:
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


FEATURES = (
    "log_size", "log_lines", "longest_line", "mean_line", "space", "compression", "token_entropy", "ident_length", "short_idents", "numbered_idents", "idents_per_char", "comments", "shapes", "deepest",
    "tool_path", "foreign_path", "known_shingles", "code_ratio", "size_bytes",
)


def marked(path: str) -> tuple[bool, bool]:
    """Whether the path has a tool's mark, and whether it lies in a directory of third-party projects."""
    p = path.replace("\\", "/")
    return bool(_GEN_NAME.search(p) or _GEN_DIR.search(p)), bool(_VENDOR.search(p))


def literal_share(body: str) -> float:
    return min(1.0, sum(map(len, _LITERAL.findall(body))) / max(1, len(body)))


def features(body: str) -> list[float]:
    """Figures of a file without what it says of itself."""
    n = max(1, len(body))
    lines = body.split("\n")
    full = [x for x in lines if x.strip()]
    ids = _IDENT.findall(body)
    k = max(1, len(ids))
    raw = body.encode("utf-8", "replace")
    shapes = Counter(re.sub(r"\w+", "w", x.strip()) for x in full)
    com = sum(map(len, _COMMENT.findall(body)))
    return [
        math.log1p(n), math.log1p(len(lines)), math.log1p(max(map(len, lines))), math.log1p(n / max(1, len(full))), sum(map(body.count, " \t\n")) / n,
        len(zlib.compress(raw, 3)) / max(1, len(raw)), _entropy(Counter(ids)), sum(map(len, ids)) / k, sum(len(x) < 3 for x in ids) / k, sum(x[-1].isdigit() for x in ids) / k, k / n,
        min(1.0, com / n), len(shapes) / max(1, len(full)), math.log1p(max((len(x) - len(x.lstrip()) for x in full), default=0)),
    ]


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


class Hashes(dict):
    """Remembers the hash of each word, some hundred thousand at a time."""

    def __missing__(self, w: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(text: str, memo: Hashes) -> np.ndarray:
    """Hashes of the distinct five-word shingles."""
    w = _IDENT.findall(text)
    if len(w) < 5:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    n = len(h) - 4
    with np.errstate(over="ignore"):
        s = sum(h[i : i + n] * _MULTIPLIERS[i] for i in range(5))
    return np.unique(s ^ (s >> np.uint64(29))).view(np.int64)


def _library_hashes(library: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Hashes()
        for b in batches:
            for text in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(says(text)[2], memo))], names=["h"])

    return library.where("content IS NOT NULL").select("content").mapInArrow(run, "h BIGINT").distinct()


_FIGURES = "labelled BOOLEAN, says BOOLEAN, foreign BOOLEAN, features ARRAY<DOUBLE>, shingles INT, known INT, hashes ARRAY<BIGINT>"


def described(files: DataFrame, library: DataFrame, most: int = MAX_SHINGLES) -> DataFrame:
    """files (file_id, path, content, and size_bytes and code_ratio if known), library (content) → (file_id, labelled, says, foreign, features): whether it says that a tool made it or shows that it is data, whether it says so or that it comes from elsewhere, the latter alone, and its figures in the order of FEATURES. Null content counts as empty."""
    spark, own = files.sparkSession, Stage(files.sparkSession, "shingles")
    lib = own.put(_library_hashes(library))
    few = lib.count() <= most
    sent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in lib.collect()], np.int64)) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo = sent.value, Hashes()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for path, content, size, ratio in zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist()):
                text = (bytes(content.as_py()) if content.is_valid else b"").decode("utf-8", "replace").replace("\r\n", "\n")
                tool, foreign, body = says(text)
                s = shingles(body, memo)
                hits = 0
                if known is not None and len(known) and len(s):
                    hits = int((known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s).sum())
                f = features(body)
                f += [*map(float, marked(path or "")), 0.0, f[-1] if ratio is None else ratio, math.log1p(len(text) if size is None else size)]
                out[0].append(tool or literal_share(body) >= DATA)
                out[1].append(f)
                out[2].append(len(s))
                out[3].append(hits)
                out[4].append(s.tolist() if known is None else [])
                out[5].append(tool or foreign)
                out[6].append(foreign)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.bool_()), pa.array(out[5], pa.bool_()), pa.array(out[6], pa.bool_()), pa.array(out[1], pa.list_(pa.float64())), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.list_(pa.int64()))], names=["file_id", "labelled", "says", "foreign", "features", "shingles", "known", "hashes"])

    more = [F.col(c).cast(t).alias(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in (("size_bytes", "bigint"), ("code_ratio", "double"))]
    d = files.select(F.col("file_id").cast("bigint").alias("file_id"), "path", "content", *more).mapInArrow(run, "file_id BIGINT, " + _FIGURES)
    hits: Column = F.col("known")
    if not few:  # counted by a join on the hashes
        d = own.put(d)
        found = d.select("file_id", F.explode("hashes").alias("h")).join(lib, "h").groupBy("file_id").agg(F.count("*").alias("_hits"))
        d, hits = d.join(found, "file_id", "left"), F.coalesce("_hits", F.lit(0))
    share = F.when(F.col("shingles") > 0, hits / F.col("shingles")).otherwise(F.lit(0.0))
    return d.select("file_id", "labelled", "says", "foreign", _with("features", known_shingles=share).alias("features"))


def scored(files: DataFrame, library: DataFrame, rows: int = TRAINING_ROWS, seed: int = 7, most: int = MAX_SHINGLES) -> DataFrame:
    """(file_id, labelled, says, score) of every file: 1 where its head says what it is, else the forest's; that is 0 where no file or every file has a label.

    The forests are fitted on a sample of at most rows files, picked by a hash of their ids.
    """
    st = Stage(files.sparkSession, "provenance")
    d = st.put(described(files, library, most))
    million = 1_000_000
    share = min(1.0, rows / max(1, d.count()))
    picked = F.pmod(F.xxhash64("file_id", F.lit(seed)), F.lit(million)) < int(share * million)
    judge = fitted(st, d.where(picked), seed)
    own = judge(d) if judge else d.withColumn("score", F.lit(0.0))
    return own.select("file_id", "labelled", "says", F.when(F.col("says"), 1.0).otherwise(F.col("score")).alias("score"))


def _with(features: str, **values: Column) -> Column:
    """The features with some replaced by name."""

    def one(x: Column, i: Column) -> Column:
        out = x
        for k, v in values.items():
            out = F.when(i == FEATURES.index(k), v).otherwise(out)
        return out

    return F.transform(features, one)


def fitted(st: Stage, sample: DataFrame, seed: int):
    """A function that adds the score, from two forests grown on described files (see above); None without files of both kinds."""
    # What comes from elsewhere looks hand-written; on either side it would blur the label.
    rows = st.put(sample.where("NOT foreign").select("file_id", F.col("labelled").cast("double").alias("label"), "features"))
    if len({r[0] for r in rows.select("label").distinct().collect()}) < 2:
        return None
    x = array_to_vector("features").alias("x")
    grow = lambda t: RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=60, maxDepth=9, maxBins=48, minInstancesPerNode=2, seed=seed, subsamplingRate=0.8).fit(t.select("label", x).coalesce(4))
    judge = lambda forest, t: forest.transform(t.withColumn("x", x)).withColumn("score", vector_to_array("probability")[1]).drop("x", "probability", "rawPrediction", "prediction")
    spy = (F.col("label") == 1) & (F.pmod(F.xxhash64("file_id", F.lit(seed + 2)), F.lit(1000)) < int(1000 * SPIES))
    first = st.put(judge(grow(rows.withColumn("label", F.when(spy, 0.0).otherwise(F.col("label")))), rows))
    spies = first.where(spy).agg(F.avg("score")).first()[0]
    top = 1.0 if spies is None else LOW * spies
    marks = [F.element_at("features", FEATURES.index(k) + 1) for k in ("tool_path", "foreign_path", "known_shingles")]
    hand = first.where((F.col("label") == 0) & (F.col("score") <= top) & (marks[0] == 0) & (marks[1] == 0) & (marks[2] < COPY)).select("file_id", "label", "features")
    part = F.pmod(F.xxhash64("file_id", F.lit(seed + 1)), F.lit(1000))
    shown = [{"tool_path": F.lit(1.0)}, {"foreign_path": F.lit(1.0)}, {"known_shingles": COPY + (1 - COPY) * F.pmod(F.xxhash64("file_id"), F.lit(101)) / 100}]
    fit = hand.unionByName(first.where("label = 1").select("file_id", "label", "features"))
    for k, v in enumerate(shown):
        again = hand.where((part >= int(1000 * SHOWN * k)) & (part < int(1000 * SHOWN * (k + 1))))
        fit = fit.unionByName(again.select("file_id", F.lit(1.0).alias("label"), _with("features", **v).alias("features")))
    second = grow(st.put(fit))
    return lambda t: judge(second, t)


def not_hand_written(scores: DataFrame) -> DataFrame:
    """Files that say so, and those the forest tells."""
    return scores.where("score >= 0.5").select("file_id")
