"""Symbols with their lines, parameters and owners, and the syntax tree they form.

Where a symbol ends needs a walk over its text: brackets outside strings and comments for most languages, indentation for
Python. That walk runs in Arrow batches over whole files and emits flat rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.operators.extract import CLASSES, FUNCTIONS, NOT_METHODS, steady

_SKIP = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|\{|\}|;|\(|\)")
_HASH = re.compile(r"#[^\n]*|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_RULES = {lang: [(re.compile(steady(p)), kind) for p, kind in v] for lang, v in FUNCTIONS.items()}
_TYPES = {lang: [(re.compile(steady(p)), kind) for p, kind, _, _ in v] for lang, v in CLASSES.items()}
_RULES["rust"] = [(re.compile(r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"), "function")]
_TYPES["rust"] = _TYPES["rust"] + [(re.compile(r"(?m)^[ \t]*impl\b(?:<[^>\n]*>)?[ \t]+(?:[^{\n]*?\bfor[ \t]+)?(\w+)()"), "impl")]
_RECEIVER = re.compile(r"func\s+\(\s*\w+\s+\*?(\w+)")


def blanked(text: str, lang: str) -> str:
    """The text with strings and comments covered by a character that is neither space nor word, line ends kept; so positions stay and no long runs of white space arise."""
    rx = _HASH if lang == "python" else _SKIP
    keep = "{};()"
    return rx.sub(lambda m: m[0] if m[0] in keep else re.sub(r"[^\n]", "\x01", m[0]), text)


def _generic_end(plain: str, at: int) -> int:
    """Position behind the angle brackets that open at at (their bounds may hold round ones); at itself where none do."""
    if plain[at : at + 1] != "<":
        return at
    depth = 0
    for j in range(at, len(plain)):
        if plain[j] == "<":
            depth += 1
        elif plain[j] == ">" and plain[j - 1] not in "-=":
            depth -= 1
            if depth == 0:
                return j + 1
    return at


def _lambda_parameters(text: str, plain: str, at: int) -> list[str]:
    """What stands between the word lambda, which ends at at, and its colon."""
    depth, start, out = 0, at, []
    for j in range(at, len(plain)):
        c = plain[j]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif depth == 0 and c in ",:":
            out.append(text[start:j])
            start = j + 1
            if c == ":":
                break
    return [" ".join(p.split()) for p in out if p.strip()]


def _parameters(text: str, plain: str, at: int) -> list[str]:
    """What stands in the round brackets that open at or behind at, split at commas outside inner brackets."""
    i = plain.find("(", _generic_end(plain, at))
    if i < 0 or "\n\n" in plain[at:i]:
        return []
    depth, start, out = 0, i + 1, []
    for j in range(i, len(plain)):
        c = plain[j]
        if c in "([{<":
            depth += 1
        elif c in ")]}>" and plain[j - 1] not in "-=":
            depth -= 1
            if depth == 0:
                out.append(text[start:j])
                break
        elif c == "," and depth == 1:
            out.append(text[start:j])
            start = j + 1
    return [" ".join(p.split()) for p in out if p.strip()]


def _brace_end(plain: str, at: int, braces: list[tuple[int, int]]) -> int:
    """Position of the bracket that closes the first block behind at; at itself where a semicolon ends it before."""
    i = bisect_right(braces, (at, 9))
    semi = plain.find(";", at)
    depth = 0
    for p, d in braces[i:]:
        if depth == 0 and d > 0 and 0 <= semi < p:
            return semi
        depth += d
        if depth <= 0:
            return p
    return len(plain) - 1 if depth else at


def _indent_end(lines: list[str], first: int) -> int:
    """Last line of the block that starts on line first (from 0): the last before one that is not deeper."""
    base = len(lines[first]) - len(lines[first].lstrip())
    last = first
    for i in range(first + 1, len(lines)):
        s = lines[i].strip()
        if s:
            if len(lines[i]) - len(lines[i].lstrip()) <= base and s[0] not in ")]}":
                break
            last = i
    return last


def symbols_of(text: str, lang: str) -> list[dict]:
    """Functions and types of one text: symbol_type, kind, name, start_line, end_line, parameters, is_async, parent_class, owner (index of the innermost type around, or -1)."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    plain = blanked(text, lang)
    ends = [m.start() for m in re.finditer("\n", text)]
    lines = text.split("\n")
    braces = [(m.start(), 1 if m[0] == "{" else -1) for m in re.finditer(r"[{}]", plain)]
    out, seen = [], set()
    for table, what in ((_TYPES, "class"), (_RULES, "function")):
        for rx, kind in table.get(lang, ()):
            for m in rx.finditer(plain):
                name = m[1]
                if not name or what == "function" and kind == "method" and name in NOT_METHODS:
                    continue
                at = m.start(1)
                if (what, at) in seen:
                    continue
                seen.add((what, at))
                line = bisect_right(ends, at - 1)
                end = _indent_end(lines, line) if lang == "python" else bisect_right(ends, _brace_end(plain, m.end(1), braces) - 1)
                parent = (m[2] or "").split(",")[0].strip() if what == "class" and m.re.groups > 1 else ""
                out.append({"symbol_type": what, "kind": kind, "name": name, "start_line": line + 1, "end_line": max(end, line) + 1, "parameters": (_lambda_parameters(text, plain, m.end()) if kind == "lambda" else _parameters(text, plain, m.end(1))) if what == "function" else [], "is_async": what == "function" and re.search(r"\basync\b", m[0]) is not None, "parent_class": parent or None, "receiver": (r[1] if (r := _RECEIVER.match(m[0])) else None) if lang == "go" and what == "function" else None})
    out.sort(key=lambda s: (s["start_line"], -s["end_line"], s["symbol_type"]))
    open_: list[int] = []
    for i, s in enumerate(out):
        while open_ and out[open_[-1]]["end_line"] < s["start_line"]:
            open_.pop()
        inside = [j for j in open_ if out[j]["end_line"] >= s["end_line"]]
        s["parent"] = inside[-1] if inside else -1
        types = [j for j in inside if out[j]["symbol_type"] == "class"]
        s["owner_class"] = out[types[-1]]["name"] if types else s.pop("receiver", None)
        s.pop("receiver", None)
        open_.append(i)
    return out


_C_LIKE = r"(?<![.\w$#@])(?:(?:if|for|foreach|while|switch)\b(?:\s+(?:constexpr|await))?\s*\(|try\b\s*\{)"
# control structures: branches, loops, switches and try blocks; Python's only where a statement can begin
_CONTROL = {
    "python": re.compile(r"(?m)^[ \t]*(?:(?:if|elif|while|for|async[ \t]+for|try)\b|match[ \t]+[^=\n]+:[ \t\x01]*$)"),
    "go": re.compile(r"(?<![.\w])(?:if|for|switch|select)\b"),
    "rust": re.compile(r"(?<![.\w'#])(?:if|while|loop|match|for(?=\s[^{;]*?\bin\b))\b"),
    "csharp": re.compile(_C_LIKE + r"|(?<=\s)switch\s*\{"),
}
_CONTROL |= dict.fromkeys(("javascript", "typescript", "c", "cpp"), re.compile(_C_LIKE))


def control_lines(text: str, lang: str) -> list[int]:
    """The lines (from 1) of the control structures of a text, outside strings, comments and preprocessor lines."""
    plain = blanked(text.replace("\r\n", "\n").replace("\r", "\n"), lang)
    if lang in ("c", "cpp", "csharp"):
        plain = re.sub(r"(?m)^[ \t]*#[^\n]*", lambda m: "\x01" * len(m[0]), plain)
    ends = [m.start() for m in re.finditer("\n", plain)]
    at = [m.start() for m in _CONTROL[lang].finditer(plain)]
    if lang == "python":  # lines inside brackets or behind a backslash continue an expression
        marks = [(m.start(), 1 if m[0] in "([{" else -1) for m in re.finditer(r"[()\[\]{}]", plain)]
        depth, i, kept = 0, 0, []
        for p in at:
            while i < len(marks) and marks[i][0] < p:
                depth = max(0, depth + marks[i][1])
                i += 1
            if depth == 0 and plain[max(0, p - 2) : p] != "\\\n":
                kept.append(p)
        at = kept
    return [bisect_right(ends, p - 1) + 1 for p in at] if lang == "python" else [bisect_right(ends, p) + 1 for p in at]


def complexity_of(text: str, lang: str) -> list[dict]:
    """Each function of a text with control, the structures of which it is the innermost function, and file_control, all of the file."""
    f = [s | {"number": i} for i, s in enumerate(symbols_of(text, lang)) if s["symbol_type"] == "function" and s["name"] not in NOT_METHODS]
    lines = control_lines(text, lang)
    own = [0] * len(f)
    open_, i = [], 0  # of the functions around a line, the last to begin is on top
    for n in lines:
        while i < len(f) and f[i]["start_line"] <= n:
            open_.append(i)
            i += 1
        while open_ and f[open_[-1]]["end_line"] < n:
            open_.pop()
        if open_:
            own[open_[-1]] += 1
    return [s | {"control": c, "file_control": len(lines)} for s, c in zip(f, own)]


def _run_complexity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [{"repo": repo, "path": path, "language": lang} | {k: s[k] for k in ("owner_class", "name", "number", "start_line", "end_line", "control", "file_control")} for repo, path, lang, text in zip(*[b.column(i).to_pylist() for i in range(4)]) for s in complexity_of(text, lang)]
        yield pa.RecordBatch.from_pylist(rows, _COMPLEXITY)


_COMPLEXITY = pa.schema([*[(c, pa.string()) for c in ("repo", "path", "language", "owner_class", "name")], *[(c, pa.int32()) for c in ("number", "start_line", "end_line", "control", "file_control")]])
_COLS = [("symbol_type", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("parameters", pa.list_(pa.string())), ("is_async", pa.bool_()), ("parent_class", pa.string()), ("owner_class", pa.string()), ("number", pa.int32()), ("parent", pa.int32())]
_SCHEMA = pa.schema([("repo", pa.string()), ("path", pa.string()), ("language", pa.string()), *_COLS])
_DDL = "repo STRING, path STRING, language STRING, symbol_type STRING, kind STRING, name STRING, start_line INT, end_line INT, parameters ARRAY<STRING>, is_async BOOLEAN, parent_class STRING, owner_class STRING, number INT, parent INT"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: dict[str, list] = {f: [] for f in _SCHEMA.names}
        for repo, path, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            for i, s in enumerate(symbols_of(text.as_py(), lang)):
                for k, v in (s | {"repo": repo, "path": path, "language": lang, "number": i}).items():
                    cols[k].append(v)
        yield pa.RecordBatch.from_pydict(cols, _SCHEMA)


def symbols(sources: DataFrame) -> DataFrame:
    """(repo, path, language, symbol_type, kind, name, start_line, end_line, parameters, is_async, parent_class, owner_class, number, parent).

    number counts a file's symbols in order of their lines, parent is the number of the innermost symbol around, -1 at the
    top. A Go method outside its type is owned by its receiver. Files of unknown languages and null texts have no symbols.
    """
    s = sources.where(F.col("language").isin(list(_RULES)) & F.col("text").isNotNull())
    return s.select("repo", "path", "language", "text").mapInArrow(_run, _DDL)


def complexity(sources: DataFrame) -> DataFrame:
    """(repo, path, language, owner_class, name, number, start_line, end_line, control, file_control): functions with the control structures of their own, those of functions inside them aside, and of their file."""
    s = sources.where(F.col("language").isin(list(_RULES)) & F.col("text").isNotNull())
    return s.select("repo", "path", "language", "text").mapInArrow(_run_complexity, "repo STRING, path STRING, language STRING, owner_class STRING, name STRING, number INT, start_line INT, end_line INT, control INT, file_control INT")


def signatures(symbol: DataFrame) -> DataFrame:
    """Functions with their signature, ``name(p, q)``."""
    f = symbol.where("symbol_type = 'function'")
    return f.select("repo", "path", "owner_class", "name", F.concat("name", F.lit("("), F.array_join("parameters", ", "), F.lit(")")).alias("signature"), F.size("parameters").alias("n_params"), "is_async", (F.col("end_line") - F.col("start_line") + 1).alias("lines"))


def ast(symbol: DataFrame) -> DataFrame:
    """The tree of each file: a root over the whole file, types and functions below it, as (record_id, node_no, parent_no, node_type, name, start_line, end_line)."""
    kind = F.when(F.col("symbol_type") == "class", F.when(F.col("kind") == "impl", "class").otherwise(F.col("kind"))).when(F.col("owner_class").isNotNull(), "method").otherwise("function")
    key = F.concat_ws("/", "repo", "path").alias("record_id")
    nodes = symbol.select(key, (F.col("number") + 1).alias("node_no"), (F.col("parent") + 1).alias("parent_no"), kind.alias("node_type"), "name", "start_line", "end_line")
    roots = symbol.groupBy("repo", "path").agg(F.max("end_line").alias("end_line")).select(key, F.lit(0).alias("node_no"), F.lit(-1).alias("parent_no"), F.lit("file_root").alias("node_type"), F.lit("").alias("name"), F.lit(1).alias("start_line"), "end_line")
    return roots.unionByName(nodes)
