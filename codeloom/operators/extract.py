"""Functions, classes and imports of source files, as rows.

Names come from expressions that run on the JVM over the whole text; the line of a match is the number of line ends before
it. No row is built in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import code
from codeloom.functions.text import WHITE

# fixed values: (kind, expression, group of the name) by language
FUNCTIONS = {
    "javascript": [
        (r"(?m)^\s*(?:async\s+)?function\s+(\w+)\s*\(", "function"),
        (r"(?m)^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>", "arrow"),
        (r"(?m)^\s*(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{", "method"),
        (r"export\s+(?:async\s+)?function\s+(\w+)\s*\(", "export"),
    ],
    "python": [(r"(?m)^\s*(?:async\s+)?def\s+(\w+)\s*\(", "function"), (r"(?m)^\s*(\w+)\s*=\s*lambda", "lambda")],
    "go": [(r"func\s+(?:\([^)]*\)\s+)?(\w+)\s*\([^)]*\)", "function")],
    "rust": [(r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", "function")],
    "cpp": [(r"(?m)^\s*(?:virtual\s+|static\s+|inline\s+)*\w+(?:\s*::\s*\w+)*\s+(\w+)\s*\([^)]*\)\s*(?:const\s*)?(?:override\s*|final\s*)?(?:\s*\{\s*|\s*;)", "function")],
    "csharp": [(r"(?m)^\s*(?:public|private|protected|internal)?\s*(?:static|virtual|override|abstract|sealed|async)?\s*\w+(?:<[^>]*>)?\s+(\w+)\s*\([^)]*\)\s*(?:\{|;)", "method")],
}
NOT_METHODS = ["if", "for", "while", "switch", "try", "catch", "class", "function", "const", "let", "var", "return"]
CLASSES = {
    "javascript": [(r"(?m)^\s*(?:export\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?\s*\{", "class", 1, 2)],
    "python": [(r"(?m)^\s*class\s+(\w+)(?:\s*\(\s*([^)]+)\s*\))?\s*:", "class", 1, 2)],
    "cpp": [(r"(?m)^\s*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+(\w+)(?:\s*:\s*(?:public|private|protected)?\s*([^{]+))?\s*\{", "class", 1, 2)],
    "csharp": [(r"(?m)^\s*(?:public|private|protected|internal)?\s*(?:static|abstract|sealed|partial)?\s*(?:class|interface|struct)\s+(\w+)(?:<[^>]*>)?(?:\s*:\s*([^{]+))?\s*\{", "class", 1, 2)],
    "go": [(r"type\s+(\w+)\s+struct\s*\{()", "struct", 1, 2), (r"type\s+(\w+)\s+interface\s*\{()", "interface", 1, 2)],
    "rust": [(r"(?:pub\s+)?struct\s+(\w+)()", "struct", 1, 2), (r"(?:pub\s+)?enum\s+(\w+)()", "enum", 1, 2), (r"(?:pub\s+)?trait\s+(\w+)()", "trait", 1, 2)],
}
IMPORTS = {
    "javascript": [(r"(?m)^\s*import\s+(?:[^'\";]*?\sfrom\s+)?['\"]([^'\"]+)['\"]", "es6"), (r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", "commonjs")],
    "python": [(r"(?m)^\s*from\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s+import\s+.+", "from"), (r"(?m)^\s*import\s+([a-zA-Z_][a-zA-Z0-9_.]*)", "import")],
    "cpp": [(r"#include\s*[<\"]([^>\"\n]+)[>\"]", "include")],
    "csharp": [(r"using\s+([^;=()]+);", "using")],
    "go": [(r"(?m)^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"\n]+)\"[ \t\r]*$", "import")],
    "rust": [(r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);", "use")],
}


def steady(pattern: str) -> str:
    """The same expression with possessive runs of white space: several in a row would else be tried in every split of a long run."""
    return pattern.replace(r"\s*", r"\s*+").replace(r"\s+", r"\s++")


for _t in (FUNCTIONS, CLASSES, IMPORTS):
    _t["typescript"] = _t["javascript"]
for _t in (FUNCTIONS, CLASSES, IMPORTS):
    _t["c"] = _t["cpp"]
# imports with the list of names they bring in, groups: module and list, for JavaScript list and module. Relative imports of Python are among them
NAMED_IMPORTS = {k: [(p + "()", kind) for p, kind in v] for k, v in IMPORTS.items()}
NAMED_IMPORTS["python"] = [
    (r"(?m)^\s*from\s+([.\w]+)\s+import\b\s*(\([^)]*\)|[^\\\n;#]*(?:\\\r?\n[^\\\n;#]*)*)", "from"),
    (r"(?m)^\s*import\s+()([a-zA-Z_][^\n;#]*)", "import"),
]
NAMED_IMPORTS["javascript"] = NAMED_IMPORTS["typescript"] = [
    (r"(?m)^\s*import\b\s*(?:([^'\";]*?)\bfrom\s*)?['\"]([^'\"]+)['\"]", "es6"),
    (r"(?:\b(?:const|let|var)\s+(\{[^{}]*\}|\w+)\s*=\s*)?require\(\s*['\"]([^'\"]+)['\"]\s*\)", "commonjs"),
]
EXPORTS = {"javascript": [(r"(?m)^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\s+(\w+)", "named")]}
EXPORTS["typescript"] = EXPORTS["javascript"]
CALL = r"(?:(\w+)\.)?(\w+)\s*\("


def source_text(files: DataFrame, keep: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """Binary contents as text, with the language of the path; null contents are left out, invalid bytes replaced."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return files.where("content IS NOT NULL").select(*keep, code.language(F.col("path")).alias("language"), text.alias("text"))


def _as_row(kind: str, groups: int):
    return lambda x: F.struct(F.lit(kind).alias("kind"), *[x[f"g{i + 1}"].alias(f"g{i + 1}") for i in range(groups)])


def _found(df: DataFrame, table: dict[str, list], groups: int) -> DataFrame:
    """One row per match: language, kind and the groups g1, g2."""
    pieces = []
    for lang in dict.fromkeys(table):
        for spec in table[lang]:
            g = [F.regexp_extract_all("text", F.lit(steady(spec[0])), F.lit(i)) for i in range(1, groups + 1)]
            z = F.arrays_zip(*[c.alias(f"g{i + 1}") for i, c in enumerate(g)])
            pieces.append(F.when(F.col("language") == lang, F.transform(z, _as_row(spec[1], groups))))
    none = F.array().cast("array<struct<kind:string," + ",".join(f"g{i + 1}:string" for i in range(groups)) + ">>")
    all_ = F.concat(*[F.coalesce(p, none) for p in pieces])
    keep = [c for c in df.columns if c != "text"]
    return df.select(*keep, F.explode(all_).alias("m")).select(*keep, "m.*")


def functions(sources: DataFrame) -> DataFrame:
    """(repo, path, language, kind, name): declared functions, arrow functions, methods and lambdas, each match of each expression."""
    f = _found(sources, FUNCTIONS, 1).withColumnRenamed("g1", "name")
    return f.where(~((F.col("kind") == "method") & F.col("language").isin("javascript", "typescript") & F.col("name").isin(NOT_METHODS)))


def classes(sources: DataFrame) -> DataFrame:
    """(repo, path, language, kind, name, parent): the first of several parents; null where there is none."""
    c = _found(sources, {k: [(p, kind) for p, kind, _, _ in v] for k, v in CLASSES.items()}, 2)
    parent = F.trim(F.element_at(F.split("g2", ","), 1))
    return c.select("repo", "path", "language", "kind", F.col("g1").alias("name"), F.when(F.length(parent) > 0, parent).alias("parent"))


def imports(sources: DataFrame) -> DataFrame:
    """(repo, path, language, kind, module)."""
    return _found(sources, IMPORTS, 1).withColumn("module", F.trim("g1")).drop("g1")


def named_imports(sources: DataFrame) -> DataFrame:
    """(repo, path, language, kind, module, imported_names): each import with the names it brings in, as their file calls them, not by their alias; the words of the module are among the names."""
    i = _found(sources, NAMED_IMPORTS, 2)
    js = F.col("language").isin("javascript", "typescript")
    listed, module = F.when(js, F.col("g1")).otherwise(F.col("g2")), F.trim(F.when(js, F.col("g2")).otherwise(F.col("g1")))
    # comments, aliases, new names of destructured ones, the word type of type imports
    plain = F.regexp_replace(listed, r"//[^\n]*|/\*[\s\S]*?\*/|#[^\n]*", " ")
    plain = F.regexp_replace(plain, r"\s+as\s+\w+|:\s*\w+", "")
    plain = F.when(js, F.regexp_replace(plain, r"\btype\s+(?=\w)|\btype\s*(?=\{)", "")).otherwise(plain)
    names = F.array_distinct(F.concat(F.split(module, r"[^\w]+"), F.split(plain, r"[^\w]+")))
    module = F.when((F.col("language") == "python") & (F.col("kind") == "import"), F.regexp_extract("g2", r"^[\w.]+", 0)).otherwise(module)
    return i.select("repo", "path", "language", "kind", module.alias("module"), F.filter(names, lambda x: x != "").alias("imported_names"))


def exports(sources: DataFrame) -> DataFrame:
    return _found(sources, EXPORTS, 1).withColumnRenamed("g1", "name")


def calls(sources: DataFrame) -> DataFrame:
    """(repo, path, language, object, function, is_method): every name before a round bracket, of one or two parts."""
    c = _found(sources, {k: [(CALL, "call")] for k in FUNCTIONS}, 2)
    obj = F.when(F.length("g1") > 0, F.col("g1"))
    return c.where(~F.col("g2").isin(NOT_METHODS)).select("repo", "path", "language", obj.alias("object"), F.col("g2").alias("function"), obj.isNotNull().alias("is_method"))


def numbered_lines(sources: DataFrame) -> DataFrame:
    """(repo, path, language, line_no from 1, line)."""
    return sources.select("repo", "path", "language", F.posexplode(code.lines(F.col("text"))).alias("p", "line")).select("repo", "path", "language", (F.col("p") + 1).alias("line_no"), "line")


def matches(sources: DataFrame, pattern: str) -> DataFrame:
    """(repo, path, line_no, col, line): non-overlapping occurrences of a fixed text, columns in bytes from 1."""
    if not pattern:
        raise ValueError("the pattern is empty")
    ln = numbered_lines(sources).where(F.contains("line", F.lit(pattern)))
    parts = F.split("line", F.lit("\\Q" + pattern + "\\E"), -1)
    heads = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.octet_length(F.array_join(F.slice(parts, 1, i), pattern)) + 1)
    return ln.select("repo", "path", "line_no", F.explode(heads).alias("col"), "line")


def declared(sources: DataFrame) -> DataFrame:
    """Functions and classes in one table of symbols."""
    f = functions(sources).select("repo", "path", "language", F.lit("function").alias("symbol_type"), "kind", "name", F.lit(None).cast("string").alias("parent"))
    c = classes(sources).select("repo", "path", "language", F.lit("class").alias("symbol_type"), "kind", "name", "parent")
    return f.unionByName(c)


def text_metrics(sources: DataFrame) -> DataFrame:
    """(repo, path, language, total_lines, empty_lines, comment_lines, code_lines, code_ratio, cyclomatic, nesting, rating)."""
    # Lines are counted by expressions over the whole text: none is cut out. Each line ends with a line end here, also the last.
    t, lang = F.col("text"), F.col("language")
    white = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE if c != "\n") + "]*+"
    d = sources.select("repo", "path", "language", "text", F.when(F.length(t) > 0, F.concat(F.regexp_replace(t, r"\r?\n\z", ""), F.lit("\n"))).otherwise(F.lit("")).alias("b"))

    def count(line: str) -> Column:
        return F.regexp_count("b", F.lit(f"(?md)^{white}{line}"))

    d = d.select(
        "repo", "path", "language", "text", code.occurrences(F.col("b"), "\n").alias("total_lines"), count("\n").alias("empty_lines"),
        F.when(lang == "python", count("#")).otherwise(count(r"(?://|/\*|\*)")).alias("comment_lines"),
    ).withColumn("code_lines", F.col("total_lines") - F.col("empty_lines") - F.col("comment_lines"))
    return d.select(
        "repo", "path", "language", "total_lines", "empty_lines", "comment_lines", "code_lines",
        F.when(F.col("total_lines") > 0, F.col("code_lines") / F.col("total_lines")).otherwise(F.lit(0.0)).alias("code_ratio"), code.cyclomatic(t, lang).alias("cyclomatic"), code.nesting(t, lang).alias("nesting"),
    ).withColumn("rating", code.rating(F.col("cyclomatic")))
