"""Expressions over paths and source text: language, filters, lines, complexity, ratings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codeloom.functions.text import trim_white

# fixed values: extensions by language, filters, keywords, limits
EXTENSIONS = {
    "javascript": [".js", ".mjs", ".jsx", ".cjs"],
    "typescript": [".ts", ".tsx"],
    "cpp": [".cpp", ".cxx", ".cc", ".hpp", ".hxx", ".hh"],
    "c": [".c", ".h"],
    "python": [".py", ".pyw", ".pyi"],
    "csharp": [".cs"],
    "go": [".go"],
    "rust": [".rs"],
}
DISPLAY = {"javascript": "JavaScript", "typescript": "TypeScript", "cpp": "Cpp", "c": "C", "python": "Python", "csharp": "CSharp", "go": "Go", "rust": "Rust"}
EXCLUDED = ["node_modules", ".git", "dist", "build", "__pycache__", "target"]
WATCH_EXCLUDED = [".git", "node_modules", "target", ".DS_Store", "*.tmp", "*.log"]
WATCH_IMPORTANT = ["Makefile", "Dockerfile", "LICENSE", "README", "CHANGELOG", "Jenkinsfile", ".gitignore", ".dockerignore", ".env", "package.json", "Cargo.toml", "go.mod", "requirements.txt"]
TEST_NAMES = ["test", "spec"]
TEST_PATHS = ["__tests__", "/test/", "/tests/", "/spec/", "/specs/", ".test.js", ".test.ts", ".spec.js", ".spec.ts"]
_JS = ["if ", "else if", "else ", "for ", "while ", "do ", "switch ", "case ", "catch ", "&&", "||", "? ", ".then(", ".catch(", "async ", "await "]
KEYWORDS = {
    "javascript": _JS,
    "typescript": _JS,
    "python": ["if ", "elif ", "else:", "for ", "while ", "try:", "except", "finally:", "with ", "and ", "or ", "lambda", "yield", "async def", "await ", "list comprehension", "dict comprehension"],
    "csharp": ["if (", "else if", "else {", "for (", "foreach (", "while (", "do {", "switch (", "case ", "catch (", "&&", "||", "? ", "??", "async ", "await ", "yield ", "try {", "throw "],
    "cpp": ["if (", "else if", "else {", "for (", "while (", "do {", "switch (", "case ", "catch (", "&&", "||", "? ", "template<", "try {", "throw "],
    "go": ["if ", "else ", "for ", "switch ", "case ", "select ", "go ", "defer ", "&&", "||", "?"],
    "rust": ["if ", "else ", "for ", "while ", "loop ", "match ", "if let", "while let", "&&", "||", "?", "async ", "await", " => "],
}
LINQ = ["from ", "where ", "select ", "group ", "join ", "orderby "]
RATINGS = [(10, "simple"), (20, "moderate"), (50, "complex"), (None, "very_complex")]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def language(path: Column) -> Column:
    """Language of the lower-cased extension, or ``unknown``; null for a null path."""
    e = extension(path)
    out = F.when(path.isNull(), F.lit(None).cast("string"))
    for lang, ext in EXTENSIONS.items():
        out = out.when(e.isin(ext), lang)
    return out.otherwise("unknown")


def display_name(lang: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in DISPLAY.items() for x in kv])
    return F.coalesce(F.try_element_at(m, lang), F.lit("Unknown"))


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def excluded(path: Column, patterns: list[str] | None = None) -> Column:
    """Whether the whole path contains one of the patterns, as plain text."""
    return _any([F.contains(path, F.lit(p)) for p in patterns or EXCLUDED])


def is_test(path: Column) -> Column:
    """By name or folder; a folder at the top of a relative path counts as one below a root."""
    low = F.concat(F.lit("/"), F.lower(path))
    return _any([F.contains(file_name(low), F.lit(p)) for p in TEST_NAMES] + [F.contains(low, F.lit(p)) for p in TEST_PATHS])


def is_source(path: Column) -> Column:
    return extension(path).isin([e for v in EXTENSIONS.values() for e in v])


def is_watched(path: Column) -> Column:
    """Not excluded, and either an important file or one with a source extension."""
    return ~excluded(path, WATCH_EXCLUDED) & (file_name(path).isin(WATCH_IMPORTANT) | is_source(path))


def normal_path(path: Column) -> Column:
    """Resolves ``.`` and ``..``; a ``..`` above the start is dropped. No loop: a fold over the segments."""
    parts = F.split(path, "/")
    empty = F.array().cast("array<string>")
    stack = F.aggregate(parts, empty, lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(stack, "/"))


def lines(text: Column) -> Column:
    """Lines without their ends; no empty line after a last line end; an empty text has none."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


def line_kind(line: Column, lang: Column) -> Column:
    t = trim_white(line)
    comment = F.when(lang == "python", t.startswith("#")).otherwise(t.startswith("//") | t.startswith("/*") | t.startswith("*"))
    return F.when(t == "", "empty").when(comment, "comment").otherwise("code")


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a fixed text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("int")


def cyclomatic(text: Column, lang: Column) -> Column:
    """1 + occurrences of the language's keywords, overlapping ones counting twice; 1 where the language has none."""
    out = None
    for name, words in KEYWORDS.items():
        score = F.lit(1)
        for w in words:
            score = score + occurrences(text, w)
        if name == "python":
            score = score + F.floor((occurrences(text, "[") + occurrences(text, "{")) / 4).cast("int")
        if name == "csharp":
            for w in LINQ:
                score = score + F.floor(occurrences(text, w) / 2).cast("int")
        out = F.when(lang == name, score) if out is None else out.when(lang == name, score)
    return out.otherwise(F.lit(1))


def brace_depth(text: Column) -> Column:
    """Greatest number of open braces, closing ones without partner being ignored."""
    signs = F.split(F.regexp_replace(text, r"[^{}]", ""), "")
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))

    def step(a, x):
        d = F.when(x == "{", a["d"] + 1).when((x == "}") & (a["d"] > 0), a["d"] - 1).otherwise(a["d"])
        return F.struct(d.alias("d"), F.greatest(a["m"], d).alias("m"))

    return F.aggregate(signs, zero, step, lambda a: a["m"])


def indent_depth(text: Column) -> Column:
    """Greatest indentation in steps of four, blank and comment lines left out."""
    real = F.filter(lines(text), lambda x: ~F.ltrim(trim_white(x)).startswith("#") & (trim_white(x) != ""))
    return F.coalesce(F.array_max(F.transform(real, lambda x: F.floor((F.octet_length(x) - F.octet_length(F.regexp_replace(x, r"^\s+", ""))) / 4).cast("int"))), F.lit(0))


def nesting(text: Column, lang: Column) -> Column:
    return F.when(lang == "python", indent_depth(text)).otherwise(brace_depth(text))


def rating(score: Column) -> Column:
    out = None
    for top, name in RATINGS[:-1]:
        out = F.when(score <= top, name) if out is None else out.when(score <= top, name)
    return out.otherwise(RATINGS[-1][1])


def signature(name: Column, parameters: Column) -> Column:
    return F.concat(name, F.lit("("), F.array_join(parameters, ", "), F.lit(")"))


def risk(change: Column, breaking: Column, references: Column) -> Column:
    return (
        F.when(change.endswith("removed") & (references > 0), "high")
        .when(breaking | (references > 10), "high")
        .when((references > 3) | (change == "signature_changed"), "medium")
        .otherwise("low")
    )


def risk_rank(level: Column) -> Column:
    return F.when(level == "high", 3).when(level == "medium", 2).otherwise(1)


def full_call(function: Column, obj: Column, is_method: Column) -> Column:
    return F.when(is_method & obj.isNotNull(), F.concat_ws(".", obj, function)).otherwise(function)


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def risk_of_count(changes: Column) -> Column:
    """Up to 2 changes low, up to 10 medium, more high."""
    return F.when(changes <= 2, "low").when(changes <= 10, "medium").otherwise("high")


def note_type(text: Column, types: list[str]) -> Column:
    """The type a text names, whatever its case; null for others."""
    low = F.lower(F.trim(text))
    return F.when(low.isin(types), low)


def is_hidden(path: Column) -> Column:
    return file_name(path).startswith(".")


def relative(path: Column, base: str) -> Column:
    """The path below base; a path elsewhere stays."""
    b = base.rstrip("/") + "/"
    return F.when(path.startswith(b), F.substring(path, len(b) + 1, 1 << 20)).otherwise(path)


def typed_signature(name: Column, parameters: Column, returns: Column) -> Column:
    """``name(a: T, b) -> R`` from an array of structs (name, type); what has no type shows none."""
    each = F.transform(parameters, lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["type"]), F.lit(""))))
    return F.concat(name, F.lit("("), F.array_join(each, ", "), F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), returns), F.lit("")))
