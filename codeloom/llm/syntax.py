"""Source files that are not valid in their language.

1. Each file is lexed into a row: its tokens' kinds as a string, one character a token, and its distinct adjacent pairs.
2. The pairs, exploded into rows, are anti-joined with the pairs the language's productions permit.
3. Nesting and productions: the innermost brackets of a file are checked against what may stand in them and replaced by
   one character, again and again, until the top remains; the contents seen before are looked up. For Python the logical
   lines are then checked, and the blocks that indentation makes of them.

Productions are matched by automata in linear time, so no file is given up, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm import grammar
from codeloom.session import Stage

_INNER = re.compile(r"\(([^()\[\]{}]*)\)|\[([^()\[\]{}]*)\]|\{([^()\[\]{}]*)\}")
_AS = {"(": "G", "[": "A", "{": "B"}
_WIDTH, _BASE = 0xE000, 0x1800
_DIGITS = 3


def _digits(n: int) -> str:
    """A width as three characters of the private area; no text is as long as they reach."""
    return chr(_WIDTH + n // _BASE // _BASE) + chr(_WIDTH + n // _BASE % _BASE) + chr(_WIDTH + n % _BASE)


def _number(digits: str) -> int:
    a, b, c = (ord(x) - _WIDTH for x in digits)
    return (a * _BASE + b) * _BASE + c


class Checker:
    """Lexes and checks texts of one language; remembers what it has seen."""

    def __init__(self, name: str):
        self.lang = grammar.language(name)
        self.python = name == "python"
        self.kinds = grammar.Kinds(self.lang)
        self.seen: dict[tuple[str, str], bool] = {}
        self.lines: dict[str, str] = {}

    def lex(self, text: str) -> str:
        """Kinds of the tokens; ``!`` is text that is no token. A leading byte-order mark is dropped, line ends are unified."""
        if text[:1] == "\ufeff":
            text = text[1:]
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if "\0" in text:
            return "!"
        if text[:2] == "#!" and self.lang.name in ("javascript", "typescript", "python", "rust") and text[2:3] != "[":
            text = text[text.find("\n") :] if "\n" in text else ""
        if self.python:
            return self._lex_python(text)
        tokens = [m.group() for m in self.lang.lex.finditer(text)] if self.lang.lex.groups else self.lang.lex.findall(text)
        k = "".join(map(self.kinds.__getitem__, tokens))
        return self.lang.newline(k) if self.lang.newline else k

    def _lex_python(self, text: str) -> str:
        out = []
        for t in self.lang.lex.findall("\n" + text):
            if t[0] == "\n":
                w = t[t.rfind("\n") + 1 :]  # tabs count to the next multiple of eight, and as one: both must agree
                out.append("L" + _digits(len(w.expandtabs(8))) + _digits(len(w)))
            else:
                out.append(self.kinds[t])
        k = "".join(out)
        return re.sub("^(?:L[\ue000-\uf8ff]{6})+(?=L)|(?:L[\ue000-\uf8ff]{6})+$", "", k)

    def _inside(self, m: re.Match) -> str:
        whole = m.group()
        o, body = whole[0], whole[1:-1]
        if self.python and "L" in body:
            body = re.sub("L[\ue000-\uf8ff]{6}", "", body)
        ok = self.seen.get((o, body))
        if ok is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            ok = self.seen[o, body] = self.lang.fits(o, self._prepared(body))
        if not ok:
            raise SyntaxError(whole[:80])
        return _AS[o]

    def _prepared(self, body: str) -> str:
        for rx, rep in ((self.lang.generics, ""),) if self.lang.generics else ():
            while True:
                new = rx.sub(rep, body)
                if new == body:
                    break
                body = new
        for rx, rep in self.lang.folds:
            body = rx.sub(rep, body)
        return body

    def problem(self, kinds: str) -> str | None:
        """What is wrong with nesting or productions, or None."""
        if "!" in kinds:
            return "no token"
        k = kinds
        try:
            while True:
                new = _INNER.sub(self._inside, k)
                if new == k:
                    break
                k = new
        except SyntaxError as e:
            return f"inside {e}"
        if re.search(r"[()\[\]{}]", k):
            return "nesting"
        if self.python:
            return self._blocks(k)
        return None if self.lang.fits("top", self._prepared(k)) else "top"

    def _line(self, line: str) -> str:
        """Kind of a logical line: a head that opens a block, the same in lower case with its suite on the line, ``@``, ``s`` or ``!``."""
        c = self.lines.get(line)
        if c is None:
            if len(self.lines) > 300_000:
                self.lines.clear()
            c = "!"
            if self.lang.fits("top", line):
                c = "s"
            elif line[0] == "@":
                c = "@" if self.lang.fits("decorator", line) else "!"
            else:
                cuts = [i + 1 for i, x in enumerate(line) if x == ":"]
                heads = ((h, i) for h in self.lang.heads for i in reversed(cuts) if self.lang.fits(f"head {h}", line[:i]))
                c = next((h + "01"[i < len(line)] for h, i in heads if i == len(line) or self.lang.fits("top", line[i:])), "!")
            self.lines[line] = c
        return c

    def _blocks(self, k: str) -> str | None:
        stack, alt, owner, opener = [0], [0], [""], ""
        opens, last = False, {0: ""}  # last: what stood before at each level
        for part in k.split("L")[1:]:
            w, w1, line = _number(part[:_DIGITS]), _number(part[_DIGITS : 2 * _DIGITS]), part[2 * _DIGITS :]
            if not line:
                continue
            c = self._line(line)
            if c == "!":
                return f"line {line[:80]}"
            if opens:
                if w <= stack[-1]:
                    return "no block"
                if w1 <= alt[-1]:
                    return "tabs and spaces"
                stack.append(w)
                alt.append(w1)
                owner.append(opener)
                last[len(stack)] = ""
            elif w > stack[-1]:
                return "indent"
            while w < stack[-1]:
                if last.get(len(stack)) == "T" or last.get(len(stack)) == "@":
                    return "try or decorator without more"
                stack.pop()
                alt.pop()
                owner.pop()
            if w != stack[-1]:
                return "dedent"
            if w1 != alt[-1]:
                return "tabs and spaces"
            d, b = len(stack), c[0]
            before = last.get(d, "")
            if (b == "j") != (owner[-1] == "C"):
                return "match without cases or case without match"
            opener = b
            if b in "eE" and not (before in tuple("Ie") or b == "E" and before in tuple("FWH")):
                return "else without if"
            if b == "H" and before not in ("T", "H") or b == "Y" and before not in ("T", "H", "h"):
                return "except without try"
            if before == "T" and b not in "HY" or before == "@" and b not in "fc@":
                return "try or decorator without more"
            last[d] = "h" if b == "E" and before == "H" else b
            opens = c[-1] == "0"
        if opens:
            return "no block"
        return "try or decorator without more" if any(last.get(i) in ("T", "@") for i in range(1, len(stack) + 1)) else None

    @staticmethod
    def pairs(kinds: str) -> set[str]:
        k = re.sub("[\ue000-\uf8ff]", "", kinds)
        return set(map("".join, zip(k, k[1:])))


def of_language(path: Column, language: Column) -> Column:
    """The given language, trimmed and lower-cased; where null, blank or ``unknown``, that of the path's extension; else null."""
    given = F.lower(F.trim(language))
    ext = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    by_ext = F.create_map(*[F.lit(x) for kv in grammar.EXTENSIONS.items() for x in kv])
    return F.when(given.isNotNull() & ~given.isin("", "unknown"), given).otherwise(F.try_element_at(by_ext, ext))


def with_language(source_files: DataFrame, files: DataFrame) -> DataFrame:
    """source_files with the column ``lang``. Of several rows of files for one file the latest non-null language that is not unknown counts."""
    usable = F.lower(F.trim("language"))
    one = files.where(usable.isNotNull() & ~usable.isin("", "unknown")).groupBy("file_id").agg(F.max_by(usable, F.struct("analyzed_at", "ingested_at", usable)).alias("_given"))
    return source_files.join(one, "file_id", "left").withColumn("lang", of_language(F.col("path"), F.col("_given"))).drop("_given")


def _decode(content: bytes | None) -> str | None:
    return None if content is None else bytes(content).decode("utf-8", "replace")


_LEX = pa.schema([("file_id", pa.int64()), ("lang", pa.string()), ("kinds", pa.string()), ("pairs", pa.list_(pa.string()))])


def _lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    checkers: dict[str, Checker] = {}
    for b in batches:
        ids, langs, kinds, pairs = [], [], [], []
        for i, lang, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            c = checkers.get(lang) or checkers.setdefault(lang, Checker(lang))
            k = c.lex(_decode(content.as_py()) or "")
            ids.append(i)
            langs.append(lang)
            kinds.append(k)
            pairs.append(sorted(c.pairs(k)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs), pa.array(kinds), pa.array(pairs, pa.list_(pa.string()))], schema=_LEX)


def lexed(files: DataFrame) -> DataFrame:
    """files (file_id, lang, content) → (file_id, lang, kinds, pairs); files of other languages and of null content are left out."""
    f = files.where(F.col("lang").isin(*grammar.LANGUAGES) & F.col("content").isNotNull()).select("file_id", "lang", "content")
    return f.mapInArrow(_lex, "file_id BIGINT, lang STRING, kinds STRING, pairs ARRAY<STRING>")


_REASON = pa.schema([("file_id", pa.int64()), ("lang", pa.string()), ("reason", pa.string())])


def _productions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    checkers: dict[str, Checker] = {}
    for b in batches:
        bad = []
        for i, lang, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            c = checkers.get(lang) or checkers.setdefault(lang, Checker(lang))
            if r := c.problem(k):
                bad.append((i, lang, r))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*bad)] if bad else [pa.array([], f.type) for f in _REASON], schema=_REASON)


def unparsable(files: DataFrame) -> DataFrame:
    """files (file_id, lang, content) → (file_id, lang, reason) of the files that are no valid text of their language.

    Empty files and a leading byte-order mark are valid; null content, and languages without productions, are no cases.
    Invalid UTF-8 is read with replacement characters, which are no tokens outside strings and comments.
    """
    spark = files.sparkSession
    tokens = Stage(spark, "tokens").put(lexed(files))
    allowed = spark.createDataFrame([(n, p) for n in grammar.LANGUAGES for p in sorted(grammar.permissible_pairs(n))], "lang STRING, pair STRING")
    # The permissible pairs are a property of the grammars, not of the data (some ten thousand rows), so they are broadcast.
    pairs = tokens.select("file_id", "lang", F.explode("pairs").alias("pair"))
    strange = pairs.join(F.broadcast(allowed), ["lang", "pair"], "left_anti").groupBy("file_id", "lang").agg(F.concat(F.lit("pair "), F.min("pair")).alias("reason"))
    broken = tokens.select("file_id", "lang", "kinds").mapInArrow(_productions, "file_id BIGINT, lang STRING, reason STRING")
    return strange.unionByName(broken).groupBy("file_id", "lang").agg(F.min("reason").alias("reason"))


def rates(files: DataFrame, flagged: DataFrame) -> DataFrame:
    """(repo, language, files, unparsable, rate) of the files with a known language; null repos form a group."""
    known = files.where(F.col("lang").isin(*grammar.LANGUAGES) & F.col("content").isNotNull()).select("file_id", "repo", "lang")
    all_ = known.join(flagged.select("file_id", F.lit(1).alias("bad")), "file_id", "left")
    return all_.groupBy("repo", F.col("lang").alias("language")).agg(F.count("*").alias("files"), F.count("bad").alias("unparsable"), F.round(F.count("bad") / F.count("*"), 6).alias("rate"))
