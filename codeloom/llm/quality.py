"""Figures that tell natural prose from lists, tables, code, boilerplate and junk, one row per document.

Texts are cut into lines and paragraphs. A line is an item of a list, a row of a table, of a log or of a dump, code in a
fence, a heading, or running text. Running text that stood in the document before, as a line or as a whole paragraph, is
boilerplate. What remains is prose if it reads like it: enough common words (or kana), few symbols, word-like words, and no
n-gram that dominates it. A document is prose if most of its characters are and no n-gram dominates the whole of it.

Characters are counted by class in one pass over their code points; n-grams of a batch are counted by sorting, all
documents and paragraphs together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Common words may be many languages' lists, but they are sent to every task and so are bounded.
MAX_COMMON = 100_000

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+(?:[.,]\d+)*")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"“”„«»‘’()…—–\-、。「」『』・！？]|_")
_END = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")
_BULLET = re.compile(r"(?:[-*+•‣◦▪·–—]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX]\]|[☐☑✓✔✗])\s+(?=\S)")
_TABLE = re.compile(r"^\|.*\||\|[^|]*\||\t.*\t|</?t[rdh]\b|</?table|^[-=+|:\s]{6,}$|\S {3,}\S.*\S {3,}\S|\S {6,}\S|^[^,\s][^,]*(?:,[^,\s][^,]*){2,}$")
_LOG = re.compile(r"^\W?\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d|^\W?\d\d:\d\d:\d\d\b|^(?:at |File \")\S|^Traceback\b|^(?:\[?(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b)")
_HEX = re.compile(r"^[0-9a-f]{4,}:?\s+(?:[0-9a-f]{2,4}\s+){3,}")
_HEAD = re.compile(r"^#{1,6}\s|^[=\-~]{3,}$")
_MOJIBAKE = re.compile(r"[ãâÃÂå-é][\x80-\xbf]|[\x80-\x9f]|\ufffd")
_ODD = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]|[A-Za-z][~#0](?!\w)")
_CODE = re.compile(r"[;{}]$|^[{}@]|\)\s*(?:->.*)?:$|^[\w.]+ [-+*/]?= |^(?:return|import|from|def|fn|func|use|let|const|var)\b.*[({]|^(?://|/\*|\"{3})")
_IDENT = re.compile(r"[a-z]+(?:_[a-z0-9]+)+|[a-z]+[A-Z]\w*|[A-Z][a-z]+[A-Z]\w*")


#: Share of the words' characters from which an n-gram dominates a text.
DOMINANT = 0.5
#: Remembered words of a task; beyond that they are forgotten and looked up again.
MEMORY = 500_000

# classes of characters
_SPACE, _SIGN, _IDEO, _SYLLABLE, _SUSPECT = 1, 2, 3, 4, 5


def _class_table() -> np.ndarray:
    t = np.zeros(0x110000, np.uint8)
    chars = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    for c in chars:
        if c.isspace():
            t[ord(c)] = _SPACE
        elif _SYMBOL.match(c):
            t[ord(c)] = _SIGN
    for i in range(0x10000, 0x110000, 256):
        block = "".join(map(chr, range(i, i + 256)))
        for m in _SYMBOL.finditer(block):
            t[i + m.start()] = _SIGN
    t[0x3400:0xA000] = _IDEO
    t[0x3040:0x3100] = _SYLLABLE
    t[0x80:0xC0] = np.where(t[0x80:0xC0] == 0, _SUSPECT, t[0x80:0xC0])
    return t


_TABLE_OF_CLASSES: list[np.ndarray] = []


def _classes(text: str) -> np.ndarray:
    """How many characters of each class a text has."""
    if not _TABLE_OF_CLASSES:
        _TABLE_OF_CLASSES.append(_class_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_TABLE_OF_CLASSES[0][codes], minlength=6)


def _letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """What n-grams are made of where words are not set apart: each character, of length one."""
    ids = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return ids, np.ones(len(ids), np.int64)


class Words(dict):
    """Remembers of each word its number (alike for upper and lower case), length, and whether it is common, and a number."""

    def __init__(self, common: frozenset[str]):
        self.common, self.numbers = common, {}

    def __missing__(self, w: str) -> tuple[int, int, bool, bool]:
        if len(self) > MEMORY:
            self.clear()
        low = w.lower()
        out = self[w] = (self.numbers.setdefault(low, len(self.numbers)), len(w), low in self.common, w[0].isdigit())
        return out


def covers(texts: list[tuple[np.ndarray, np.ndarray]], most: int = 4) -> np.ndarray:
    """texts (words' numbers, words' lengths) → for each text and n from 2 to most the share of its words' characters that the n-gram covers that covers most; 0 unless it occurs twice without overlap."""
    out = np.zeros((len(texts), most - 1))
    sizes = np.array([len(ids) for ids, _ in texts], np.int64)
    if not sizes.sum():
        return out
    ids, lens = np.concatenate([x for x, _ in texts]).astype(np.int64), np.concatenate([x for _, x in texts]).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    total = np.maximum(np.bincount(text, lens, len(texts)), 1)
    ends = np.concatenate([[0], np.cumsum(lens)])
    gram = ids
    for n in range(2, most + 1):
        at = len(ids) - n + 1
        if at < 1:
            break
        gram = gram[:at] * (ids.max() + 1) + ids[n - 1 :]
        _, gram = np.unique(gram, return_inverse=True)
        fit = np.flatnonzero(text[:at] == text[n - 1 :])  # those that cross from text to text are left out
        key = text[fit] * (gram.max() + 1) + gram[fit]
        order = np.argsort(key, kind="stable")
        k, where = key[order], fit[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([start, [len(k)]]))
        close = np.concatenate([[False], (k[1:] == k[:-1]) & (where[1:] - where[:-1] < n)]) if len(k) else np.zeros(0, bool)
        for g in np.unique(np.searchsorted(start, np.flatnonzero(close), "right") - 1).tolist():
            last, c = -n, 0
            for p in where[start[g] : start[g] + count[g]].tolist():
                if p - last >= n:
                    last, c = p, c + 1
            count[g] = c
        first = where[start]
        size = (ends[first + n] - ends[first]) * count
        twice = count > 1
        np.maximum.at(out[:, n - 2], text[first[twice]], size[twice] / total[text[first[twice]]])
    return np.minimum(out, 1.0)


def ngram_cover(words: list[str], n: int) -> float:
    """Share of the words' characters that the n-gram covers that covers most; 0 unless it occurs twice."""
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    return float(covers([(ids, np.array([len(w) for w in words], np.int64))], n)[0, n - 2])


class _Run:
    """A stretch of running text with what decides whether it reads like prose."""

    __slots__ = ("size", "fits", "ids", "lens")

    def __init__(self, lines: list[str], size: int, memo: Words):
        text = "\n".join(lines)
        bare = re.sub(r"`[^`\n]{1,60}`|https?://\S+", " x ", text) if "`" in text or "://" in text else text
        n = _classes(bare)
        chars = int(n.sum() - n[_SPACE]) or 1
        ideo = int(n[_IDEO] + n[_SYLLABLE])
        symbols = int(n[_SIGN]) / chars
        self.size = size
        self.ids, self.lens, self.fits = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        if (n[_SUSPECT] or "\ufffd" in bare or n[_SPACE] and "\x85" in bare) and len(_MOJIBAKE.findall(bare)) > 0.02 * chars:
            return
        if ideo > 0.3 * chars:
            self.ids, self.lens = _letters(bare)
            self.fits = int(n[_SYLLABLE]) > 0.25 * ideo and symbols < 0.08
            return
        words = [memo[w] for w in _WORD.findall(bare)]
        if not words:
            return
        ids, lens, common, digits = zip(*words)
        k, letters = len(words), sum(lens)
        self.ids, self.lens = np.array(ids), np.array(lens)
        code = sum(bool(_CODE.search(x.strip())) for x in lines) > 0.4 * len(lines)
        known = sum(common)
        joints = len(_ODD.findall(bare))
        # one half and one: so the share means the same for short texts
        self.fits = not code and joints <= 0.15 * k and symbols <= 0.06 and letters >= 0.7 * chars and sum(digits) <= 0.3 * k and letters <= 12 * k and 0 < known and (known + 0.5) / (k + 1) >= 0.15 and (not joints and "_" not in bare or len(_IDENT.findall(bare)) <= 0.2 * k)


class _Parts:
    """Lines of one text by kind."""

    def __init__(self, text: str, memo: Words):
        self.kinds: Counter = Counter()
        self.runs: list[_Run] = []
        self.memo = memo
        self.run: list[tuple[str, str]] = []  # as they stand and without quotation marks
        self.seen: set[str] = set()
        fence = item = False
        for raw in text.split("\n"):
            x = raw.strip()
            n = len(x.replace(" ", ""))
            if x[:3] in ("```", "~~~"):
                self.close()
                fence = not fence
                continue
            if fence:
                self.kinds["code"] += n
                continue
            if not x:
                self.close()
                item = False
                continue
            q = re.sub(r"^(?:>\s?)+", "", x) if x[0] == ">" else x
            if _HEAD.match(q):
                self.close()
                self.kinds["head"] += n
                item = False
            elif _LOG.search(q) or _HEX.match(q):
                self.close()
                self.kinds["log"] += n
            elif _TABLE.search(q):
                self.close()
                self.kinds["table"] += n
            elif _BULLET.match(q):
                self.close()
                self.kinds["list"] += n
                item = True
            elif item and raw[:1].isspace():
                self.kinds["list"] += n  # an item's further lines are indented
            else:
                item = False
                self.run.append((x, q))
        self.close()

    def close(self) -> None:
        """Ends a stretch of running text; lines and whole stretches that stood in the text before are boilerplate. A quotation is no copy of what it quotes."""
        if not self.run:
            return
        whole = "\n".join(x for x, _ in self.run).lower()
        fresh, old = [], 0
        again = whole in self.seen
        for x, q in self.run:
            low = x.lower()
            if again or low in self.seen:
                old += len("".join(q.split()))
            else:
                fresh.append(q)
                self.seen.add(low)
        self.seen.add(whole)
        if old:
            self.kinds["boilerplate"] += old
        if fresh:
            self.runs.append(_Run(fresh, sum(len("".join(q.split())) for q in fresh), self.memo))
        self.run = []


def batch_figures(texts: list[str | None], memo: Words) -> list[dict]:
    """All figures of each text; of null or blank text they are 0 or false and is_blank is true."""
    clean = [(t or "").replace("\r\n", "\n").replace("\r", "\n") for t in texts]
    parts = [_Parts(t, memo) for t in clean]
    words = [[memo[w] for w in _WORD.findall(t)] for t in clean]
    counts = [_classes(t) for t in clean]
    every = [_letters(t) if n[_IDEO] + n[_SYLLABLE] > 0.3 * (n.sum() - n[_SPACE]) else (np.array([w[0] for w in ws], np.int64), np.array([w[1] for w in ws], np.int64)) for t, n, ws in zip(clean, counts, words)]
    runs = [r for p in parts for r in p.runs]
    grams = covers(every)
    in_runs = covers([(r.ids, r.lens) for r in runs])
    share = lambda k, n: float(k / n) if n else 0.0
    dup = lambda xs: share(sum(c * len(x) for x, c in Counter(xs).items() if c > 1), sum(map(len, xs)))
    out, at = [], 0
    for t, n, p, ws, g in zip(clean, counts, parts, words, grams.tolist()):
        kinds = p.kinds
        for r in p.runs:
            kinds["prose" if r.fits and in_runs[at].max() <= DOMINANT else "other"] += r.size
            at += 1
        full = [x for x in map(str.strip, t.split("\n")) if x]
        paras = [x for x in re.split(r"\n\s*\n", t.strip()) if x.strip()]
        chars = int(n.sum() - n[_SPACE])
        weighed = sum(kinds.values()) - kinds["head"]
        prose = share(kinds["prose"], weighed)
        out.append({
            "n_chars": len(t), "n_words": len(ws), "n_lines": len(full), "n_paragraphs": len(paras),
            "mean_word_length": share(sum(w[1] for w in ws), len(ws)),
            "symbol_ratio": share(int(n[_SIGN]), chars),
            "punctuated_lines": share(sum(bool(_END.search(x[-8:])) for x in full), len(full)),
            "common_words": share(sum(w[2] for w in ws), len(ws)),
            "duplicate_lines": dup(full), "duplicate_paragraphs": dup(paras),
            "top_2gram": g[0], "top_3gram": g[1], "top_4gram": g[2],
            "list_share": share(kinds["list"], weighed), "table_share": share(kinds["table"], weighed), "log_share": share(kinds["log"], weighed), "code_share": share(kinds["code"], weighed),
            "boilerplate_share": share(kinds["boilerplate"], weighed), "prose_share": prose, "is_blank": chars == 0, "is_prose": chars > 0 and prose > 0.5 and max(g) <= DOMINANT,
        })
    return out


def figures(text: str | None, common: frozenset[str]) -> dict:
    return batch_figures([text], Words(common))[0]


#: Documents whose n-grams are counted together.
ROWS = 1000
_INTS = ("n_chars", "n_words", "n_lines", "n_paragraphs")
_NAMES = list(figures("", frozenset()))
DDL = "doc_id BIGINT, " + ", ".join(f"{n} {'BIGINT' if n in _INTS else 'BOOLEAN' if n.startswith('is_') else 'DOUBLE'}" for n in _NAMES)


def statistics(documents: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents → (doc_id, figures ...), one row per row; whole texts, of any length. common_words (word) are compared lower-cased."""
    words = [r[0] for r in common_words.where("word IS NOT NULL").select(F.lower("word")).distinct().limit(MAX_COMMON + 1).collect()]
    if len(words) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    common = frozenset(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words(common)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                rows = [{"doc_id": i} | f for i, f in zip(part.column(0).to_pylist(), batch_figures(part.column(1).to_pylist(), memo))]
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DDL)


_SCHEMA = pa.schema([("doc_id", pa.int64())] + [(n, pa.int64() if n in _INTS else pa.bool_() if n.startswith("is_") else pa.float64()) for n in _NAMES])


def not_prose(stats: DataFrame) -> DataFrame:
    """Documents with non-blank text that is, for the most part, no natural prose."""
    return stats.where("NOT is_blank AND NOT is_prose").select("doc_id")
