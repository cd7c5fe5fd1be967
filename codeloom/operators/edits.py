"""Edits of texts as expressions: a preview is a projection, a confirmation writes its result once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import code


def _join(ls: Column) -> Column:
    return F.array_join(ls, "\n")


def replace(text: Column, pattern: str, by: str, *, ignore_case: bool = False, whole_word: bool = False, regex: bool = False) -> Column:
    """All occurrences replaced. Plain text unless regex; whole words and ignoring case work for both."""
    if not pattern:
        raise ValueError("the pattern is empty")
    if not (ignore_case or whole_word or regex):
        return F.replace(text, F.lit(pattern), F.lit(by))
    p = pattern if regex else "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    p = rf"\b(?:{p})\b" if whole_word else p
    to = by if regex else re.sub(r"([\\$])", r"\\\1", by)
    return F.regexp_replace(text, ("(?i)" if ignore_case else "") + p, to)


def count(text: Column, pattern: str) -> Column:
    return code.occurrences(text, pattern)


def insert(text: Column, position: int, new: str) -> Column:
    """new as line ``position`` (from 1); 0 or a place past the end appends."""
    ls, add = code.lines(text), F.array(F.lit(new))
    if position < 1:
        return _join(F.concat(ls, add))
    return _join(F.when(F.size(ls) < position, F.concat(ls, add)).otherwise(F.concat(F.slice(ls, 1, position - 1), add, F.slice(ls, position, F.greatest(F.size(ls) - position + 1, F.lit(0))))))


def insert_beside(text: Column, marker: str, new: str, after: bool = True) -> Column:
    """new before or after the first line that contains marker; without one the text stays."""
    ls, add = code.lines(text), F.array(F.lit(new))
    at = F.array_position(F.transform(ls, lambda x: F.contains(x, F.lit(marker))), F.lit(True))
    cut = (at if after else at - 1).cast("int")
    return F.when(at == 0, text).otherwise(_join(F.concat(F.slice(ls, F.lit(1), cut), add, F.slice(ls, cut + 1, F.size(ls) - cut))))


def taken(text: Column, start: int, n: int) -> Column:
    """n lines from line start (from 1), fewer where the text ends; none where it ends before."""
    if start < 1:
        raise ValueError("lines count from 1")
    return F.slice(code.lines(text), start, n)


def without(text: Column, start: int, n: int) -> Column:
    ls = code.lines(text)
    return _join(F.concat(F.slice(ls, 1, start - 1), F.slice(ls, start + n, F.greatest(F.size(ls) - (start + n - 1), F.lit(0)))))


def move_lines(source: Column, start: int, n: int, target: Column, position: int) -> tuple[Column, Column]:
    """(source without the lines, target with them at position). Raises at run time where start is past the source's end."""
    moved = taken(source, start, n)
    ls = code.lines(target)
    at = F.when(F.lit(position) < 1, F.size(ls)).otherwise(F.least(F.lit(position) - 1, F.size(ls)))
    checked = F.when(F.size(code.lines(source)) < start, F.raise_error(F.lit("the first line is past the end")).cast("string")).otherwise(without(source, start, n))
    return checked, _join(F.concat(F.slice(ls, F.lit(1), at), moved, F.slice(ls, at + 1, F.size(ls) - at)))


def move_span(df: DataFrame, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """(source, target, start, end) → texts after moving the lines of a symbol to the end of the target, runs of blank lines collapsed to one."""
    ls = code.lines(F.col("source"))
    s, e = F.col(start), F.col(end)
    rest = F.concat(F.slice(ls, F.lit(1), s - 1), F.slice(ls, e + 1, F.greatest(F.size(ls) - e, F.lit(0))))
    body = F.slice(ls, s, e - s + 1)
    squeeze = lambda c: F.regexp_replace(c, r"\n{3,}", "\n\n")
    return df.withColumns({"new_source": squeeze(_join(rest)), "new_target": squeeze(_join(F.concat(code.lines(F.col("target")), F.array(F.lit("")), body)))})


def preview(df: DataFrame, before: str, after: str, cap: int = 10) -> DataFrame:
    """Changed lines side by side, the first cap of them per row."""
    a, b = code.lines(F.col(before)), code.lines(F.col(after))
    z = F.filter(F.arrays_zip(a.alias("a"), b.alias("b"), F.sequence(F.lit(1), F.greatest(F.size(a), F.size(b), F.lit(1))).alias("n")), lambda x: ~x["0"].eqNullSafe(x["1"]))
    return df.withColumn("preview", F.transform(F.slice(z, 1, cap), lambda x: F.format_string("%d: %s -> %s", x["2"], F.coalesce(x["0"], F.lit("")), F.coalesce(x["1"], F.lit("")))))


def confirm(previews: DataFrame, id_: str) -> DataFrame:
    """The preview with its state set; fails if it was confirmed before or does not exist."""
    row = previews.where(F.col("id") == id_).select("confirmed").limit(1).collect()
    if not row:
        raise KeyError(id_)
    if row[0][0]:
        raise ValueError(f"{id_} was confirmed before")
    return previews.withColumn("confirmed", F.col("confirmed") | (F.col("id") == id_))
