"""Trimming and splitting as the line rules need them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# fixed value: the characters with the Unicode property White_Space
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_white(c: Column) -> Column:
    """Trims all Unicode white space, not only blanks."""
    return F.trim(c, F.lit(WHITE))


def canonical_id(c: Column) -> Column:
    """Trimmed and lower-cased; blank becomes null."""
    plain = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")  # nothing to trim, seen at little cost
    t = F.lower(F.when(plain, c).otherwise(trim_white(c)))
    return F.when(F.length(t) > 0, t)
