"""Token sequences as strings with one code point per token.

Bytes 0..255 are the code points U+0000..U+00FF (a Latin-1 reading of the UTF-8 bytes), learned token ``t`` is
U+10000+t. Merging a pair everywhere, left to right without overlap, is then the built-in ``replace``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEARNED = 0x10000


def token_char(token: int) -> str:
    return chr(token if token < 256 else LEARNED + token)


def from_text(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def from_ids(ids: Column) -> Column:
    """Of an array of byte ids (0..255); null elements are skipped."""
    raw = F.unhex(F.array_join(F.transform(ids, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return F.decode(raw, "ISO-8859-1")


def chars(tokens: Column) -> Column:
    return F.when(F.length(tokens) > 0, F.split(tokens, "")).otherwise(F.array().cast("array<string>"))


def char_id(ch: Column) -> Column:
    code = F.ascii(ch)
    return F.when(code >= LEARNED, code - LEARNED).otherwise(code).cast("int")


def to_ids(tokens: Column) -> Column:
    return F.transform(chars(tokens), char_id)


def merge(tokens: Column, left: int, right: int, new: int) -> Column:
    return F.replace(tokens, F.lit(token_char(left) + token_char(right)), F.lit(token_char(new)))


def bound(value: Column, use) -> Column:
    """``use`` of a value computed once; inside a higher-order function an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pairs(tokens: Column) -> Column:
    """Array of (pair, off) of every adjacent pair, overlapping ones included."""

    def of(cs: Column) -> Column:
        at = F.when(F.size(cs) > 1, F.sequence(F.lit(1), F.size(cs) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.concat(F.get(cs, i - 1), F.get(cs, i)).alias("pair"), i.alias("off")))

    return bound(chars(tokens), of)


def pack_pair(left: Column, right: Column) -> Column:
    """One 64-bit key of a pair of ids."""
    return F.shiftleft(left.cast("long"), 32).bitwiseOR(right.cast("long"))


def unpack_pair(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 32).cast("int"), key.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
