"""Lossless splitting of text into chunks as one JVM regular expression."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode_classes import KINDS, SURROGATES, as_class, char_class, ranges

APOSTROPHES = ".'’\\-"


def _named(group: str, wanted: set[str]) -> str:
    """A Java class of exactly the ``wanted`` characters, by a category of Java's where the two Unicode versions agree.

    Java tests long lists of ranges one by one, but categories by table, so only the differences are written out.
    """
    every = "".join(chr(cp) for cp in range(0x80, 0x110000) if cp not in SURROGATES)
    jvm = SparkContext._active_spark_context._jvm
    java = set(jvm.java.util.regex.Pattern.compile(f"[^{group}]+").matcher(every).replaceAll(""))
    wrong, missing = as_class(java - wanted), as_class(wanted - java)
    return f"[[^\\x00-\\x7f]&&[{group}]" + (f"&&[^{wrong}]" if wrong else "") + "]" + missing


@lru_cache(maxsize=1)
def java_classes() -> tuple[str, str, str, str]:
    """Insides of bracket expressions for Latin, digits, other letters and white space; ASCII is decided first."""
    beyond = {k: {chr(cp) for a, b in ranges()[k] for cp in range(max(a, 0x80), b + 1)} for k in ("LATIN_WORD", "DIGIT", "UNICODE_WORD", "SPACE")}
    ascii_part = {k: as_class({chr(cp) for a, b in ranges()[k] for cp in range(a, min(b, 0x7F) + 1)}) for k in beyond}
    listed = lambda k: f"{ascii_part[k]}[[^\\x00-\\x7f]&&[{as_class(beyond[k])}]]"
    return listed("LATIN_WORD"), ascii_part["DIGIT"] + _named(r"\p{N}", beyond["DIGIT"]), _named(r"\p{L}\p{M}", beyond["UNICODE_WORD"]), listed("SPACE")


@lru_cache(maxsize=1)
def pattern() -> str:
    """Chunk pattern. Possessive groups keep Java's matcher from recursing on runs of any length."""
    lat, dig, uni, spc = java_classes()
    # Runs are loops over one class, which Java makes without a group; a group is entered for a connector only.
    word = "|".join((rf"[{lat}][{lat}{dig}]*+(?:[{APOSTROPHES}][{lat}{dig}]++)*+", rf"[{dig}]++(?:[.\-][{dig}]++)*+", rf"[{uni}]++", rf"\.[{lat}][{lat}{dig}]*+"))
    return rf"(?s) (?:{word})|[{spc}]++|</|{word}|(.)\1*+"


@lru_cache(maxsize=1)
def re2_pattern() -> str:
    """The same for RE2, which has no back-references: other characters come out singly, and equal neighbours are joined later."""
    lat, dig, uni, spc = (char_class(k) for k in ("LATIN_WORD", "DIGIT", "UNICODE_WORD", "SPACE"))
    word = "|".join((rf"[{lat}](?:[{APOSTROPHES}]?[{lat}{dig}])*", rf"[{dig}](?:[.\-]?[{dig}])*", rf"[{uni}]+", rf"\.[{lat}][{lat}{dig}]*"))
    return rf"(?s) (?:{word})|[{spc}]+|</|{word}|<+|\.+|."


def pretokenize(text: Column) -> Column:
    """Array of chunks whose concatenation is the text; null and empty texts give an empty array."""
    return F.when(F.length(text) > 0, F.regexp_extract_all(text, F.lit(pattern()), F.lit(0))).otherwise(F.array().cast("array<string>"))


def char_kind(ch: Column) -> Column:
    """Kind of a one-character string."""
    out = F.when(F.lit(False), "")
    for k in KINDS[:-1]:
        out = out.when(ch.rlike(f"^[{char_class(k)}]$"), k)
    return out.otherwise(KINDS[-1])


def split_specials(text: Column, specials: list[str]) -> Column:
    """Array of alternating plain and special parts of a text; the longest special wins at a place."""
    if not specials:
        return F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    alt = "|".join("\\Q" + s + "\\E" for s in sorted(specials, key=len, reverse=True))
    parts = F.regexp_extract_all(text, F.lit(f"(?s)(?:{alt})|(?:(?!{alt}).)++"), F.lit(0))
    return F.when(F.length(text) > 0, parts).otherwise(F.array().cast("array<string>"))
