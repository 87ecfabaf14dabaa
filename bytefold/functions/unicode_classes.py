"""Character kinds of the pretokenizer as regular-expression ranges, computed from ``unicodedata``.

The ranges are built once per process by the rule below, so the JVM regular expression, the DuckDB oracle
and the Python helpers all use the same Unicode version (that of the Python build).
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

KINDS = ("SPACE", "LATIN_WORD", "DIGIT", "UNICODE_WORD", "PUNCT", "SYMBOL", "OTHER")
SURROGATES = range(0xD800, 0xE000)


def is_latin(ch: str) -> bool:
    if ch == "_" or (ch.isascii() and ch.isalpha()):
        return True
    return unicodedata.category(ch)[0] in "LM" and "LATIN" in unicodedata.name(ch, "")


def char_kind(ch: str) -> str:
    """Kind of one character; the first rule that holds decides."""
    if ch.isspace():
        return "SPACE"
    if is_latin(ch):
        return "LATIN_WORD"
    by_category = {"N": "DIGIT", "L": "UNICODE_WORD", "M": "UNICODE_WORD", "P": "PUNCT", "S": "SYMBOL"}
    return by_category.get(unicodedata.category(ch)[0], "OTHER")


@lru_cache(maxsize=1)
def ranges() -> dict[str, tuple[tuple[int, int], ...]]:
    """Inclusive code point ranges of each kind, surrogates left out."""
    out: dict[str, list[list[int]]] = {k: [] for k in KINDS}
    for cp in range(sys.maxunicode + 1):
        if cp in SURROGATES:
            continue
        runs = out[char_kind(chr(cp))]
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return {k: tuple((a, b) for a, b in v) for k, v in out.items()}


@lru_cache(maxsize=None)
def char_class(*kinds: str) -> str:
    """Inside of a bracket expression, in the ``\\x{..}`` notation that Java and RE2 share."""
    return "".join(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for k in kinds for a, b in ranges()[k])


def as_class(chars: set[str]) -> str:
    """Inside of a bracket expression of the given characters."""
    runs: list[list[int]] = []
    for cp in sorted(map(ord, chars)):
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(rf"\x{{{a:x}}}" if a == b else rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs)
