"""One form for texts that look the same.

Characters that the form may change (by normalization quick-check, width, invisibility, kind of blank or likeness to a
Latin character) are unstable. Only runs of them, with the character before as context, are normalised and spliced back;
texts without any stay untouched in the JVM. Texts of equal form and different characters belong together.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.shared import ensure_checkpoint_dir
from .common import table

#: What looks like an ASCII letter or sign, of Cyrillic, Greek, Armenian, Cherokee, Lisu, phonetic letters and
#: punctuation. ASCII itself never changes, so texts of ASCII alone are their own form.
LOOKS_LIKE = {
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СᏟꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "ꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧ", "I": "ІΙꓲ", "J": "ЈᎫꓙ", "K": "КΚᏦꓗ", "L": "Ꮮꓡ", "M": "МΜᎷꓟ", "N": "Νꓠ",
    "O": "ОΟՕꓳ", "P": "РΡᏢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔ", "U": "Սꓴ", "V": "Ꮩꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫ", "Y": "Υꓬ", "Z": "ΖᏃꓜ",
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "іı", "j": "јϳ", "l": "Ɩ", "n": "ո", "o": "оοօ", "p": "р", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "ν", "w": "ԝ", "x": "х", "y": "у",
    "-": "‐‑‒−﹣", "'": "’‘ʼ′´", '"': "“”″", ",": "‚¸", "/": "∕⁄", ":": "∶ː", ".": "․", "!": "ǃ", "*": "∗", "~": "∼˜",
}
ALIKE = {ch: plain for plain, chars in LOOKS_LIKE.items() for ch in chars}
#: Compatibility mappings that keep the look, and ranges in which any of them does (leaders, Roman numerals, radicals,
#: ligatures).
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<font>"}
SAME_LOOK_RANGES = ((0x2024, 0x2026), (0x2160, 0x217F), (0x2E80, 0x2FD5), (0xFB00, 0xFB06), (0xF900, 0xFAFF))
KEPT_CONTROLS = "\t\n"
#: What can't be told stable at a glance: the JVM passes only texts with such a character on. (Java tries the ranges of a
#: long class one after the other; Python's classes are bit maps, so the precise test is made there.)
GLANCE = r"[^\t\n\x20-\x7e]"


def invisible(ch: str) -> bool:
    """Format characters and controls that show nothing; also fillers and variation selectors."""
    if ch in KEPT_CONTROLS:
        return False
    return unicodedata.category(ch) in ("Cf", "Cc") or ch in "͏ᅟᅠ឴឵ㅤﾠ" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF


@lru_cache(maxsize=None)
def spelled(ch: str) -> str:
    """Decomposed form of one character, look-alikes replaced."""
    if invisible(ch):
        return ""
    if unicodedata.category(ch) == "Zs":
        return " "
    if ch in ALIKE:
        return ALIKE[ch]
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if tag.startswith("<"):
        if tag in SAME_LOOK or any(a <= ord(ch) <= b for a, b in SAME_LOOK_RANGES):
            return "".join(map(spelled, "".join(chr(int(x, 16)) for x in rest.split())))
        return ch
    plain = unicodedata.normalize("NFD", ch)
    return ch if plain == ch else "".join(map(spelled, plain))


def canonical(text: str) -> str:
    """The form of a whole text; the reference for ``spliced``."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(map(spelled, text))))


@lru_cache(maxsize=1)
def segment_pattern() -> str:
    """A run of unstable characters, which the form may change or which may join the one before, with the character before it."""
    runs: list[list[int]] = []
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if (kind := unicodedata.category(ch)) in ("Cn", "Co", "Cs"):
            continue
        joins = kind[0] == "M" or 0x1100 <= cp <= 0x11FF
        if joins or (ch != " " and unicodedata.normalize("NFC", spelled(ch)) != ch):
            if runs and runs[-1][1] == cp - 1:
                runs[-1][1] = cp
            else:
                runs.append([cp, cp])
    inner = "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)
    return f"[^{inner}]?[{inner}]+"


@lru_cache(maxsize=2)
def compiled(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern, re.S)


def spliced(text: str, pattern: str | None = None) -> str:
    return compiled(pattern or segment_pattern()).sub(lambda m: canonical(m[0]), text)


def _spliced(text: Column) -> Column:
    """The pattern, some thousand characters, is made once and sent along."""
    pattern = segment_pattern()

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else spliced(t, pattern))

    return run(text)


def same_look(text: Column) -> Column:
    """The common form of a text. Null stays null, empty stays empty."""
    return F.when(text.rlike(GLANCE), _spliced(text)).otherwise(text)


KEY = ("scope", "f1", "f2")


def formed(rows: DataFrame) -> DataFrame:
    """(scope, id, f1, f2, raw) of rows (scope, id, text) with a text: two hashes of the form, one of the text, as good as 128
    bits. The texts are read and formed once and never shuffled; the numbers stay in a checkpoint."""
    form = F.when(F.col("_u"), _spliced(F.when(F.col("_u"), F.col("text")))).otherwise(F.col("text"))
    t = rows.where("text is not null").withColumn("_u", F.col("text").rlike(GLANCE)).withColumn("_f", form)
    ensure_checkpoint_dir(rows.sparkSession)
    return t.select("scope", "id", F.xxhash64(F.lit(5), "_f").alias("f1"), F.xxhash64(F.lit(6), "_f", F.length("_f")).alias("f2"), F.xxhash64(F.lit(7), "text").alias("raw")).checkpoint()


def alike(rows: DataFrame) -> DataFrame:
    """(scope, id_a, id_b), id_a < id_b, of rows (scope, id, text) that look the same but are not equal.

    Repeated rows count once, null texts are like nothing. Groups are reduced to their distinct texts first; only groups
    of several are paired, and never two equal texts. Hot forms are split by the skew join.
    """
    t = formed(rows)
    mixed = t.groupBy(*KEY).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select(*KEY)
    members = t.join(mixed, list(KEY), "left_semi").distinct()
    # Pairs of different texts of a form, then their rows: never two rows of one text, however many there are.
    texts = members.select(*KEY, "raw").distinct()
    couples = texts.join(texts.withColumnRenamed("raw", "raw2"), list(KEY)).where("raw < raw2")
    one = couples.join(members, [*KEY, "raw"])
    two = one.join(members.select(*KEY, F.col("raw").alias("raw2"), F.col("id").alias("id2")), [*KEY, "raw2"])
    return two.where("id <> id2").select("scope", F.least("id", "id2").alias("id_a"), F.greatest("id", "id2").alias("id_b")).distinct()


def classes(rows: DataFrame) -> DataFrame:
    """(scope, id, class_id) of every row that looks like a different one: class_id is the least id of the form. Repeated rows
    count once; the result grows with the rows, however large a class is."""
    t = formed(rows)
    mixed = t.groupBy(*KEY).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.min("id").alias("class_id")).where("lo <> hi").select(*KEY, "class_id")
    return t.join(mixed, list(KEY)).select("scope", "id", "class_id").distinct()


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "text_item").select(F.lit("item").alias("scope"), F.col("item_ord").alias("id"), "text")
    files = table(spark, sf, "corpus_file").where("suffix = '.py'").select(F.lit("file").alias("scope"), F.col("file_id").alias("id"), F.col("content").alias("text"))
    return items.unionByName(files)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return alike(_texts(spark, sf))


def p7_classes(spark: SparkSession, sf: str) -> DataFrame:
    return classes(_texts(spark, sf))


def sql_forms() -> str:
    """CTEs ending in ``t(scope, id, text, form)`` for DuckDB: every character spelled by a table of those that change."""
    changed = []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.category(ch) not in ("Cn", "Co", "Cs") and (s := spelled(ch)) != unicodedata.normalize("NFD", ch):
            changed.append((cp, s))
    changed += [(cp, "") for cp in (*range(1, 32), 127) if invisible(chr(cp))]
    values = ", ".join("({}, {})".format(cp, " || ".join(f"chr({ord(c)})" for c in s) or "''") for cp, s in changed)
    return f"""src AS (SELECT 'item' AS scope, item_ord AS id, text FROM text_item WHERE text IS NOT NULL UNION SELECT 'file', file_id, content FROM corpus_file WHERE suffix = '.py' AND content IS NOT NULL),
m(cp, s) AS MATERIALIZED (VALUES {values}),
d AS MATERIALIZED (SELECT DISTINCT text FROM src WHERE text <> ''),
c AS (SELECT text, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS k FROM d),
f AS (SELECT text, nfc_normalize(string_agg(coalesce(s, c), '' ORDER BY k)) AS form FROM c LEFT JOIN m ON cp = unicode(c) GROUP BY text),
t AS MATERIALIZED (SELECT scope, id, text, coalesce(form, '') AS form FROM src LEFT JOIN f USING (text))"""


ORACLES = {
    "p7_found": f"WITH {sql_forms()} SELECT DISTINCT a.scope, a.id AS id_a, b.id AS id_b FROM t a JOIN t b ON a.scope = b.scope AND a.form = b.form AND a.text <> b.text AND a.id < b.id",
    "p7_classes": f"WITH {sql_forms()}, g AS (SELECT scope, form, min(id) AS class_id FROM t GROUP BY ALL HAVING count(DISTINCT text) > 1) SELECT DISTINCT scope, id, class_id FROM t JOIN g USING (scope, form)",
}
QUERIES = {"p7_found": p7_found, "p7_classes": p7_classes}
