"""Corpus folders as text items."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Suffixes read line by line, and line ends besides the line feed (fixed values).
LINE_SUFFIXES = (".txt", ".log", ".html", ".htm")
PLAIN_LINE_SUFFIXES = (".txt", ".log")
TERMINATORS = "\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """NFC form; Spark has no built-in for it. Null stays null."""
    return text.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def lines(text: Column) -> Column:
    """Lines without their line feeds, other terminators kept, empty lines and ``===`` left out."""
    found = F.regexp_extract_all(text, F.lit(f"[^{TERMINATORS}]*+[{TERMINATORS}]|[^{TERMINATORS}]++"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, "\n+$", "")), lambda x: (x != "") & (x != "==="))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def items(files: DataFrame, path: str = "path", content: str = "content", line_suffixes: tuple[str, ...] = LINE_SUFFIXES, clean: bool = True) -> DataFrame:
    """(path, line_no, text) of text files: lines of line-based suffixes, else the whole file.

    Line ends become line feeds; ``clean`` also takes off one byte order mark and brings texts to NFC.
    Null contents give nothing, an empty whole file one empty item.
    """
    text = F.regexp_replace(F.col(content), "\r\n?", "\n")
    if clean:
        text = nfc(F.regexp_replace(text, "^\ufeff", ""))
    rows = files.select(F.col(path).alias("path"), text.alias("_text")).where("_text is not null")
    rows = rows.withColumn("_items", F.when(suffix(F.col("path")).isin(*line_suffixes), lines(F.col("_text"))).otherwise(F.array("_text")))
    return rows.select("path", F.posexplode("_items").alias("line_no", "text"))


def load_folder(spark: SparkSession, folder: str, plain: bool = False) -> DataFrame:
    """(item_ord, path, line_no, text) of the UTF-8 files below a folder, in order of path components; others are skipped.

    ``plain`` takes lines of .txt and .log only and leaves marks and forms as they are. A missing folder or a file in
    its place raises, except with ``plain``.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not plain:
        if not fs.exists(root):
            raise FileNotFoundError(folder)
        if not fs.getFileStatus(root).isDirectory():
            raise NotADirectoryError(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.select("path", F.col("content").cast("string").alias("content")).where(F.is_valid_utf8("content"))
    rows = items(files, line_suffixes=PLAIN_LINE_SUFFIXES if plain else LINE_SUFFIXES, clean=not plain)
    rows = rows.orderBy(F.split("path", "/"), "line_no")
    return rows.select(F.monotonically_increasing_id().alias("item_ord"), "path", "line_no", "text")
