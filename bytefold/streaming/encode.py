"""Encoding of streams: a stateless projection, so the batch operators apply as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tokenizer import Tokenizer


def encode_stream(stream: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    return stream.withColumn("ids", tokenizer.encode(F.col(text)))


def write_encoded(stream: DataFrame, tokenizer: Tokenizer, path: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Appends (all columns, ids) as Parquet, exactly once, and ends with what is there now."""
    out = encode_stream(stream, tokenizer, text)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
