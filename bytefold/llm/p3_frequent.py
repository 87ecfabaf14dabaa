"""Most frequent items of columns with very many distinct values, in bounded memory.

Rows are summed within bounded batches, so that a hot value leaves each batch once, and partitioned by the hash of
(field, item). Each partition keeps a count-min sketch with conservative update and a bounded heap of heavy candidates
for every field. The heaps are disjoint and merge by union. An exact recount of the few candidates follows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import ensure_checkpoint_dir
from .common import table

#: Cells in a row of the sketch (a power of two), rows, candidates kept in a heap, rows summed before they leave a task.
WIDTH, DEPTH, HEAP, BATCH_ROWS = 1 << 16, 4, 2048, 1 << 18
SHARE = 0.004
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class HeavySketch:
    """Count-min sketch with conservative update and a bounded heap of the items of largest estimate.

    A batch of distinct items is updated at once from the estimates before it, so a cell never falls below the true
    count of an item in it. Memory: WIDTH * DEPTH counters and HEAP items.
    """

    def __init__(self, width: int = WIDTH, depth: int = DEPTH, heap: int = HEAP) -> None:
        self.cells, self.shift, self.heap = np.zeros((depth, width), np.int64), np.uint64(64 - int(math.log2(width))), heap
        self.hashes, self.items, self.counts, self.total = np.zeros(0, np.uint64), np.zeros(0, object), np.zeros(0, np.int64), 0

    def places(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes[None, :] * MULTIPLIERS[: len(self.cells), None]) >> self.shift).astype(np.int64)

    def update(self, hashes: np.ndarray, items: np.ndarray, counts: np.ndarray) -> None:
        """With distinct items and their summed counts."""
        at = self.places(hashes)
        rows = np.arange(len(self.cells))[:, None]
        estimate = self.cells[rows, at].min(axis=0) + counts
        for k in range(len(self.cells)):
            np.maximum.at(self.cells[k], at[k], estimate)
        self.total += int(counts.sum())
        if len(self.counts) >= self.heap:
            likely = estimate > self.counts.min()
            hashes, items, estimate = hashes[likely], items[likely], estimate[likely]
        fresh = ~np.isin(self.hashes, hashes)
        h, i, c = (np.concatenate([old[fresh], new]) for old, new in ((self.hashes, hashes), (self.items, items), (self.counts, estimate)))
        if len(c) > self.heap:
            top = np.argpartition(c, len(c) - self.heap)[-self.heap :]
            h, i, c = h[top], i[top], c[top]
        self.hashes, self.items, self.counts = h, i, c


def sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of w by (field, item, h) over up to BATCH_ROWS rows at a time."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.Table.from_batches(held).group_by(["field", "item", "h"]).aggregate([("w", "sum")])
            yield from t.select(["field", "item", "h", "w_sum"]).rename_columns(["field", "item", "h", "w"]).to_batches()
            held.clear()

    rows = 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows >= BATCH_ROWS:
            yield from flush()
            rows = 0
    yield from flush()


def sketch(batches: Iterator[pd.DataFrame], share: float = SHARE) -> Iterator[pd.DataFrame]:
    """(field, item, n) of a partition's heaps, and a row with null item for each field's total.

    Candidates below the share of the partition's own total are below that of the whole, too, and stay behind, so a
    partition gives at most about 1/share items of a field.
    """
    sketches: dict[str, HeavySketch] = {}
    for b in batches:
        for field, part in b.groupby("field"):
            part = part.groupby("h", sort=False).agg(item=("item", "first"), w=("w", "sum"))
            sketches.setdefault(field, HeavySketch()).update(part.index.to_numpy().astype(np.int64).view(np.uint64), part["item"].to_numpy(object), part["w"].to_numpy(np.int64))
    for field, s in sketches.items():
        heavy = s.counts >= share * s.total
        yield pd.DataFrame({"field": field, "item": [None, *s.items[heavy]], "n": [s.total, *s.counts[heavy]]})


def weighted(columns: dict[str, tuple[DataFrame, object, object]]) -> DataFrame:
    """(field, item, h, w) of columns given as field -> (table, item, weight); null items and null weights count nothing."""
    out = None
    for field, (df, item, weight) in columns.items():
        part = df.select(F.lit(field).alias("field"), item.alias("item"), weight.cast("long").alias("w")).where("item is not null and w is not null")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("h", F.xxhash64("field", "item")).select("field", "item", "h", "w")


def frequent(columns: dict[str, tuple[DataFrame, object, object]], share: float = SHARE) -> DataFrame:
    """(field, item, n, total) of items with at least ``share`` of their field's weight; n is exact.

    An item of that share is among at most 1/share of a field, far fewer than a heap holds, and is never
    underestimated, so it can't be missed. Ties all come out; a field without rows gives none.
    """
    rows = weighted(columns)
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = rows.mapInArrow(sum_batches, "field string, item string, h long, w long").repartition(parts, "h")
    heaps = summed.mapInPandas(partial(sketch, share=share), "field string, item string, n long").checkpoint()  # a few hundred rows a partition
    total = heaps.where("item is null").groupBy("field").agg(F.sum("n").alias("total"))  # a row per field
    wanted = heaps.where("item is not null").join(F.broadcast(total), "field").where(F.col("n") >= share * F.col("total")).select("field", "item", "total")
    # At most about 1/share items a field pass, so they may be broadcast.
    exact = rows.join(F.broadcast(wanted), ["field", "item"]).groupBy("field", "item").agg(F.sum("w").alias("n"), F.first("total").alias("total"))
    return exact.where(F.col("n") >= share * F.col("total")).select("field", "item", "n", "total")


def _columns(spark: SparkSession, sf: str) -> dict:
    one = F.lit(1)
    return {
        "corpus": (table(spark, sf, "corpus_chunk"), F.col("chunk"), one),
        "merge_counts": (table(spark, sf, "merge_count"), F.concat(F.col("left_id").cast("string"), F.lit(","), F.col("right_id").cast("string")), F.col("n")),
        "final_token_counts": (table(spark, sf, "token_count"), F.col("token_id").cast("string"), F.col("n")),
    }


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return frequent(_columns(spark, sf)).select("field", "item")


def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    return frequent(_columns(spark, sf)).select("field", "item", "n")


QUERIES = {"p3_found": p3_found, "p3_counts": p3_counts}
_ALL = f"""WITH r AS (SELECT 'corpus' AS field, chunk AS item, 1 AS w FROM corpus_chunk UNION ALL SELECT 'merge_counts', left_id || ',' || right_id, n FROM merge_count UNION ALL SELECT 'final_token_counts', token_id::VARCHAR, n FROM token_count),
s AS (SELECT field, item, sum(w)::BIGINT AS n FROM r WHERE item IS NOT NULL AND w IS NOT NULL GROUP BY 1, 2),
f AS (SELECT *, sum(n) OVER (PARTITION BY field) AS total FROM s)"""
ORACLES = {"p3_found": f"{_ALL} SELECT field, item FROM f WHERE n >= {SHARE} * total", "p3_counts": f"{_ALL} SELECT field, item, n FROM f WHERE n >= {SHARE} * total"}
