"""Packing of documents into containers of fixed capacity.

Documents are spread over shards large enough that a few open containers at the end of each do not matter. In a shard,
sum-of-squares packing puts every item, largest first, into the fill level that leaves the least sum of squared numbers
of partially filled containers; those numbers are kept in an array over the levels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .p8_encode import encode

#: Most items of a shard: bounds a task's memory and time. Small inputs are one shard.
SHARD_ITEMS = 1 << 16


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container, offset) of items of 1..capacity, placed in the order given.

    Of equally good levels the fullest is taken. A container is opened only where that, too, is best.
    """
    count = np.zeros(capacity + 1, np.int64)  # open containers by level; full and empty ones are not partially filled
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, opened = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    big = np.iinfo(np.int64).max
    for k, s in enumerate(sizes.tolist()):
        top = capacity - s
        change = count[s : capacity + 1] - count[: top + 1]  # of the squares, halved, less one: N(h+s) - N(h)
        cost = 2 * change + 2
        cost[top] = 1 - 2 * count[top]  # filled up
        cost[1:][count[1 : top + 1] == 0] = big
        cost[0] = 2 * count[s] + 1 if s < capacity else 0  # a new one
        h = top - int(np.argmin(cost[::-1]))
        if h:
            count[h] -= 1
            c = stacks[h].pop()
        else:
            c, opened = opened, opened + 1
        if h + s < capacity:
            count[h + s] += 1
            stacks[h + s].append(c)
        where[k], offset[k] = c, h
    return where, offset


def pack(items: DataFrame, key: str, size: str, containers: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container_type, container_no, key, piece, start, n_tokens, offset) of every item for every container type.

    Items beyond the capacity are split into full pieces and a rest; others are never split. Items of null or no size
    come out once with null container_no. Repeated keys are items of their own. ``containers`` is a small reference table.
    """
    n = items.count()
    shards = max(1, math.ceil(n / shard_items))
    kinds = containers.select("container_type", F.col("capacity_tokens").cast("long").alias("_cap")).where("_cap > 0")
    base = items.select(F.col(key), F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("_n"), F.monotonically_increasing_id().alias("_row"))
    every = base.withColumn("_kind", F.explode(F.array(*[F.struct(F.lit(r[0]).alias("t"), F.lit(r[1]).alias("cap")) for r in kinds.collect()]) if n else F.array().cast("array<struct<t:string,cap:bigint>>")))
    cap = F.col("_kind.cap")
    pieces = every.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_n") / cap) - 1, F.lit(0))))).select(
        F.col("_kind.t").alias("container_type"), cap.alias("_cap"), key, "_row", "piece", (F.col("piece") * cap).alias("start"), F.least(cap, F.col("_n") - F.col("piece") * cap).alias("n_tokens")
    )
    pieces = pieces.withColumn("_shard", F.pmod(F.xxhash64("_row", "container_type"), F.lit(shards))).drop("_row")  # rows of one key are spread, too
    kind = items.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", key, "piece"], ascending=[False, True, True], kind="stable")
        real = pdf["n_tokens"].to_numpy() > 0
        no, at = np.full(len(pdf), -1, np.int64), np.zeros(len(pdf), np.int64)
        no[real], at[real] = sum_of_squares(pdf["n_tokens"].to_numpy(np.int64)[real], int(pdf["_cap"].iloc[0]))
        number = pd.array(no * shards + int(pdf["_shard"].iloc[0]), dtype="Int64")
        number[~real] = pd.NA
        return pdf.assign(container_no=number, offset=at)[["container_type", "container_no", key, "piece", "start", "n_tokens", "offset"]]

    return pieces.groupBy("container_type", "_shard").applyInPandas(run, f"container_type string, container_no long, `{key}` {kind}, piece long, start long, n_tokens long, offset long")


def p9_packing(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.shared import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    sizes = encode(table(spark, sf, "documents"), "doc_id", "text", sizes=True).checkpoint()  # two numbers a document
    return pack(sizes, "doc_id", "n_tokens", table(spark, sf, "container"))


def p9_check(spark: SparkSession, sf: str) -> DataFrame:
    """(container_type, n_documents, n_overfull, n_split, n_lost): what the packing must keep, counted from its rows: every document
    once for each type, no container beyond its capacity, no document split that fits, no tokens lost."""
    kinds = F.broadcast(table(spark, sf, "container").select("container_type", F.col("capacity_tokens").alias("cap")))
    rows = p9_packing(spark, sf).join(kinds, "container_type")
    fill = rows.where("container_no is not null").groupBy("container_type", "container_no").agg((F.sum("n_tokens") > F.first("cap")).cast("int").alias("over")).groupBy("container_type").agg(F.sum("over").alias("n_overfull"))
    end = F.max(F.col("start") + F.col("n_tokens"))
    of_doc = rows.groupBy("container_type", "doc_id").agg(F.sum((F.col("piece") == 0).cast("int")).alias("n"), ((F.max("piece") > 0) & (end <= F.first("cap"))).cast("int").alias("split"), (F.sum("n_tokens") != F.sum((F.col("piece") == 0).cast("int")) * end).cast("int").alias("lost"))
    of_doc = of_doc.groupBy("container_type").agg(F.sum("n").alias("n_documents"), F.sum("split").alias("n_split"), F.sum("lost").alias("n_lost"))
    return of_doc.join(fill, "container_type", "left").select("container_type", "n_documents", F.coalesce("n_overfull", F.lit(0)).alias("n_overfull"), "n_split", "n_lost")


QUERIES = {"p9_packing": p9_packing, "p9_check": p9_check}
ORACLES = {"p9_check": "SELECT container_type, (SELECT count(*) FROM documents) AS n_documents, 0::BIGINT AS n_overfull, 0::BIGINT AS n_split, 0::BIGINT AS n_lost FROM container"}
