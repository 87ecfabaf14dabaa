"""Visible, internal and discarded tokens, and their exported ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Reserved specials in the order of their ids (fixed values).
SPECIALS = ("<_EOS_>", "<_SOS_>", "<_SEP_>", "<_PAD_>")
BASES = 256


def id_map(merges: DataFrame, exposure: DataFrame, visible_vocab_size: int, min_exposure_count: int) -> DataFrame:
    """(old_id, exposure, status, new_id) of learned tokens.

    In order of learning, a token exposed often enough is visible until the visible vocabulary is full, an earlier one
    exposed too little is internal, and all after the last visible one that fits are discarded (new_id null).
    The windows run over one row per merge, which the vocabulary size bounds.
    """
    room = visible_vocab_size - BASES
    rows = merges.select(F.col("token_id").alias("old_id")).join(F.broadcast(exposure.where(f"token_id >= {BASES}").withColumnRenamed("token_id", "old_id")), "old_id", "left")
    rows = rows.withColumn("exposure", F.coalesce("exposure", F.lit(0).cast("long"))).withColumn("_ok", (F.col("exposure") >= min_exposure_count).cast("int"))
    before = Window.orderBy("old_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_seen", F.coalesce(F.sum("_ok").over(before), F.lit(0)))
    rows = rows.withColumn("status", F.when(F.col("_seen") >= room, "discarded").when(F.col("_ok") == 1, "visible").otherwise("internal"))
    every = Window.partitionBy()
    n_visible = F.sum((F.col("status") == "visible").cast("int")).over(every)
    rank = F.row_number().over(Window.partitionBy("status").orderBy("old_id"))
    new = F.when(F.col("status") == "visible", BASES - 1 + rank).when(F.col("status") == "internal", BASES - 1 + n_visible + len(SPECIALS) + rank)
    return rows.select("old_id", "exposure", "status", new.cast("int").alias("new_id"))


def export_rows(merges: DataFrame, ids: DataFrame, token_bytes: dict[int, bytes]) -> DataFrame:
    """(token_id, left_id, right_id, bytes, merge_rank, is_internal) of bytes, visible tokens, specials and internal tokens.

    Children go through the id map; -1 stands for none. ``token_bytes`` and the map have one entry per token.
    """
    spark = merges.sparkSession
    raw = spark.createDataFrame([(k, bytearray(v)) for k, v in token_bytes.items()], "old_id int, bytes binary")
    kept = ids.where("new_id is not null").select("old_id", "new_id", "status")
    mapping = F.broadcast(spark.range(BASES).select(F.col("id").cast("int").alias("old_id"), F.col("id").cast("int").alias("new_id")).unionByName(kept.select("old_id", "new_id")))
    child = lambda side: mapping.select(F.col("old_id").alias(f"{side}_old"), F.col("new_id").alias(f"{side}_id"))
    learned = kept.join(merges.select(F.col("token_id").alias("old_id"), F.col("left_id").alias("left_old"), F.col("right_id").alias("right_old")), "old_id").join(raw, "old_id")
    learned = learned.join(child("left"), "left_old").join(child("right"), "right_old")
    learned = learned.select(F.col("new_id").alias("token_id"), "left_id", "right_id", "bytes", F.col("old_id").alias("merge_rank"), (F.col("status") == "internal").alias("is_internal"))
    bases = raw.where(f"old_id < {BASES}").selectExpr("old_id as token_id", "-1 as left_id", "-1 as right_id", "bytes", "-1 as merge_rank", "false as is_internal")
    named = spark.createDataFrame([(i, bytearray(s.encode())) for i, s in enumerate(SPECIALS)], "k int, bytes binary")
    both = named.select("k", "bytes", F.lit(0).alias("v")).unionByName(kept.select(F.lit(None).cast("int").alias("k"), F.lit(None).cast("binary").alias("bytes"), (F.col("status") == "visible").cast("int").alias("v")))
    both = both.withColumn("v", F.sum("v").over(Window.partitionBy())).where("k is not null")
    specials = both.select((BASES + F.col("v") + F.col("k")).cast("int").alias("token_id"), F.lit(-1).alias("left_id"), F.lit(-1).alias("right_id"), "bytes", F.lit(-1).alias("merge_rank"), F.lit(False).alias("is_internal"))
    return learned.unionByName(bases).unionByName(specials)
