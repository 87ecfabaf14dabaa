"""Near-duplicate source files with small edits.

Equal shingle sets become one representative. Representatives are laid into bands of size so wide that similar ones lie in
the same band or in neighbours; a tile is what a band and its upper neighbour post under a shingle of their prefixes (any two
sets of the wanted similarity share one), tiles of the same members being one. In a tile the exact sizes are compared, the
bits of hashed bitmaps bound the overlap from above, and what is left is intersected exactly on sorted arrays. No pair of
the wanted similarity is lost at any step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.tokens import bound
from ..sources.shared import ensure_checkpoint_dir
from .common import hash_sample, salted_left_join, table, words

SIMILARITY, SHINGLE = 0.5, 3
#: Bits of a bitmap, rows of a block of a tile, files from which the common shingles are guessed. The guess orders
#: prefixes (rare first) and so decides speed only, never the result.
BITS, BLOCK, SAMPLE, COMMON = 1024, 2048, 4096, 1 << 18


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Sorted array of the hashes of the distinct runs of ``size`` words."""

    def of(w: Column) -> Column:
        at = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - (size - 1))).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " ")))))

    return bound(words(text, "[A-Za-z0-9_]+"), of)


def prefix_length(n: int, t: float = SIMILARITY) -> int:
    """Shingles to post so that sets of similarity t share one: all but the least overlap, plus one."""
    return n - int(np.ceil(t * n - 1e-9)) + 1 if n else 0


def bitmap(s: np.ndarray) -> bytes:
    out = np.zeros(BITS, bool)
    out[(s.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS.bit_length() + 1)] = True
    return np.packbits(out).tobytes()


def post(common: np.ndarray):
    """Adds prefix (rare shingles first, then by hash) and bitmap to (rid, s)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            prefixes, maps = [], []
            for s in b["s"]:
                s = np.asarray(s, np.int64)
                often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
                prefixes.append(np.concatenate([s[~often], s[often]])[: prefix_length(len(s))])
                maps.append(bitmap(s))
            yield b.assign(prefix=prefixes, bits=maps)[["rid", "n", "s", "prefix", "bits"]]

    return run


def compare(n: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (of ``left`` and ``right``, both by ascending n) inside the size band that the bitmaps can't rule out."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    sizes = n[right]
    for i in left:
        lo, hi = np.searchsorted(sizes, np.ceil(t * n[i] - 1e-9)), np.searchsorted(sizes, np.floor(n[i] / t + 1e-9), "right")
        js = right[lo:hi]
        if len(js):
            apart = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1, dtype=np.int64)
            both = n[js] + n[i]
            js = js[(both - apart) // 2 >= np.ceil(both * t / (1 + t) - 1e-9)]
            out.append((np.full(len(js), i), js))
    if not out:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def band(n: Column, t: float = SIMILARITY) -> Column:
    """Number of a size's band: sizes that similarity t allows together lie in one band or in two neighbours."""
    return F.floor(F.log(n.cast("double")) / float(-np.log(t)) + 1e-9).cast("int")


def tiles(batches: Iterator[pd.DataFrame], t: float = SIMILARITY) -> Iterator[pd.DataFrame]:
    """Candidate pairs (a, b), a < b, of rows (tile, side, guest, n, rid, bits) sorted by tile; side 0 meets 1, side 2 meets
    itself, and guests, who come from the band above, do not meet each other. A tile has at most two blocks.
    """
    held: list[pd.DataFrame] = []

    def flush(parts: list[pd.DataFrame]) -> pd.DataFrame:
        g = pd.concat(parts).sort_values("n", kind="stable") if len(parts) > 1 else parts[0].sort_values("n", kind="stable")
        n, rid, side, guest = g["n"].to_numpy(np.int64), g["rid"].to_numpy(np.int64), g["side"].to_numpy(), g["guest"].to_numpy(bool)
        bits = np.frombuffer(b"".join(g["bits"]), np.uint64).reshape(len(g), -1)
        at = lambda mask: np.nonzero(mask)[0]
        if (side == 2).any():
            i, j = compare(n, bits, at(~guest), np.arange(len(g)), t)
            i, j = i[(i < j) | guest[j]], j[(i < j) | guest[j]]
        else:
            i, j = map(np.concatenate, zip(compare(n, bits, at((side == 0) & ~guest), at(side == 1), t), compare(n, bits, at((side == 0) & guest), at((side == 1) & ~guest), t)))
        a, b = rid[i], rid[j]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    for batch in batches:
        if not len(batch):
            continue
        key = batch["tile"].to_numpy()
        cuts = np.nonzero(key[1:] != key[:-1])[0] + 1
        out = []
        for part in np.split(np.arange(len(batch)), cuts):
            rows = batch.iloc[part]
            if held and held[0]["tile"].iloc[0] != rows["tile"].iloc[0]:
                out.append(flush(held))
                held.clear()
            held.append(rows)
        if out:
            yield pd.concat(out).drop_duplicates()
    if held:
        yield flush(held)


@F.pandas_udf(IntegerType())
def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted arrays of distinct values."""
    return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)], dtype="int32")


def near_duplicates(files: DataFrame, key: str, text: str, t: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, rid) has every row with a text and its representative, the least id of equal sets;
    links (a, b), a < b, are the similar pairs of representatives.

    Texts too short for a shingle are alike only if equal. Null texts are alike to nothing. Empty tables give no rows.
    """
    spark = files.sparkSession
    ensure_checkpoint_dir(spark)
    rows = files.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("_t")).withColumn("s", shingles(F.col("_t")))
    same = F.when(F.size("s") > 0, F.concat_ws("-", F.xxhash64(F.lit(1), "s"), F.xxhash64(F.lit(2), "s"), F.size("s"))).otherwise(F.concat(F.lit("text-"), F.sha2("_t", 256)))
    rows = rows.withColumn("same", same).drop("_t").checkpoint()
    reps = rows.groupBy("same").agg(F.min("id").alias("rid"))
    members = salted_left_join(rows.select("id", "same"), reps, "same", "id").select("id", "rid")
    reps = rows.where(F.size("s") > 0).join(reps.select(F.col("rid").alias("id")), "id", "left_semi").select(F.col("id").alias("rid"), F.size("s").alias("n"), "s")
    sample = hash_sample(reps, "rid", SAMPLE).select(F.explode("s").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    often = sample.where(f"c >= greatest(4, {SAMPLE} / 500)").orderBy(F.desc("c"), "x").limit(COMMON).select("x").toPandas()["x"].to_numpy(np.int64)
    posted = reps.mapInPandas(post(np.sort(often)), "rid long, n int, s array<long>, prefix array<long>, bits binary").checkpoint()

    # Members are counted by a pre-aggregated sum and joined back; a hot shingle's postings are split by the skew join.
    postings = posted.select("rid", "n", F.explode("prefix").alias("x"))
    counts = postings.groupBy("x").agg(F.count(F.lit(1)).alias("cnt"), F.sum(F.xxhash64("rid") % (1 << 40)).alias("sig")).where("cnt > 1")
    # Shingles with the same members are one tile a band; a tile beyond a block is cut into pairs of blocks.
    tile = postings.join(counts, "x").groupBy("rid", "sig", "cnt").agg(F.first("n").alias("n")).withColumn("blocks", F.ceil(F.col("cnt") / BLOCK).cast("int"))
    tile = tile.withColumn("band", band(F.col("n"), t)).withColumn("guest", F.explode(F.when(F.col("band") > 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    tile = tile.withColumn("band", F.col("band") - F.col("guest").cast("int"))
    mine = F.pmod(F.xxhash64("rid", F.lit(3)), F.col("blocks")).cast("int")
    tile = tile.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    tile = tile.select("rid", "n", "guest", F.xxhash64("sig", "cnt", "band", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile"), side.alias("side"))
    tile = tile.join(posted.select("rid", "bits").hint("shuffle_hash"), "rid")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = tile.select("tile", "side", "guest", "n", "rid", "bits").repartition(parts, "tile").sortWithinPartitions("tile").mapInPandas(lambda it: tiles(it, t), "a long, b long").distinct()
    sets = posted.select("rid", "s", "n")
    joined = found.join(sets.select(F.col("rid").alias("a"), F.col("s").alias("sa"), F.col("n").alias("na")), "a").join(sets.select(F.col("rid").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb")), "b")
    n = overlap("sa", "sb")
    links = joined.select("a", "b", "na", "nb", n.alias("o")).where(F.col("o") >= t * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")
    return members, links


def _ts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus_file").where("suffix = '.ts'")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of like files; the result asks for pairs, so copies are written out."""
    members, links = near_duplicates(_ts(spark, sf), "file_id", "content")
    members = members.checkpoint()
    other = members.select(F.col("id").alias("id2"), F.col("rid").alias("rid2"))
    inside = members.join(other, (F.col("rid") == F.col("rid2")) & (F.col("id") < F.col("id2"))).select("id", "id2")
    across = links.join(members.withColumnRenamed("rid", "a"), "a").join(other.withColumnRenamed("rid2", "b"), "b").select("id", "id2")
    both = inside.unionByName(across)
    return both.select(F.least("id", "id2").alias("file_id_a"), F.greatest("id", "id2").alias("file_id_b"))


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, class_id, n_links): one row per file, copies not written out; links between different sets."""
    members, links = near_duplicates(_ts(spark, sf), "file_id", "content")
    ends = links.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count(F.lit(1)).alias("n_links"))
    out = salted_left_join(members, ends, "rid", "id")
    return out.select(F.col("id").alias("file_id"), F.col("rid").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p4_found": p4_found, "p4_classes": p4_classes}
ORACLES = {
    "p4_classes": """WITH w AS (SELECT file_id, content, regexp_extract_all(content, '[A-Za-z0-9_]+') AS w FROM corpus_file WHERE suffix = '.ts' AND content IS NOT NULL),
s AS MATERIALIZED (SELECT DISTINCT file_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT file_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
n AS (SELECT file_id, count(*) AS n FROM s GROUP BY 1),
o AS MATERIALIZED (SELECT a.file_id AS a, b.file_id AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x GROUP BY 1, 2),
p AS MATERIALIZED (SELECT a, b, o = x.n AND o = y.n AS same FROM o JOIN n x ON x.file_id = a JOIN n y ON y.file_id = b WHERE o >= 0.5 * (x.n + y.n - o)),
c AS MATERIALIZED (SELECT a AS file_id, min(b) AS class_id FROM p WHERE same GROUP BY 1 UNION ALL SELECT a.file_id, min(b.file_id) FROM w a JOIN w b ON a.content = b.content WHERE len(a.w) < 3 GROUP BY 1),
k AS (SELECT x.class_id, count(DISTINCT y.class_id) AS n_links FROM p JOIN c x ON x.file_id = a JOIN c y ON y.file_id = b WHERE NOT same GROUP BY 1)
SELECT file_id, class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN k USING (class_id)""",
    "p4_found": """WITH w AS (SELECT file_id, content, regexp_extract_all(content, '[A-Za-z0-9_]+') AS w FROM corpus_file WHERE suffix = '.ts' AND content IS NOT NULL),
s AS MATERIALIZED (SELECT DISTINCT file_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT file_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
n AS (SELECT file_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.file_id AS a, b.file_id AS b, count(*) AS o FROM s a JOIN s b ON a.x = b.x AND a.file_id < b.file_id GROUP BY 1, 2)
SELECT a AS file_id_a, b AS file_id_b FROM o JOIN n x ON x.file_id = a JOIN n y ON y.file_id = b WHERE o >= 0.5 * (x.n + y.n - o)
UNION SELECT a.file_id, b.file_id FROM w a JOIN w b ON a.content = b.content AND a.file_id < b.file_id""",
}
