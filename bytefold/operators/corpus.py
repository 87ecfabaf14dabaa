"""The weighted corpus of distinct chunks and its pair statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.pretokenize import pretokenize


def chunk_rows(texts: DataFrame, order: str, text: str, whole: bool = False) -> DataFrame:
    """(item_ord, pos, chunk) of every chunk. ``whole`` takes each text as one chunk. Null and empty texts have none."""
    parts = F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>")) if whole else pretokenize(F.col(text))
    rows = texts.select(F.col(order).cast("long").alias("item_ord"), parts.alias("_parts"))
    return rows.select("item_ord", F.posexplode("_parts").alias("pos", "chunk"))


def unique_chunks(rows: DataFrame) -> DataFrame:
    """(chunk, freq, first_ord, first_pos) of distinct chunks; map-side combined, so the hot chunk shuffles once per task.

    Equal chunks merge alike for ever, so training on distinct chunks with weights is exact; the first place keeps
    the order by which ties are broken. Null and empty chunks are left out; repeated rows count.
    """
    agg = rows.where(F.length("chunk") > 0).groupBy("chunk").agg(F.count(F.lit(1)).alias("freq"), F.min(F.struct(F.col("item_ord").cast("long").alias("item_ord"), F.col("pos").cast("int").alias("pos"))).alias("_first"))
    return agg.select("chunk", "freq", F.col("_first.item_ord").alias("first_ord"), F.col("_first.pos").alias("first_pos"))


def tokenised(unique: DataFrame) -> DataFrame:
    """The training state: (tokens, freq, first_ord, first_pos)."""
    return unique.select(T.from_text(F.col("chunk")).alias("tokens"), "freq", "first_ord", "first_pos")


def pair_stats(state: DataFrame) -> DataFrame:
    """(pair, n, first) of adjacent pairs: weighted count and first place in corpus order.

    Counts within a chunk are combined before the shuffle by the partial aggregate.
    """
    at = state.where(F.length("tokens") > 1).select("freq", "first_ord", "first_pos", F.explode(T.pairs(F.col("tokens"))).alias("p"))
    place = F.struct("first_ord", "first_pos", F.col("p.off").alias("off"))
    return at.groupBy(F.col("p.pair").alias("pair")).agg(F.sum("freq").alias("n"), F.min(place).alias("first"))


def pair_counts(state: DataFrame) -> DataFrame:
    """(left_id, right_id, n) of adjacent pairs."""
    return pair_stats(state).select(T.char_id(F.substring("pair", 1, 1)).alias("left_id"), T.char_id(F.substring("pair", 2, 1)).alias("right_id"), "n")


def best_pair(state: DataFrame) -> DataFrame:
    """The most frequent pair, of equals the one met first: one row (left_id, right_id, n), none without pairs."""
    top = pair_stats(state).orderBy(F.desc("n"), "first").limit(1)
    return top.select(T.char_id(F.substring("pair", 1, 1)).alias("left_id"), T.char_id(F.substring("pair", 2, 1)).alias("right_id"), "n")


#: Pairs of the largest counts looked at in one job.
LEADERS = 32


def pair_totals(state: DataFrame) -> DataFrame:
    """(pair, n) of adjacent pairs, without their places: a hash aggregate."""
    return state.where(F.length("tokens") > 1).select("freq", F.explode(T.pairs(F.col("tokens"))["pair"]).alias("pair")).groupBy("pair").agg(F.sum("freq").alias("n"))


def updated_totals(totals: DataFrame, state: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """Pair totals after ``merges`` (left, right, new) of the state: only the chunks that hold a merged pair are counted again, as
    they were (taken off) and as they become (added)."""
    holds, merged = F.lit(False), F.col("tokens")
    for left, right, new in merges:
        holds = holds | F.col("tokens").contains(T.token_char(left) + T.token_char(right))
        merged = T.merge(merged, left, right, new)
    signed = lambda t, sign: F.transform(T.pairs(t)["pair"], lambda p: F.struct(p.alias("pair"), F.lit(sign).alias("sign")))
    # No filter: pushed below the merges, it would repeat all of them for every pair.
    rows = state.select("freq", "tokens", merged.alias("merged"), holds.alias("holds"))
    changes = F.when(F.col("holds"), F.concat(signed(F.col("tokens"), -1), signed(F.col("merged"), 1)))
    delta = rows.select("freq", F.explode_outer(changes).alias("x")).where("x is not null").select("x.pair", (F.col("freq") * F.col("x.sign")).alias("n"))
    return totals.unionByName(delta).groupBy("pair").agg(F.sum("n").alias("n")).where("n <> 0")


def _ids(pair: str) -> tuple[int, int]:
    left, right = (ord(c) - (T.LEARNED if ord(c) >= T.LEARNED else 0) for c in pair)
    return left, right


def leading_pairs(state: DataFrame, totals: DataFrame) -> list[tuple[int, int, int]]:
    """(left, right, n) of the best pair and of those that are sure to be the best after it, none without pairs.

    A pair follows in the same batch if it shares no token with those before it and its count is above that of the next:
    a pair that a merge creates stands where one sharing a token with the merged pair stood, so it can't count more
    than what is left outside the batch. A pair of equal tokens ends a batch, for its merge may create itself again.
    Of equal counts the pair met first wins; places are looked for only among the chunks that hold the tied pairs.
    """
    top = totals.orderBy(F.desc("n"), "pair").limit(LEADERS).collect()
    if not top:
        return []
    most = top[0]["n"]
    tied = [r["pair"] for r in top if r["n"] == most]
    if len(tied) > 1:
        rows = state
        if len(tied) < len(top):
            holds = F.lit(False)
            for p in tied:
                holds = holds | F.col("tokens").contains(p)
            rows = state.where(holds)
        at = rows.where(F.length("tokens") > 1).select("first_ord", "first_pos", F.explode(T.pairs(F.col("tokens"))).alias("p")).select("first_ord", "first_pos", "p.*")
        at = at.where(F.col("pair").isin(tied)) if len(tied) < len(top) else at.join(totals.where(F.col("n") == most).select("pair"), "pair", "left_semi")
        first = at.groupBy("pair").agg(F.min(F.struct("first_ord", "first_pos", "off")).alias("first")).orderBy("first").first()["pair"]
        return [(*_ids(first), most)]
    out, used = [], set()
    for k, r in enumerate(top):
        left, right = _ids(r["pair"])
        sure = k + 1 < len(top) and r["n"] > top[k + 1]["n"] or k + 1 == len(top) < LEADERS
        if out and (not sure or used & {left, right}):
            break
        out.append((left, right, r["n"]))
        used |= {left, right}
        if left == right:
            break
    return out


def exposure(state: DataFrame) -> DataFrame:
    """(token_id, exposure) of the tokens now standing in the corpus."""
    rows = state.select("freq", F.explode(T.chars(F.col("tokens"))).alias("c"))
    return rows.groupBy("c").agg(F.sum("freq").alias("exposure")).select(T.char_id(F.col("c")).alias("token_id"), "exposure")


def merge_corpus(state: DataFrame, left: int, right: int, new: int) -> DataFrame:
    """The state with a pair merged everywhere, left to right without overlap: a narrow projection."""
    return state.withColumn("tokens", T.merge(state["tokens"], left, right, new))
