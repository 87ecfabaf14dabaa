"""Queries over the test tables, one per operator of the engine."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pretokenize import char_kind, pretokenize
from ..functions import tokens as T
from ..operators import corpus, prune
from ..operators.tokenizer import Tokenizer
from ..operators.train import Trainer
from ..sources import folder, vocab
from ..sources.shared import ensure_checkpoint_dir
from ..sources.vocab import Vocab

N_MERGES = 16
VISIBLE = 256 + 12
MIN_EXPOSURE = 200
N_WHOLE = 8
_trained: dict[tuple, Trainer] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The trainer's corpus as (item_ord, pos, chunk)."""
    return table(spark, sf, "corpus_chunk").select("item_ord", "pos", "chunk")


def trained(spark: SparkSession, sf: str) -> Trainer:
    """A trainer after N_MERGES merges over all chunks; kept for the queries that build on it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _trained:
        _trained.clear()
        _trained[key] = Trainer(spark, 256 + N_MERGES, VISIBLE, MIN_EXPOSURE).train(chunks=chunks(spark, sf))
    return _trained[key]


def vocabulary(t: Trainer) -> Vocab:
    """The exported vocabulary of a trainer, in memory."""
    rows = prune.export_rows(t.merge_table(), t.id_map(), t.token_bytes()).collect()  # the vocabulary's size
    out = Vocab()
    for r in rows:
        out.children[r.token_id], out.token_bytes[r.token_id] = (r.left_id, r.right_id), bytes(r.bytes)
        if r.is_internal:
            out.internal.add(r.token_id)
        if r.merge_rank >= 0:
            out.ranks[r.left_id, r.right_id] = r.merge_rank
        elif r.token_id >= 256:
            out.specials[bytes(r.bytes).decode()] = r.token_id
    return out


def pretok_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.explode(pretokenize(F.col("text"))).alias("chunk"))
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


def pretok_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "text_item").select(F.explode(pretokenize(F.col("text"))).alias("chunk"))
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


def chunk_stats_by_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "corpus_chunk").where("chunk is not null").groupBy("source_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("source_id").agg(F.sum("n").alias("n_chunks"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("n") * F.octet_length("chunk")).alias("n_bytes"))


def char_kind_histogram(spark: SparkSession, sf: str) -> DataFrame:
    chars = table(spark, sf, "documents").select(F.explode(T.chars(F.col("text"))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return chars.groupBy(char_kind(F.col("c")).alias("kind")).agg(F.sum("n").alias("n"))


def unique_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.unique_chunks(chunks(spark, sf))


def byte_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.exposure(corpus.tokenised(corpus.unique_chunks(chunks(spark, sf)))).select(F.col("token_id").alias("byte"), F.col("exposure").alias("n"))


def pair_counts_round0(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.pair_counts(corpus.tokenised(corpus.unique_chunks(chunks(spark, sf))))


def best_pair_round0(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.best_pair(corpus.tokenised(corpus.unique_chunks(chunks(spark, sf))))


def bpe_train_16(spark: SparkSession, sf: str) -> DataFrame:
    t = trained(spark, sf)
    raw = t.token_bytes()
    return spark.createDataFrame([(m.token_id, m.left_id, m.right_id, m.n, raw[m.token_id].hex().upper()) for m in t.merges], "token_id int, left_id int, right_id int, n long, bytes_hex string")


def token_exposure(spark: SparkSession, sf: str) -> DataFrame:
    return trained(spark, sf).exposure()


def prune_visibility(spark: SparkSession, sf: str) -> DataFrame:
    return trained(spark, sf).id_map()


def _export(spark: SparkSession, sf: str, internal: bool) -> DataFrame:
    t = trained(spark, sf)
    rows = prune.export_rows(t.merge_table(), t.id_map(), t.token_bytes()).where(F.col("is_internal") == internal)
    return rows.select("token_id", "left_id", "right_id", F.hex("bytes").alias("bytes_hex"), "merge_rank")


def vocab_export(spark: SparkSession, sf: str) -> DataFrame:
    return _export(spark, sf, False)


def inter_vocab_export(spark: SparkSession, sf: str) -> DataFrame:
    return _export(spark, sf, True)


def encode_documents(spark: SparkSession, sf: str) -> DataFrame:
    ids = Tokenizer(vocabulary(trained(spark, sf))).encode(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


def encode_items(spark: SparkSession, sf: str) -> DataFrame:
    ids = Tokenizer(vocabulary(trained(spark, sf))).encode(F.col("text"))
    return table(spark, sf, "text_item").select("item_ord", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


def encode_special_items(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("<_SOS_>"), F.coalesce("text", F.lit("")), F.lit("<_EOS_>"))
    ids = Tokenizer(vocabulary(trained(spark, sf))).encode(text, encode_special_tokens=True)
    return table(spark, sf, "text_item").select("item_ord", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


def decode_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    tok = Tokenizer(vocabulary(trained(spark, sf)))
    back = table(spark, sf, "documents").select("doc_id", "text", tok.decode(tok.encode(F.col("text")), skip_special_tokens=False).alias("back"))
    return back.select("doc_id", F.md5(F.encode("back", "UTF-8")).alias("md5_back"))


def decode_bare_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items encoded with their specials as ids and decoded without them."""
    tok = Tokenizer(vocabulary(trained(spark, sf)))
    back = tok.decode(tok.encode(F.col("text"), encode_special_tokens=True))
    return table(spark, sf, "text_item").select("item_ord", F.md5(F.encode(back, "UTF-8")).alias("md5_back"))


def resume_16(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the merges, a checkpoint, and the rest by a trainer that goes on from it."""
    folder_ = f"{ensure_checkpoint_dir(spark)}/resume-{uuid.uuid4().hex}"
    half = 256 + N_MERGES // 2
    Trainer(spark, half, 256, 0).train(chunks=chunks(spark, sf), checkpoint_vocab_sizes=(half,), checkpoint_dir=folder_).close()
    return Trainer.load_checkpoint(spark, f"{folder_}/checkpoint_vocab_{half}", train_vocab_size=256 + N_MERGES, visible_vocab_size=256).train().merge_table()


def vocab_file_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The exported vocabulary written as its two files and read again; files of the driver, as large as the vocabulary."""
    t = trained(spark, sf)
    with tempfile.TemporaryDirectory() as place:
        names = f"{place}/vocab.txt", f"{place}/inter_vocab.txt"
        vocab.write(prune.export_rows(t.merge_table(), t.id_map(), t.token_bytes()), *names)
        back = vocab.load(*names).table(spark)
    return back.select("token_id", "left_id", "right_id", F.hex("bytes").alias("bytes_hex"), "merge_rank")


def compression_by_source(spark: SparkSession, sf: str) -> DataFrame:
    tok = Tokenizer(vocabulary(trained(spark, sf)))
    rows = table(spark, sf, "text_item").select("source_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("b"), F.size(tok.encode(F.col("text"))).alias("t"))
    return rows.groupBy("source_id").agg(F.sum("b").alias("n_bytes"), F.sum("t").alias("n_tokens"))


def vanilla_train_8(spark: SparkSession, sf: str) -> DataFrame:
    t = Trainer(spark, 256 + N_WHOLE, 256, 0, whole=True).train(table(spark, sf, "text_item"))
    return t.merge_table()


def visible_fill(spark: SparkSession, sf: str) -> DataFrame:
    t = Trainer(spark, 256 + 4, 256 + 4, MIN_EXPOSURE).train(chunks=chunks(spark, sf))
    t.visible_vocab_size = 256 + 8
    return t.train_until_visible_full(256 + 20, step_size=4, checkpoint_dir=f"{ensure_checkpoint_dir(spark)}/visible_fill").id_map()


def load_items(spark: SparkSession, sf: str) -> DataFrame:
    """Text items of the corpus files: lines of line-based files, whole contents of the others."""
    rows = folder.items(table(spark, sf, "corpus_file").withColumn("path", F.concat_ws("/", F.col("file_id").cast("string"), "path")))
    return rows.select(F.split("path", "/")[0].cast("long").alias("file_id"), F.col("line_no").cast("int").alias("line_no"), "text")


def merge_count_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Final aggregation of the pair counts reported by shards, under packed keys. Null counts count nothing."""
    rows = table(spark, sf, "merge_count").where("n is not null").withColumn("pair_key", T.pack_pair(F.col("left_id"), F.col("right_id")))
    left, right = T.unpack_pair(F.col("pair_key"))
    return rows.groupBy("pair_key").agg(F.sum("n").alias("n")).select("pair_key", left.alias("left_id"), right.alias("right_id"), "n")


QUERIES = {f.__name__: f for f in (pretok_documents, pretok_items, chunk_stats_by_source, char_kind_histogram, unique_chunks, byte_histogram, pair_counts_round0, best_pair_round0, bpe_train_16, token_exposure, prune_visibility, vocab_export, inter_vocab_export, encode_documents, encode_items, encode_special_items, decode_roundtrip, decode_bare_items, resume_16, vocab_file_roundtrip, compression_by_source, vanilla_train_8, visible_fill, load_items, merge_count_pairs)}
