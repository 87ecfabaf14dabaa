"""Training: repeated counting and merging of the best pair."""

from __future__ import annotations

import logging
import math
import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..sources import checkpoint as ckpt
from ..sources.shared import ensure_checkpoint_dir
from . import corpus, prune

log = logging.getLogger(__name__)
BASES = 256


@dataclass
class Merge:
    token_id: int
    left_id: int
    right_id: int
    n: int | None = None


@dataclass
class Trainer:
    """Learns merges on distinct weighted chunks.

    Pair totals are kept beside the corpus; a merge counts again only the chunks that hold its pair, and merges that can't
    influence each other are made in one job. The sizes include the 256 bytes and exclude specials. ``whole`` merges within whole texts instead of chunks.
    The driver holds one row per merge, which the vocabulary size bounds; the corpus stays in Spark. Lineage is cut by a
    reliable checkpoint every ``cut_every`` merges. ``partitions`` spreads the distinct chunks evenly over so many tasks;
    the result does not depend on it.
    """

    spark: SparkSession
    train_vocab_size: int = 1024
    visible_vocab_size: int = 1024
    min_exposure_count: int = 2
    whole: bool = False
    cut_every: int = 16
    partitions: int | None = None
    merges: list[Merge] = field(default_factory=list)
    state: DataFrame | None = None
    metrics: list[dict] = field(default_factory=list)
    #: When training began, on the clock; ``mark_start`` sets it anew.
    started: float | None = None

    def __post_init__(self) -> None:
        if self.visible_vocab_size < BASES or self.train_vocab_size < BASES:
            raise ValueError("a vocabulary holds at least the 256 bytes")
        if self.train_vocab_size < self.visible_vocab_size:
            raise ValueError("train_vocab_size must be at least visible_vocab_size")
        if self.partitions is not None and self.partitions < 1:
            raise ValueError("partitions must be at least 1")

    @property
    def next_id(self) -> int:
        return max((m.token_id for m in self.merges), default=BASES - 1) + 1

    def _keep(self, state: DataFrame) -> DataFrame:
        """A checkpointed copy, the former one let go."""
        ensure_checkpoint_dir(self.spark)
        old, kept = getattr(self, "_kept", None), state.persist(StorageLevel.MEMORY_AND_DISK)
        out = kept.checkpoint(eager=True).persist(StorageLevel.MEMORY_AND_DISK)
        kept.unpersist()
        if old is not None:
            old.unpersist()
        self._kept = out
        return out

    def train(self, texts: DataFrame | None = None, order: str = "item_ord", text: str = "text", chunks: DataFrame | None = None, checkpoint_vocab_sizes: tuple[int, ...] = (), checkpoint_dir: str | None = None) -> "Trainer":
        """Fresh from ``texts`` or from ready ``chunks`` (item_ord, pos, chunk); with neither it goes on from the state.

        Ends at ``train_vocab_size``, without pairs, or when the best pair occurs once.
        """
        if texts is not None:
            chunks = corpus.chunk_rows(texts, order, text, self.whole)
        if chunks is not None:
            self.merges, self.state = [], corpus.tokenised(corpus.unique_chunks(chunks))
            if self.partitions is not None:
                self.state = self.state.repartition(self.partitions)
        elif self.state is None:
            raise ValueError("there is no corpus to go on from")
        sizes, done = set(checkpoint_vocab_sizes), 0
        if self.next_id >= self.train_vocab_size:
            return self
        self.started = self.started or time.time()
        try:
            self.state = self._keep(self.state)
            totals = corpus.pair_totals(self.state).checkpoint()  # as many rows as there are different pairs
            while self.next_id < self.train_vocab_size:
                began = time.perf_counter()
                batch = corpus.leading_pairs(self.state, totals)
                # Never beyond the wanted size or the next checkpoint.
                room = min([self.train_vocab_size, *(x for x in sizes if x > self.next_id)]) - self.next_id
                batch = [x for x in batch[:room] if x[2] >= 2]
                if not batch:
                    break
                merges = [(left, right, self.next_id + k) for k, (left, right, _) in enumerate(batch)]
                totals = corpus.updated_totals(totals, self.state, merges).checkpoint()
                for (left, right, new), (*_, n) in zip(merges, batch):
                    self.merges.append(Merge(new, left, right, n))
                    self.state = corpus.merge_corpus(self.state, left, right, new)
                before, done = done, done + len(batch)
                if done // self.cut_every > before // self.cut_every:
                    self.state = self._keep(self.state)
                self._note(batch, time.perf_counter() - began, before)
                if self.next_id in sizes:
                    self.save_checkpoint(f"{checkpoint_dir or '.'}/checkpoint_vocab_{self.next_id}")
        except BaseException:
            self.close()
            raise
        return self

    def _note(self, batch: list[tuple[int, int, int]], seconds: float, before: int) -> None:
        """Metrics and log lines of a batch; every ten merges the time since the start and the speed."""
        for k, (left, right, n) in enumerate(batch):
            new = self.next_id - len(batch) + k
            self.metrics.append({"token_id": new, "n": n, "seconds": seconds / len(batch)})
            log.info("merge %d: (%d, %d), n=%d", new, left, right, n)
        if (before + len(batch)) // 10 > before // 10:
            elapsed = time.time() - self.started
            log.info("%d merges, %.1f s, %.0f tokens an hour", len(self.merges), elapsed, 3600 * len(self.metrics) / max(elapsed, 1e-9))

    def mark_start(self) -> None:
        self.started = time.time()

    def metrics_table(self) -> DataFrame:
        """(token_id, n, seconds, tokens_per_hour) of the merges made by this trainer."""
        rows = [(m["token_id"], m["n"], m["seconds"], 3600 / max(m["seconds"], 1e-9)) for m in self.metrics]
        return self.spark.createDataFrame(rows, "token_id int, n long, seconds double, tokens_per_hour double")

    def close(self) -> None:
        """Lets the cached corpus go."""
        if (kept := getattr(self, "_kept", None)) is not None:
            kept.unpersist()

    def exposure(self) -> DataFrame:
        return corpus.exposure(self.state)

    def merge_table(self) -> DataFrame:
        rows = [(m.token_id, m.left_id, m.right_id, m.n) for m in self.merges]
        return self.spark.createDataFrame(rows, "token_id int, left_id int, right_id int, n long")

    def token_bytes(self) -> dict[int, bytes]:
        out = {i: bytes([i]) for i in range(BASES)}
        for m in sorted(self.merges, key=lambda m: m.token_id):
            out[m.token_id] = out[m.left_id] + out[m.right_id]
        return out

    def exportable_visible(self) -> int:
        """Number of learned tokens exposed often enough, counted up to the visible target (but one, if any, for a target of 0)."""
        learned = self.exposure().where(f"token_id >= {BASES} and exposure >= {self.min_exposure_count}").count()
        if self.min_exposure_count <= 0:
            learned = len(self.merges)
        return min(learned, max(1, self.visible_vocab_size - BASES))

    def train_until_visible_full(self, max_train_vocab_size: int, checkpoint_vocab_sizes: tuple[int, ...] = (), checkpoint_dir: str | None = None, step_size: int = 25) -> "Trainer":
        """Extends training in batches until the visible vocabulary is full, the cap is reached or nothing is learned.

        A last checkpoint is always saved, in the working folder if none is given."""
        if step_size < 1:
            raise ValueError("step_size must be at least 1")
        if self.state is None:
            raise ValueError("there is no corpus to go on from")
        if max_train_vocab_size <= self.next_id:
            raise ValueError("max_train_vocab_size must exceed the next id")
        target = self.visible_vocab_size - BASES
        while (missing := target - self.exportable_visible()) > 0 and (before := self.next_id) < max_train_vocab_size:
            self.train_vocab_size = min(before + max(step_size, math.ceil(1.1 * missing)), max_train_vocab_size)
            self.train(checkpoint_vocab_sizes=checkpoint_vocab_sizes, checkpoint_dir=checkpoint_dir)
            if self.next_id == before:
                break
        self.train_vocab_size = self.next_id
        self.save_checkpoint(f"{checkpoint_dir or '.'}/checkpoint_vocab_{self.next_id}")
        return self

    def id_map(self) -> DataFrame:
        return prune.id_map(self.merge_table(), self.exposure(), self.visible_vocab_size, self.min_exposure_count)

    def save_checkpoint(self, path: str) -> None:
        sizes = {"train_vocab_size": self.train_vocab_size, "visible_vocab_size": self.visible_vocab_size, "min_exposure_count": self.min_exposure_count}
        ckpt.save(self.spark, path, self.merge_table(), self.state, sizes | {"next_id": self.next_id})

    @classmethod
    def load_checkpoint(cls, spark: SparkSession, path: str, **sizes: int) -> "Trainer":
        """Merges and corpus of a checkpoint; the sizes come from the caller."""
        merges, state, _ = ckpt.load(spark, path)
        out = cls(spark, **sizes)
        out.merges = [Merge(*r) for r in merges.orderBy("token_id").collect()]  # bounded by the vocabulary size
        out.state = state
        return out
