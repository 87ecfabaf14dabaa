"""Encoding of the corpus with a public byte-level tokenizer by merge replay.

The JVM cuts texts into words. Each task replays the tokenizer's merges over the distinct words of large blocks of its
part of the corpus: an inverted index from token pair to positions, merges applied in order of rank to all positions
of their pair at once, and only the neighbours touched looked up again. Words met in earlier blocks are not replayed.
"""

from __future__ import annotations

import heapq
import importlib.util
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters of text in a block, and distinct words whose ids a task keeps (parameters; they change no result).
BLOCK_BYTES, KEPT_WORDS = 24 << 20, 1 << 20
#: White space of Unicode, written out since Java's \s is ASCII (fixed values).
WHITE = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}++| ?\p{{N}}++| ?[^{WHITE}\p{{L}}\p{{N}}]++|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    """Path of a vocabulary in the folder of public tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(folder / name)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in such vocabularies: itself if printable, else the next from U+0100 on."""
    out, extra = [], 0x100
    for b in range(256):
        shown = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF
        out.append(chr(b if shown else extra))
        extra += not shown
    return out


class Merges:
    """Merge table: byte -> id, and sorted pair keys with their ranks and new ids."""

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bytes = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.left, self.right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = self.left << 32 | self.right
        order = np.argsort(keys, kind="stable")
        # One slot a pair in an open table of twice the size: a look-up is one or two steps on average.
        self.bits = int(len(keys)).bit_length() + 2
        self.slots, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        todo = keys[order], order
        at = self._slot(todo[0])
        while len(at):
            free = self.slots[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = np.zeros(len(at), bool)
            won[first] = True
            won &= free
            self.slots[at[won]], self.ranks[at[won]] = todo[0][won], todo[1][won]
            todo, at = (todo[0][~won], todo[1][~won]), (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for none."""
        keys = left << 32 | right
        at, out = self._slot(keys), np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            seen = self.slots[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def replay(raw: np.ndarray, starts: np.ndarray, m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts) of words given as their joined bytes and the place where each begins (ends with the length)."""
    n = len(raw)
    ids = m.bytes[raw]
    nxt, prev, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
    ends = starts[1:][np.diff(starts) > 0]
    nxt[ends - 1] = -1
    prev[starts[:-1][np.diff(starts) > 0]] = -1
    index: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def post(at: np.ndarray, rank: np.ndarray) -> None:
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.nonzero(rank[1:] != rank[:-1])[0] + 1
        for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(ranks, r)

    at = np.nonzero(nxt >= 0)[0]
    rank = m.rank(ids[at], ids[nxt[at]])
    if (rank >= 0).any():
        post(at[rank >= 0], rank[rank >= 0])
    while ranks:
        r = heapq.heappop(ranks)
        parts = index.pop(r)
        a, b, new = m.left[r], m.right[r], m.new[r]
        at = np.unique(np.concatenate(parts) if len(parts) > 1 else parts[0])  # neighbours merged at once post a place twice
        at = at[alive[at]]
        right = nxt[at]
        ok = (ids[at] == a) & (right >= 0)
        ok[ok] = ids[right[ok]] == b
        at, right = at[ok], right[ok]
        if a == b and len(at) > 1:  # in a run of equals every second pair, from the left
            fresh = np.concatenate([[True], at[1:] != right[:-1]])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            keep = (np.arange(len(at)) - first) % 2 == 0
            at, right = at[keep], right[keep]
        if not len(at):
            continue
        ids[at] = new
        alive[right] = False
        after = nxt[right]
        nxt[at] = after
        has = after >= 0
        prev[after[has]] = at[has]
        before = prev[at]
        spots = np.concatenate([before[before >= 0], at[has]])
        if len(spots):
            rank = m.rank(ids[spots], ids[nxt[spots]])
            if (found := rank >= 0).any():
                post(spots[found], rank[found])
    counts = np.concatenate([[0], np.cumsum(alive)])
    return ids[alive], counts[starts]


class Encoder:
    """Ids of arrays of words; keeps those of words already met, up to KEPT_WORDS."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts) of every word of a string array without nulls."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > KEPT_WORDS:
            self.forget()
        fresh = [w for w in distinct if w not in self.known]
        if fresh:
            raw = [w.encode("utf-8") for w in fresh]
            starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
            ids, at = replay(np.frombuffer(b"".join(raw), np.uint8), starts, self.merges)
            self.known.update(zip(fresh, range(len(self.starts) - 1, len(self.starts) - 1 + len(fresh))))
            self.starts = np.concatenate([self.starts, at[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        which = np.fromiter((self.known[w] for w in distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        begin, size = self.starts[which], self.starts[which + 1] - self.starts[which]
        out = np.concatenate([[0], np.cumsum(size)])
        return self.ids[np.repeat(begin - out[:-1], size) + np.arange(out[-1])], out


def words_of(text: Column) -> Column:
    """Words of a text by the tokenizer's pattern; null and empty texts have none."""
    return F.when(F.length(text) > 0, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def encode(docs: DataFrame, key: str, text: str, path: str | None = None, sizes: bool = False) -> DataFrame:
    """(key, ids), or (key, n_tokens) with ``sizes``, of every row; without special tokens, whose strings are plain text.

    Null and empty texts have an empty list. Repeated rows come out as often. Nothing is shuffled: every task encodes
    the rows it reads, and words are shared within it.
    """
    # The driver alone reads the file; the merge table, some megabytes for any vocabulary of its kind, is sent once an executor.
    shared = docs.sparkSession.sparkContext.broadcast(merges(path or vocabulary_file()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            lists = t["words"].combine_chunks()
            if isinstance(lists, pa.ChunkedArray):
                lists = pa.concat_arrays(lists.chunks)
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            ids, starts = encoder.encode(lists.flatten())
            ends = starts[offsets]
            if sizes:
                out = pa.array(np.diff(ends), pa.int64())
            else:
                out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            for b in pa.table({key: t[key], "n_tokens" if sizes else "ids": out}).to_batches(max_chunksize=4096):
                yield b

        size = 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= BLOCK_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, words_of(F.col(text)).alias("words")).mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens long" if sizes else "ids array<int>"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(table(spark, sf, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
