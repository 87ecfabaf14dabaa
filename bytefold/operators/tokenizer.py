"""Encoding and decoding columns with a vocabulary."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.pretokenize import pretokenize, split_specials
from ..sources.vocab import Vocab

#: Up to so many merges a fold of ``replace`` in the JVM beats the trip to Python; it may only be used in rank order.
FOLD_LIMIT = 4
#: Distinct chunks whose ids a task keeps.
KEPT_CHUNKS = 1 << 19


def encode_chunk(raw: bytes, merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Ids of a chunk: the pair of least rank is merged everywhere, again and again. ``merges``: pair -> (rank, new)."""
    ids, nxt = list(raw), list(range(1, len(raw) + 1))
    prev = [i - 1 for i in range(len(raw))]
    heap = [(merges[p][0], i, p) for i in range(len(ids) - 1) if (p := (ids[i], ids[i + 1])) in merges]
    heapq.heapify(heap)
    dead = bytearray(len(ids))
    while heap:
        _, i, p = heapq.heappop(heap)
        j = nxt[i]
        if dead[i] or j >= len(ids) or (ids[i], ids[j]) != p:
            continue
        ids[i] = merges[p][1]
        dead[j] = 1
        nxt[i] = nxt[j]
        if nxt[i] < len(ids):
            prev[nxt[i]] = i
        for a in (prev[i], i):
            if a >= 0 and nxt[a] < len(ids) and (q := (ids[a], ids[nxt[a]])) in merges:
                heapq.heappush(heap, (merges[q][0], a, q))
    return [t for i, t in enumerate(ids) if not dead[i]]


def encode_chunk_literally(raw: bytes, merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """As above for any vocabulary, also one whose ranks do not exceed their children's."""
    ids = list(raw)
    while found := [p for p in zip(ids, ids[1:]) if p in merges]:
        best = min(found, key=lambda p: merges[p][0])
        out: list[int] = []
        i = 0
        while i < len(ids):
            hit = i + 1 < len(ids) and (ids[i], ids[i + 1]) == best
            out.append(merges[best][1] if hit else ids[i])
            i += 1 + hit
        ids = out
    return ids


class Tokenizer:
    """Column functions over a vocabulary, which is the only thing sent to the executors (bounded by its size).

    Null and empty texts encode to an empty array.
    """

    def __init__(self, vocab: Vocab, whole: bool = False) -> None:
        self.vocab, self.whole = vocab, whole
        self.expansion = vocab.expansion()
        ranks = vocab.ranks
        self.table = {(a, b): (ranks[a, b], new) for a, b, new in vocab.merges}
        of = {new: ranks[a, b] for a, b, new in vocab.merges}
        #: Each merge comes after those of its children, as in every trained vocabulary.
        self.ordered = all(ranks[a, b] > max(of.get(a, -1), of.get(b, -1)) for a, b, _ in vocab.merges)

    def _fold(self, chunks: Column) -> Column:
        """Ids of an array of chunks by ``replace`` in order of rank, inside the JVM."""
        def one(chunk: Column) -> Column:
            tokens = T.from_text(chunk)
            for merge in self.vocab.merges:
                tokens = T.merge(tokens, *merge)
            return T.to_ids(tokens)

        ids = F.flatten(F.transform(chunks, one))
        if self.expansion:
            table = F.create_map(*[x for k, v in self.expansion.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
            ids = F.flatten(F.transform(ids, lambda t: F.coalesce(F.try_element_at(table, t), F.array(t))))
        return ids

    def _python(self, parts: Column, specials: dict[str, int]) -> Column:
        """Ids of an array of chunks in Arrow batches, each distinct chunk of a task encoded once; a special is itself."""
        table, expansion = self.table, self.expansion
        step = encode_chunk if self.ordered else encode_chunk_literally
        known: dict[str, np.ndarray] = {}

        def one(chunk: str) -> np.ndarray:
            if chunk in specials:
                return np.array([specials[chunk]], np.int32)
            return np.array([x for t in step(chunk.encode(), table) for x in expansion.get(t, (t,))], np.int32)

        @F.arrow_udf("array<int>")
        def run(batch: pa.Array) -> pa.Array:
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy())])
            coded = batch.flatten().dictionary_encode()
            if len(known) > KEPT_CHUNKS:
                known.clear()
            distinct = coded.dictionary.to_pylist()
            for c in distinct:
                if c not in known:
                    known[c] = one(c)
            ids = [known[c] for c in distinct]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            begins, flat = np.cumsum(sizes) - sizes, np.concatenate([*ids, np.zeros(0, np.int32)])
            which = coded.indices.to_numpy()
            length = sizes[which]
            ends = np.concatenate([[0], np.cumsum(length)])
            out = flat[np.repeat(begins[which] - ends[:-1], length) + np.arange(ends[-1])]
            return pa.ListArray.from_arrays(pa.array(ends[offsets], pa.int32()), pa.array(out, pa.int32()))

        return run(parts)

    def encode(self, text: Column, encode_special_tokens: bool = False) -> Column:
        """Array of ids. With ``encode_special_tokens`` specials inside texts become their ids, else they are plain text."""
        cut = (lambda t: F.when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))) if self.whole else pretokenize
        if encode_special_tokens and self.vocab.specials:
            names = self.vocab.specials
            parts = split_specials(text, list(names))
            # A plain part never gives a special as a chunk: the split took all of them out.
            return self._python(F.flatten(F.transform(parts, lambda p: F.when(p.isin(*names), F.array(p)).otherwise(cut(p)))), names)
        if self.ordered and len(self.table) <= FOLD_LIMIT:
            return self._fold(cut(text))
        return self._python(cut(text), {})

    def decode(self, ids: Column, skip_special_tokens: bool = True) -> Column:
        """Text of an array of ids, malformed UTF-8 replaced. Null and empty arrays give an empty text; unknown ids raise."""
        names = {v: k.encode() for k, v in self.vocab.specials.items()}
        raw = {t: b"" if skip_special_tokens and t in names else b for t, b in (self.vocab.token_bytes | names).items()}
        size = max(raw, default=-1) + 1
        length = np.full(size, -1, np.int64)
        for t, b in raw.items():
            length[t] = len(b)
        begin = np.concatenate([[0], np.cumsum(np.maximum(length, 0))])
        flat = np.frombuffer(b"".join(raw.get(t, b"") for t in range(size)), np.uint8)

        @F.arrow_udf("string")
        def run(batch: pa.Array) -> pa.Array:
            """Bytes of all ids of a batch at once by offsets; only malformed texts are decoded one by one."""
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy())])
            ids = pc.fill_null(batch.flatten(), -1).to_numpy()
            known = (ids >= 0) & (ids < size)
            if not (known.all() and (length[ids] >= 0).all()):
                known[known] = length[ids[known]] >= 0
                raise ValueError(f"unknown token id: {ids[~known][0]}")
            n = length[ids]
            ends = np.concatenate([[0], np.cumsum(n)])
            out = flat[np.repeat(begin[ids] - ends[:-1], n) + np.arange(ends[-1])]
            cuts = ends[offsets]
            whole = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(out)])
            try:
                return whole.cast(pa.large_string()).cast(pa.string())
            except pa.ArrowInvalid:
                return pa.array([b.as_py().decode("utf-8", "replace") for b in whole], pa.string())

        return run(ids)
