"""Hashed character n-grams of whole texts in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .linear import Rows

MIX = np.uint64(0x9E3779B97F4A7C15)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def hashed(codes: np.ndarray, sizes: tuple[int, ...], bits: int, seed: int = 0) -> np.ndarray:
    """Buckets 1..2^bits-1 of all n-grams of the given sizes."""
    out = []
    for n in sizes:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, seed * 31 + n, np.uint64)
            for k in range(n):
                h = (h ^ codes[k : len(codes) - n + 1 + k]) * MIX
                h ^= h >> np.uint64(29)
            out.append(h >> np.uint64(64 - bits))
    return np.maximum(np.concatenate(out), 1).astype(np.int64) if out else np.zeros(0, np.int64)


def weights(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) with the square roots of the counts, scaled to length one."""
    idx, n = np.unique(buckets, return_counts=True)
    val = np.sqrt(n).astype(np.float32)
    return idx, val / max(float(np.linalg.norm(val)), 1e-9)


def rows(parts: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
    """Sparse rows with the bias in front."""
    sizes = np.fromiter((len(i) + 1 for i, _ in parts), np.int64, len(parts))
    ptr = np.concatenate([[0], np.cumsum(sizes)])
    one_i, one_v = np.zeros(1, np.int32), np.ones(1, np.float32)
    idx = np.concatenate([x for i, _ in parts for x in (one_i, i)]) if parts else np.zeros(0, np.int64)
    val = np.concatenate([x for _, v in parts for x in (one_v, v)]) if parts else np.zeros(0, np.float32)
    return Rows(ptr, idx, val.astype(np.float32))


def unpacked(i: pa.ChunkedArray, v: pa.ChunkedArray) -> Rows:
    """Sparse rows with the bias in front from columns of int32 buckets and float32 values as binary, without an object a row.
    One empty row, the bias alone, stands at the end."""
    parts = []
    for column, kind in ((i, np.int32), (v, np.float32)):
        a = column.cast(pa.large_binary()).combine_chunks()
        a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
        offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
        parts.append((offsets // 4, np.frombuffer(a.buffers()[2], kind)[offsets[0] // 4 : offsets[-1] // 4]))
    (offsets, idx), (_, val) = parts
    ptr = np.concatenate([offsets - offsets[0] + np.arange(len(offsets)), [offsets[-1] - offsets[0] + len(offsets)]])
    own = np.ones(ptr[-1], bool)
    own[ptr[:-1]] = False
    out_i, out_v = np.zeros(ptr[-1], np.int32), np.ones(ptr[-1], np.float32)
    out_i[own], out_v[own] = idx, val
    return Rows(ptr, out_i, out_v)
