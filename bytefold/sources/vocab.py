"""Vocabulary files: tab-separated, with three columns (plain) or four (pruned)."""

from __future__ import annotations

import ast
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "token_id int, left_id int, right_id int, bytes binary, merge_rank int, is_internal boolean"


@dataclass
class Vocab:
    """A loaded vocabulary: bytes and children by id, merges with their ranks, internal ids and specials."""

    token_bytes: dict[int, bytes] = field(default_factory=lambda: {i: bytes([i]) for i in range(256)})
    children: dict[int, tuple[int, int]] = field(default_factory=dict)
    ranks: dict[tuple[int, int], int] = field(default_factory=dict)
    internal: set[int] = field(default_factory=set)
    specials: dict[str, int] = field(default_factory=dict)

    @property
    def merges(self) -> list[tuple[int, int, int]]:
        """(left, right, new) in order of rank."""
        by_pair = {c: t for t, c in self.children.items() if c != (-1, -1)}
        return [(*c, by_pair[c]) for c in sorted(by_pair, key=lambda c: self.ranks[c])]

    def expansion(self) -> dict[int, list[int]]:
        """Internal id -> the non-internal ids it stands for."""
        out: dict[int, list[int]] = {}

        def expand(t: int) -> list[int]:
            if t not in self.internal:
                return [t]
            if t not in out:
                out[t] = [x for c in self.children[t] for x in expand(c)]
            return out[t]

        for t in self.internal:
            expand(t)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, *c, bytearray(self.token_bytes[t]), self.ranks.get(c, -1) if c != (-1, -1) else -1, t in self.internal) for t, c in self.children.items()]
        return spark.createDataFrame(rows, SCHEMA)


def _children(literal: str) -> tuple[int, int]:
    pair = ast.literal_eval(literal)
    if not (isinstance(pair, tuple) and len(pair) == 2 and all(isinstance(x, int) for x in pair)):
        raise ValueError(f"not a pair of ids: {literal}")
    return pair


def _rows(path: str, columns: int):
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            line = line.rstrip("\r\n")
            if line:
                parts = line.split("\t", columns - 1 if columns == 3 else -1)
                if len(parts) != columns:
                    raise ValueError(f"{columns} columns expected: {line}")
                yield parts


def load(path: str, inter_path: str | None = None) -> Vocab:
    """Four-column files. A missing internal file is passed over; bytes come from the text column."""
    out = Vocab()
    for file, internal in ((path, False), (inter_path, True)):
        if file is None or internal and not os.path.exists(file):
            continue
        for ident, pair, literal, rank in _rows(file, 4):
            token, children, text = int(ident), _children(pair), ast.literal_eval(literal)
            if not isinstance(text, (str, bytes)):
                raise ValueError(f"neither text nor bytes: {literal}")
            raw = text.encode() if isinstance(text, str) else text
            out.children[token], out.token_bytes[token] = children, raw
            if internal:
                out.internal.add(token)
            if children == (-1, -1):
                if token >= 256:
                    out.specials[raw.decode("utf-8", "replace")] = token
            elif int(rank) < 0:
                raise ValueError(f"learned token {token} has no rank")
            else:
                out.ranks[children] = int(rank)
    return out


def load_plain(path: str) -> Vocab:
    """Three-column file. Bytes are built from the children in order of id; ids order the merges."""
    out = Vocab()
    out.children = {int(t): _children(c) for t, c, _ in _rows(path, 3)}
    for token in sorted(t for t in out.children if t >= 256):
        a, b = out.children[token]
        if a not in out.token_bytes or b not in out.token_bytes:
            raise ValueError(f"token {token} is made of missing ids {a}, {b}")
        out.token_bytes[token] = out.token_bytes[a] + out.token_bytes[b]
        out.ranks[a, b] = token
    return out


def token_literal(raw: bytes) -> str:
    """Python literal of a token: text if it is UTF-8 without control characters below U+0020, else bytes."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return repr(raw)
    return repr(raw) if any(c < " " for c in text) else repr(text)


def write(rows: DataFrame, path: str, inter_path: str) -> None:
    """Both four-column files from ``export_rows``; the driver holds the vocabulary, nothing of the corpus."""
    entries = sorted(rows.collect(), key=lambda r: r["token_id"])
    for file, internal in ((path, False), (inter_path, True)):
        with open(file, "w", encoding="utf-8", newline="\n") as out:
            out.writelines(f"{r['token_id']}\t({r['left_id']}, {r['right_id']})\t{token_literal(bytes(r['bytes']))}\t{r['merge_rank']}\n" for r in entries if r["is_internal"] == internal)


def write_plain(token_bytes: dict[int, bytes], children: dict[int, tuple[int, int]], path: str) -> None:
    """Three-column file; undecodable bytes show as U+FFFD."""
    with open(path, "w", encoding="utf-8", newline="\n") as out:
        for t in sorted(token_bytes):
            a, b = children.get(t, (-1, -1))
            out.write(f"{t}\t({a}, {b})\t{token_bytes[t].decode('utf-8', 'replace')!r}\n")
