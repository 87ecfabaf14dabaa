"""Natural language in the comments and string literals of Python files.

A lexer of six states finds the spans. Over a chunk of a file it is a function from the state before to the state after;
composing these functions by prefix gives every chunk its state, so chunks of a huge file are lexed apart, and only the
spans at their borders are joined. Spans are labelled by multinomial logistic regression on hashed character n-grams.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import ensure_checkpoint_dir
from . import ngrams
from .common import hash_sample, table
from .linear import Linear, fit

#: Characters of a chunk; size of the feature space.
CHUNK, BITS = 1 << 16, 16
#: The labelled sample (parameters): documents, sentences of each, files, spans of each, characters of the longest span in it.
TRAIN_DOCS, TRAIN_SENTENCES, TRAIN_FILES, TRAIN_SPANS, TRAIN_CHARS = 3000, 12, 1500, 64, 2000
MIN_WORDS, MIN_SIGNS = 5, 8
NONE = "-"

CODE, COMMENT, TRIPLE_S, TRIPLE_D, SINGLE, DOUBLE = range(6)
OPEN = re.compile(r"#|'''|\"\"\"|'|\"")
STATE_OF = {"#": COMMENT, "'''": TRIPLE_S, '"""': TRIPLE_D, "'": SINGLE, '"': DOUBLE}
CLOSE = {
    COMMENT: re.compile(r"(?=\n)"),
    TRIPLE_S: re.compile(r"(?:[^'\\]|\\.|'(?!''))*?'''", re.S),
    TRIPLE_D: re.compile(r'(?:[^"\\]|\\.|"(?!""))*?"""', re.S),
    SINGLE: re.compile(r"(?:[^'\\\n]|\\.)*(?:'|(?=\n))", re.S),
    DOUBLE: re.compile(r'(?:[^"\\\n]|\\.)*(?:"|(?=\n))', re.S),
}
PREFIX = re.compile(r"[A-Za-z]{0,2}$")


def lex(text: str, state: int, base: int = 0) -> tuple[int, list[tuple[int, int, int, int]]]:
    """(state after, spans) of a chunk entered in a state. A span is (kind, start, end, open): open has bit 1 if it began
    before the chunk and bit 2 if it goes on after it; places count from ``base``."""
    spans, i, n = [], 0, len(text)
    start, kind, opened = 0, state, 1 if state else 0
    while True:
        if kind == CODE:
            m = OPEN.search(text, i)
            if not m:
                return CODE, spans
            start, kind, opened, i = m.start(), STATE_OF[m[0]], 0, m.end()
        m = CLOSE[kind].search(text, i) if kind == COMMENT else CLOSE[kind].match(text, i)
        if not m:
            spans.append((kind, base + start, base + n, opened | 2))
            return kind, spans
        i = m.end()
        spans.append((kind, base + start, base + i, opened))
        kind = CODE


def transition(text: str) -> list[int]:
    """The state after a chunk for each state before it."""
    return [lex(text, s)[0] for s in range(6)]


def entry_states(maps: list[list[int]]) -> list[int]:
    """State before every chunk: the prefix composition of the chunks' functions, applied to code.

    The composition is associative, so it may be made in any grouping; here by doubling (parallel prefix).
    """
    m = np.array(maps, np.int64).reshape(-1, 6)
    step = 1
    while step < len(m):
        m = np.concatenate([m[:step], np.take_along_axis(m[step:], m[:-step], axis=1)])
        step *= 2
    return [CODE, *m[:-1, CODE].tolist()] if len(m) else []


def cuts(text: str, size: int) -> list[int]:
    """Ends of the chunks of a text: after ``size`` characters, moved on to where no quote or backslash is near the cut."""
    out, at = [], size
    while at < len(text):
        while at < len(text) and any(c in "'\"\\" for c in text[at - 1 : at + 2]):
            at += 1
        if at < len(text):
            out.append(at)
        at += size
    return [*out, len(text)]


def spans_of(text: str, size: int = CHUNK) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all comments and literals of a file, lexed chunk by chunk."""
    ends = cuts(text, size)
    begins = [0, *ends[:-1]]
    states = entry_states([transition(text[a:b]) for a, b in zip(begins, ends)]) if len(ends) > 1 else [CODE]
    return stitched([s for a, b, q in zip(begins, ends, states) for s in lex(text[a:b], q, a)[1]])


def stitched(pieces: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces in order, those that go on joined with what follows."""
    out: list[list[int]] = []
    going = False
    for kind, a, b, opened in pieces:
        if opened & 1 and going and out:
            out[-1][2] = b
        else:
            out.append([kind, a, b])
        going = bool(opened & 2)
    return [tuple(x) for x in out]


def is_raw(text: str, a: int) -> bool:
    return "r" in PREFIX.search(text, max(0, a - 2), a)[0].lower()


def stands_alone(text: str, a: int, blank: bool = True) -> bool:
    """Whether only blanks stand before place ``a`` in its line; ``blank`` says so of what came before the text."""
    line = text.rfind("\n", 0, a) + 1
    return not text[line:a].strip(" \t\f\r﻿") and (line > 0 or blank)


def joined(spans: list[tuple[int, int, str, bool, bool]]) -> list[tuple[int, str]]:
    """(line_no, content) of spans (kind, line_no, text with its marks, alone, raw): adjacent comment-only lines as one,
    literals without quotes."""
    out: list[tuple[int, str]] = []
    last = -9  # line of the last comment-only line
    for kind, line, t, alone, raw in spans:
        if kind == COMMENT:
            if alone and last == line - 1:
                out[-1] = (out[-1][0], out[-1][1] + "\n" + t[1:])
            else:
                out.append((line, t[1:]))
            last = line if alone else -9
        else:
            q = 3 if kind in (TRIPLE_S, TRIPLE_D) else 1
            out.append((line, t[q:-q] if raw else unescaped(t[q:-q])))
            last = -9
    return out


def contents(text: str, size: int = CHUNK) -> list[tuple[int, str]]:
    """(line_no, content) of the comments and literals of a file."""
    found, line, at = [], 1, 0
    for kind, a, b in spans_of(text, size):
        line += text.count("\n", at, a)
        at = a
        found.append((kind, line, text[a:b], kind == COMMENT and stands_alone(text, a), kind != COMMENT and is_raw(text, a)))
    return joined(found)


ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|(\n)|(.))", re.S)


def unescaped(s: str) -> str:
    if "\\" not in s:
        return s

    def one(m: re.Match[str]) -> str:
        if code := m[1] or m[2] or m[3]:
            return chr(int(code, 16)) if int(code, 16) <= 0x10FFFF else " "
        return "" if m[4] else " " if m[5] in "nrtfv" else m[5]

    s = ESCAPE.sub(one, s)
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in s) else s


SIGNS = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
HOLES = re.compile(r"\{[^{}\n]*\}|%\(?\w*\)?[sdrf]\b|^\s*:\w+[^\n]*$|https?://\S+|<[^<>\n]*>", re.M)
#: A licence or copyright notice by its form: a line of copyright, a tag, a line that states a licence (fixed values).
NOTICE = re.compile(
    r"(?im)^[\s*#/!\"'\ufeff]*(?:(?:copyright|©|\(c\))[\s(c)©]*)+\d{4}"
    r"|spdx-license-identifier"
    r"|^\W*(?:licen[cs]ed?|lizenz|licence|licencia|licença|lisenssi|лицензия|许可证?|许可协议|ライセンス|terms)\s*(?:[-:=：]|under\b)"
)


def prose(content: str) -> str | None:
    """The words of a span, or None where there are too few to be running language."""
    t = HOLES.sub(" ", content) if any(c in content for c in "{%:<") else content
    if not t.isascii() and SIGNS.search(t):
        return t if len(SIGNS.findall(t)) >= MIN_SIGNS or len(WORD.findall(SIGNS.sub(" ", t))) >= MIN_WORDS else None
    return t if len(WORD.findall(t)) >= MIN_WORDS else None


def coded(t: str) -> bool:
    """Whether a span is plainly code, a query, a path, a setting or data (weak label, for training only)."""
    return bool(re.search(r"\w\(|\w_\w|[=;{}\[\]|<>]|\bSELECT\b|\bINSERT\b|://|\w/\w|-----|\\|\w\.\w+\(|[A-Za-z0-9+/]{30,}", t)) or " " not in t.strip() and not SIGNS.search(t)


def vector(t: str) -> tuple[np.ndarray, np.ndarray]:
    t = re.sub(r"\d+", "0", re.sub(r"\s+", " ", f" {t.strip()} "))
    return ngrams.weights(ngrams.hashed(ngrams.points(t), (1, 2, 3, 4), BITS))


def train(files: DataFrame, documents: DataFrame) -> tuple[np.ndarray, list[str]]:
    """(weights, labels). Languages are learned from sentences of about TRAIN_DOCS documents, of which a few have a wrong
    label; what is no language from plainly coded spans and notices of about TRAIN_FILES files. Which of their sentences and
    spans are taken is decided by hashes; spans beyond TRAIN_CHARS are no samples."""
    docs = hash_sample(documents.where("text is not null and length(lang) = 2"), "doc_id", TRAIN_DOCS)
    sentences = F.filter(F.split("text", r"(?<=[.!?。！？])\s*|\n+"), lambda s: F.length(s).between(12, TRAIN_CHARS))
    ranked = F.slice(F.array_sort(F.transform(sentences, lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("t")))), 1, TRAIN_SENTENCES)
    got = docs.select("lang", F.explode(ranked).alias("x")).select("lang", "x.t").toPandas()
    sample = hash_sample(files, "file_id", TRAIN_FILES).select("file_id", "content")

    def negatives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["content"]:
                mine = [t for _, content in contents(text) if (t := prose(content)) is not None and len(t) <= TRAIN_CHARS and (coded(t) or NOTICE.search(content))]
                out += sorted(mine, key=lambda t: zlib.crc32(t.encode("utf-8", "surrogatepass")))[:TRAIN_SPANS]
            yield pd.DataFrame({"t": out}, dtype="object")

    none = sample.mapInPandas(negatives, "t string").toPandas()["t"].tolist()
    texts = [*got["t"], *none]
    labels = sorted(set(got["lang"])) + [NONE]
    y = np.array([labels.index(x) for x in got["lang"]] + [len(labels) - 1] * len(none), np.int64)
    if not texts:
        return np.zeros((1 << BITS, len(labels)), np.float32), labels
    share = np.bincount(y, minlength=len(labels))
    weight = np.sqrt(len(y) / len(labels) / np.maximum(share, 1))[y].clip(0.3, 4).astype(np.float32)
    model = fit(ngrams.rows([vector(t) for t in texts]), y, 1 << BITS, "softmax", classes=len(labels), epochs=6, rate=0.5, weight=weight)
    return model.weights, labels


def chunked(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """(file_id, n, content) of files beyond ``size``: chunks with safe cuts, one row each.

    A file is one value of a table, so it is read by one task; its chunks are then dealt out to all tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, text in zip(b["file_id"], b["content"]):
                ends = cuts(text, size)
                yield pd.DataFrame({"file_id": i, "n": range(len(ends)), "content": [text[x:y] for x, y in zip([0, *ends[:-1]], ends)]})

    return files.mapInPandas(run, "file_id long, n int, content string").repartition("file_id", "n")


def find(files: DataFrame, documents: DataFrame, size: int = CHUNK) -> DataFrame:
    """(file_id, line_no, lang) of every span of running language in Python files (file_id, content).

    Null and empty contents have none. Repeated rows come out as often. Unclosed literals end with their line, triple
    quoted ones with the file.
    """
    files = files.where("content is not null").select("file_id", "content")
    matrix, labels = train(files, documents)

    def label(found: list[tuple[int, int, str]]) -> pd.DataFrame:
        keep = [(i, line, t) for i, line, c in found if not NOTICE.search(c) and (t := prose(c)) is not None]
        best = Linear(matrix).scores(ngrams.rows([vector(t) for _, _, t in keep])).argmax(axis=1)
        out = [(i, line, labels[k]) for (i, line, _), k in zip(keep, best) if labels[k] != NONE]
        return pd.DataFrame(out, columns=["file_id", "line_no", "lang"])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield label([(i, line, c) for i, text in zip(b["file_id"], b["content"]) for line, c in contents(text)])

    out = "file_id long, line_no long, lang string"
    small = files.where(F.length("content") <= size).mapInPandas(whole, out)
    ensure_checkpoint_dir(files.sparkSession)
    parts = chunked(files.where(F.length("content") > size), size).checkpoint()  # only the huge files; read twice

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tails = [t.rpartition("\n") for t in b["content"]]
            yield pd.DataFrame({"file_id": b["file_id"], "n": b["n"], "m": [transition(t) for t in b["content"]], "lines": [t.count("\n") for t in b["content"]], "ends": [bool(x[1]) for x in tails], "blank": [not x[2].strip(" \t\f\r﻿") for x in tails]})

    def prefix(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n")
        blank, before = [], True
        for ends, rest in zip(g["ends"], g["blank"]):
            blank.append(before)
            before = rest and (ends or before)
        return pd.DataFrame({"file_id": g["file_id"], "n": g["n"], "state": entry_states([list(m) for m in g["m"]]), "line": (g["lines"].cumsum() - g["lines"] + 1).astype("int64"), "blank": blank})

    # A few numbers a chunk come together for each file.
    states = parts.mapInPandas(maps, "file_id long, n int, m array<int>, lines long, ends boolean, blank boolean").groupBy("file_id").applyInPandas(prefix, "file_id long, n int, state int, line long, blank boolean")

    def lexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Labels of what is settled inside a chunk (kind -1), and the pieces at its borders that may go on in another."""
        for b in batches:
            done, settled = [], []
            for i, n, text, state, line, blank in zip(b["file_id"], b["n"], b["content"], b["state"], b["line"], b["blank"]):
                found, opens, at, no = [], [], 0, 0
                for kind, a, e, o in lex(text, state)[1]:
                    no += text.count("\n", at, a)
                    at = a
                    found.append((kind, no, text[a:e], kind == COMMENT and not o & 1 and stands_alone(text, a, blank), kind != COMMENT and is_raw(text, a)))
                    opens.append(o)
                last = text.count("\n")
                follows = lambda k: found[k][0] == COMMENT == found[k - 1][0] and found[k][3] and (found[k - 1][3] or opens[k - 1] & 1) and found[k][1] == found[k - 1][1] + 1  # noqa: B023, E731
                head, tail = 0, len(found)
                if found and (opens[0] & 1 or found[0][3] and found[0][1] < 2):
                    head = 1
                    while head < len(found) and follows(head):
                        head += 1
                if found and (opens[-1] & 2 or found[-1][3] and found[-1][1] >= last - 1):
                    tail -= 1
                    while tail > head and follows(tail):
                        tail -= 1
                tail = max(tail, head)
                settled += [(i, line + no, c) for no, c in joined(found[head:tail])]
                done += [(i, n, k, line + found[k][1], found[k][0], found[k][2], opens[k] | 4 * found[k][3] | 8 * found[k][4]) for k in [*range(head), *range(tail, len(found))]]
            yield pd.concat([label(settled).assign(n=-1, k=0, kind=-1, t=None, o=0), pd.DataFrame(done, columns=["file_id", "n", "k", "line_no", "kind", "t", "o"]).assign(lang=None)])[columns]

    columns = ["file_id", "line_no", "lang", "n", "k", "kind", "t", "o"]
    pieces = parts.join(states.hint("shuffle_hash"), ["file_id", "n"]).mapInPandas(lexed, out + ", n int, k int, kind int, t string, o int").checkpoint()  # spans at borders and labels

    def borders(g: pd.DataFrame) -> pd.DataFrame:
        spans: list[list] = []
        going = False
        for line, kind, t, o in g.sort_values(["n", "k"])[["line_no", "kind", "t", "o"]].itertuples(index=False):
            if o & 1 and going:
                spans[-1][2] += t
            else:
                spans.append([kind, line, t, bool(o & 4), bool(o & 8)])
            going = bool(o & 2)
        return label([(int(g["file_id"].iloc[0]), line, c) for line, c in joined([tuple(x) for x in spans])])

    big = pieces.where("kind < 0").select("file_id", "line_no", "lang").unionByName(pieces.where("kind > 0").groupBy("file_id").applyInPandas(borders, out))
    return small.unionByName(big)


def _py(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus_file").where("suffix = '.py'")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return find(_py(spark, sf), table(spark, sf, "documents"))


QUERIES = {"p6_found": p6_found}
