"""Pages of repeated key phrases, links and tags instead of sentences.

Features of each document (densities of links, tags, price lines and phrase lines, entropy, repetition, share of function
words, punctuation) are compared with the robust centre and scatter of its language, over all documents, copies counting
once. An outlier by Mahalanobis distance is spam if it lies in a direction of spam and at least as far out in it as the
language's middle document would with half of its characters replaced by the outlier's own mix of such material; length
and angle are measured in the same metric, so what else is odd about a document counts, too.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import ensure_checkpoint_dir
from .common import table

#: Share of a language's documents from which a word is a function word; squared distance (99.9 % of chi-square with as
#: many degrees as features); part of a text replaced by material that marks how far out spam begins; least cosine between
#: a deviation and its direction of spam; coverage below which a segment is no sentence; uses from which a word is a key
#: word; documents below which a language takes the statistics of all documents.
FUNCTION_SHARE, DISTANCE, SPAM_SHARE, COSINE, SENTENCE, KEY_USES, FEW = 0.1, 26.12, 0.5, 0.5, 0.7, 4, 50
#: Share of function words from which a text is no code.
PLAIN = 0.85
#: Densities of material and the other features. Spam raises the former and lowers the share of function words.
MATERIAL = ("link", "tag", "price", "phrase")
FEATURES = (*MATERIAL, "entropy", "repeat", "function", "punctuation")
FLOOR = 0.05  # least scale of a feature
EVERY = "*"  # the group of all documents
SPAN = 24  # words of a span by which copies are known, 16 + 8

CJK = "぀-ヿ㐀-鿿豈-﫿"
SIGN = re.compile(f"[{CJK}]")
WORD = re.compile(rf"[^\W_{CJK}]+|[{CJK}]")
SIGNLESS_WORD = re.compile(r"[^\W_]+")
#: Lower case of ASCII, with a blank for what is in no word.
ASCII = "".join(c.lower() if c.isalnum() else " " for c in map(chr, range(128)))
SEGMENT = re.compile(r"[^\n.!?。！？]*(?:[.!?。！？](?![\s\"”')\]])[^\n.!?。！？]*)*[.!?。！？]*[ \t]*\n?")
LINK = re.compile(r"https?://|www\.\w|<a\s+href|\]\(")
HASHTAG = re.compile(r"#[^\s#]+")
PRICE = re.compile(r"(?:[$€£¥]|\b(?:EUR|USD|GBP|RUB))\s?\d|\d\s?(?:€|£|\$|EUR\b|USD\b|руб|元|円)")
#: Strings of which a link or a price holds at least one; looking for them costs a fraction of the pattern.
LINK_SIGNS = ("://", "www.", "<a", "](")
PRICE_SIGNS = ("$", "€", "£", "¥", "EUR", "USD", "GBP", "RUB", "руб", "元", "円")
CODE_START = re.compile(r"\s*(?:(?:import|from|def|class|return|const|let|var|function|export|if|for|while|else|public|private|static|package|namespace|#include|@|\}|\)|//|/\*|\*|# )\b|[\w.\[\]]+ [+\-*/]?= |[\w.]+\(.*\)\s*$)")
CODE_ENDS = (";", "{", "}", ":")


def has_link(text: str) -> bool:
    return any(map(text.__contains__, LINK_SIGNS)) and LINK.search(text) is not None


def has_price(text: str) -> bool:
    return any(map(text.__contains__, PRICE_SIGNS)) and PRICE.search(text) is not None


def is_code(line: str) -> bool:
    return line.rstrip().endswith(CODE_ENDS) or "=>" in line or CODE_START.match(line) is not None


def words_of(text: str) -> list[str]:
    """Lower-case words, each sign of Chinese and Japanese being one; texts without signs have cheaper ways to the same."""
    if text.isascii():
        return text.translate(ASCII).split()
    low = text.lower()
    return (WORD if SIGN.search(low) else SIGNLESS_WORD).findall(low)


class Hashes(dict):
    """Hashes of words as 8 bytes, kept while there are not too many."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "surrogatepass")).to_bytes(8, "little")
        return h


HASHES = Hashes()
STEP = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4, 8, 16)]
BLOCK = 1 << 16  # words from which the texts at hand are sketched together


def sketches(found: list[list[str]]) -> list[int]:
    """Least hash of the spans of SPAN words of each text: equal for equal texts and, but by chance, for slightly extended ones."""
    if not found:
        return []
    parts = [b"".join(map(HASHES.__getitem__, words)) for words in found]
    for i, p in enumerate(parts):
        if len(p) < 8 * SPAN:
            parts[i] = (np.frombuffer(p, "<u8") + np.uint64(1)).tobytes() + bytes(8 * SPAN - len(p)) if p else bytes(8 * SPAN)
    x = np.frombuffer(b"".join(parts), "<u8")
    for k, step in enumerate(STEP[:4]):  # spans of 2, 4, 8 and 16 words
        eight = x
        x = x[: -(1 << k)] * step + x[1 << k :]
    x = x[:-8] * STEP[4] + eight[16:]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    end = np.cumsum([len(p) // 8 for p in parts])
    # A text's spans begin from its first word to the last but 23; those between begin in one text and end in another.
    bounds = np.stack([np.concatenate([[0], end[:-1]]), end - SPAN + 1], axis=1).ravel()
    return (np.minimum.reduceat(x, bounds[:-1])[::2] >> np.uint64(1)).tolist()


def sketched(texts: Iterable[str]) -> Iterator[tuple[list[str], int]]:
    """(words, sketch) of each text, in order."""
    held: list[list[str]] = []
    size = 0
    for text in texts:
        held.append(words := words_of(text))
        size += len(words)
        if size >= BLOCK:
            yield from zip(held, sketches(held))
            held, size = [], 0
    yield from zip(held, sketches(held))


def function_words(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[str, ...]]:
    """word -> languages in whose documents it is frequent. Counts all documents with a language, a group of copies as one.

    One document of each sketch goes from a task, as its distinct words, so a group of copies is a row a task; they are
    counted within a task first, so a frequent word leaves it once. No language has more than (words of a document) /
    FUNCTION_SHARE such words.
    """

    def voters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, int]] = set()
        for b in batches:
            rows = []
            for l, (ws, k) in zip(b["l"], sketched(b["t"])):
                if (at := (l, k)) not in seen:
                    seen.add(at)
                    rows.append((*at, " ".join(sorted(set(ws)))))
            if len(seen) > 1 << 17:
                seen.clear()
            yield pd.DataFrame(rows, columns=["l", "k", "ws"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter[str]] = {}
        last = None

        def out() -> pd.DataFrame:
            rows = [(l, w, n) for l, c in held.items() for w, n in c.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["l", "w", "c"])

        for b in batches:
            for l, k, ws in zip(b["l"], b["k"], b["ws"]):
                if (l, k) == last:
                    continue
                last = l, k
                c = held.setdefault(l, Counter())
                c.update(ws.split())
                c[""] += 1  # documents
            if sum(map(len, held.values())) > 1 << 18:
                yield out()
        yield out()

    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.where(f"{text} is not null and {lang} is not null").select(F.col(lang).alias("l"), F.col(text).alias("t"))
    voting = rows.mapInPandas(voters, "l string, k long, ws string").repartition("l", "k").sortWithinPartitions("l", "k", "ws")
    counts = voting.mapInPandas(partial, "l string, w string, c long").groupBy("l", "w").agg(F.sum("c").alias("c")).checkpoint()  # read twice
    sizes = {r.l: r.c for r in counts.where("w = ''").collect()}  # a row per language
    if not sizes:
        return {}
    least = F.create_map(*[x for l, n in sizes.items() for x in (F.lit(l), F.lit(max(3.0, FUNCTION_SHARE * n)))])
    out: dict[str, list[str]] = {}
    for r in counts.where(F.col("w") != "").where(F.col("c") >= F.element_at(least, F.col("l"))).select("l", "w").collect():
        out.setdefault(r.w, []).append(r.l)
    return {w: tuple(sorted(ls)) for w, ls in out.items()}


class Known:
    """Function words with the number of their set of languages; there are few such sets."""

    def __init__(self, words: dict[str, tuple[str, ...]]) -> None:
        self.sets = sorted(set(map(tuple, words.values())))
        number = {s: k for k, s in enumerate(self.sets)}
        self.set_of = {w: number[tuple(s)] for w, s in words.items()}
        self.words = {l: {w for w, s in words.items() if l in s} for s in self.sets for l in s}


#: n log n of small counts.
N_LOG_N = [0.0, *(n * math.log(n) for n in range(1, 1 << 12))]


def measure(text: str, lang: str | None, known: Known, found: list[str] | None = None) -> tuple[str, list[float]]:
    """(language by function words, features) of a document. found: its words, if they are at hand."""
    counts = Counter(words_of(text) if found is None else found)
    total = sum(counts.values())
    by_set = [0] * len(known.sets)
    for w in counts.keys() & known.set_of.keys():
        by_set[known.set_of[w]] += counts[w]
    votes: Counter[str] = Counter()
    for n, langs in zip(by_set, known.sets):
        if n:
            for l in langs:
                votes[l] += n
    codes = votes.pop("code", 0)
    group = max(votes, key=lambda l: (votes[l], l)) if votes else (lang or "")
    function = votes[group] / max(1, total)
    most = max(counts.values(), default=0)
    n_log_n = sum(map(N_LOG_N.__getitem__, counts.values())) if most < len(N_LOG_N) else sum(n * math.log(n) for n in counts.values())
    entropy = 1 - n_log_n / (total * math.log(total)) if total > 1 else 1.0
    punctuation = min(1.0, sum(map(text.count, ".!?。！？,，")) * 10 / len(text))
    share = dict.fromkeys(MATERIAL, 0.0)
    code = False
    if function < PLAIN:
        lines = [x for x in text.split("\n") if x.strip()]
        if code := len(lines) > 3 and sum(map(is_code, lines)) >= 0.4 * len(lines) and sum(map(has_link, lines)) < 0.5 * len(lines):
            group, function = "code", codes / max(1, total)
    natural = known.words.get(group, set())
    key = {w for w, n in counts.items() if n >= KEY_USES and w not in natural and (len(w) > 2 or not w.isascii()) and not w.isdigit()}
    if key or "#" in text or has_link(text) or has_price(text):  # else no segment is material
        natural = counts.keys() & natural
        size = 0
        for s in SEGMENT.findall(text):
            if not (n := len(s.strip())):
                continue
            size += n
            if has_link(s):
                share["link"] += n
            elif code:
                continue
            elif "#" in s and sum(map(len, HASHTAG.findall(s))) > n / 2:
                share["tag"] += n
            else:
                ws = words_of(s)
                if sum(w in natural for w in ws) < SENTENCE * max(1, len(ws)):
                    if has_price(s):
                        share["price"] += n
                    elif any(w in key for w in ws):
                        share["phrase"] += n
        share = {k: v / max(1, size) for k, v in share.items()}
    return group, [*share.values(), entropy, 1 - len(counts) / max(1, total), function, punctuation]


def form(x: Column, y: Column) -> Column:
    """x' S^-1 y by the inverse scatter of the row's language."""
    row = lambda a, i: a * F.aggregate(F.zip_with(y, F.get("inv", i), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(F.transform(x, row), F.lit(0.0), lambda s, v: s + v)


def spam(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key) of spam documents. Null, empty and blank texts are none; repeated rows come out as often.

    Every document is measured whole, and the statistics cover all documents of a language, a group of copies by its mean.
    Documents of no language, and of one with less than FEW documents, are compared with all documents.
    """
    known = Known(function_words(docs, text, lang))
    names = list(FEATURES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *measure(t, l, known, ws), k) for i, t, l, (ws, k) in zip(b["key"], b["text"], b["lang"], sketched(b["text"]))]
            yield pd.DataFrame({"key": [r[0] for r in rows], "grp": [r[1] for r in rows], "k": [r[3] for r in rows]} | {n: [r[2][k] for r in rows] for k, n in enumerate(names)})

    kind = docs.schema[key].dataType.simpleString()
    some = docs.where(F.trim(F.regexp_replace(text, r"\s+", " ")) != "").select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    f = some.mapInPandas(run, f"key {kind}, grp string, k long, " + ", ".join(f"{n} double" for n in names)).checkpoint()  # ten numbers a document
    once = f.groupBy("grp", "k").agg(*[F.avg(n).alias(n) for n in names])
    once = once.select(F.explode(F.array("grp", F.lit(EVERY))).alias("grp"), *names)
    middle = once.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), *[F.percentile_approx(n, 0.5, 1000).alias(f"m_{n}") for n in names])
    middle = middle.where((F.col("size") >= FEW) & (F.col("grp") != "") | (F.col("grp") == EVERY))
    off = once.join(F.broadcast(middle), "grp")  # a row per language
    scale = off.groupBy("grp").agg(*[F.greatest(1.4826 * F.percentile_approx(F.abs(F.col(n) - F.col(f"m_{n}")), 0.5, 1000), F.lit(FLOOR)).alias(f"s_{n}") for n in names])
    scaled = {n: (F.col(n) - F.col(f"m_{n}")) / F.col(f"s_{n}") for n in names}
    clip = {n: F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z)) for n, z in scaled.items()}
    # Scatter of the winsorised deviations, so the spam itself does not widen it.
    moments = off.join(F.broadcast(scale), "grp").groupBy("grp").agg(*[F.avg(clip[a] * clip[b]).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).collect()  # a row per language
    inverse = {}
    for r in moments:
        m = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
        # Never less than the unit scatter of the scaled features: where there is little variation nothing is an outlier.
        inverse[r.grp] = np.linalg.inv(m + np.diag(np.maximum(1 - np.diag(m), 0.05))).tolist()
    table_of = docs.sparkSession.createDataFrame(list(inverse.items()) or [("", [[0.0]])], "grp string, inv array<array<double>>")
    known_groups = [g for g in inverse if g != EVERY]
    placed = f.withColumn("grp", F.when(F.col("grp").isin(*known_groups), F.col("grp")).otherwise(EVERY) if known_groups else F.lit(EVERY))
    rows = placed.join(F.broadcast(middle), "grp").join(F.broadcast(scale), "grp").join(F.broadcast(table_of), "grp")
    total = sum((F.col(n) for n in MATERIAL), F.lit(0.0))
    rows = rows.where(total > 0)  # others point in no direction of spam
    toward = {n: (SPAM_SHARE * F.col(n) / total - F.col(f"m_{n}")) / F.col(f"s_{n}") for n in MATERIAL}
    # Half a text's function words go with it at most, and none if the material holds as many.
    toward["function"] = F.least(F.lit(0.0), F.greatest(scaled["function"], -SPAM_SHARE * F.col("m_function") / F.col("s_function")))
    z, b = F.array(*[scaled[n] for n in names]), F.array(*[toward.get(n, F.lit(0.0)) for n in names])
    rows = rows.select("key", "inv", z.alias("z"), b.alias("b"))
    rows = rows.select("key", form(F.col("z"), F.col("z")).alias("d2"), form(F.col("z"), F.col("b")).alias("along"), form(F.col("b"), F.col("b")).alias("reach2"))
    directed = (F.col("along") > 0) & (F.pow("along", F.lit(2)) >= COSINE**2 * F.col("d2") * F.col("reach2"))
    return rows.where((F.col("d2") > DISTANCE) & directed & (F.col("along") >= F.col("reach2"))).select(F.col("key").alias(key))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam(table(spark, sf, "documents"))


QUERIES = {"p10_found": p10_found}
