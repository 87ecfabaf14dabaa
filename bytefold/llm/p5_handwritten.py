"""Generated, minified, vendored files and data blobs among JavaScript.

Linear support-vector classifiers, one a kind, on hashed character n-grams (of the characters and of their shapes) and path
components learn from weak labels: tool headers, banners, package folders, shapes of lines and literals. Every labelled file
is learned with its giveaways (headers and tools' marks, wherever they stand) masked, and once more with them as
n-grams of their own, so that a classifier can't lean on them but hears them where a file shows nothing else. The labels'
patterns take no part in prediction: all rows come from the scores, whose thresholds come from repositories held out, and
from equal bodies: copies of a file found vendored are vendored wherever they lie.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import ensure_checkpoint_dir
from . import ngrams
from .common import hash_sample, salted_left_join, table
from .linear import Linear, fit

#: Files of the labelled sample and heaviest features of each that the fit takes (parameters, which bound what reaches the
#: driver), size of the feature space, words beyond which equal bodies are copies.
TRAIN_FILES, TRAIN_FEATURES, BITS, COPY_WORDS = 4000, 8192, 17, 8
WORD = re.compile(r"\w+")
KINDS = ("generated", "minified", "vendored", "data")
SUFFIXES = (".js", ".mjs", ".cjs")

LEADING = re.compile(r"\A﻿?(?:#![^\n]*\n)?(?:\s*(?:/\*(?!\*{5}/)[\s\S]*?\*/|//[^\n]*(?:\n|\Z)))+")
TOOL = re.compile(r"(?im)@generated\b|^\W*(?:this (?:file|code|module) (?:was|is|has been) )?(?:auto[- ]?generated|code generated|generated|created automatically|automatically (?:created|generated)|produced(?: automatically)?)\b[^\n]{0,40}\b(?:by|with|from)\b|automatisch (?:erzeugt|generiert|erstellt)|(?:自动生成|自動生成|自动產生)|générée? automatiquement|(?:generad|gerad)[oa] (?:automáticamente|automaticamente)|автоматически (?:созда|сгенер)|сгенерирован[оа]? автоматически|luotu automaattisesti")
OUTPUT = re.compile(r"//[#@] sourceMappingURL=|__webpack_|/\*{6}/ |this && this\.__\w+|jspb\.Message|this\.\$ = \$\$\[|\$root\.\w+ = \(function|Object\.defineProperty\(exports, \"__esModule\"")
BANNER = re.compile(r"(?i)/\*!?[\s*]*(?:@file\s+)?[\w.@/-]+[ \t]+v?\d+\.\d+(?:\.\d+)?\b|@version\s+v?\d+\.\d+|\(c\) the [\w.-]+ authors")
PACKAGES = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|third[_-]?party|3rd[_-]?party|vendor)/", re.I)
LITERAL = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
LONG = 200  # characters from which a literal is data rather than text
DATA_LINE = re.compile(r"^\s*(?:[\[{(]?\s*(?:-?\d[\d.eE+-]*|0x[0-9a-fA-F]+|\"[^\"]*\"|'[^']*'|null|true|false)\s*[,:]?\s*[\]})]*,?\s*)*(?:\"[^\"]*\"\s*:\s*\{[^{}]*\},?)?\s*[\]})]*[,;]?\s*$")


def body_of(content: str) -> str:
    """Content without leading comments; line ends unified."""
    return LEADING.sub("", content.replace("\r\n", "\n"), count=1).strip()


def shape(body: str) -> tuple[float, float, float]:
    """(mean length of lines weighted by length, share of blanks, share of data); the first two without long literals."""
    total = max(1, len(body))
    blobs = 0

    def cut(m: re.Match[str]) -> str:
        nonlocal blobs
        if m.end() - m.start() < LONG:
            return m[0]
        blobs += m.end() - m.start()
        return '""'

    rest = LITERAL.sub(cut, body) if len(body) > LONG else body
    lines = rest.split("\n")
    size = max(1, len(rest))
    mean = sum(len(x) ** 2 for x in lines) / size
    blank = sum(rest.count(c) for c in " \t\n") / size
    listed = sum(len(x) + 1 for x in lines if any(c.isdigit() or c in "\"'" for c in x) and len(x) > 8 and DATA_LINE.match(x))
    return mean, blank, (blobs + listed) / total


def marks(path: str, content: str) -> tuple[set[str], bool]:
    """(kinds a file shows by itself, whether it is surely none of them): weak labels, for training only."""
    head = m[0] if (m := LEADING.match(content.replace("\r\n", "\n"))) else ""
    body = body_of(content)
    mean, blank, data = shape(body)
    out = set()
    if TOOL.search(head) or OUTPUT.search(content):
        out.add("generated")
    if data > 0.75 and len(body) > 300:
        out.add("data")
    elif (mean > 200 and blank < 0.14 and len(body) > 300) or re.search(r"[.-]min\.[cm]?js$", path):
        out.add("minified")
    if PACKAGES.search(path) or BANNER.search(head):
        out.add("vendored")
    return out, not out and data < 0.7 and mean < 120


#: What the shape n-grams see of each ASCII character, and of all others.
SHAPE = np.array([97 if chr(c).islower() else 65 if chr(c).isupper() else 48 if chr(c).isdigit() else 10 if c == 10 else 32 if chr(c).isspace() else c for c in range(128)], np.uint64)


def features(path: str, content: str) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(masked, giveaways), each as (buckets, values): n-grams of the whole body without giveaways and path components;
    n-grams of the leading comments and tools' marks."""
    body = body_of(content)
    told = [LEADING.match(content.replace("\r\n", "\n"))]
    told = [m[0] for m in told if m]
    if OUTPUT.search(body):
        told += OUTPUT.findall(body)
        body = OUTPUT.sub(" ", body)
    codes = ngrams.points(body)
    shapes = SHAPE[np.where(codes < 128, codes, 127).astype(np.int64)]
    if len(shapes):
        shapes = shapes[np.concatenate([[True], shapes[1:] != shapes[:-1]])]
    idx, val = ngrams.weights(np.concatenate([ngrams.hashed(codes, (4,), BITS), ngrams.hashed(shapes, (4, 6), BITS, 1)]))
    parts = [p for p in re.split(r"[/]", path.lower())[2:-1]]
    parts += ["." + x for x in path.rsplit("/", 1)[-1].lower().split(".")[1:]]
    extra = np.unique(np.array([ngrams.hashed(ngrams.points("path:" + p), (len(p) + 5,), BITS, 2)[0] for p in parts] or [1], np.int64))
    masked = added((idx, val), (extra, np.full(len(extra), PATH, np.float32)))
    words = re.sub(r"\d+", "0", re.sub(r"\s+", " ", " ".join(told).lower()))
    return masked, ngrams.weights(ngrams.hashed(ngrams.points(words), (4, 7), BITS, 3))


PATH = 0.3  # weight of a path component beside the body's n-grams


def added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at, where = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    out = np.zeros(len(at), np.float32)
    np.add.at(out, where, np.concatenate([a[1], b[1]]))
    return at, out


def heaviest(f: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if len(f[0]) <= TRAIN_FEATURES:
        return f
    keep = np.sort(np.argsort(-f[1], kind="stable")[:TRAIN_FEATURES])
    return f[0][keep], f[1][keep]


def threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The score from which the F1 measure is best: 0 if that is as good as any, else the middle of the best ones.
    Unreachable where nothing is true."""
    if not y.any():
        return math.inf
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = 0  # equal scores can't be parted
    k = int(np.argmax(f1))
    below = s[k + 1] if k + 1 < len(s) else min(s[k], -1.0)
    return 0.0 if below < 0 < s[k] else float(s[k] + below) / 2


def train(files: DataFrame) -> tuple[np.ndarray, list[float]]:
    """(weights of the four classifiers, their thresholds) from about TRAIN_FILES files at most."""
    sample = hash_sample(files, "file_id", TRAIN_FILES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for repo, path, content in zip(b["repo_id"], b["path"], b["content"]):
                kinds, none = marks(path or "", content)
                if kinds or none:
                    masked, told = features(path or "", content)
                    for f in [masked, added(masked, told)] if len(told[0]) else [masked]:
                        i, v = heaviest(f)
                        out.append((0 if pd.isna(repo) else int(repo), sum(1 << k for k, x in enumerate(KINDS) if x in kinds), f is not masked or not len(told[0]), i.astype(np.int32).tobytes(), v.tobytes()))
            yield pd.DataFrame(out, columns=["repo", "kinds", "shown", "i", "v"])

    packed = sample.select("repo_id", "path", "content").mapInPandas(run, "repo long, kinds int, shown boolean, i binary, v binary").toArrow()  # eight bytes a feature
    n = packed.num_rows
    if not n:
        return np.zeros((1 << BITS, len(KINDS)), np.float32), [math.inf] * len(KINDS)
    rows, repos, shown, kinds = ngrams.unpacked(packed["i"], packed["v"]), packed["repo"].to_numpy(), packed["shown"].to_numpy(), packed["kinds"].to_numpy()
    del packed
    y = np.stack([np.where(kinds >> k & 1, 1.0, np.where(kinds == 0, -1.0, 0.0)) for k in range(len(KINDS))], axis=1)
    y = np.concatenate([y, np.full((1, len(KINDS)), -1.0)]).astype(np.float32)
    held = repos % 5 == 0
    # A file that shows nothing (the empty row at the end) is hand-written, so what little a tiny file shows must speak for a
    # kind, not against it.
    use = np.concatenate([np.nonzero(~held)[0], np.full(1 + n // 20, n)])
    model = fit(rows.take(use), y[use], 1 << BITS, "hinge", classes=len(KINDS), epochs=12, rate=0.2, l2=1e-5)
    test = np.nonzero(held & shown)[0]  # as they are met
    score = model.scores(rows.take(test))
    return model.weights, [threshold(score[y[test, k] != 0, k], y[test, k][y[test, k] != 0] > 0) for k in range(len(KINDS))]


def not_handwritten(files: DataFrame) -> DataFrame:
    """(file_id, kinds) of JavaScript files (file_id, repo_id, path, content) that no person wrote for their repository.

    Null and blank contents are none. Repeated rows come out as often.
    """
    files = files.select("file_id", "repo_id", "path", "content").where("content is not null and trim(content) <> ''")
    weights, limits = train(files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Linear(weights)
        for b in batches:
            bodies, parts = [], []
            for path, content in zip(b["path"], b["content"]):
                body = re.sub(r"\s+", " ", body_of(content))
                bodies.append(body if len(WORD.findall(body[:400])) > COPY_WORDS or len(body) > 400 else None)
                parts.append(added(*features(path or "", content)))
            scores = model.scores(ngrams.rows(parts))
            kinds = [[k for j, k in enumerate(KINDS) if row[j] > limits[j]] for row in scores]
            yield pd.DataFrame({"file_id": b["file_id"], "kinds": [sorted(k) for k in kinds], "body": [None if x is None else hash_of(x) for x in bodies], "marked": ["vendored" in k for k in kinds]})

    ensure_checkpoint_dir(files.sparkSession)
    seen = files.mapInPandas(run, "file_id long, kinds array<string>, body long, marked boolean").checkpoint()  # a few numbers a file
    copied = seen.where("body is not null").groupBy("body").agg(F.max("marked").alias("copied"), F.count("*").alias("n")).where("copied and n > 1").drop("n")
    got = salted_left_join(seen, copied, "body", "file_id")
    kinds = F.when(F.col("copied"), F.array_union("kinds", F.array(F.lit("vendored")))).otherwise(F.col("kinds"))
    return got.select("file_id", kinds.alias("kinds")).where(F.size("kinds") > 0)


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return not_handwritten(table(spark, sf, "corpus_file").where(F.col("suffix").isin(*SUFFIXES))).select("file_id")


def p5_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return not_handwritten(table(spark, sf, "corpus_file").where(F.col("suffix").isin(*SUFFIXES))).select("file_id", F.array_join("kinds", ",").alias("kinds"))


QUERIES = {"p5_found": p5_found, "p5_kinds": p5_kinds}
