"""Credentials in source code.

Candidates (literals as a lexer finds them, addresses with passwords, authorisation headers, private keys, options of
scripts, lines of settings) are scored by logistic regression on character Markov likelihood, shape, words inside,
surrounding identifiers and path. All files are learned from. Their labels are weak: matches of patterns, everything
doubtful left out; the patterns themselves are no features. The scores are calibrated on those that each row has from a
model of the other repositories, and those of at least ``THRESHOLD`` are secrets. Redaction blanks exactly their characters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .linear import Linear, Rows, bucket, descent, log_sums, newton, platt_sums
from .p6_natural import CODE, COMMENT, DOUBLE, SINGLE, lex

#: Size of the feature space (buckets are stored in 16 bits), probability from which it counts.
DIM, THRESHOLD = 1 << 14, 0.5
#: Parts of the repositories for calibration, weight of the squared weights beside the mean loss.
FOLDS, L2 = 5, 1e-6
#: Labelled rows stored as one, tasks at most that send sums to the driver at once.
PACK, TASKS = 4096, 32
PACKED = {"fold": "int", "n": "int", "positive": "int", "y": "binary", "ptr": "binary", "idx": "binary", "val": "binary"}
SHAPES = 40  # buckets below this number are shape features
#: Characters of the line before and after a candidate whose identifiers are its surroundings; least length of a candidate.
BEFORE, AFTER, LEAST = 80, 24, 4

PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY( BLOCK)?-----(?:\r?\n|\\r\\n|\\n)?(.*?)(?:\r?\n|\\r\\n|\\n)?[ \t]*-----END \1PRIVATE KEY", re.S)
LITERAL = re.compile(r"""(?<![\w"'])[uUbBrRfF]{0,2}(["'])(?!\1\1)([^\s"']{4,})\1""")
URL = re.compile(r"""[A-Za-z][\w+.-]*://[^\s:/@"'<>]*:([^\s@/"']+)@""")
SCHEME = re.compile(r"""\b(?:Bearer|Basic|Token|token)\s+([^\s"'<>]{6,})""")
NETRC = re.compile(r"""\blogin\s+\S+\s+password\s+([^\s"']{4,})""")
USER = re.compile(r"""\s-u\s+[^\s:"'/]+:([^\s"']{4,})""")
OPTION = re.compile(r"""--(?:[a-z-]*(?:key|token|secret|pass(?:word)?|pwd|auth)[a-z-]*)[ =]([^\s"']{5,})""")
ASSIGNED = re.compile(r"""(?i)\b([A-Z_]*(?:key|token|secret|pass|passwd|password|pwd|auth)[A-Z_]*)\s*[:=]\s*([^\s"'`,;()\[\]]{6,})""")
#: A line of settings, whatever the name's language.
LINE = re.compile(r"""(?m)^[ \t]*([^\W\d][\w .-]*?)[ \t]*[:=][ \t]*([^\s"'`,;()\[\]{}]{4,})[ \t]*\r?$""")
JSON = re.compile(r'"((?:\\.|[^"\\])*)"|[{}\[\]:,]', re.S)
PLACEHOLDER = re.compile(r"(?i)^(.)\1{3,}$|\$\{|^\$|\{\{|\{[\w.]+\}|<|>|\byour?[\W_]|change.?me|replace|dummy|example|placeholder|^env:|^vault:|xxxx|\*\*\*|todo|sample|insert|redacted|none$|null$")
#: The same in long values, where the words also occur by chance: they must stand apart.
LONG, LONG_PLACEHOLDER = 200, re.compile(r"(?i)^(.)\1{3,}$|\$\{|^\$|\{\{|\{[\w.]+\}|<|>|^env:|^vault:|\*\*\*|(?<![a-z0-9])(?:your?|change.?me|replace|dummy|example|placeholder|x{4,}|todo|sample|insert|redacted)(?![a-z0-9])|(?<![a-z0-9])(?:none|null)$")
PROVIDER = re.compile(r"^(AKIA|ASIA)[0-9A-Z]{16}$|^xox[abprs]-[\w-]{10,}|^(sk|pk|rk)_(live|test)_\w{10,}|^gh[pousr]_\w{20,}|^glpat-[\w-]{10,}|^eyJ[\w-]+\.eyJ[\w-]+\.[\w-]+$|^AIza[\w-]{20,}|^SG\.[\w-]+\.[\w-]+")
WANTED = re.compile(r"(?i)pass|pwd|secret|token|api.?key|access.?key|signing|credential|authorization|bearer|basic|login\(|session|private|client_secret|\bpw_|\bauth|_key\b|jwt|cookie")
#: Names of passwords and keys in the languages of the corpora (fixed values).
SETTING = re.compile(r"(?i)(?:^|[\s;])(?:pass|passwd|password|passphrase|pwd|secret|api_?key|token|passwort|kennwort|schlüssel|contraseña|clave|senha|mot de passe|mdp|salasana|пароль|ключ|密码|密碼|口令|パスワード)[\"']?\s*[:=]\s*[bruf]{0,2}[\"']?$")
HARMLESS = re.compile(r"(?i)commit|sha\d|etag|hash|digest|checksum|run_id|uuid|icon|image|_pub\b|public|md5|integrity|license|schema|field|version|path\.join|compile\(|\bt_|load_key|environ\[|machine_id|trace|span_id")
IDENTIFIER = re.compile(r"[A-Za-z_][\w.]*(\(.*)?$")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
ALPHABET = 96
#: Code of each byte in the counts of pairs.
CODES = np.clip(np.arange(256) - 32, 0, ALPHABET - 1)


def dev_script(content: str) -> tuple[int, int] | None:
    """(start, end) of the value of ``scripts.dev`` in a JSON text, walked by its nesting; the last one counts."""
    found, stack, key, valued = None, [], None, False
    for m in JSON.finditer(content):
        t = m[0]
        if t == ":":
            valued = True
            continue
        if t in "{[":
            stack.append(key)
            key = None
        elif t in "}]":
            if stack:
                stack.pop()
            key = None
        elif t == ",":
            key = None
        elif not valued:
            key = m[1]
        elif key == "dev" and stack == [None, "scripts"]:
            found = m.span(1)
        valued = False
    return found


def candidates(content: str, path: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, context) of what may be a secret in a content, by place; spans of the same place once."""
    found: dict[tuple[int, int], tuple[str, str]] = {}

    def add(start: int, end: int, kind: str) -> None:
        if end - start < LEAST or (start, end) in found:
            return
        line = content.rfind("\n", 0, start) + 1
        before = content[max(line, start - BEFORE) : start]
        if kind == "literal" and line and (before.strip(" \t\"'uUbBrRfF") == "" or before.lstrip().startswith("return ")):
            before = content[content.rfind("\n", 0, line - 1) + 1 : line - 1][-BEFORE:] + " " + before  # goes on from the line before
        rest = content[end : end + AFTER].split("\n", 1)[0]
        found[start, end] = kind, before + "\0" + rest

    if path.endswith("package.json"):
        if not (at := dev_script(content)):
            return []
        base, part = at[0], content[slice(*at)]
        for p, kind in ((URL, "url"), (SCHEME, "scheme"), (USER, "option")):
            for x in p.finditer(part):
                add(base + x.start(1), base + x.end(1), kind)
        for x in OPTION.finditer(part):
            cut = x[1].find(":") + 1 if x[0].startswith("--auth") else 0
            add(base + x.start(1) + cut, base + x.end(1), "option")
        for x in ASSIGNED.finditer(part):
            if not any(s <= base + x.start(2) < e or "://" in x[2] for s, e in found):
                add(base + x.start(2) + x[2].find(":") + 1, base + x.end(2), "env")
        return [(s, e, *v) for (s, e), v in sorted(found.items())]
    taken: list[tuple[int, int]] = []
    if "PRIVATE KEY" in content:
        for m in PEM.finditer(content):
            add(m.start(3), m.end(3), "pem")
            taken.append(m.span())
    if "://" in content:
        for m in URL.finditer(content):
            add(*m.span(1), "url")
    for m in SCHEME.finditer(content):
        add(*m.span(1), "scheme")
    if " -u " in content:
        for m in USER.finditer(content):
            add(*m.span(1), "option")
    if "login" in content:
        for m in NETRC.finditer(content):
            add(*m.span(1), "netrc")
    inner = {s for s, _ in found}
    ends = {e for _, e in found}

    def literal(start: int, end: int) -> None:
        if not (end in ends or start in inner or any(a <= start < b for a, b in taken)):
            add(start, end, "literal")

    def setting(m: re.Match[str], base: int) -> None:
        if not any(a <= base + m.start() < b for a, b in taken) and "://" not in m[2]:
            add(base + m.start(2), base + m.end(2), "assigned")

    for kind, start, end, _ in lex(content, CODE)[1]:
        if kind in (SINGLE, DOUBLE):
            closed = content[end - 1] == content[start] and end - start > 1
            literal(start + 1, end - closed)
        else:  # texts inside the code, with literals and settings of their own
            part = content[start:end]
            for m in LITERAL.finditer(part):
                literal(start + m.start(2), start + m.end(2))
            if kind != COMMENT:
                for m in LINE.finditer(part):
                    setting(m, start)
    for m in ASSIGNED.finditer(content):
        setting(m, 0)
    return [(s, e, *v) for (s, e), v in sorted(found.items())]


def placeholder(secret: str) -> bool:
    return bool((PLACEHOLDER if len(secret) <= LONG else LONG_PLACEHOLDER).search(secret))


def weak_label(secret: str, kind: str, context: str) -> int | None:
    """1 or 0 where a pattern says so, None where in doubt."""
    before, _, after = context.partition("\0")
    if kind != "pem" and placeholder(secret):
        return 0
    if kind == "pem" or PROVIDER.search(secret):
        return 1
    near = before[-64:]
    mixed = bool(re.search(r"\d", secret) and re.search(r"[A-Za-z]", secret)) or len(re.findall(r"[a-z][A-Z]", secret)) > 3
    if kind in ("url", "scheme", "netrc", "option", "env"):
        return 1 if mixed and len(secret) >= 7 else None if mixed or re.search("[a-z][A-Z]", secret) else 0
    if " " in secret:  # only where it is all a name of a password stands for; sentences are none
        return None if mixed and SETTING.search(before) else 0
    if kind == "assigned" and mixed and SETTING.search(before):
        return 1  # a line of settings inside a text
    if kind == "assigned":
        return 0 if IDENTIFIER.match(secret) and not re.search(r"\d{2}", secret) or not mixed else None
    if not mixed or "://" in secret or secret.startswith("/") or ";base64," in secret or secret.startswith("\\u") or "/" in secret and re.search(r"\?\w+=", secret[secret.find("/") :]) or HARMLESS.search(near):
        return 0
    if WANTED.search(near):
        return 1 if len(secret) >= 8 else None
    return 0 if re.fullmatch(r"[a-z_]+(?:\.[a-z_]*)?|[a-z0-9_]+\.\w{2,4}", secret) or "/" in secret and re.fullmatch(r"[\w./#?=-]*", secret) else None


@lru_cache(1 << 14)
def place(text: str) -> int:
    """Bucket of a feature that is no shape."""
    return SHAPES + bucket(text, DIM - SHAPES)


@lru_cache(1 << 10)
def folders(path: str) -> list[int]:
    return [place("p:" + p) for p in path.split("/")[2:-1]]


def features(secret: str, kind: str, context: str, path: str, markov: np.ndarray) -> dict[int, float]:
    codes = CODES[np.frombuffer(secret.encode("utf-8"), np.uint8)]
    like = float(np.add.reduce(markov[codes[:-1], codes[1:]]) / (len(codes) - 1)) if len(codes) > 1 else -5.0
    n = len(secret)
    digits, uppers, lowers = (sum(map(f, secret)) / n for f in (str.isdigit, str.isupper, str.islower))
    # Shapes are yes/no or binned, so no scale has to be learned.
    out = {1 + int(min(max(-like * 2, 0), 11)): 1.0, 13 + min(n // 6, 8): 1.0}
    flags = (digits > 0, digits > 0.3, uppers > 0, lowers == 1, digits + lowers + uppers < 1, bool(re.fullmatch(r"[0-9a-f]{16,}", secret)), bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", secret)), " " in secret, secret.count(" ") > 2, bool(IDENTIFIER.fullmatch(secret)) and digits < 0.2, "/" in secret, not secret.isascii(), len(set(secret)) < 5, "?" in secret and "=" in secret, "\\u" in secret, bool(re.search(r"[{}<>$]", secret)))
    out |= {23 + i: 1.0 for i, f in enumerate(flags) if f}
    for p in PARTS.findall(secret):  # the words inside, each by its share of the whole
        if len(p) > 2:
            at = SHAPES + bucket("w:" + p.lower(), DIM - SHAPES)
            out[at] = out.get(at, 0.0) + len(p) / n
    before, _, after = context.partition("\0")
    add = lambda s: out.__setitem__(place(s), 1.0)
    add("k:" + kind)
    ids = [p.lower() for p in PARTS.findall(before)][-8:]
    for p in ids:
        add("c:" + p)
    for p in ids[-2:]:
        add("n:" + p)
    add("b:" + before.rstrip("\"' ")[-2:])
    add("a:" + after[:2])
    digit = "d" if digits else "-"
    for p in ids[-3:]:
        add(f"x:{digit}{p}")
    out |= dict.fromkeys(folders(path), 1.0)
    return out


def _kinds(files: DataFrame) -> DataFrame:
    return files.where((F.col("suffix") == ".py") | F.col("path").rlike(r"(^|/)package\.json$"))


def _wanted(files: DataFrame) -> DataFrame:
    return _kinds(files.where("content is not null")).select("file_id", "repo_id", "path", "content")


def bigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((ALPHABET, ALPHABET), np.int64)
    for b in batches:
        for content in b["content"]:
            raw = " ".join(re.findall(r"[A-Za-z_]{3,}", content)).encode()
            codes = np.clip(np.frombuffer(raw, np.uint8).astype(np.int64) - 32, 0, ALPHABET - 1)
            np.add.at(total, (codes[:-1], codes[1:]), 1)
    at = np.nonzero(total)
    yield pd.DataFrame({"a": at[0], "b": at[1], "n": total[at]})


def labelled(markov: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows (fold, n, positive, y, ptr, idx, val) of up to ``PACK`` labelled candidates each, their sparse features as bytes."""

    def pack(fold: int, parts: list[tuple[int, dict[int, float]]]) -> tuple:
        y, rows = np.array([y for y, _ in parts], np.uint8), Rows.of([f for _, f in parts])
        return fold, len(y), int(y.sum()), y.tobytes(), rows.ptr.astype(np.int32).tobytes(), rows.idx.astype(np.uint16).tobytes(), rows.val.tobytes()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, parts = [], [[] for _ in range(FOLDS)]
            for fold, path, content in zip(batch["fold"], batch["path"], batch["content"]):
                for s, e, kind, context in candidates(content, path or ""):
                    if (y := weak_label(content[s:e], kind, context)) is not None:
                        parts[fold].append((y, features(content[s:e], kind, context, path or "", markov)))
                        if len(parts[fold]) == PACK:
                            out.append(pack(fold, parts[fold]))
                            parts[fold] = []
            out += [pack(k, p) for k, p in enumerate(parts) if p]
            yield pd.DataFrame(out, columns=list(PACKED))

    return rows


def summed(packed: DataFrame, part: Callable[[int, Rows, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all packs of ``part`` of fold, rows and labels; each of at most ``TASKS`` tasks sends one array."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for fold, y, ptr, idx, val in zip(batch["fold"], batch["y"], batch["ptr"], batch["idx"], batch["val"]):
                rows = Rows(np.frombuffer(ptr, np.int32).astype(np.int64), np.frombuffer(idx, np.uint16).astype(np.int64), np.frombuffer(val, np.float32))
                got = part(fold, rows, np.frombuffer(y, np.uint8).astype(np.int64))
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"sums": [total.tobytes()]})

    tasks = min(TASKS, packed.sparkSession.sparkContext.defaultParallelism)
    return sum(np.frombuffer(r.sums) for r in packed.coalesce(tasks).mapInPandas(sums, "sums binary").collect())


def fitted(packed: DataFrame, totals: np.ndarray) -> np.ndarray:
    """(DIM, FOLDS + 1): logistic regression without each fold, and with all. ``totals``: labels of 0 and 1 of each fold.

    All models descend at once, so a step of all is one pass over the stored rows; a model of no rows stays 0.
    """
    n = np.append(totals.sum() - totals.sum(axis=1), totals.sum())
    models = {k: descent(DIM) for k in range(FOLDS + 1) if n[k]}
    w, at = np.zeros((DIM, FOLDS + 1)), {k: next(m) for k, m in models.items()}
    while at:
        ids, here = np.array(list(at)), np.stack(list(at.values()), axis=1)

        def part(fold: int, rows: Rows, y: np.ndarray) -> np.ndarray:
            out, of = np.zeros((1 + DIM, len(ids))), ids != fold
            if of.any():
                out[:, of] = log_sums(rows, y, here[:, of])
            return out.ravel()

        got = summed(packed, part).reshape(1 + DIM, len(ids))
        for j, k in enumerate(ids.tolist()):
            x = here[:, j]
            try:
                at[k] = models[k].send((got[0, j] / n[k] + L2 / 2 * (x @ x), got[1:, j] / n[k] + L2 * x))
            except StopIteration as done:
                w[:, k] = done.value
                del at[k]
    return w


def calibrated(packed: DataFrame, w: np.ndarray, totals: np.ndarray) -> tuple[float, float]:
    """(a, b) of the probability 1/(1+exp(-(a*s+b))), s being the score of each row by the model without its fold.

    Folds without labels of both kinds outside don't count.
    """
    counts = (totals.sum(axis=0) - totals > 0).all(axis=1)
    zeros, ones = totals[counts].sum(axis=0).tolist()
    if not (zeros and ones):
        return 1.0, 0.0
    wanted = np.array([1 / (zeros + 2), (ones + 1) / (ones + 2)])

    def sums(a: float, b: float) -> np.ndarray:
        return summed(packed, lambda fold, rows, y: platt_sums(Linear(w[:, [fold]]).scores(rows)[:, 0], wanted[y], a, b) if counts[fold] else np.zeros(5))

    return newton(sums, zeros + ones)


def train(files: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(markov, weights, a, b) from all files.

    The driver gets sums over the rows only. The labelled rows lie on the executors' disks until the models are fitted.
    """
    wanted = _wanted(files)
    counts = np.ones((ALPHABET, ALPHABET))
    for r in wanted.mapInPandas(bigrams, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # at most ALPHABET^2
        counts[r.a, r.b] += r.n
    markov = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    # A file without repository stands for itself.
    folds = wanted.withColumn("fold", F.pmod(F.coalesce("repo_id", "file_id", F.lit(0)), F.lit(FOLDS)).cast("int"))
    packed = folds.mapInPandas(labelled(markov), ", ".join(map(" ".join, PACKED.items()))).persist(StorageLevel.DISK_ONLY)
    try:
        totals = np.zeros((FOLDS, 2), np.int64)
        for r in packed.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("positive").alias("p")).collect():
            totals[r.fold] = r.n - r.p, r.p
        w = fitted(packed, totals)
        a, b = calibrated(packed, w, totals)
    finally:
        packed.unpersist()
    return markov, w[:, [FOLDS]].astype(np.float32), max(a, 0.1), b


def find(files: DataFrame, redact: bool = False) -> DataFrame:
    """(file_id, secret): each distinct secret of each Python file and of ``scripts.dev`` of each package.json.

    With ``redact`` instead (file_id, content), every secret's characters but line ends being asterisks, all rows of
    ``files`` of these kinds with content kept. Null contents give no secrets; ``redacted`` keeps them too. No shuffle: a file is one row.
    """
    markov, weights, a, b = train(files)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Linear(weights)
        for batch in batches:
            spots, feats = [], []
            for k, (path, content) in enumerate(zip(batch["path"], batch["content"])):
                for s, e, kind, context in candidates(content, path or ""):
                    spots.append((k, s, e))
                    feats.append(features(content[s:e], kind, context, path or "", markov))
            score = a * model.scores(Rows.of(feats))[:, 0] + b
            keep = [x for x, ok in zip(spots, score >= np.log(THRESHOLD / (1 - THRESHOLD))) if ok]
            contents, ids = batch["content"].tolist(), batch["file_id"].tolist()
            if redact:
                for k, s, e in keep:
                    contents[k] = contents[k][:s] + re.sub(r"[^\r\n]", "*", contents[k][s:e]) + contents[k][e:]
                yield pd.DataFrame({"file_id": ids, "content": contents})
            else:
                yield pd.DataFrame(sorted({(ids[k], contents[k][s:e]) for k, s, e in keep}), columns=["file_id", "secret"])

    return _wanted(files).mapInPandas(scan, "file_id long, content string" if redact else "file_id long, secret string")


def redacted(files: DataFrame) -> DataFrame:
    """(file_id, content): every Python file and package.json with its secrets blanked, null contents as they are."""
    return find(files, redact=True).union(_kinds(files.where("content is null")).select("file_id", "content"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return find(table(spark, sf, "corpus_file"))


def p2_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redacted(table(spark, sf, "corpus_file"))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
