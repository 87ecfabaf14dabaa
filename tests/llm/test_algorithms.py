import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bytefold.llm import p3_frequent, p4_neardup, p8_encode, p9_pack


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    s, true = p3_frequent.HeavySketch(width=64, depth=4, heap=50), Counter()
    for _ in range(30):
        items, n = np.unique(rng.zipf(1.3, 500) % 5000, return_counts=True)
        h = items.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        s.update(h, items.astype(object), n.astype(np.int64))
        true.update(dict(zip(items.tolist(), n.tolist())))
    kept = dict(zip(s.items.tolist(), s.counts.tolist()))
    assert len(kept) <= 50 and s.total == sum(true.values())
    assert all(kept[i] >= true[i] for i in kept)
    assert {i for i, n in true.most_common(5)} <= set(kept)


def test_frequent(spark):
    rng = random.Random(2)
    rows = [("hot", 1, 1)] * 4000 + [(f"x{rng.randint(0, 5000)}", 1, 1) for _ in range(8000)] + [(None, 1, 1)] * 500 + [("null weight", None, 1), ("", 60, 1)] + [("tie1", 50, 1), ("tie2", 50, 1)]
    df = spark.createDataFrame(rows, "item string, n long, h long").repartition(5)
    count = Counter()
    for i, n, _ in rows:
        if i is not None and n is not None:
            count[i] += n
    total = sum(count.values())
    want = {(i, n) for i, n in count.items() if n >= 0.004 * total}
    got = p3_frequent.frequent({"f": (df, F.col("item"), F.col("n")), "empty": (df.limit(0), F.col("item"), F.col("n"))})
    assert {(r["item"], r["n"]) for r in got.collect()} == want and ("tie1", 50) in want


def brute(texts, t=0.5):
    sets = {}
    for i, x in texts:
        if x is not None:
            w = re.findall("[A-Za-z0-9_]+", x)
            sets[i] = ({tuple(w[k : k + 3]) for k in range(len(w) - 2)}, x)
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a][1] == sets[b][1] or sets[a][0] and sets[b][0] and len(sets[a][0] & sets[b][0]) >= t * len(sets[a][0] | sets[b][0])}


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    rng = random.Random(4)
    monkeypatch.setattr(p4_neardup, "BLOCK", block)
    vocab = [f"w{i}" for i in range(3000)]
    head = " ".join(rng.choices(vocab, k=40))
    texts = []
    for f in range(12):
        base = rng.choices(vocab, k=rng.randint(20, 150))
        for v in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append((head + " " if f % 2 else "") + " ".join(w))
    texts += [texts[0], texts[0] + "!", "a b", "a b", "a c", "", "", None, None]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "file_id long, content string, n int, rid long")
    members, links = p4_neardup.near_duplicates(df, "file_id", "content")
    of = {r.id: r.rid for r in members.collect()}
    link = {(r.a, r.b) for r in links.collect()}
    got = {(a, b) for a in of for b in of if a < b and (of[a] == of[b] or (min(of[a], of[b]), max(of[a], of[b])) in link)}
    assert got == brute(rows)
    members, links = p4_neardup.near_duplicates(df.limit(0), "file_id", "content")
    assert members.collect() == [] == links.collect()


def test_replay_equals_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p8_encode.vocabulary_file())
    t.encode_special_tokens = True
    rng = random.Random(6)
    pool = ["the ", "-", "--", "a", "xx", " ", "\n", "\r\n", "é", "中文", "\U0001f600", "don't", "<|endoftext|>", "123", "\t", " ", "　", "\x00", "_", "X", "ﬁ", "́", " "]
    texts = ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(300)] + ["-" * 2000, "x" * 999, " " * 500 + "a", None, "", "<|endoftext|>", "a" * 3000]
    df = spark.createDataFrame([(i, x, [1]) for i, x in enumerate(texts)], "doc_id long, text string, ids array<int>").repartition(3)
    got = {r.doc_id: r.ids for r in p8_encode.encode(df, "doc_id", "text").collect()}
    want = {i: e.ids for i, e in enumerate(t.encode_batch([x or "" for x in texts], add_special_tokens=False))}
    assert got == want
    sizes = {r.doc_id: r.n_tokens for r in p8_encode.encode(df, "doc_id", "text", sizes=True).collect()}
    assert sizes == {i: len(x) for i, x in want.items()}
    assert p8_encode.encode(df.limit(0), "doc_id", "text").collect() == []


def test_words_kept_between_blocks(monkeypatch):
    path = p8_encode.vocabulary_file()
    a = p8_encode.Encoder(p8_encode.merges(path))
    first = a.encode(pa.array(["hello", " world", "hello"]))
    monkeypatch.setattr(p8_encode, "KEPT_WORDS", 1)
    again = a.encode(pa.array(["hello", " world", "hello"]))
    assert first[0].tolist() == again[0].tolist() and first[1].tolist() == again[1].tolist()
    assert a.encode(pa.array([], pa.string()))[1].tolist() == [0]


def test_packing(spark):
    rng = random.Random(7)
    items = [(i, rng.choice([None, 0, 5, 100, 512, 513, 5000, rng.randint(1, 600)]), "x") for i in range(3000)] + [(1, 7, "x")] * 2
    df = spark.createDataFrame(items, "doc_id long, n_tokens long, container_type string")
    kinds = spark.createDataFrame([("small", 512), ("large", 4096)], "container_type string, capacity_tokens int")
    for shard in (1 << 16, 700):
        rows = p9_pack.pack(df, "doc_id", "n_tokens", kinds, shard).collect()
        for kind, cap in (("small", 512), ("large", 4096)):
            mine = [r for r in rows if r.container_type == kind]
            assert Counter(r.doc_id for r in mine if r.n_tokens == 0) == Counter(i for i, n, _ in items if not n)
            assert all((r.container_no is None) == (r.n_tokens == 0) for r in mine)
            whole = Counter()
            for r in mine:
                whole[r.doc_id] += r.n_tokens
            assert whole == Counter({i: 0 for i, _, _ in items}) + Counter({k: v for k, v in _sums(items).items()}) or all(whole[i] == v for i, v in _sums(items).items())
            bins = {}
            for r in mine:
                if r.container_no is not None:
                    bins.setdefault(r.container_no, []).append((r.offset, r.n_tokens))
            for b in bins.values():
                b.sort()
                assert all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and b[0][0] == 0 and sum(b[-1]) <= cap
            last = {}
            for r in mine:
                last[r.doc_id] = max(last.get(r.doc_id, 0), r.piece)
            assert all(r.n_tokens == cap for r in mine if r.piece < last[r.doc_id] and r.doc_id != 1)
            need = sum(v for v in _sums(items).values()) / cap
            assert len(bins) <= 1.06 * need + 2 * (len(items) // shard + 1)
    assert p9_pack.pack(df.limit(0), "doc_id", "n_tokens", kinds).collect() == []


def _sums(items):
    out = Counter()
    for i, n, _ in items:
        out[i] += n or 0
    return out


def test_sum_of_squares_matches_definition():
    rng = random.Random(11)
    sizes, cap = [rng.randint(1, 20) for _ in range(300)], 20
    where, offset = p9_pack.sum_of_squares(np.array(sizes), cap)
    level, n = {}, Counter()
    for s, w, o in zip(sizes, where.tolist(), offset.tolist()):
        assert level.get(w, 0) == o
        costs = {}
        for h in {0, *n}:
            if h + s <= cap and (h == 0 or n[h]):
                m = n.copy()
                if h:
                    m[h] -= 1
                if h + s < cap:
                    m[h + s] += 1
                costs[h] = sum(v * v for v in m.values())
        assert costs[o] == min(costs.values())
        if o:
            n[o] -= 1
        level[w] = o + s
        if o + s < cap:
            n[o + s] += 1
