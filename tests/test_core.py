import random

import pytest
from pyspark.sql import functions as F

from bytefold.functions.pretokenize import java_classes, pretokenize
from bytefold.functions.unicode_classes import char_kind, ranges
from bytefold.operators import corpus, prune
from bytefold.operators.tokenizer import Tokenizer, encode_chunk, encode_chunk_literally
from bytefold.operators.train import Trainer
from bytefold.plans.queries import vocabulary
from bytefold.sources import folder, vocab
from bytefold.streaming.encode import write_encoded

GOLDENS = {
    "123abc 123abc, abc123 abc123，中文abc, abc中文": ["123", "abc", " 123", "abc", ",", " abc123", " abc123", "，", "中文", "abc", ",", " abc", "中文"],
    "<<a </b": ["<<", "a", " ", "</", "b"],
    "def f(x):\n    return x + 1\n": ["def", " f", "(", "x", ")", ":", "\n    ", "return", " x", " ", "+", " 1", "\n"],
    "C++ C# GPT-4 don't file.java": ["C", "++", " C", "#", " GPT-4", " don't", " file.java"],
    ".js  .py .html a.b ..c": [".js", "  ", ".py", " .html", " a.b", " ", "..", "c"],
    "C’était déjà": ["C’était", " déjà"],
    "½x Ⅷb": ["½", "x", " Ⅷ", "b"],
    "a.-b": ["a", ".", "-", "b"],
    "": [],
}


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_ord long, text string")


def test_pretokenizer_goldens(spark):
    got = {r.text: r.c for r in frame(spark, list(GOLDENS)).select("text", pretokenize(F.col("text")).alias("c")).collect()}
    assert got == GOLDENS
    assert frame(spark, [None]).select(pretokenize(F.col("text")).alias("c")).first().c == []


def test_pretokenizer_loses_nothing_and_stands_long_runs(spark):
    rng = random.Random(1)
    pool = "ab Z09_.'-’<>/\\\n\té中字ж½。，!\U0001f600‍ ́"
    texts = ["".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(500)] + ["a" * 200_000, "a-" * 100_000 + "b", "." * 50_000]
    rows = frame(spark, texts).select("text", F.array_join(pretokenize(F.col("text")), "").alias("back")).collect()
    assert all(r.text == r.back for r in rows)


def test_java_classes_are_the_kinds(spark):
    """Every code point but surrogates has the kind of the Unicode database in the chunk pattern, too."""
    every = "".join(chr(cp) for cp in range(1, 0x110000) if not 0xD800 <= cp < 0xE000)
    kinds = {k: {chr(cp) for a, b in ranges()[k] for cp in range(a, b + 1)} - {"\0"} for k in ("LATIN_WORD", "DIGIT", "UNICODE_WORD", "SPACE")}
    for inner, k in zip(java_classes(), kinds):
        found = set(spark.sparkContext._jvm.java.util.regex.Pattern.compile(f"[^{inner}]+").matcher(every).replaceAll(""))
        assert found == kinds[k]


def test_kinds():
    assert [char_kind(c) for c in "a_5½中,+‍ªＡ "] == ["LATIN_WORD", "LATIN_WORD", "DIGIT", "DIGIT", "UNICODE_WORD", "PUNCT", "SYMBOL", "OTHER", "UNICODE_WORD", "LATIN_WORD", "SPACE"]


THE = ["the then them the", "other then there", "lower lowest low", None, ""]


@pytest.fixture(scope="module")
def the(spark):
    return Trainer(spark, 263, 260, 2).train(frame(spark, THE))


def test_training_golden(the):
    assert [(m.token_id, m.left_id, m.right_id, m.n) for m in the.merges] == [(256, 116, 104, 7), (257, 256, 101, 7), (258, 32, 257, 5), (259, 108, 111, 3), (260, 259, 119, 3), (261, 258, 110, 2), (262, 260, 101, 2)]
    assert {r.token_id: r.exposure for r in the.exposure().where("token_id > 255").collect()} == {257: 2, 258: 3, 260: 1, 261: 2, 262: 2}


def test_pruning_golden(the):
    got = {r.old_id: (r.status, r.new_id) for r in the.id_map().collect()}
    assert got == {256: ("internal", 264), 257: ("visible", 256), 258: ("visible", 257), 259: ("internal", 265), 260: ("internal", 266), 261: ("visible", 258), 262: ("visible", 259)}
    few = {r.old_id: (r.status, r.new_id) for r in prune.id_map(the.merge_table(), the.exposure(), 258, 2).collect()}
    assert few == {256: ("internal", 262), 257: ("visible", 256), 258: ("visible", 257)} | {i: ("discarded", None) for i in range(259, 263)}
    free = {r.old_id: r.new_id for r in prune.id_map(the.merge_table(), the.exposure(), 263, 0).collect()}
    assert free == {i: i for i in range(256, 263)}


def test_export_and_tokenizer(spark, the, tmp_path):
    rows = prune.export_rows(the.merge_table(), the.id_map(), the.token_bytes())
    vocab.write(rows, str(tmp_path / "vocab.txt"), str(tmp_path / "inter.txt"))
    assert "256\t(264, 101)\t'the'\t257\n" in (tmp_path / "vocab.txt").read_text()
    assert (tmp_path / "inter.txt").read_text() == "264\t(116, 104)\t'th'\t256\n265\t(108, 111)\t'lo'\t259\n266\t(265, 119)\t'low'\t260\n"
    loaded = vocab.load(str(tmp_path / "vocab.txt"), str(tmp_path / "inter.txt"))
    assert loaded.merges == vocabulary(the).merges and loaded.specials == {"<_EOS_>": 260, "<_SOS_>": 261, "<_SEP_>": 262, "<_PAD_>": 263}
    tok = Tokenizer(loaded)
    texts = frame(spark, ["low", "lower", "<_SOS_>low<_EOS_><", "中文 the \x00<<_SOS_>", None, ""])
    got = texts.select("text", tok.encode(F.col("text")).alias("plain"), tok.encode(F.col("text"), True).alias("ids")).withColumn("back", tok.decode(F.col("ids"), False)).withColumn("bare", tok.decode(F.col("ids"))).collect()
    assert got[0].plain == [108, 111, 119] and got[1].plain == [259, 114]
    assert got[2].ids == [261, 108, 111, 119, 260, 60] and got[2].bare == "low<"
    assert got[3].ids[-2:] == [60, 261]
    assert [r.back for r in got] == [r.text or "" for r in got] and got[4].ids == [] and got[5].plain == []
    assert vocab.load(str(tmp_path / "vocab.txt"), str(tmp_path / "none")).internal == set()
    with pytest.raises(Exception, match="unknown token id"):
        spark.createDataFrame([([9999],)], "ids array<int>").select(tok.decode(F.col("ids"))).collect()


def test_python_and_jvm_encoders_agree(spark, the):
    tok = Tokenizer(vocabulary(the))
    texts = frame(spark, ["then lowest thethethe", "aaaa th", None, "е́"])
    a = texts.select(tok.encode(F.col("text")).alias("x")).collect()
    a2 = texts.select(tok._fold(pretokenize(F.col("text"))).alias("x")).collect()
    assert a == a2
    b = texts.select(tok._python(pretokenize(F.col("text")), {}).alias("x")).collect()
    assert a == b
    rng = random.Random(2)
    for _ in range(300):
        merges = {}
        ids = [97, 98]
        for r in range(8):
            merges.setdefault((rng.choice(ids), rng.choice(ids)), (r, 256 + r))
            ids.append(256 + r)
        raw = bytes(rng.choices([97, 98], k=rng.randint(0, 30)))
        assert encode_chunk(raw, merges) == encode_chunk_literally(raw, merges) or any(v[0] <= max((x - 256 for x in k), default=-1) for k, v in merges.items())


def test_training_equals_naive(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(6)) for _ in range(20)]
    got = Trainer(spark, 256 + 12, 256, 0, cut_every=5).train(frame(spark, texts))
    rows = [list(c.encode()) for r in frame(spark, texts).select(pretokenize(F.col("text")).alias("c")).collect() for c in r.c]
    want = []
    for new in range(256, 256 + 12):
        seen = {}
        for ids in rows:
            for p in zip(ids, ids[1:]):
                seen[p] = seen.get(p, 0) + 1
        best = max(seen, key=seen.get)  # the first of equals
        want.append((new, *best, seen[best]))
        rows = [encode_chunk_literally_ids(ids, best, new) for ids in rows]
    assert [(m.token_id, m.left_id, m.right_id, m.n) for m in got.merges] == want


def test_many_merges_equal_naive(spark):
    """Merges made together, ties, runs of equal tokens: the same as one after the other, with all pairs counted anew."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(150)] + ["aaaaaaaa", "aaaaa", "abababab"]
    weights = [1 / (k + 1) for k in range(len(words))]
    texts = [" ".join(rng.choices(words, weights, k=40)) for _ in range(60)]
    trainer = Trainer(spark, 256 + 60, 256, 0, cut_every=16).train(frame(spark, texts))
    rows = [list(c.encode()) for r in frame(spark, texts).select(pretokenize(F.col("text")).alias("c")).collect() for c in r.c]
    want = []
    for new in range(256, 256 + 60):
        seen = {}
        for ids in rows:
            for p in zip(ids, ids[1:]):
                seen[p] = seen.get(p, 0) + 1
        best = max(seen, key=seen.get)
        want.append((new, *best, seen[best]))
        rows = [encode_chunk_literally_ids(ids, best, new) for ids in rows]
    assert [(m.token_id, m.left_id, m.right_id, m.n) for m in trainer.merges] == want
    assert len(trainer.metrics) == 60 and trainer.started is not None


def test_totals_after_merges_equal_a_recount(spark):
    state = corpus.tokenised(corpus.unique_chunks(spark.createDataFrame([(i, 0, c) for i, c in enumerate(["abab", "aaaa", "xab", "ba", "abc", "abab"])], "item_ord long, pos int, chunk string")))
    merges = [(97, 98, 256), (120, 256, 257)]
    after = corpus.merge_corpus(corpus.merge_corpus(state, *merges[0]), *merges[1])
    got = {tuple(r) for r in corpus.updated_totals(corpus.pair_totals(state), state, merges).collect()}
    assert got == {tuple(r) for r in corpus.pair_totals(after).collect()}


def test_decode_malformed_and_unknown(spark):
    tok = Tokenizer(vocab.Vocab(specials={"<_EOS_>": 256}))
    cases = {"E4BD": "\ufffd", "FF41": "\ufffdA", "E4BDE4BD": "\ufffd\ufffd", "F09F98": "\ufffd", "F0809080": "\ufffd" * 4, "EDA080": "\ufffd" * 3, "C3": "\ufffd", "": "", "C3A9": "é"}
    df = spark.createDataFrame([(list(bytes.fromhex(h)) + [256], v) for h, v in cases.items()] + [(None, ""), ([], "")], "ids array<int>, want string")
    assert all(r.a == r.want and r.b in (r.want + "<_EOS_>", "") for r in df.select("want", tok.decode(F.col("ids")).alias("a"), tok.decode(F.col("ids"), False).alias("b")).collect())
    for bad in ([257], [-1], [1, None]):
        with pytest.raises(Exception, match="unknown token id"):
            spark.createDataFrame([(bad,)], "ids array<int>").select(tok.decode(F.col("ids"))).collect()


def encode_chunk_literally_ids(ids, pair, new):
    out, i = [], 0
    while i < len(ids):
        hit = tuple(ids[i : i + 2]) == pair
        out.append(new if hit else ids[i])
        i += 1 + hit
    return out


def test_plain_trainer_and_greedy_overlap(spark, tmp_path):
    t = Trainer(spark, 300, 256, 0, whole=True).train(frame(spark, ["aaabdaaabac"]))
    assert [(m.left_id, m.right_id, m.n) for m in t.merges] == [(97, 97, 4), (256, 97, 2), (257, 98, 2)]
    assert {r.token_id: r.exposure for r in t.exposure().collect()} == {258: 2, 100: 1, 97: 1, 99: 1}
    vocab.write_plain(t.token_bytes(), {m.token_id: (m.left_id, m.right_id) for m in t.merges}, str(tmp_path / "v"))
    tok = Tokenizer(vocab.load_plain(str(tmp_path / "v")), whole=True)
    assert frame(spark, ["aaabdaaabac"]).select(tok.encode(F.col("text")).alias("x")).first().x == [258, 100, 258, 97, 99]


def test_checkpoint_and_fill(spark, the, tmp_path):
    half = Trainer(spark, 260, 256, 2).train(frame(spark, THE), checkpoint_vocab_sizes=(259,), checkpoint_dir=str(tmp_path))
    back = Trainer.load_checkpoint(spark, str(tmp_path / "checkpoint_vocab_259"), train_vocab_size=263, visible_vocab_size=256, min_exposure_count=2)
    assert back.next_id == 259 and [m.token_id for m in half.merges] == [256, 257, 258, 259]
    assert back.train().merges == the.merges
    fill = Trainer(spark, 257, 257, 2).train(frame(spark, THE))
    fill.visible_vocab_size = 258
    fill.train_until_visible_full(270, step_size=2, checkpoint_dir=str(tmp_path / "fill"))
    assert fill.next_id == 259 and fill.exportable_visible() == 2
    assert Trainer.load_checkpoint(spark, str(tmp_path / "fill/checkpoint_vocab_259"), train_vocab_size=263, visible_vocab_size=256).next_id == 259
    for bad in (dict(max_train_vocab_size=259), dict(max_train_vocab_size=300, step_size=0)):
        with pytest.raises(ValueError):
            fill.train_until_visible_full(**bad)
    with pytest.raises(ValueError):
        Trainer(spark, 255, 255)
    with pytest.raises(ValueError):
        Trainer(spark, 300).train()
    assert Trainer(spark, 257, 256).train(frame(spark, [])).merges == []


def test_loader(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "a-b").mkdir()
    (tmp_path / "a/x.txt").write_bytes("﻿l1\r\nl2 l3\x0cl4\r\n===\r\n\r\nend".encode())
    (tmp_path / "a-b/y.bin").write_bytes(b"\xff\xfe")
    (tmp_path / "a.py").write_bytes(b"p\r\nq\rr")
    rows = folder.load_folder(spark, str(tmp_path)).orderBy("item_ord").collect()
    assert [r.text for r in rows] == ["l1", "l2 ", "l3\x0c", "l4", "end", "p\nq\nr"]
    with pytest.raises(FileNotFoundError):
        folder.load_folder(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        folder.load_folder(spark, str(tmp_path / "a.py"))


def test_vocab_errors(tmp_path):
    f = tmp_path / "v"
    for bad in ("256\t(1, 2)\t'x'\n", "256\t[1, 2]\t'x'\t3\n", "256\t(1, 2)\t5\t3\n", "256\t(1, 2)\t'x'\t-1\n"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            vocab.load(str(f))
    f.write_text("300\t(256, 1)\t'x'\n")
    with pytest.raises(ValueError):
        vocab.load_plain(str(f))


def test_streaming_encode(spark, the, tmp_path):
    frame(spark, ["the low"]).write.parquet(str(tmp_path / "in"))
    tok = Tokenizer(vocabulary(the))
    stream = spark.readStream.schema("item_ord long, text string").parquet(str(tmp_path / "in"))
    write_encoded(stream, tok, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    want = frame(spark, ["the low"]).select(tok.encode(F.col("text")).alias("ids")).first().ids
    assert spark.read.parquet(str(tmp_path / "out")).first().ids == want


def test_pair_counts_with_nulls_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 0, "aaa", 5), (1, 0, "aaa", 5), (2, 1, None, 5), (3, 1, "", 5)], "item_ord long, pos int, chunk string, freq int")
    state = corpus.tokenised(corpus.unique_chunks(rows))
    assert [tuple(r) for r in corpus.pair_counts(state).collect()] == [(97, 97, 4)]
    assert corpus.best_pair(state.limit(0)).collect() == []
