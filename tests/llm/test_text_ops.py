"""Operators that judge one text at a time, against brute force in plain Python."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest

from siftspark.llm import compression_rules, kernel, piece_codec, pseudo_lm, toxicity, weak_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
HARD = ["", " ", "\n\t", "a", "one two three four", "x " * 30, "Ünïcode wörds für alle hier\n\nzwei", "a b c d e a b c d e f", "no\x00nul", "日本 語 の 文 章 で す か", "line\nline\nother\nline", "#$%& * <b> |", "w" * 5000, "nbsp stays one", "\x1c\x1d sep"]


def words(t):
    return WORD.findall(t)


@pytest.mark.parametrize("text", HARD)
def test_word_hashes_part_words_as_the_pattern_does(text):
    h = kernel.word_hashes(text.encode())
    w = words(text)
    assert len(h) == len(w)
    assert len(set(h.tolist())) == len(set(w))


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    text = ("some words of a longer text " * 50 + "w" * 300 + " end").encode()
    whole = kernel.word_hashes(text)
    monkeypatch.setattr(kernel, "PIECE", 64)
    assert (kernel.word_hashes(text) == whole).all()


def base(text):
    w = words(text or "")
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    cover = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(cover), failed


@pytest.mark.parametrize("text", [None, *HARD, "p q r s t u v w x y z " * 2, "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9"])
def test_base_measures(text):
    import zstandard

    got = compression_rules.judge(text, compression_rules.Bands(), zstandard.ZstdCompressor(level=3))
    assert got[:6] == base(text)
    assert got[6] is False or not got[5]


def test_bands_reject_repetition_and_noise():
    import base64
    import random

    import zstandard

    rng = random.Random(1)
    pack = zstandard.ZstdCompressor(level=3)
    noise = " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(200))
    assert compression_rules.judge(noise, compression_rules.Bands(), pack)[-1].startswith("incompressible")
    rows = " ".join(f"{i % 7}{'ab' * 20}{i % 5}" for i in range(900))
    assert compression_rules.judge(rows, compression_rules.Bands(repeat_percent=100), pack)[-1].startswith("repetitive")
    prose = " ".join(rng.choice("the of river stone walked slowly under bright morning clouds and nobody said anything about it for hours".split()) for _ in range(120))
    assert compression_rules.judge(prose, compression_rules.Bands(), pack)[-1] == "kept"


def test_bands_reject_short_texts_and_hidden_passages():
    import base64
    import random

    import zstandard

    rng = random.Random(2)
    pack = zstandard.ZstdCompressor(level=3)
    verdict = lambda text: compression_rules.judge(text, compression_rules.Bands(), pack)[-1]
    spaced = lambda n, width: " ".join(base64.b64encode(rng.randbytes(3 * width)).decode()[:width] for _ in range(n // width + 1))[:n]
    stems = [a + b + c for a in ("the", "ri", "sto", "wal", "ben", "mor", "clo", "no") for b in ("", "ver", "ne", "king", "light") for c in ("", "s", "ing", "ed")]
    prose = lambda n: " ".join(rng.choice(stems) for _ in range(n))[:n]
    for size in (60, 63, 64, 80, 95, 100, 127, 128, 191, 192, 255, 256, 383, 500, 511, 700, 767, 900, 1023, 1024):
        assert verdict(spaced(size, max(4, min(40, size // 11 - 1)))) == "incompressible", size
        assert verdict(prose(size)) in ("kept", "base"), size
    for size in (60, 150, 250):
        assert verdict(" ".join("a" * k for k in range(1, 40))[-size:] + " b c d e f g h i j k") in ("repetitive", "base")
    # 16 KiB of 60, and a tail of less than a chunk
    assert verdict(prose(22 << 10) + " " + spaced(16 << 10, 76) + " " + prose(22 << 10)) == "incompressible_chunks"
    assert verdict(prose(16 << 10) + spaced(4000, 76)) == "incompressible_chunks"
    assert verdict(prose(60 << 10)) == "kept" and verdict(prose(5000)) == "kept"


def test_measure_keeps_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (1, None, "x")], "doc_id long, text string, KEPT string")
    got = compression_rules.measure(df).collect()
    assert len(got) == 3 and all(r["kept"] is False for r in got)
    assert compression_rules.measure(df.where("false")).count() == 0


def test_pieces_equal_the_public_library():
    import random

    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    c = piece_codec.Codec(piece_codec.load(), most_stretches=500)
    rng = random.Random(3)
    alphabet = "abcdefghijklmnopqrstuvwxyzAB    ..,'0123456789éßñ中文\n\t▁日😀\x00#$_-"
    texts = HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [" " * n + "the end" + " " * n for n in range(40)]
    for t in texts:
        ids = c.encode(t)
        assert ids == ref.encode(t), t
        assert c.decode(ids) == ref.decode(ids) == t.replace("▁", " ")


def test_unigram_models_take_the_cheapest_path():
    m = piece_codec.Machines(["<unk>", "▁", "a", "b", "ab", "▁a", "▁ab"], [2, 1, 1, 1, 1, 1, 1], [0, -3, -2, -2, -1, -2.5, -9], False, True, False)
    c = piece_codec.Codec(m)
    assert [m.pieces[i] for i in c.encode("ab")] == ["▁", "ab"]


def unigram_model():
    """A unigram model with a charsmap, made by hand: pieces with scores, byte fallback off."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto())
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(p, -1.0 - 0.37 * i % 3 - len(p) * 0.9, 1) for i, p in enumerate([*"abcdefghiklmnoprstuvwy▁0123456789.,", "▁the", "the", "he", "▁a", "an", "and", "ing", "in", "er", "re", "▁s", "st", "ch", "sch", "über", "ü", "é", "fi", "ffi", "ab", "abc", "bc", "▁▁", "12", "123"])]
    del m.pieces[:]
    for p, score, kind in pieces:
        m.pieces.add(piece=p, score=score, type=kind)
    m.trainer_spec.model_type = 1
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = True
    m.normalizer_spec.escape_whitespaces = True
    return m.SerializeToString()


def test_unigram_models_with_a_charsmap_equal_the_public_library(tmp_path):
    import random

    import sentencepiece

    raw = unigram_model()
    (tmp_path / "u.model").write_bytes(raw)
    ref = sentencepiece.SentencePieceProcessor(model_proto=raw)
    c = piece_codec.Codec(piece_codec.load(str(tmp_path / "u.model")), most_stretches=50)
    rng = random.Random(5)
    alphabet = "abcdehinrst ,.12  ABC é\u0301ﬁüÜ①ＡＢ\u00a0\u3000Ⅳ中½ \t"
    for t in HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]:
        if "\x00" not in t:
            assert c.encode(t) == ref.encode(t), repr(t)


def test_encode_on_a_table(spark):
    df = spark.createDataFrame([(1, "hello there", "k"), (2, None, "k"), (3, "", "k"), (3, "", "k")], "doc_id long, text string, ids string")
    got = sorted(piece_codec.encode(df, check=True).collect(), key=lambda r: r["doc_id"])
    assert got[0]["round_trip"] and got[0]["n_tokens"] == len(got[0]["ids"])
    assert got[1]["ids"] is None and got[1]["n_tokens"] is None and got[2]["ids"] == []
    back = piece_codec.decode(piece_codec.encode(df)).where("doc_id = 1").first()
    assert back["decoded"] == "hello there"


BAD = ["vile", "rotten"]


def toxic_corpus(n=240):
    rng = np.random.default_rng(0)
    plain = [f"word{i}" for i in range(60)]
    out = []
    for i in range(n):
        w = [plain[j] for j in rng.integers(0, 60, rng.integers(5, 200))]
        if i % 4 == 0:
            w.insert(int(rng.integers(0, len(w))), BAD[i % 8 // 4] + ["", "!", "###"][i % 3])
        out.append((i, " ".join(w), int(i % 4 == 0)))
    return out


def test_toxicity_learns_and_finds_words_anywhere():
    rows = toxic_corpus()
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    held = [r for r in rows if not zlib.crc32(str(r[0]).encode()) % 5]
    model = toxicity.train([r[1] for r in train], [r[2] for r in train], how=toxicity.Training(epochs=8))
    s = toxicity.Scorer(model)
    got = np.array(s.scores([r[1] for r in held])) >= 0.5
    want = np.array([r[2] for r in held]) == 1
    assert (got == want).mean() > 0.9
    far = " ".join(["word1"] * 5000 + ["vile"] + ["word2"] * 5000)
    assert s.scores([far])[0] > s.scores([far.replace("vile", "word3")])[0]
    small = toxicity.Scorer(model, most_words=10, batch=2)
    assert np.allclose(small.scores([r[1] for r in held]), s.scores([r[1] for r in held]), atol=1e-5)


def test_toxicity_gradients():
    shape = toxicity.Shape(width=4, stride=2, hidden=2, word_dim=2, char_dim=2, attention=2, word_bits=4, char_bits=4)
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in toxicity._start(shape, rng).items()}
    proj, lens = rng.standard_normal((4, 3, 12)), np.array([4, 3, 1])
    loss = lambda: float((toxicity.forward(proj, lens, w, shape)[0] * [1.0, -2.0, 0.5]).sum())
    out, tape = toxicity.forward(proj, lens, w, shape, keep=True)
    g = toxicity.backward(np.array([1.0, -2.0, 0.5]), proj, tape, w, shape)
    for k in ("uf", "ub", "wa", "va", "wo"):
        i = tuple(0 for _ in w[k].shape)
        old = w[k][i]
        w[k][i] = old + 1e-3
        up = loss()
        w[k][i] = old - 1e-3
        down = loss()
        w[k][i] = old
        assert abs((up - down) / 2e-3 - g[k][i]) < 2e-3, k


def test_toxicity_on_tables(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in toxic_corpus(60)] + [(1000, None), (1000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_corpus(60)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, how=toxicity.Training(epochs=2))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 62 and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.fit(docs, labels.where("false"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_toxicity_forward_equals_a_plain_loop():
    shape = toxicity.Shape(width=5, stride=3, hidden=3, word_dim=2, char_dim=2, attention=2, word_bits=5, char_bits=5)
    rng = np.random.default_rng(3)
    w = {k: v + 0.1 * rng.standard_normal(v.shape).astype(v.dtype) for k, v in toxicity._start(shape, rng).items()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def window(ws):
        k, x = shape.hidden, []
        for word in ws:
            one, two, rows, _ = toxicity._hashed([word], shape)
            x.append(np.concatenate([w["e1"][one[0]] + w["e2"][two[0]], w["c"][rows].mean(axis=0)]) @ w["wx"] + w["bx"] if len(word) else w["bx"])
        sides = []
        for u, off, order in ((w["uf"], 0, range(len(x))), (w["ub"], 3 * k, range(len(x) - 1, -1, -1))):
            h, states = np.zeros(k), {}
            for t in order:
                g, own = h @ u, x[t][off : off + 3 * k]
                z, r = sig(own[:k] + g[:k]), sig(own[k : 2 * k] + g[k : 2 * k])
                n = np.tanh(own[2 * k :] + r * g[2 * k :])
                h = (1 - z) * n + z * h
                states[t] = h
            sides.append(states)
        states = np.array([np.concatenate([sides[0][t], sides[1][t]]) for t in range(len(x))])
        e = np.tanh(states @ w["wa"]) @ w["va"]
        a = np.exp(e - e.max())
        return float((a / a.sum()) @ states @ w["wo"] + w["bo"][0])

    scorer = toxicity.Scorer(toxicity.Model(shape, 0.1, w), batch=4)
    for text in ("one", "a b c d e f g h i j k", "Words, of MANY kinds! " * 9):
        ws = toxicity.words_of(text)
        want = max(window(ws[s : s + shape.width]) for s in toxicity.window_starts(len(ws), shape))
        assert abs(scorer.scores([text])[0] - sig(want)) < 1e-5


def test_held_out_rows_stay_out_of_the_fit(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, t) for i, t, _ in toxic_corpus(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_corpus(60)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.fit(docs, x.where(toxicity.fold() != 0), how=toxicity.Training(epochs=2, steps=4)) for x in (labels, turned))
    assert all((one.weights[k] == two.weights[k]).all() for k in one.weights)


def test_weak_scorer_equals_a_plain_loop():
    texts, labels, how = [b"good words here for all", b"### $$$ buy buy", b"good words again", b""], [0.9, 0.1, 0.8, 0.4], weak_quality.Fit(bits=6, epochs=3)
    w, b = weak_quality.fit(texts, labels, how)
    weights, square = {}, {}
    mean = float(np.mean(labels))
    bias = float(np.log(mean / (1 - mean)))
    rng = np.random.default_rng(how.seed)
    for _ in range(how.epochs):
        for i in rng.permutation(len(texts)):
            pairs = list(zip(*(x.tolist() for x in weak_quality.features(texts[i], how.bits)), strict=True))
            p = 1 / (1 + np.exp(-(bias + sum(weights.get(a, 0.0) * v for a, v in pairs))))
            for a, v in pairs:
                g = (p - labels[i]) * v + how.decay * weights.get(a, 0.0)
                square[a] = square.get(a, 1e-2) + g * g
                weights[a] = weights.get(a, 0.0) - how.rate * g / np.sqrt(square[a])
            bias -= 0.01 * (p - labels[i])
    assert abs(b - bias) < 1e-9 and all(abs(w[a] - v) < 1e-9 for a, v in weights.items())


def test_weak_quality_agrees_with_the_labels(spark):
    from conftest import DATA

    got = weak_quality.judge(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"))
    both = got.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("quality is not null").collect()
    assert all(r["kept"] == (r["score"] >= 0.5) for r in both)
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in both]) > 0.8


def test_weak_labels_recover_planted_kinds():
    rng = np.random.default_rng(2)
    n, patterns, truth = 4000, {}, []
    for _ in range(n):
        good = rng.random() < 0.8
        truth.append(good)
        votes = "".join("-" if rng.random() < 0.3 else ("g" if (rng.random() < 0.85) == good else "b") for _ in weak_quality.LABELLERS)
        patterns.setdefault(votes, []).append(good)
    posterior, share, tables = weak_quality.estimate({k: len(v) for k, v in patterns.items()})
    right = sum((posterior[k] > 0.5) == g for k, v in patterns.items() for g in v)
    assert right / n > 0.97 and abs(share - np.mean(truth)) < 0.03
    assert np.allclose(tables.sum(axis=2), 1)


def test_weak_quality_on_tables(spark):
    good = [(i, f"The house of the {i} people is in the town and it was not far. They are at the sea with a boat.") for i in range(60)]
    bad = [(100 + i, "buy!! " * 40 + "### $$$ ||| %%% ") for i in range(12)]
    docs = spark.createDataFrame([*good, *bad, (500, None), (500, ""), (None, "short")], "doc_id long, text string")
    got = weak_quality.judge(docs).collect()
    assert len(got) == 75
    assert all(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
    assert not any(r["kept"] for r in got if r["doc_id"] is not None and 100 <= r["doc_id"] < 112)
    assert weak_quality.judge(docs.where("false")).count() == 0


def test_pseudo_likelihood_equals_a_plain_loop():
    net = pseudo_lm.Net(classes=4, members=4, rare=4, dim=3, hidden=5)
    w = {k: v + 0.1 for k, v in pseudo_lm.start(net).items()}
    names = np.unique(kernel.word_hashes(b"a b c d e f g h i j k l"))
    vocab = (names, np.arange(len(names)))
    text = "A b, c zzz d e a\nb c! q r s"
    ids = pseudo_lm.ids_of(text, *vocab, net)
    total = 0.0
    for i, t in enumerate(ids):
        h = w["b"].astype(float).copy()
        for p, j in enumerate([i - 2, i - 1, i + 1, i + 2]):
            h += w["e"][ids[j] if 0 <= j < len(ids) else net.tokens] @ w["p"][p]
        h = np.tanh(h)
        a, b = divmod(int(t), net.members)
        c = h @ w["c"] + w["cb"]
        m = h @ w["m"][a] + w["mb"][a]
        total += c[a] - np.log(np.exp(c).sum()) + m[b] - np.log(np.exp(m).sum())
    n, got = pseudo_lm.score_text(text, vocab, w, net)
    assert n == len(ids) == 12 and abs(got - total) < 1e-3
    probs = np.exp([pseudo_lm.log_probs(pseudo_lm.contexts(ids, np.array([3]), net), np.array([k]), w, net)[0] for k in range(net.tokens)])
    assert abs(probs.sum() - 1) < 1e-5


def test_pseudo_likelihood_learns_an_order(spark):
    rng = np.random.default_rng(4)
    seq = ["north", "east", "south", "west"]
    texts = [" ".join(seq[(s + i) % 4] for i in range(80)) for s in rng.integers(0, 4, 60)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (900, "!!!")], "doc_id long, text string")
    net = pseudo_lm.Net(classes=4, members=4, rare=4, rounds=2)
    vocab = pseudo_lm.vocabulary(docs, net)
    got = {r["doc_id"]: r for r in pseudo_lm.score(docs, vocab, pseudo_lm.train(docs, vocab, net), net).collect()}
    assert got[0]["mean_log_likelihood"] > -0.7 and got[900]["n_tokens"] == 0 and got[900]["log_likelihood"] == 0.0
    assert pseudo_lm.score(docs.where("false"), vocab, pseudo_lm.start(net), net).count() == 0


def test_pseudo_likelihood_trains_on_every_position(spark):
    words = ["a"] * 30
    words[8:13] = ["p", "q", "z", "r", "s"]  # of texts of 30 words, a step of 24 takes positions 6 and 18 only
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(400)], "doc_id long, text string").coalesce(1)
    net = pseudo_lm.Net(batch=64)
    vocab = pseudo_lm.vocabulary(docs, net)
    ids = pseudo_lm.ids_of(" ".join(words), *vocab, net)
    lp = pseudo_lm.log_probs(pseudo_lm.contexts(ids, np.array([10]), net), ids[[10]], pseudo_lm.train(docs, vocab, net), net)
    assert lp[0] > -1.0


def test_pseudo_likelihood_gradients():
    net = pseudo_lm.Net(classes=3, members=4, rare=2, dim=3, hidden=4)
    rng = np.random.default_rng(6)
    w = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.3 for k, v in pseudo_lm.start(net).items()}
    context, target = rng.integers(0, net.tokens + 1, (9, 4)), rng.integers(0, net.tokens, 9)
    g = pseudo_lm.gradients(context, target, w, net)
    loss = lambda: -float(pseudo_lm.log_probs(context, target, w, net).mean())
    for k in w:
        for i in {tuple(rng.integers(0, n) for n in w[k].shape) for _ in range(6)}:
            old = w[k][i]
            w[k][i] = old + 1e-4
            up = loss()
            w[k][i] = old - 1e-4
            down = loss()
            w[k][i] = old
            assert abs((up - down) / 2e-4 - g[k][i]) < 1e-6, k


def test_pseudo_likelihood_sums_the_columns_of_embeddings_by_token(monkeypatch):
    """Not the wider hidden layer once for each side: what is added by token is the dearest part of a step."""
    net, rng, added = pseudo_lm.Net(), np.random.default_rng(8), []
    monkeypatch.setattr(pseudo_lm, "_sums_by", lambda tokens, rows, vocab, f=pseudo_lm._sums_by: added.append(rows.shape) or f(tokens, rows, vocab))
    for n in (700, 1024, 3):  # with and without a rest of a block of rows
        added.clear()
        context, target, w = rng.integers(0, net.tokens + 1, (n, 4)), rng.integers(0, net.tokens, n), pseudo_lm.start(net)
        g = pseudo_lm.gradients(context, target, w, net)
        assert added == [(n * 4, net.dim)]
        halves = [pseudo_lm.gradients(context[i::2], target[i::2], w, net) for i in (0, 1)]
        sizes = [len(target[i::2]) / n for i in (0, 1)]
        assert all(np.allclose(g[k], sum(x[k] * y for x, y in zip(halves, sizes, strict=True)), atol=1e-5) for k in w)


@pytest.mark.parametrize("kind", [np.float32, np.float64])
@pytest.mark.parametrize("width", [1, 2, 3, 16])
def test_rows_are_summed_by_token(kind, width):
    rng = np.random.default_rng(width)
    tokens, rows = rng.integers(0, 9, 400), rng.standard_normal((400, width)).astype(kind)
    got = pseudo_lm._sums_by(tokens, rows, 11)
    assert got.dtype == kind and np.allclose(got, [rows[tokens == t].sum(axis=0) for t in range(11)], atol=1e-4)


def test_counts_of_words_do_not_depend_on_what_a_task_sums_first(spark):
    docs = spark.createDataFrame([(f"a b{'cdefghi'[i % 7]} a",) for i in range(3500)], "text string").coalesce(1)
    want = {int(kernel.word_hashes(f"b{k}".encode()).view(np.int64)[0]): 500 for k in "cdefghi"} | {int(kernel.word_hashes(b"a").view(np.int64)[0]): 7000}
    for most in (1 << 19, 1, 9):
        assert {r["word"]: r["times"] for r in pseudo_lm.word_counts(docs, most).collect()} == want
    parts = [np.unique(np.array(x, np.uint64), return_counts=True) for x in ([5, 5, 2**63], [], [5, 7])]
    assert pseudo_lm._summed(parts).to_pydict() == {"word": [5, 7, -(2**63)], "times": [3, 1, 1]} and pseudo_lm._summed(parts[1:2]).num_rows == 0


@pytest.mark.parametrize("size", [0, 1, 6, 1000, 70_000])
def test_words_are_found_by_their_leading_bits(size):
    rng = np.random.default_rng(size)
    crowded = np.array([0, 1, 2, 3, 2**64 - 2, 2**64 - 1], np.uint64)[:size]  # several names of one slot, at both ends
    names = np.unique(np.concatenate([crowded, rng.integers(0, 2**64 - 1, size, dtype=np.uint64)]))
    asked = np.concatenate([names, np.array([4, 5, 2**64 - 3], np.uint64), rng.integers(0, 2**64 - 1, 2000, dtype=np.uint64)])
    known, at = pseudo_lm._found(asked, names, pseudo_lm.slots_of(names))
    assert (known == np.isin(asked, names)).all() and (names[at] == asked[known]).all() if size else not known.any()


def test_words_of_texts_are_counted_where_they_begin():
    texts = [*HARD, None, "", "!!!", "A, b", None]
    hashes, lens = pseudo_lm.hashes_of(texts)
    assert lens.tolist() == [len(pseudo_lm._clean(t).split()) for t in texts] and len(hashes) == lens.sum()
    starts, same = kernel.placed_hashes(" \u00fc b\t\n cc".encode())
    assert starts.tolist() == [1, 4, 8] and len(same) == 3


def test_pseudo_likelihood_does_not_depend_on_the_split_of_files(spark):
    rng = np.random.default_rng(7)
    docs = spark.createDataFrame([(i, " ".join("abcdefgh"[j] * 2 for j in rng.integers(0, 8, 50))) for i in range(80)] + [(3, "aa bb"), (3, "aa bb")], "doc_id long, text string")
    net = pseudo_lm.Net(classes=4, members=4, rare=4, batch=32, bucket_tokens=1000)
    one, five = ({k: v.tolist() for k, v in pseudo_lm.train(d, pseudo_lm.vocabulary(d, net), net).items()} for d in (docs.coalesce(1), docs.repartition(5)))
    assert one == five


@pytest.mark.parametrize("frequent", [0.0, 0.004, 1.0])
def test_pseudo_likelihood_tells_rare_words_apart(spark, frequent):
    net = pseudo_lm.Net(classes=2, members=4, rare=2, frequent=frequent)
    common = "a b c d e f " * 40
    texts = [common + " ".join(f"rare{chr(97 + i % 25)} often" for i in range(j, j + 9)) for j in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, "!!!")], "doc_id long, text string").repartition(3)
    counts = pseudo_lm.word_counts(docs)
    vocab, w = pseudo_lm.vocabulary(docs, net, counts), pseudo_lm.start(net)
    rare = pseudo_lm.rare_words(counts, vocab, net)
    new = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (900, None), (901, "!!!"), (902, "a madeup b")], "doc_id long, text string")
    got = pseudo_lm.score(new, vocab, w, net, rare=rare, keep_text=False).collect()
    times, bucket = {}, lambda word: int(kernel.word_hashes(word.encode())[0] % np.uint64(net.rare))
    known = set(vocab[0].tolist())
    israre = lambda word: int(kernel.word_hashes(word.encode())[0]) not in known
    for t in texts:
        for word in filter(israre, t.split()):
            times[word] = times.get(word, 0) + 1
    totals = [sum(k for x, k in times.items() if bucket(x) == b) for b in range(net.rare)]
    assert len(got) == len(texts) + 4 and "text" not in got[0].asDict()
    for r in got:
        text = {900: "", 901: "", 902: "a madeup b"}.get(r["doc_id"]) if r["doc_id"] >= 900 else texts[r["doc_id"]]
        n, want = pseudo_lm.score_text(text, vocab, w, net)
        want += sum(np.log(times.get(x, 1) / (totals[bucket(x)] + 1)) for x in filter(israre, text.split()))
        assert r["n_tokens"] == n and abs(r["log_likelihood"] - want) < 1e-3 and abs(r["mean_log_likelihood"] - want / max(n, 1)) < 1e-4
    assert len({r["log_likelihood"] for r in got if r["doc_id"] == 0}) == 1


def test_the_grammar_is_asked_about_arcs_that_are_taken(monkeypatch):
    """The least path stays the one of the public library, and few of the arcs that the lexicon finds meet the grammar."""
    from sentencepiece import SentencePieceProcessor

    c, asked = piece_codec.Codec(piece_codec.load()), []
    monkeypatch.setattr(c.grammar, "weigh", lambda a, b, f=c.grammar.weigh: asked.append((a, b)) or f(a, b))
    words = ["internationalization", "untelligence", "Eraneaeser", "ofthatingon", "x\U0001F600y", "e\u0301nverlichzu"]
    found = sum(len(c._arcs(s, at)) for s in words for at in range(len(s)))
    public = SentencePieceProcessor(model_file=piece_codec.MODEL)
    assert [c.encode(w) for w in words] == [public.encode(w) for w in words]
    assert 3 * len(asked) < found
