import random
import re
import zlib

import numpy as np
import pytest

from quire.llm import langid, toxicity


def slow_grams(text):
    """N-grams by the definition: lower-case letters, a border for each run of other characters."""
    s = re.sub("_+", "_", "_" + "".join(c if c.isalpha() else "_" for c in text.lower()) + "_")
    return [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)]


def as_buckets(grams):
    at = lambda g: int(langid.hashed(np.array([0 if c == "_" else ord(c) for c in g], np.uint64), len(g))[0])
    return [at(g) for g in grams]


@pytest.mark.parametrize("block", [1, 2, 3, 5, 1 << 18])
def test_grams_do_not_depend_on_blocks(block, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", block)
    for text in ["the cat", "The  cat!!", "a", "??a? b!", "Straße 中文 1 x", "!!", " a b  c "]:
        want = sorted(as_buckets(slow_grams(text)))
        got = np.sort(np.concatenate([np.concatenate(b) for b in langid.blocks(text)])).tolist()
        assert got == want, (text, block)


def test_kernel_is_shared_grams_over_the_root_of_the_product():
    texts = ["the cat", "The  cat!!", "le chat", "x"]
    grams = [langid.buckets(t) for t in texts]
    model = langid.Model(["a", "b", "c", "d"], grams)
    sets = [set(slow_grams(t)) for t in texts]
    want = [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets]
    assert np.allclose(model.marks @ model.marks.T, want, atol=1e-6) and want[0][1] == 1


def test_scores_equal_a_slow_kernel_regression():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(w) for _ in range(12)) for w in (["the", "dog", "house"], ["le", "chien", "maison"], ["der", "hund", "haus"]) for _ in range(6)]
    labels = [x for x in ("en", "fr", "de") for _ in range(6)]
    model = langid.Model(labels, [langid.buckets(t) for t in texts], landmarks=6)
    sets = [set(slow_grams(t)) for t in texts]
    k = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets])
    # with every row a landmark the Nyström features give the kernel itself: ridge regression in its dual form, with a bias
    y = np.array([[1.0 if v == lang else -1.0 for lang in ("de", "en", "fr")] for v in labels])
    x = np.linalg.eigh(k)[1] * np.sqrt(np.maximum(np.linalg.eigh(k)[0], 0))
    x1 = np.hstack((x, np.ones((18, 1))))
    margin = x1 @ np.linalg.solve(x1.T @ x1 + langid.RIDGE * np.eye(19), x1.T @ y)
    got = model.predict(texts)
    assert [lang for lang, _ in got] == labels
    assert np.allclose([s for _, s in got], np.clip((margin.max(1) + 1) / 2, 0, 1), atol=1e-3)


def test_language_edges(spark):
    rows = [(k, f"the dog and the house number {k}", "en", 1) for k in range(20)] + [(100 + k, f"le chien et la maison numero {k}", "fr", 1) for k in range(20)]
    rows += [(200, None, "en", 0), (201, "", None, 0), (202, "123 !? 😀", "fr", 0), (None, "the house", "en", 0), (0, "the dog", "en", 2), (300, "le " * 60_000, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, language int")
    found, at = langid.identify(docs, langid.train(docs))
    assert at == "language_1" and found.columns == [*docs.columns, at]
    got = {r.doc_id: r[at] for r in found.collect()}
    assert got[200] == got[201] == got[202] == ("und", 0.0) and got[300].lang == "fr" and got[None].lang == "en"
    assert all(r.lang == ("en" if k < 100 else "fr") for k, r in got.items() if k is not None and k < 200)
    none = langid.train(docs.filter("lang is null"))
    assert {r[1].lang for r in langid.identify(docs, none, keep=["doc_id"])[0].collect()} == {"und"}
    assert langid.identify(docs.limit(0), none)[0].count() == 0


def test_every_text_with_a_letter_has_a_language_unless_a_share_is_asked_for():
    labels = [x for x in ("en", "fr") for _ in range(6)]
    model = langid.Model(labels, [langid.buckets(t) for t in ["the dog and the house"] * 6 + ["le chien et la maison"] * 6])
    odd = ["Re.", "x", "qzx wvk jjq", "чужой язык", "1 a"]
    assert all(lang in ("en", "fr") for lang, _ in model.predict(odd))
    assert [lang for lang, _ in model.predict([*odd, "the dog", "12 !?", None], langid.LEAST_KNOWN)] == ["und"] * 5 + ["en", "und", "und"]


def test_many_languages_and_scripts(spark):
    """No bound on the number of labels, and letters of any script are told apart."""
    rng = random.Random(8)
    alphabets = [[chr(0x4E00 + 40 * k + j) for j in range(40)] for k in range(70)]
    say = lambda k: " ".join("".join(rng.choice(alphabets[k]) for _ in range(4)) for _ in range(30))
    rows = [(100 * k + i, say(k), f"l{k:02d}") for k in range(70) for i in range(3)] + [(5, say(0), "l00"), (5, "again", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found, at = langid.identify(docs, langid.train(docs.unionByName(docs)))
    assert all(r[at].lang == r.lang for r in found.collect() if r.lang)


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op4_langid(spark, sf).toPandas()
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars").toPandas()
    both = got.merge(truth, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    assert both.score.between(0, 1).all() and len(got) == len(truth)
    held = both[both.held_out & both.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.97


def slow_words(raw):
    """Word scores by the definition, byte by byte, with the length of an n-gram as its weight."""
    words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", raw.lower())
    return words, [[(b" " + w + b" ")[i : i + n] for n in toxicity.SIZES for i in range(len(w) + 3 - n)] for w in words]


def test_grams_of_words():
    raw = "Idiot, an é \u00fcber-a".encode()
    bucket, owner = toxicity.grams(toxicity.levelled(raw))
    words, lists = slow_words(raw)
    one = lambda g: toxicity.grams(np.frombuffer(g, np.uint8))[0][-1]  # noqa: E731  the longest n-gram of a piece is the last
    assert owner.max() + 1 == len(words)
    for k, found in enumerate(lists):
        assert sorted(bucket[owner == k].tolist()) == sorted(int(one(g)) for g in found)


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_scores_do_not_depend_on_blocks(block, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    weights = np.random.default_rng(3).normal(size=toxicity.BUCKETS)
    rng = random.Random(5)
    texts = ["", "a", "??", "x" * 500, "é" * 300, " ".join("".join(rng.choice("abcé") for _ in range(rng.randrange(9))) for _ in range(300))]
    for t in texts:
        raw = t.encode()
        words, lists = slow_words(raw)
        one = lambda g: weights[toxicity.grams(np.frombuffer(g, np.uint8))[0][-1]]
        want = [np.mean([one(g) for g in found]) for found in lists]
        got = toxicity.word_scores(toxicity.levelled(raw), weights)
        assert np.allclose(got, want)
        k = toxicity.STRETCH
        means = [np.mean(want[i : i + k]) for i in range(max(1, len(want) - k + 1))] if want else [0.0]
        assert np.allclose(toxicity.stretch_means(got), means)


def test_one_training_step_equals_a_slow_version():
    model = toxicity.Model([(b"river stone", 0), (b"stupid idiot", 1)])
    e, s, o = (x.astype(float).copy() for x in (model.embed, model.soft, model.offset))
    bucket, share = toxicity._bag(*toxicity.grams(toxicity.levelled(b"stupid river")))
    other = toxicity._bag(*toxicity.grams(toxicity.levelled(b"stone")))
    model.rng = np.random.default_rng(0)
    order = np.random.default_rng(0).permutation(2).tolist()
    seen, seen_soft = {}, 1e-6
    for i in order:
        (b, w), y = ((bucket, share), 1) if i == 0 else (other, 0)
        mean = sum(w[j] * e[b[j]] for j in range(len(b)))
        z = mean @ s + o
        p = np.exp(z) / np.exp(z).sum() - np.eye(2)[y]
        back = s @ p
        for j in range(len(b)):
            g = w[j] * back
            seen[b[j]] = seen.get(b[j], 1e-8) + (g * g).mean()
            e[b[j]] = e[b[j]] - 0.1 * g / seen[b[j]] ** 0.5
        g = np.outer(mean, p)
        seen_soft += (g * g).mean()
        s, o = s - 0.1 * g / seen_soft**0.5, o - 0.01 * p
    model._learn([(bucket, share, 1), (*other, 0)], 1, 0.1)
    assert np.allclose(model.weights, e @ (s[:, 1] - s[:, 0]), atol=1e-3)


def test_toxicity_edges(spark):
    words = ["river", "house", "stone", "green", "walk", "paper", "cloud"]
    say = lambda k: " ".join(words[(k * j) % 7] for j in range(1, 20))
    rows = [(k, say(k) + (" you stupid idiot" if k % 2 else ""), 1.0) for k in range(60)] + [(900, None, 0.0), (901, "", 0.0), (902, "??", 0.0), (None, say(3), 0.0), (903, "stone " * 300_000 + "stupid idiot", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(0, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    found, at = toxicity.toxicity(docs, toxicity.train(docs, labels))
    assert at == "toxicity_1"
    got = {r.doc_id: r[at] for r in found.collect()}
    assert all((got[k] >= 0.5) == bool(k % 2) for k in range(60)) and got[903] > 0.5
    assert got[900] == got[901] == got[902] and 0 <= got[900] <= 1
    assert {r[0] for r in toxicity.toxicity(docs, toxicity.train(docs, labels.limit(0)), keep=[])[0].collect()} == {0.5}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), may_learn=~langid.held_out("doc_id", 5, 0))
    found, at = toxicity.toxicity(docs.filter(langid.held_out("doc_id", 5, 0)), model, keep=["toxic"])
    p = found.toPandas()
    hit = p[at] >= 0.5
    assert (hit & (p.toxic == 1)).sum() / (p.toxic == 1).sum() > 0.79 and (hit & (p.toxic == 0)).sum() / (p.toxic == 0).sum() < 0.02


def test_toxicity_learns_from_whole_texts(spark):
    rng = np.random.default_rng(1)
    words = ["river", "house", "stone", "green", "walk", "paper", "cloud", "table", "lamp", "road"]
    say = lambda n: " ".join(rng.choice(words, n))
    rows = [(k, say(1500) + (" you stupid idiot " if k % 2 else " ") + say(20)) for k in range(40)] + [(100 + k, say(20) + (" you stupid idiot" if k % 2 else "")) for k in range(40)]
    labels = [(k, k % 2) for k, _ in rows]
    rows += [(900 + k, say(40_000)) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {k: model.score(t.encode()) >= 0.5 for k, t in rows}
    assert got == {k: k < 900 and bool(k % 2) for k, _ in rows}
    x, piece = model.worst_piece(rows[1][1].encode(), 200)
    assert x == model.worst(rows[1][1].encode()) and b"stupid" in piece and b"idiot" in piece and len(piece) < 300
