import math
import random

from quire.llm import licenses as L
from quire.llm.text import alnum_words


def test_join_equals_brute_force():
    rng = random.Random(2)
    vocabulary = [f"w{k}".encode() for k in range(14)]
    sets = [(f"t{k}", frozenset(rng.sample(vocabulary[:10], rng.randrange(1, 8))), 20) for k in range(12)]
    for threshold in (0.5, 0.8, 1.0):
        index = L.Index(sets, {w: rng.randrange(5) for w in vocabulary}, threshold)
        for _ in range(300):
            block = set(rng.sample(vocabulary, rng.randrange(0, 12)))
            want = {(k, len(block & s) / len(s)) for k, (_, s, _) in enumerate(sets) if len(block & s) >= math.ceil(threshold * len(s) - 1e-9)}
            assert set(index.matches(block)) == want


def test_places():
    words = alnum_words(b"cc by nc cc BY-NC cc by nc by nc Under the MIT license")
    got = L.phrase_places(words, {k.encode(): v for k, v in L.PHRASES.items()})
    assert got == [(0, "cc-by-nc"), (3, "cc-by-nc"), (6, "cc-by-nc"), (11, "mit")]


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x\nLicensed under the Apache License, Version 2.0."), (3, "x\nLicensed under the Apache License, Version 2.0."), (None, "This work is licensed under the\nGNU General Public License, version 3"),
            (5, "a " * 100_000 + "\nThis work is licensed under the GNU General Public License version 3!")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, licenses int")
    found, at = L.scan(docs)
    assert at == "licenses_1" and found.columns == [*docs.columns, at]
    got = sorted((str(r.doc_id), r[at].n_words, r[at].places, r[at].phrase_labels, r[at].labels) for r in found.collect())
    assert got == sorted([
        ("1", 0, [], [], []), ("2", 0, [], [], []), ("3", 9, [4], ["apache-2"], ["apache-2"]), ("3", 9, [4], ["apache-2"], ["apache-2"]),
        ("5", 100_012, [], [], ["gpl", "gpl-3"]), ("None", 12, [], [], ["gpl", "gpl-3"]),
    ])
    assert L.scan(docs.limit(0))[0].count() == 0


def test_blocks_equal_brute_force():
    rng = random.Random(3)
    vocabulary = [f"w{k}".encode() for k in range(60)]
    sets = [(f"t{k}", frozenset(s := rng.sample(vocabulary[:12], rng.randrange(1, 8))), rng.randrange(len(s), 20)) for k in range(12)]
    index = L.Index(sets, {}, 0.8)
    for _ in range(100):
        words = rng.choices(vocabulary, k=rng.randrange(0, 200))
        want = {}
        for k, (_, s, wide) in enumerate(sets):
            most = max(len(s.intersection(words[i : i + wide])) for i in range(max(1, len(words))))
            if most >= math.ceil(0.8 * len(s) - 1e-9):
                want[k] = most / len(s)
        got = {}
        for k, _, share in index.blocks(words):
            got[k] = max(share, got.get(k, 0))
        assert got == want


def test_wrapped_notices_and_words_met_by_chance(spark):
    wrap = lambda t, n: "\n# ".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows = [(label, "Copyright (c) 2020 A. N. Author\n\n" + wrap(t, 9) + "\nand so on") for label, texts in L.TEMPLATES.items() for t in texts]
    far = ["The NC team was pressed by the CC committee", "version 2 of the Apache helicopter license plates", "general " + "a " * 3000 + "public " + "b " * 3000 + "license 3", "public domain", "mit", "the bsd"]
    rows += [(None, t) for t in far]
    found, at = L.scan(spark.createDataFrame(rows, "doc_id string, text string"))
    for r in found.collect():
        if r.doc_id:
            assert r.doc_id in r[at].labels and r[at].score >= 0.8, r
        else:
            assert r[at].labels == [] and r[at].score == 0, r
