import random
import re

import numpy as np
import pytest

from quire.llm import decontaminate as D
from quire.llm.fmindex import FMIndex


def slow(text, items, window=13):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w, hit, named = split(text), set(), []
    for name, item in items:
        v = split(item)
        wins = {tuple(v[i : i + window]) for i in range(max(len(v) - window, 0) + 1)} if v else set()
        found = [(i, len(g)) for g in wins for i in range(len(w) - len(g) + 1) if tuple(w[i : i + len(g)]) == g]
        hit |= {p for i, n in found for p in range(i, i + n)}
        named += [name] if found else []
    return len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_all(seed):
    rng = np.random.default_rng(seed)
    s = np.concatenate((rng.integers(0, 4, 150), [0]))
    index = FMIndex(s, 3)
    for n in (1, 2, 4):
        rows = rng.integers(1, 4, (8, n))
        for row, a, b in zip(rows, *index.search(rows), strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(s) - n + 1) if (s[i : i + n] == row).all()]


@pytest.mark.parametrize("seed", range(4))
def test_judge_equals_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(["Ab", "b", "c,", "dé", "E."]) for _ in range(n))
    items = [("7", say(15)), ("10", say(4)), ("x", ""), ("y", None), ("z", say(13))]
    docs = [None, "", "...", *(say(rng.randrange(60)) + " " + (rng.choice(items)[1] or "") for _ in range(30))]
    phrases = D.Phrases([(k, t and t.encode()) for k, t in items])
    monkeypatch.setattr(D.occurrences, "__defaults__", (17,))  # shards far shorter than a document
    halves = [D.Phrases([(k, t and t.encode()) for k, t in part]) for part in (items[:2], items[2:])]
    assert D.judge([t and t.encode() for t in docs], halves) == D.judge([t and t.encode() for t in docs], [phrases])
    got = D.judge([t and t.encode() for t in docs], [phrases])
    for t, r in zip(docs, got, strict=True):
        assert (r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]) == slow(t, items)


def test_table(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"start {passage} end", "a"), (2, None, None), (3, "", "b"), (4, "nothing here", "c"), (None, passage, "d"), (1, f"start {passage} end", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decontamination string")
    bench = spark.createDataFrame([(10, passage), (9, passage.upper()), (9, "other words here"), (10, passage + " more"), (10, passage), (None, "nothing"), (8, None)], "item_id long, text string")
    one, at = D.decontaminate(docs, bench)
    many, at2 = D.decontaminate(docs, bench, item_bytes=150)
    assert at == "decontamination_1" and one.columns[:3] == docs.columns
    for found, name in ((one, at), (many, at2)):
        got = [(r.doc_id, r.decontamination, r[name].n_hit, r[name]["items"], r[name].contaminated, [tuple(s) for s in r[name].spans]) for r in found.collect()]
        hit = [(1, "a", 20, ["10", "9"], True, [(1, 21)])] * 2 + [(4, "c", 1, [""], True, [(0, 1)]), (None, "d", 20, ["10", "9"], True, [(0, 20)])]
        assert sorted(map(str, got)) == sorted(map(str, [*hit, (2, None, 0, [], False, []), (3, "b", 0, [], False, [])]))
    assert D.decontaminate(docs, bench.limit(0))[0].filter(f"{at}.n_hit > 0").count() == 0
    assert D.decontaminate(docs.limit(0), bench)[0].count() == 0
