import hashlib
import random
import re
from fractions import Fraction

import pytest

from quire.llm import mixing as M


def slow_targets(sizes, weights, budget, cap):
    """Water-filling in fractions: who is over its cap is clamped, what it leaves is shared again."""
    clamped = {}
    while True:
        rest = budget - sum(clamped.values())
        open_ = {s: w for s, w in weights.items() if s not in clamped and w}
        total = sum(open_.values())
        targets = {s: clamped.get(s, Fraction(rest * weights[s], total) if total and weights[s] else Fraction(0)) for s in sizes}
        over = {s: cap * sizes[s] for s in open_ if targets[s] > cap * sizes[s]}
        if not over:
            return targets
        clamped |= over


def slow_mix(docs, weights, cap=3, seed=M.SEED):
    """taken of each document (id, source, text), by sorting every source."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in docs]
    key = [int(hashlib.md5(f"{seed}:{'' if d is None else d}:{n}".encode()).hexdigest()[:9], 16) for (d, _, _), n in zip(docs, size, strict=True)]
    sizes = {}
    for (_, s, _), n in zip(docs, size, strict=True):
        sizes[s] = sizes.get(s, 0) + n
    targets = slow_targets(sizes, {s: weights(s) for s in sizes}, sum(sizes.values()), cap)
    taken = [0] * len(docs)
    for s in sizes:
        mine = sorted((k for k, d in enumerate(docs) if d[1] == s), key=lambda k: key[k])
        whole = int(targets[s] // sizes[s]) if sizes[s] else 0
        left, picked = targets[s] - whole * sizes[s], set()
        groups = {}
        for k in mine:
            groups.setdefault(key[k], []).append(k)
        for search in range(M.SEARCHES):
            rest, run = left - sum(size[k] for k in picked), 0
            for g in groups.values():
                g = [k for k in g if k not in picked and (not search or size[k] * M.SMALL <= rest)]
                run += sum(size[k] for k in g)
                if run > rest:
                    break
                picked |= set(g)
        for k in mine:
            taken[k] = size[k] * (whole + (k in picked)) if size[k] else 0
    return size, sizes, targets, taken


def random_docs(rng, sources, n):
    docs = []
    for k in range(n):
        words = rng.choice([0, 1, 5, 40, 40, 40, 300])
        docs.append((rng.choice([k, k, k, k // 2, None]), rng.choice(sources), rng.choice([" ".join(["w"] * words), "a\x0bb  c d", None, ""])))
    return docs


@pytest.mark.parametrize("sources", [["a", "a", "a", "b", None], ["b", "é", "Z", "😀", "", "b", "b", None], ["only"]])
def test_mix_equals_brute_force(spark, sources):
    docs = random_docs(random.Random(len(sources)), sources, 300)
    frame = spark.createDataFrame([(*d, 7, "x", 1) for d in docs], "doc_id long, source string, text string, mix int, key string, size int")
    names = sorted({d[1] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    size, sizes, targets, taken = slow_mix(docs, lambda s: names.index(s) % 3 + 1)
    out, at = M.mix(frame)
    assert out.columns == [*frame.columns, at] and at == "mix_1"
    got = sorted((str(r.doc_id), str(r.source), str(r.text), r[at].size, r[at].source_size, round(r[at].target, 6), r[at].taken, r.key) for r in out.collect())
    want = sorted(
        (str(d), str(s), str(t), size[k], sizes[s], round(float(targets[s]), 6), taken[k], "x") for k, (d, s, t) in enumerate(docs)
    )
    assert got == want
    again = sorted((str(r.doc_id), str(r.source), str(r.text), r[at].taken) for r in M.mix(frame.repartition(7))[0].collect())
    assert again == [(a, b, c, n) for a, b, c, *_, n, _ in sorted((a, b, c, n, "") for a, b, c, _, _, _, n, _ in got)]


def test_given_weights_caps_and_empty_tables(spark):
    docs = [(k, s, "w " * n) for k, (s, n) in enumerate([("a", 10), ("a", 20), ("b", 1000), ("c", 50), ("d", 0), ("e", 5)])]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string")
    weights = spark.createDataFrame([("a", 4), ("a", 4), ("c", 1), ("d", 9), ("e", None), ("zz", 5)], "source string, weight int")
    out, at = M.mix(frame, weights, cap=2)
    got = {r.source: (r[at].target, r[at].taken) for r in out.collect() if r.source != "a"}
    # a and c stop at twice their size; b and e weigh nothing, so the rest of the words stays unused.
    assert got == {"b": (0.0, 0), "c": (100.0, 100), "d": (0.0, 0), "e": (0.0, 0)}
    assert {r[at].repeats for r in out.collect() if r.source == "a"} == {2}
    assert M.mix(frame.limit(0))[0].count() == 0


def test_places_of_many_sources(spark):
    names = [f"s{k * 7919 % 1000}" for k in range(1000)] + [None]
    sources = spark.createDataFrame([(s,) for s in names], "source string").repartition(9)
    got = {r.source: r.place for r in M.ranked(sources).collect()}
    assert got == {s: k for k, s in enumerate(sorted(names, key=lambda s: (s is None, s or "")))}


def test_sources_come_near_their_targets_and_plan_is_native(spark):
    out = M.op13_mixing(spark, "/root/testdata/sf0.01")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source")
    rows = out.join(docs, "doc_id").toPandas()
    assert len(rows) == 1000 and (rows.taken <= 3 * rows["size"]).all()
    for _, g in rows.groupby("source"):
        assert 0 <= g.target.iloc[0] - g.taken.sum() <= 0.02 * g.target.iloc[0]
    assert abs(rows.groupby("source").target.first().sum() - rows["size"].sum()) < 1e-6 * rows["size"].sum()
