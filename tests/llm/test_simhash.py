import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import simhash
from quire.llm.graph import connected_components, put_together


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(fps):
    """fps: list of (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(fps):
        groups.setdefault(find(i), []).append(key)
    return {key: min(g) for g in groups.values() for key in g}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a B", "A b c", "a b c d é Ü ñ " * 9, "x\x1fy z \x0b q", "w " * 40_000])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_native_hash_agrees(spark):
    got = spark.sql("select xxhash64('a b c') as h").first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("short", [1, 3, 32])
def test_links_equal_brute_force(spark, short):
    rng = random.Random(3)
    fps = []
    for base in [rng.getrandbits(64) for _ in range(12)]:
        chain = base
        for _ in range(12):
            fps.append(chain)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                chain ^= 1 << b
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    found = {r.node: r.root for r in connected_components(simhash.links(distinct, short=short)).collect()}
    want = slow_components([(s, f) for s, f in zip(signed, fps, strict=True)])
    assert {s: found.get(s, s) for s in signed} == want


def test_tally_keeps_pairs_and_bounds_long_postings():
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate((rng.integers(0, 1 << 24, 50), rng.integers(0, 1 << 62, 50))))  # many agree in five bytes
    masks = np.array([simhash.mask((3, 4, 5, 6, 7)), simhash.mask((0, 1, 2, 3, 4))], np.int64)
    rows = sorted((p, int(f & masks[p]), int(f)) for p in (0, 1) for f in fps)
    table = pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["positions", "fingerprint"])
    groups = {}
    for p, k, f in rows:
        groups.setdefault((p, k), []).append(f)
    for size in (1, 7, 1000):
        found = [r for b in simhash.short_postings(table.to_batches(size), masks, 20) for r in zip(*b.to_pydict().values(), strict=True)]
        pairs = sorted((a, b) for a, b, _ in found if b is not None)
        assert pairs == sorted(c for g in groups.values() if len(g) <= 20 for c in combinations(g, 2))
        assert sorted((p, a) for a, b, p in found if b is None) == sorted((p, f) for (p, _), g in groups.items() if len(g) > 20 for f in g)


def test_posting_links_of_a_large_posting():
    rng = np.random.default_rng(1)
    members = np.unique(rng.integers(0, 1 << 16, 3000, np.uint64))
    found = simhash.posting_links(members, list(range(16)), 2)
    want = slow_components([(int(m), int(m)) for m in members])
    label = {b: a for a, b in found}
    assert {int(m): label.get(int(m), int(m)) for m in members} == want


def test_near_duplicates_edges(spark):
    rows = [(5, "the cat sat on the mat", 1), (2, "THE cat  sat\non the mat", 2), (9, None, 3), (7, "", 4), (None, "the cat sat on the mat", 5), (5, "the cat sat on the mat", 6), (1, "other words stand here now", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    found = sorted((str(r.id), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert found == [("1", 1), ("2", 2), ("5", 2), ("5", 2), ("7", 7), ("9", 7), ("None", 2)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, slow_fingerprint(r.text)) for r in rows]
    want = slow_components(fps)
    got = simhash.op3_simhash(spark, "/root/testdata/sf0.001").collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(k, f"{f:016x}", want[k]) for k, f in fps}
    assert len(got) == len(rows)


def test_put_together():
    rng = random.Random(7)
    for _ in range(40):
        edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 70))]
        root = {x: x for e in edges for x in e}
        for a, b in edges:
            root = {x: root[a] if r == root[b] else r for x, r in root.items()}
        groups = {}
        for x, r in root.items():
            groups.setdefault(r, []).append(x)
        want = sorted((x, min(g)) for g in groups.values() for x in g if x != min(g))
        got = put_together(*(np.array(c, np.int64) for c in zip(*edges, strict=True)))
        assert sorted(zip(*(c.tolist() for c in got), strict=True)) == want


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in connected_components(edges).collect()} == {0}
    assert connected_components(edges.limit(0)).count() == 0
