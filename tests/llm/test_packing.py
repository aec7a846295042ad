import random

from quire.llm import packing as P
from quire.llm.simhash import near_duplicates


def slow(pieces, capacity, per_source):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = [
            (b["left"], k) for k, b in enumerate(bins)
            if b["left"] >= length and (cluster is None or cluster not in b["clusters"]) and (source is None or b["sources"].count(source) < per_source)
        ]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "clusters": [], "sources": []})
        b = bins[k]
        out.append((k, capacity - b["left"]))
        b["left"] -= length
        b["clusters"].append(cluster)
        b["sources"].append(source)
    return out


def test_best_fit_equals_brute_force():
    rng = random.Random(5)
    for _ in range(20):
        pieces = sorted(((rng.randrange(0, 101), rng.choice(["a", "a", "b", None]), rng.choice([None, *range(9)])) for _ in range(150)), key=lambda p: -p[0])
        assert P.best_fit(pieces, 100, 2) == slow(pieces, 100, 2)


def test_pack(spark):
    rows = [(1, 250, "a", 1), (2, 90, "a", 1), (2, 90, "a", 1), (3, None, None, None), (None, 0, "b", 2), (4, 60, "a", 3), (5, 40, "b", 3), (6, 40, "b", None), (2**60 + 1, 10, "c", 9)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, length long, source string, cluster long, bin string")
    for shard in (4, 100):
        out = P.pack(docs, capacity=100, per_source=1, shard=shard).collect()
        assert sorted((str(r.id), r.start, r.length) for r in out) == sorted(
            [("1", 0, 100), ("1", 100, 100), ("1", 200, 50), ("2", 0, 90), ("2", 0, 90), ("3", 0, 0), ("None", 0, 0), ("4", 0, 60), ("5", 0, 40), ("6", 0, 40), (str(2**60 + 1), 0, 10)]
        )
        bins = {}
        for r in out:
            bins.setdefault((r.shard, r.bin), []).append(r)
        for held in bins.values():
            held.sort(key=lambda r: (r.offset, r.length))
            assert all(a.offset + a.length <= b.offset for a, b in zip(held, held[1:], strict=False)) and held[-1].offset + held[-1].length <= 100
    assert P.pack(docs.limit(0)).count() == 0


def test_rows_that_agree_are_dealt_over_all_shards(spark):
    docs = spark.range(600, numPartitions=3).selectExpr("cast(null as long) doc_id", "30L length", "cast(null as string) source", "cast(null as long) cluster")
    out = P.pack(docs, capacity=100, shard=60).toPandas()
    assert len(out) == 600 and out.groupby("shard").size().between(20, 120).all() and out.shard.nunique() == 10


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    out = P.op9_packing(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    assert out.groupby("doc_id").length.sum().to_dict() == {r.doc_id: len(r.text.encode()) for r in docs.itertuples()}
    assert out.groupby(["shard", "bin"]).length.sum().max() <= P.CAPACITY
    source = docs.set_index("doc_id").source
    assert out.assign(s=out.doc_id.map(source)).groupby(["shard", "bin", "s"]).size().max() <= P.PER_SOURCE


def test_no_bin_holds_two_near_copies(spark):
    rng = random.Random(4)
    words = [rng.choice("abcdefghijklm") * rng.randrange(1, 9) for _ in range(400)]
    text = " ".join(words)
    near = [text] + [" ".join([*words[:k], "Zzz", *words[k + 1 :]]) for k in range(0, 400, 4)]
    rows = [(k, t, None) for k, t in enumerate(near)] + [(None, text.upper(), "s"), (7, "ÉTÉ " * 9, "s"), (7, "été " * 9, "s"), (500, None, "s"), (501, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = P.pack_documents(docs).toPandas()
    assert len(out) == len(rows)
    group = {r.id: r.component_id for r in near_duplicates(docs.filter("doc_id < 400 and doc_id <> 7")).collect()}
    out["group"] = out.doc_id.map(group)
    sizes = out.groupby("group").size()
    assert sizes.max() > 10 and len({t for t in near}) > 90
    assert out.groupby(["shard", "bin", "group"]).size().max() == 1
    assert not out[(out.doc_id == 7) & (out.length < 200)].duplicated(["shard", "bin"]).any()
