import random

import pytest
from pyspark.sql import functions as F

from quire.operators import catalog as C
from quire.operators import search as S
from quire.sources import sinks

SCHEMA = "gid long, title string, authors string, subjects string"


def books_of(spark, rng, gids):
    words = ["war", "wars", "warm", "peace", "the", "a", "élan", "ghost", "sea", "x1"]
    title = lambda: " ".join(rng.choices(words, [1, 1, 1, 3, 9, 9, 1, 2, 2, 1], k=rng.randrange(0, 12)))
    return spark.createDataFrame([(g, title(), rng.choice(["Roe", None, "De La Mer"]), rng.choice(["Sea", ""])) for g in gids], SCHEMA)


def same(index, books, q, spark):
    got = [(r.gid, round(r["rank"], 9)) for r in S.pool(spark, index, q).collect()]
    want = [(r.gid, round(r["rank"], 9)) for r in C.pool(books, q).collect()]
    assert got == want, q
    return got


@pytest.fixture(scope="module")
def small(spark):
    held = S.RANGE, S.BLOCK, S.FIRST
    S.RANGE, S.BLOCK, S.FIRST = 500, 16, 4
    yield
    S.RANGE, S.BLOCK, S.FIRST = held


QUERIES = ["war", "peace", "sea ghost", "ÉLAN the", "w s", "the a peace", "nothing", "x1 war sea"]


def test_index_equals_scan_over_changes(spark, tmp_path, small):
    rng, path = random.Random(1), f"{tmp_path}/index"
    books = books_of(spark, rng, range(1500)).cache()
    S.add(books, path)
    assert sum(len(same(path, books, q, spark)) for q in QUERIES) > 1000
    more = books_of(spark, rng, [*range(1490, 1600), 7]).cache()  # some are new, some replace others
    S.add(more, path)
    both = books.join(more, "gid", "left_anti").unionByName(more).cache()
    for q in QUERIES:
        same(path, both, q, spark)
    S.remove(both.filter("gid % 10 = 3").select("gid"), path)
    left = both.filter("gid % 10 <> 3").cache()
    for q in QUERIES[:4]:
        same(path, left, q, spark)
    S.merge(spark, path)
    assert len(sinks.version(spark, path)[1]["segments"]) == 1 and not sinks.version(spark, path)[1]["dead"]
    for q in QUERIES:
        same(path, left, q, spark)


def test_empty_index_and_books_without_words(spark, tmp_path, small):
    path = f"{tmp_path}/index"
    assert S.pool(spark, path, "x").count() == 0
    S.merge(spark, path)
    S.add(spark.createDataFrame([(1, None, None, None), (2, "", None, "")], SCHEMA), path)
    assert S.pool(spark, path, "x").count() == 0
    S.add(spark.createDataFrame([(3, "x", None, None)], SCHEMA), path)
    assert [r.gid for r in S.pool(spark, path, "x").collect()] == [3]
    with pytest.raises(ValueError):
        S.pool(spark, path, " .")


def test_only_folders_and_blocks_of_the_terms_are_read(spark, tmp_path, small):
    rng, path = random.Random(2), f"{tmp_path}/index"
    # One word in every book, the books of the first blocks short and full of it, the others long.
    rows = [(g, "sea " * (1 + (g < 640) * rng.randrange(1, 4)) + " ".join(f"w{rng.randrange(3000)}" for _ in range(2 if g < 640 else 20)), None, None) for g in range(4000)]
    books = spark.createDataFrame(rows, SCHEMA).cache()
    S.add(books, path)
    folder = sinks.folders(spark, path, "segments")[0]
    n = spark.read.parquet(f"{path}/{folder}/postings").select("range").distinct().count()
    ranges, known = S.ranges_of(spark, path, [folder], ["sea"])
    assert n > 50 and known == [[("sea", 4000)]] and 8 <= len(ranges[folder]) <= 10
    read = S.of_ranges(spark, path, ranges, "postings", ["sea"])
    assert len(read.inputFiles()) <= len(ranges[folder]) + 1 and read.count() == 4000
    bounds = S.block_bounds(S.of_ranges(spark, path, ranges, "blocks", ["sea"]), ["sea"], [S.weight(4000, 4000)], 10.0)
    assert bounds.count() == 250
    got = same(path, books, "sea", spark)
    able = bounds.filter(F.col("bound") <= got[-1][1] + 1e-8).count()
    assert len(got) == 400 and able < 60


def test_absent_catalog_is_empty(spark, tmp_path):
    books, there = C.stored(spark, f"{tmp_path}/none")
    assert not there and C.book(books, 1).count() == 0 and C.genre_counts(books).count() == 0 and C.shelves(books).count() == 0
    for q in ("", "war"):
        page, total = C.search(books, q)
        assert page.count() == 0 and total.first().total == 0
    sinks.publish(spark.createDataFrame([(1, "War", "A", "A", "en", 5, "S", "", "Poetry", "d", 1000, True, True, True, None)], C.BOOKS), f"{tmp_path}/c")
    books, there = C.stored(spark, f"{tmp_path}/c")
    assert there and C.search(books, "war")[1].first().total == 1 and C.book(books, 1).count() == 1
