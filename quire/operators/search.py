"""Full-text search on a stored index: postings by ranges of terms, a dictionary, block maxima, segments.

An index is a store (``quire.sources.sinks``) of segments. A segment holds the postings (term, gid, tf, len) of its
books, sorted and dealt to ranges of about RANGE postings, each a folder; a term of very many books fills several.
Its dictionary tells each term's number of books and ranges, its blocks the greatest tf and least length
among each BLOCK numbers of books. New books are a segment of their own; what they replace in earlier segments is
listed as dead, and merge() makes one segment of all. Each change is one version, so a search sees a whole index.

A search looks up the terms that begin with each of its words as a range of the dictionary, and reads
only the folders of those terms. Where each word is one term, whose number of books the dictionary knows, the
search looks at blocks in order of the best rank that they can hold: it draws POOL books from the best blocks, then
reads the blocks that could hold a better book than the last of these, and no others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.catalog import POOL, query_terms, terms
from quire.plans.staging import discard, staged
from quire.sources import sinks

RANGE, BLOCK, FIRST = 1 << 20, 1 << 10, 64
#: Fixed values of the ranking.
K1, B = 1.2, 0.75
LAST = "\U0010ffff"


def segment(books: DataFrame, path: str, folder: str) -> None:
    """Write the postings, dictionary, blocks and books of a segment."""
    tokens = staged(books.select("gid", terms("title", "authors", "subjects").alias("t")), "index-tokens")
    tokens.select("gid", F.size("t").alias("len")).write.parquet(f"{path}/{folder}/books")
    each = tokens.select("gid", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("term", "gid").agg(F.count("*").cast("int").alias("tf"), F.first("len").alias("len"))
    write_postings(each, path, folder)
    discard(tokens)


def write_postings(postings: DataFrame, path: str, folder: str) -> None:
    """Postings in ranges of terms, and the dictionary and blocks that tell of them."""
    spark, held = postings.sparkSession, staged(postings, "index-postings")
    n = max(1, -(-held.count() // RANGE))
    ranged = held.repartitionByRange(n, "term", "gid").withColumn("range", F.spark_partition_id()).sortWithinPartitions("range", "term", "gid")
    ranged.select("range", "term", "gid", "tf", "len").write.partitionBy("range").parquet(f"{path}/{folder}/postings")
    discard(held)
    back = spark.read.schema("term string, gid long, tf int, len int, range int").parquet(f"{path}/{folder}/postings")
    blocks = back.groupBy("range", "term", F.floor(F.col("gid") / BLOCK).alias("block")).agg(F.max("tf").alias("tf"), F.min("len").alias("len"), F.count("*").alias("n"))
    blocks.repartition("range").sortWithinPartitions("range", "term", "block").write.partitionBy("range").parquet(f"{path}/{folder}/blocks")
    told = spark.read.schema("term string, block long, tf int, len int, n long, range int").parquet(f"{path}/{folder}/blocks")
    told = told.groupBy("term").agg(F.sum("n").alias("books"), F.min("range").alias("first"), F.max("range").alias("last"))
    told.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/{folder}/terms")


def read(spark: SparkSession, path: str, folders: list[str], kind: str) -> DataFrame | None:
    """A table of several segments, with each row's segment."""
    found = None
    for f in folders:
        one = spark.read.parquet(f"{path}/{f}/{kind}").withColumn("segment", F.lit(f))
        found = one if found is None else found.unionByName(one)
    return found


def dead(spark: SparkSession, path: str, tables: sinks.Tables) -> DataFrame | None:
    """(segment, gid, len) of books that a later segment has replaced, or that were removed."""
    listed = tables.get("dead", [])
    return spark.read.parquet(*[f"{path}/{f}" for f in listed]) if listed else None


def living(rows: DataFrame, gone: DataFrame | None) -> DataFrame:
    return rows if gone is None else rows.join(gone.select("segment", "gid"), ["segment", "gid"], "left_anti")


def replaced(spark: SparkSession, path: str, tables: sinks.Tables, gids: DataFrame) -> list[str]:
    """The folder that lists what of these books earlier segments hold, if there is any."""
    if not tables.get("segments"):
        return []
    gone = living(read(spark, path, tables["segments"], "books"), dead(spark, path, tables)).join(gids, "gid", "left_semi")
    return [sinks.written(gone.select("segment", "gid", "len"), path)]


def add(books: DataFrame, path: str) -> None:
    """Put books (gid, title, authors, subjects) into the index, in the place of those of the same gid."""
    spark, folder = books.sparkSession, f"data-{sinks.uuid.uuid4().hex}"
    segment(books, path, folder)
    gids = spark.read.parquet(f"{path}/{folder}/books").select("gid")

    def made(tables: sinks.Tables) -> sinks.Tables:
        gone = replaced(spark, path, tables, gids)
        return {"segments": [*tables.get("segments", []), folder], "dead": [*tables.get("dead", []), *gone]}

    sinks.change(spark, path, made)


def remove(gids: DataFrame, path: str) -> None:
    """Take books (gid) out of the index."""
    spark = gids.sparkSession
    sinks.change(spark, path, lambda tables: tables | {"dead": [*tables.get("dead", []), *replaced(spark, path, tables, gids.select("gid"))]})


def merge(spark: SparkSession, path: str) -> None:
    """Make one segment of all living books."""

    def made(tables: sinks.Tables) -> sinks.Tables:
        folder, gone, listed = f"data-{sinks.uuid.uuid4().hex}", dead(spark, path, tables), tables.get("segments", [])
        if not listed:
            return tables
        living(read(spark, path, listed, "books"), gone).select("gid", "len").write.parquet(f"{path}/{folder}/books")
        write_postings(living(read(spark, path, listed, "postings"), gone).select("term", "gid", "tf", "len"), path, folder)
        return {"segments": [folder], "dead": []}

    sinks.change(spark, path, made)


def beginning(word: str) -> Column:
    """Terms that begin with a word, as a range that a scan of sorted terms can skip by."""
    return (F.col("term") >= word) & (F.col("term") < word + LAST)


def ranges_of(spark: SparkSession, path: str, listed: list[str], wanted: list[str]) -> tuple[dict[str, set[int]], list[list]]:
    """The ranges of each segment that hold terms of the words; and for each word its terms (at most two are told) with their numbers of books."""
    found = read(spark, path, listed, "terms")
    ranges: dict[str, set[int]] = {}
    known = []
    for w in wanted:
        hits = found.filter(beginning(w))
        for r in hits.select("segment", F.explode(F.sequence("first", "last")).alias("range")).distinct().collect():  # as many as there are ranges
            ranges.setdefault(r.segment, set()).add(r.range)
        known.append([(r.term, r.n) for r in hits.groupBy("term").agg(F.sum("books").alias("n")).limit(2).collect()])
    return ranges, known


def of_ranges(spark: SparkSession, path: str, ranges: dict[str, set[int]], kind: str, wanted: list[str]) -> DataFrame | None:
    """Postings or blocks of the words' terms, from their folders alone."""
    every, found = F.lit(False), None
    for w in wanted:
        every = every | beginning(w)
    for f, ks in ranges.items():
        root = f"{path}/{f}/{kind}"
        one = spark.read.option("basePath", root).parquet(*[f"{root}/range={k}" for k in sorted(ks)]).withColumn("segment", F.lit(f)).filter(every)
        found = one if found is None else found.unionByName(one)
    return found


def weight(n: float, books: float) -> float:
    """What a word that n of all books have counts for."""
    idf = math.log((books - n + 0.5) / (n + 0.5))
    return 1e-6 if idf <= 0 else idf


def scored(f: list[Column], length: Column, weights: list[float], average: float) -> Column:
    """The rank, lowest first is best, of a book with f occurrences of each word and so many terms."""
    rank = F.lit(0.0)
    for w, n in zip(weights, f, strict=True):
        rank = rank - F.lit(w) * n * (K1 + 1) / (n + K1 * (1 - B + B * length / F.lit(average)))
    return rank


def by_book(postings: DataFrame, wanted: list[str]) -> DataFrame:
    """(gid, len, f0, f1, ...) of books that have terms of the words."""
    return postings.groupBy("gid").agg(F.first("len").alias("len"), *[F.coalesce(F.sum(F.when(beginning(w), F.col("tf"))), F.lit(0)).alias(f"f{k}") for k, w in enumerate(wanted)])


def pool(spark: SparkSession, path: str, q: str) -> DataFrame:
    """(gid, rank) of the POOL best books of a query, as catalog.ranked() ranks them; a cap that belongs to the search itself."""
    wanted = query_terms(q)
    if not wanted:
        raise ValueError("the query has no word")
    tables = sinks.version(spark, path)[1]
    listed, gone = tables.get("segments", []), dead(spark, path, tables)
    none = spark.createDataFrame([], "gid long, rank double")
    if not listed:
        return none
    ranges, known = ranges_of(spark, path, listed, wanted)
    if not all(known):
        return none
    total = living(read(spark, path, listed, "books"), gone).agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
    average = float(total.avg or 1.0)
    postings = living(of_ranges(spark, path, ranges, "postings", wanted), gone)
    names = [F.col(f"f{k}") for k in range(len(wanted))]
    best = lambda rows: rows.orderBy(F.round("rank", 9), "gid").limit(POOL)
    every = F.lit(True)
    for f in names:
        every = every & (f > 0)
    if gone is not None or any(len(k) > 1 for k in known):
        counted = staged(by_book(postings, wanted), "search-books")
        n = counted.agg(*[F.count(F.when(f > 0, 1)).alias(f"n{k}") for k, f in enumerate(names)]).first()
        weights = [weight(x, total.n) for x in n]
        return best(counted.filter(every).select("gid", scored(names, F.col("len"), weights, average).alias("rank")))
    weights = [weight(k[0][1], total.n) for k in known]
    bounds = block_bounds(of_ranges(spark, path, ranges, "blocks", wanted), wanted, weights, average)
    ranked = by_book(postings, wanted).filter(every).select("gid", scored(names, F.col("len"), weights, average).alias("rank"))
    block = F.floor(F.col("gid") / BLOCK)
    first = [r.block for r in bounds.orderBy("bound", "block").limit(FIRST).collect()]
    some = best(by_book(postings.filter(block.isin(first)), wanted).filter(every).select("gid", scored(names, F.col("len"), weights, average).alias("rank"))).collect()
    if len(some) < POOL:
        return best(ranked)
    able = bounds.filter(F.col("bound") <= some[-1].rank + 1e-8).select(F.col("block").alias("_block"))
    able = postings.join(able, block == F.col("_block"), "left_semi")
    return best(by_book(able, wanted).filter(every).select("gid", scored(names, F.col("len"), weights, average).alias("rank")))


def block_bounds(blocks: DataFrame, wanted: list[str], weights: list[float], average: float) -> DataFrame:
    """(block, bound): the best rank that a book of the block can have, for blocks that have all the words."""
    met = blocks.groupBy("block").agg(F.min("len").alias("len"), *[F.max(F.when(beginning(w), F.col("tf"))).alias(f"f{k}") for k, w in enumerate(wanted)])
    met = met.dropna(subset=[f"f{k}" for k in range(len(wanted))])
    return met.select("block", scored([F.col(f"f{k}") for k in range(len(wanted))], F.col("len"), weights, average).alias("bound"))
