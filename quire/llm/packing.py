"""Best-fit packing of documents into sequences of equal capacity, under conflicts.

A document longer than a sequence is cut into pieces: full sequences of its own and a rest.
Pieces are packed by best fit in order of falling length. Bins are kept in order of what
is left in them; a bin carries one bitmap of the sources that are full in it and one of the
duplicate clusters in it. A piece goes into the tightest bin that holds it and conflicts with
neither: the search starts at the least sufficient rest and steps to the next bin until one
is compatible; if none is, a new bin is opened. So a bin holds at most one piece of a
duplicate cluster and at most PER_SOURCE pieces of one source.

Pieces are numbered as they are read and dealt by a hash of that number to shards of about
SHARD pieces; each shard is packed by one task; texts do not move. A source or cluster that
holds a third of all rows is spread evenly over the shards, and so are rows of null or equal id.

Defined results. Null and empty texts have length 0 and take a place like others. A null
source or cluster conflicts with nothing. Equal lengths go by id, then by piece; repeated
rows are packed one by one. Null ids come last. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.simhash import near_duplicates
from quire.plans.staging import staged

CAPACITY, PER_SOURCE, SHARD = 16_384, 4, 4_096


def best_fit(pieces: list[tuple[int, object, object]], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, offset) of every piece (length, source, cluster), which are given in packing order."""
    bits: dict = {}
    rest: list[tuple[int, int]] = []  # (residual, bin), sorted
    full, clusters, counts = [], [], []
    out = []
    for length, source, cluster in pieces:
        s = 0 if source is None else 1 << bits.setdefault(("source", source), len(bits))
        c = 0 if cluster is None else 1 << bits.setdefault(("cluster", cluster), len(bits))
        at = bisect_left(rest, (length, -1))
        while at < len(rest) and (full[rest[at][1]] & s or clusters[rest[at][1]] & c):
            at += 1
        if at < len(rest):
            left, b = rest.pop(at)
        else:
            left, b = capacity, len(full)
            full.append(0)
            clusters.append(0)
            counts.append({})
        out.append((b, capacity - left))
        clusters[b] |= c
        n = counts[b][s] = counts[b].get(s, 0) + 1
        if s and n >= per_source:
            full[b] |= s
        insort(rest, (left - length, b))
    return out


def pack(
    docs: DataFrame, id_col: str = "doc_id", length_col: str = "length", source_col: str = "source", cluster_col: str = "cluster",
    capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD,
) -> DataFrame:
    """One row per piece: id, piece, start (in the document), length, shard, bin, offset (in the bin).

    A bin is named by shard and bin together.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("total"),
        F.col(source_col).alias("source"),
        F.col(cluster_col).alias("cluster"),
    )
    each = rows.select("*", F.posexplode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0)))).alias("piece", "_k"))
    start = F.col("piece").cast("long") * capacity
    each = each.select("id", "piece", start.alias("start"), F.least(F.col("total") - start, F.lit(capacity)).alias("length"), "source", "cluster")
    n_shards = max(1, -(-each.count() // shard))
    # The number tells apart rows that agree in all columns; a task that runs again gives the same numbers.
    dealt = each.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "id", "piece"), F.lit(n_shards)))
    fields = [T.StructField("id", docs.schema[id_col].dataType)] + [
        T.StructField(c, t) for c, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("shard", T.LongType()), ("bin", T.LongType()), ("offset", T.LongType()))
    ]

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        places = best_fit(list(zip(*(part.column(c).to_pylist() for c in ("length", "source", "cluster")), strict=True)), capacity, per_source)
        for k, c in enumerate(("bin", "offset")):
            part = part.append_column(c, pa.array([p[k] for p in places], pa.int64()))
        return part.select([f.name for f in fields])

    return dealt.groupBy("shard").applyInArrow(run, T.StructType(fields))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", near: bool = True) -> DataFrame:
    """Pack texts by their UTF-8 bytes.

    A duplicate cluster is a group of simhash.near_duplicates over the lower-cased texts, which has all exact
    copies too; a null text is in none. With near=False, for texts whose near copies are gone, it is a text
    after case and white space are levelled.
    """
    if near:
        rows = docs.select(
            F.col(id_col).alias("id"), F.octet_length(text_col).alias("length"), F.col(source_col).alias("source"), F.lower(text_col).alias("text")
        )
        # The columns go along with the fingerprints, so that ids that are null or repeated need no join.
        groups = near_duplicates(rows, "id", "text", keep=("length", "source"))
        clustered = groups.select("id", "length", "source", F.when(F.col("length").isNotNull(), F.col("root")).alias("cluster"))
        return pack(staged(clustered, "packing"), id_col="id").withColumnRenamed("id", id_col)
    flat = F.trim(F.regexp_replace(F.lower(text_col), r"[\x20\x09-\x0D]+", " "))
    narrow = docs.select(
        F.col(id_col).alias("id"), F.octet_length(text_col).alias("length"),
        F.col(source_col).alias("source"), F.when(F.col(text_col).isNotNull(), F.xxhash64(flat)).alias("cluster"),
    )
    return pack(narrow, id_col="id").withColumnRenamed("id", id_col)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    from quire.plans.tables import table

    return pack_documents(table(spark, sf_dir, "documents"))
