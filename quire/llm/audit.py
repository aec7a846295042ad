"""Filter interaction audit: a direct replay of five filters in all their 120 orders.

A document's flags tell which filters it fails: A short, B repetitive, C loud, D with markup
signs, E a copy of a text with a smaller id anywhere in the table. Flags A to D come from one
pass over the text and stay on its row with a digest of it; texts are not shuffled.
Copies of one text that also agree in part and labels are put together before E is told, so a
group of copies of any size is a few counted rows and the least id of a text meets only those.

The replay crosses each such row with the broadcast table of the 120 orders, finds the first
filter in the order that the row fails, takes the order apart into its five steps, and sums
conditions on the first failure by part, order and step, first in each task. The sums have
600 rows for each part, whatever the size of the table.

Defined results. A null text is the empty one, without words: it fails A, and E like any other
copy. A null lang is the part of the empty string. A null id is no smaller than any and has
none smaller. Repeated rows are counted each; rows of one id and text are no copies of each other. A
document is good (toxic) if any of its labels says so. Without documents there are no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.columns import settled

FILTERS = "ABCDE"
MIN_WORDS = 100
SPACE = " \t\n\u000b\f\r"
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, digest of the text and flags (a bit each, in the order of FILTERS) of A to D."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = settled(
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text")),
        words=F.filter(F.split(F.translate("text", SPACE, " " * len(SPACE)), " "), lambda w: w != ""),
    )
    n, distinct, chars = F.size("words"), F.size(F.array_distinct("words")), F.length("text")
    capitals = chars - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = {
        "A": n < MIN_WORDS,
        "B": 100 * distinct < 80 * n,
        "C": 100 * capitals.cast("long") > 10 * chars,
        "D": F.length(F.translate("text", "#$%&*|", "")) < chars,
    }
    flags = sum(((F.when(c, bit(k)).otherwise(0)) for k, c in fails.items()), F.lit(0))
    return rows.select("id", "part", F.sha2("text", 256).alias("digest"), flags.alias("flags"))


def counted(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, flags with E, good, toxic and n: how many documents with one text are alike in these.

    The first grouping keeps the dealing of the join by id; from there on a text's copies are few rows.
    """
    told = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    known = rows.join(told, "id", "left")
    alike = ("digest", "part", "flags", "good", "toxic")
    key = [F.coalesce(c, F.lit(False)).alias(c) if c in ("good", "toxic") else F.col(c) for c in alike]
    each = known.groupBy("id", *key).agg(F.count("*").alias("n"))
    # Of rows that are alike, those of the least id, and those of none, may stand; all others have a smaller id above them.
    groups = each.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless")
    )
    texts = groups.groupBy("digest").agg(F.min("least.id").alias("first"), F.collect_list(F.struct(*alike[1:], "n", "least", "nameless")).alias("groups"))
    each = texts.select("first", F.inline("groups"))
    stays = F.col("nameless") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = F.array(
        F.struct(F.col("flags").alias("flags"), stays.alias("n")), F.struct((F.col("flags") + bit("E")).alias("flags"), (F.col("n") - stays).alias("n"))
    )
    return each.select("part", "good", "toxic", F.inline(split)).filter("n > 0")


def orders(spark: SparkSession) -> DataFrame:
    """All orders of the filters: filter_order and steps, an array of step, filter and bit."""
    rows = [(o, [(k + 1, c, bit(c)) for k, c in enumerate(o)]) for o in map("".join, permutations(FILTERS))]
    return spark.createDataFrame(rows, "filter_order string, steps array<struct<step int, filter string, bit int>>").coalesce(1)


def replay(rows: DataFrame) -> DataFrame:
    """Measures by part, order and step of rows (part, flags, good, toxic, n)."""
    crossed = rows.crossJoin(F.broadcast(orders(rows.sparkSession)))
    failing = F.transform(F.filter("steps", lambda s: s.bit.bitwiseAND(F.col("flags")) != 0), lambda s: s.step)
    each = crossed.withColumn("first", F.coalesce(F.get(failing, F.lit(0)), F.lit(len(FILTERS) + 1)))
    each = each.select("part", "flags", "good", "toxic", "n", "filter_order", "first", F.inline("steps"))
    here = F.col("first") == F.col("step")
    when = {
        "kept": F.col("first") > F.col("step"),
        "removed": here,
        "redundant": (F.col("first") < F.col("step")) & (F.col("flags").bitwiseAND(F.col("bit")) != 0),
        "unique_fails": F.col("flags") == F.col("bit"),
        "good_lost": here & F.col("good"),
        "toxic_lost": here & F.col("toxic"),
    }
    return each.groupBy("part", "filter_order", "step", "filter").agg(*[F.sum(F.when(when[m], F.col("n")).otherwise(0)).alias(m) for m in MEASURES])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, the measures, and shapley: what the step's filter removes, summed over all orders at any step."""
    sums = replay(counted(flagged(docs, id_col, text_col, part_col), labels, id_col))
    by_part = sums.groupBy("part").agg(
        F.collect_list(F.struct("filter_order", "step", "filter", *MEASURES)).alias("rows"),
        *[F.sum(F.when(F.col("filter") == c, F.col("removed")).otherwise(0)).alias(f"_{c}") for c in FILTERS],
    )
    credit = F.element_at(F.create_map(*[x for c in FILTERS for x in (F.lit(c), F.col(f"_{c}"))]), F.col("filter"))
    return by_part.select("part", *[f"_{c}" for c in FILTERS], F.inline("rows")).select("part", "filter_order", "step", *MEASURES, credit.alias("shapley"))


def op12_audit(spark, sf_dir: str) -> DataFrame:
    from quire.plans.tables import table

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
