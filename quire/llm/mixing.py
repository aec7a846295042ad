"""Mixing sources to target weights by capped water-filling. Native: DataFrame functions only.

A source's size is the sum of its documents' words. Weights share out a budget of words (all
words, unless another is given). A target over CAP times its source's size is clamped there,
and what it leaves is shared again by weight among the others, until no target is above its
cap: each round is one aggregation over the table of sources, whose three sums come back.

Then each source is repeated target / size times: whole repetitions of all its documents, and
a fractional one, for which whole documents are drawn in a seeded order. The order is that of
36 bits of a digest of seed, id and size. The key up to which the documents fit into what
the whole repetitions leave is found digit by digit: a pass sums the words of each source by
the next twelve bits, put together in each task, and the pass after it looks into the one digit
in which the sum runs over. No source is sorted or gathered, however large it is. What is
left below the first document that doesn't fit is filled by two more searches, each among documents
not drawn yet that have at most half of what is left. So a source falls short of its target by less than
one document, as a rule by a few words, and never exceeds it.

Defined results. Null texts have no words and are never drawn. A null source is a source of its
own and comes last. Rows that agree in id, source and size stand together in the order, and are drawn all
or none; repeated rows are repeated documents. A source that weights don't name, or name with null or less
than 0, weighs 0 and has target 0; weights named twice add up. If all that weigh are at their
caps the rest of the budget stays unused. An empty table gives no rows. Other columns are kept as they are;
the results are one struct column whose name gets a number if it is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.staging import discard, fresh, staged

CAP, SEED = 3, 17
#: An order key has LEVELS digits of BITS bits.
BITS, LEVELS = 12, 3
LAST_KEY = (1 << BITS * LEVELS) - 1
#: Searches for documents to draw; all but the first take documents of at most this part of what is left.
SEARCHES, SMALL = 3, 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(doc_id: Column, size: Column, seed: int = SEED) -> Column:
    """36 bits of a digest, as a whole number."""
    told = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(told), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources (a row for each source) with its place, from 0, in order of code points, null last.

    Sorted in ranges; a row's place is that in its range and the number of rows in ranges before.
    """
    held = staged(sources.sort(F.asc_nulls_last("source")).withColumn("_at", F.monotonically_increasing_id()), "mixing-ranks")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, total = [], 0  # as many as the sort had tasks
    for r in held.groupBy(part.alias("part")).count().orderBy("part").collect():
        before += [total] * (r.part + 1 - len(before))
        total += r["count"]
    start = F.element_at(F.array(*[F.lit(n).cast("long") for n in before or [0]]), part.cast("int") + 1)
    return held.withColumn("place", start + inside).drop("_at")


def cyclic_weights(sources: DataFrame, cycle=(1, 2, 3)) -> DataFrame:
    """(source, weight): the weights of cycle, again and again, for sources in order of code points."""
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("place") % len(cycle)).cast("int") + 1)
    return ranked(sources.select("source")).select("source", weight.alias("weight"))


def water_level(sources: DataFrame, budget: float, cap: int = CAP) -> float:
    """Words for each unit of weight, such that least(cap * size, level * weight) share out the budget (sources: size, weight)."""
    level, clamped = 0.0, -1
    while True:
        full = (F.col("weight") > 0) & (cap * F.col("size") <= F.lit(level) * F.col("weight")) & F.lit(clamped >= 0)
        r = sources.agg(
            F.sum(F.when(full, cap * F.col("size")).otherwise(0)).alias("capped"), F.sum(F.when(~full, F.col("weight")).otherwise(0)).alias("weight"), F.count_if(full).alias("n"),
        ).first()
        if r.n == clamped or not r.weight:
            return level
        level, clamped = (budget - r.capped) / r.weight, r.n


def filled(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """budgets (source, budget) with upto, the largest key such that the rows (source, size, key) of keys up to it fit, and their sum, mass.

    upto is -1 if not even those of the first key fit.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("mass"), F.lit(0).cast("long").alias("head"), F.lit(False).alias("whole"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        digit = F.shiftright("key", shift)
        inside = rows
        if level:
            told = state.filter("NOT whole").select(F.col("source").alias("_s"), F.col("head").alias("_head"))
            inside = rows.join(told, rows.source.eqNullSafe(told["_s"]) & (F.shiftright("key", shift + BITS) == told["_head"]))
        sums = inside.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("n"))
        old = state.select(F.col("source").alias("_s"), "budget", "mass", F.col("whole").alias("_whole"))
        running = F.sum("n").over(Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        met = sums.withColumn("run", running).join(old, sums.source.eqNullSafe(old["_s"]))
        over = F.col("mass") + F.col("run") > F.col("budget")
        found = met.groupBy("source").agg(
            F.min(F.when(over, F.col("digit"))).alias("digit"), F.coalesce(F.max(F.when(~over, F.col("run"))), F.lit(0)).alias("more")
        ).withColumnRenamed("source", "_s")
        after = state.join(found, state.source.eqNullSafe(found["_s"]), "left")
        # Where no digit runs over, all rows fit: there are no more digits to look into.
        whole = F.col("whole") | F.col("digit").isNull()
        state = staged(
            after.select("source", "budget", (F.col("mass") + F.coalesce("more", F.lit(0))).alias("mass"), F.coalesce("digit", F.lit(0)).alias("head"), whole.alias("whole")),
            "mixing-digits",
        )
    return state.select("source", "budget", "mass", F.when(F.col("whole"), LAST_KEY).otherwise(F.col("head") - 1).alias("upto"))


def plan(rows: DataFrame, weights: DataFrame | None = None, budget: float | None = None, cap: int = CAP) -> DataFrame:
    """A row for each source of rows (source, size, key): source, source_size, target, whole (repetitions of all) and what is drawn besides.

    Search k draws, of the documents not drawn before, those of keys up to upto_k and of at most small_k words.
    """
    sizes = staged(rows.groupBy("source").agg(F.sum("size").alias("size")), "mixing-sources")
    weights = cyclic_weights(sizes) if weights is None else weights
    told = weights.groupBy(F.col("source").alias("_s")).agg(F.sum(F.greatest("weight", F.lit(0))).alias("weight"))
    sources = staged(sizes.join(told, sizes.source.eqNullSafe(told["_s"]), "left").select("source", "size", F.coalesce("weight", F.lit(0)).alias("weight")), "mixing-weights")
    budget = (sources.agg(F.sum("size")).first()[0] or 0) if budget is None else budget
    level = water_level(sources, budget, cap)
    target = F.least((cap * F.col("size")).cast("double"), F.lit(float(level)) * F.col("weight"))
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    targets = sources.withColumn("target", target).withColumn("whole", whole)
    targets = staged(targets.withColumn("budget", F.col("target") - F.col("whole") * F.col("size")), "mixing-targets")
    found = targets.select("source", F.col("size").alias("source_size"), "target", "whole", F.col("budget").alias("rest"))
    for k in range(SEARCHES):
        small = F.col("rest") / SMALL if k else F.col("source_size").cast("double")
        found = staged(found.withColumn(f"small_{k}", small), "mixing-search")
        open_ = rows
        if k:
            limits = found.withColumnRenamed("source", "_s")
            open_ = rows.join(limits, rows.source.eqNullSafe(limits["_s"])).filter(~drawn_before(k) & (F.col("size") <= F.col(f"small_{k}")))
        upto = filled(open_.select("source", "size", "key"), found.select("source", F.col("rest").alias("budget")))
        upto = upto.select(F.col("source").alias("_s"), F.col("upto").alias(f"upto_{k}"), "mass")
        found = found.join(upto, found.source.eqNullSafe(upto["_s"])).withColumn("rest", F.col("rest") - F.col("mass")).drop("_s", "mass")
    return staged(found.drop("rest"), "mixing-plan")


def drawn_before(k: int) -> Column:
    """Whether one of the first k searches draws the row."""
    found = F.lit(False)
    for i in range(k):
        found |= (F.col("size") <= F.col(f"small_{i}")) & (F.col("key") <= F.col(f"upto_{i}"))
    return found


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """The narrow rows (source, size, key) of documents."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    return rows.select("id", "source", "size", order_key(F.col("id"), F.col("size"), seed).alias("key"))


def drawn(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (source, size, key, others) with source_size, target, repeats and taken."""
    found = found.withColumnRenamed("source", "_s")
    repeats = F.when(F.col("size") > 0, F.col("whole") + drawn_before(SEARCHES).cast("long")).otherwise(0)
    met = rows.join(found, rows.source.eqNullSafe(found["_s"])).withColumn("repeats", repeats)
    return met.select(*rows.columns, "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def mix(
    docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None, cap: int = CAP, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", name: str = "mix",
) -> tuple[DataFrame, str]:
    """The documents with a struct size, source_size, target, repeats, taken; and the struct's name.

    weights: (source, weight); without it the weights 1, 2, 3 in turn. A document is to be taken repeats times.
    """
    name = fresh(docs.columns, name)
    rows = staged(measured(docs, id_col, text_col, source_col, seed), "mixing-rows")
    found = plan(rows, weights, budget, cap)
    # A document's key is worked out anew, so texts go past the plan once and no row is looked up by its id.
    size = n_words(F.col(text_col))
    held = docs.select(F.struct("*").alias("doc"), F.col(source_col).alias("source"), size.alias("size"), order_key(F.col(id_col), size, seed).alias("key"))
    out = drawn(held, found)
    discard(rows)
    struct = F.struct("size", "source_size", "target", "repeats", "taken").alias(name)
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns], struct), name


def op13_mixing(spark, sf_dir: str) -> DataFrame:
    from quire.plans.tables import table

    rows = staged(measured(table(spark, sf_dir, "documents"), "doc_id", "text", "source", SEED), "mixing-rows")
    return drawn(rows, plan(rows)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
