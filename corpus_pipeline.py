"""The corpus pipeline: language ID, quality rules, near-dedup, decontamination, packing.

STAGES lists (name, function). A function takes (spark, docs, sf_dir), where docs is what
its predecessor kept with the columns of documents, and returns a DataFrame. All stages but
the last return the columns of documents, extra ones included; the last returns a row for
each piece of a document: doc_id, piece, start, length, shard, bin, offset.

run() writes each stage's rows to the shared folder and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, langid, packing, quality, simhash
from quire.plans.staging import discard, fresh, staged
from quire.plans.tables import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified, learned from the labelled rows of docs that may be learned from.

    Rejected (``und``): texts that are null or have no letter, and texts of whose three-letter
    n-grams too few are known in the best language (langid.LEAST_KNOWN).
    """
    model = langid.train(docs, may_learn=~langid.held_out("doc_id", 4, 2))
    found, at = langid.identify(docs, model, least_known=langid.LEAST_KNOWN)
    return found.filter(F.col(at).lang != "und").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and the divergence tests against all documents of their language.

    Null and empty texts fail a base rule. A null language has no common words to be held against.
    Whole texts are counted; repeated rows are judged alike and each kept or dropped.
    """
    found, at = quality.judge(docs)
    return found.filter(F.col(at).kept).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group (three-word shingles, two bits): the least doc_id, null ids last.

    Rows, not ids, are kept or dropped: an id may stand in several rows, each in the group of its own
    text. Of rows with a group's least id that with the least hash of all its columns stays; of rows
    that agree in every column, one. Null and empty texts are one group, that of fingerprint zero.
    """
    id_at, text_at, key_at = (fresh(docs.columns, c) for c in ("_dedup_id", "_dedup_text", "_dedup_key"))
    hashed = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    key = F.xxhash64(*hashed)
    rows = docs.select(F.col("doc_id").alias(id_at), F.col("text").alias(text_at), key.alias(key_at))
    groups = staged(simhash.near_duplicates(rows, id_at, text_at, keep=(key_at,)), "dedup-groups")
    counted = groups.groupBy("root", "id", key_at).agg(F.count("*").alias("n"))
    head = F.min(F.struct(F.col("id").isNull().alias("none"), "id", key_at, "n")).alias("head")
    heads = staged(counted.groupBy("root").agg(head).select("head.*"), "dedup-heads")
    # Texts meet the verdicts by one shuffle at any size; a broadcast of the verdicts would grow with the table.
    n_at = fresh(docs.columns, "_dedup_n")
    verdicts = heads.select(F.col("id").alias(id_at), F.col(key_at).alias(f"{key_at}_"), F.col("n").alias(n_at)).hint("merge")
    keyed = docs.withColumn(key_at, key)
    met = (keyed.doc_id.eqNullSafe(verdicts[id_at])) & (keyed[key_at] == verdicts[f"{key_at}_"])
    kept = keyed.join(verdicts, met).select(*docs.columns, n_at, f"{key_at}_")
    once = kept.filter(F.col(n_at) == 1)
    if heads.filter("n > 1").isEmpty():
        return once.select(*docs.columns)
    # Rows that agree in every column: any of them is the same row.
    repeated = kept.filter(F.col(n_at) > 1).dropDuplicates([f"{key_at}_"])
    return once.unionByName(repeated).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not contaminated by the benchmark (a twentieth of their words in its windows).

    Null and empty texts have no words and stay. Whole texts are searched, in shards that overlap.
    Repeated rows are judged one by one; an empty benchmark drops nothing.
    """
    found, at = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col(at).contaminated).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the UTF-8 bytes of all documents; near-duplicates are gone, so a cluster is a text's words in lower case.

    Null and empty texts take a place of length 0; very long ones are cut into full sequences and a
    rest; repeated rows are packed one by one, in different sequences; null ids are packed like others.
    """
    return packing.pack_documents(docs, near=False)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
