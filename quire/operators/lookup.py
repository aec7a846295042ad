"""Dictionary look-ups that read through a published cache: what it lacks is asked for once, hits and misses are written back.

The cache is a store (``quire.sources.sinks``) of rows (key, word, lang, provider, payload, fetched_at); a null payload is
a known miss. Words are looked up spelling by spelling, all words at a time: a round joins the spellings
that are next with the cache, asks for the distinct ones that it has not got or that are too old,
and puts the winners of the race back in one version. Words that are a mere form of another go a second
time, for their base words only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators.state import SENSES, base_word, entry, fresh_entries, race
from quire.plans.staging import staged
from quire.sources import sinks

CACHE = "key string, word string, lang string, provider string, payload string, fetched_at double"
ENTRY = f"struct<phonetic:string,senses:{SENSES}>"
#: The provider asked first, the seconds after which the others are asked too, the longest word.
LEADER, HEDGE, LONGEST = "wiktionary", 0.7, 64
#: Most spellings of a word (text.spellings).
SPELLINGS = 8

Ask = Callable[[DataFrame], DataFrame]


def cached(spark: SparkSession, path: str) -> DataFrame:
    """The cache as it is now; an absent one is empty."""
    found = sinks.published(spark, path)
    return spark.createDataFrame([], CACHE) if found is None else found.select(*[c.split(" ")[0] for c in CACHE.split(", ")])


def read_through(wanted: DataFrame, path: str, ask: Ask, now: float, leader: str = LEADER, hedge: float = HEDGE) -> DataFrame:
    """(word, lang, provider, payload, cached) of distinct words (word, lang); payload is an entry as JSON, null where nobody has one.

    ask gives for words (word, lang) the answers of providers (word, lang, provider, payload, took), their own JSON.
    An answer without a sense is a miss; words without an answer are one too.
    """
    spark = wanted.sparkSession
    known = fresh_entries(cached(spark, path), now).select("word", "lang", "provider", "payload")
    have = staged(wanted.join(known, ["word", "lang"], "inner"), "lookup-known")
    missing = staged(wanted.join(have, ["word", "lang"], "left_anti"), "lookup-missing")
    told = have.withColumn("cached", F.lit(True))
    if missing.isEmpty():
        return told
    read = F.to_json(entry(F.col("payload"), F.col("provider"), F.col("word"), F.col("lang")))
    won = race(ask(missing).withColumn("payload", read), ["word", "lang"], leader, hedge)
    new = staged(missing.join(won.select("word", "lang", "provider", "payload"), ["word", "lang"], "left"), "lookup-new")
    key = F.concat_ws(":", "lang", "word")
    sinks.replace_documents(new.select(key.alias("key"), "*", F.lit(float(now)).alias("fetched_at")), path, key="key")
    return told.unionByName(new.withColumn("cached", F.lit(False)))


def first_spelling(words: DataFrame, path: str, ask: Ask, now: float, **race_) -> DataFrame:
    """(word, lang, spelling, provider, payload, cached): the first spelling of each word (word, lang) that anyone knows; later ones are not asked for."""
    tried = F.when(F.col("lang") == "en", X.spellings(F.col("word"))).otherwise(F.array("word"))
    left, found = staged(words.select("word", "lang", tried.alias("tried")), "lookup-open"), None
    for k in range(SPELLINGS):
        rows = left.filter(F.size("tried") > k).withColumn("spelling", F.get("tried", F.lit(k)))
        if rows.isEmpty():
            break
        looked = read_through(rows.select(F.col("spelling").alias("word"), "lang").distinct(), path, ask, now, **race_)
        hits = looked.filter("payload IS NOT NULL").withColumnRenamed("word", "spelling")
        hits = staged(rows.join(hits, ["spelling", "lang"]).select("word", "lang", "spelling", "provider", "payload", "cached"), "lookup-hits")
        found = hits if found is None else found.unionByName(hits)
        left = staged(left.join(hits, ["word", "lang"], "left_anti"), "lookup-open")
    none = words.sparkSession.createDataFrame([], "word string, lang string, spelling string, provider string, payload string, cached boolean")
    return none if found is None else found


def define(requests: DataFrame, path: str, ask: Ask, now: float, **race_) -> DataFrame:
    """requests (word, lang, others) with found, form_of, provider, phonetic, senses, cached; null where nobody has an entry.

    A null language is English, others count by their first two letters. Empty and very long words are not asked for.
    Where a word is a mere inflection its base word's entry is given, one hop on, and form_of is the inflection; an
    inflection whose base has none stays itself.
    """
    level = F.substring(F.lower(F.coalesce("lang", F.lit("en"))), 1, 2)
    asked = requests.withColumns({"_word": X.normal_word(F.col("word")), "_lang": level})
    words = asked.filter((F.length("_word") > 0) & (F.length("_word") <= LONGEST)).select(F.col("_word").alias("word"), F.col("_lang").alias("lang")).distinct()
    read = F.from_json("payload", ENTRY)
    first = first_spelling(words, path, ask, now, **race_).withColumn("e", read)
    first = staged(first.withColumn("base", base_word(F.transform("e.senses", lambda s: s.definition))), "lookup-first")
    follow = first.filter("base IS NOT NULL AND base <> spelling")
    hop = first_spelling(follow.select(F.col("base").alias("word"), "lang").distinct(), path, ask, now, **race_).withColumn("e", read)
    hop = hop.select(F.col("word").alias("base"), "lang", *[F.col(c).alias(f"_{c}") for c in ("spelling", "provider", "cached", "e")])
    d = first.join(hop, ["base", "lang"], "left")
    moved = F.col("_spelling").isNotNull() & (F.col("base") != F.col("spelling"))
    pick = lambda c: F.when(moved, F.col(f"_{c}")).otherwise(F.col(c))
    d = d.select(
        F.col("word").alias("_word"), F.col("lang").alias("_lang"), pick("spelling").alias("found"), F.when(moved, F.col("spelling")).alias("form_of"),
        pick("provider").alias("provider"), pick("e").alias("_entry"), pick("cached").alias("cached"),
    )
    out = asked.join(d, ["_word", "_lang"], "left")
    return out.select(*requests.columns, "found", "form_of", "provider", F.col("_entry.phonetic").alias("phonetic"), F.col("_entry.senses").alias("senses"), "cached")
