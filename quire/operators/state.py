"""Keyed state in batch form: a limiter, caches that age, races of providers, settings, dictionary look-ups."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Frame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as X

HIT_SECONDS, MISS_SECONDS = 90 * 86_400, 86_400
LIMIT, WINDOW_SECONDS = 30, 600.0


class Window:
    """Times of admitted events of one key; at most ``limit`` of them are held."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds, self.times = limit, seconds, deque()

    def admit(self, t: float) -> bool:
        while self.times and t - self.times[0] > self.seconds:
            self.times.popleft()
        if len(self.times) < self.limit:
            self.times.append(t)
            return True
        return False


def busy_runs(attempts: DataFrame, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """attempts (key, t, seq) with run: numbers of a key's stretches that lie more than a window apart, rising with time.

    Before a run nothing that was admitted counts any more, so runs can be judged each for itself. Times are put in
    cells of a window's length; within a cell no two are a window apart, so runs begin at
    cells, and only their first and last times, summed up in each task, meet by key.
    """
    rows = attempts.select("key", F.col("t").cast("double").alias("t"), "seq").withColumn("cell", F.floor(F.col("t") / float(seconds)))
    cells = rows.groupBy("key", "cell").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    by = Frame.partitionBy("key").orderBy("cell")
    apart = (F.col("first") - F.lag("last").over(by) > float(seconds)).cast("long")
    told = cells.withColumn("apart", F.coalesce(apart, F.lit(0).cast("long"))).withColumn("run", F.sum("apart").over(by))
    told = told.select(F.col("key").alias("_key"), F.col("cell").alias("_cell"), "run")
    met = rows.key.eqNullSafe(told["_key"]) & rows.cell.eqNullSafe(told["_cell"])
    return rows.join(told, met).select("key", "t", "seq", "run")


def admitted(attempts: DataFrame, limit: int = LIMIT, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """attempts (key, t, seq) with ok: whether fewer than limit admitted events of the key lie in the window before.

    Refused attempts are not counted, so admission depends on earlier admissions, but not over a
    gap longer than the window. Rows are dealt by key and busy run and sorted; a task reads them as a stream and holds one
    window, so a key of any size is shared out among tasks and needs little memory.
    """
    rows = busy_runs(attempts, seconds)

    def run(batches):
        key, window = object(), None
        for batch in batches:
            ok = []
            for k, r, t in zip(*(batch.column(c).to_pylist() for c in ("key", "run", "t")), strict=True):
                if (k, r) != key:
                    key, window = (k, r), Window(limit, seconds)
                ok.append(window.admit(t))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "t", "seq")), pa.array(ok, pa.bool_())], names=["key", "t", "seq", "ok"])

    dealt = rows.repartition("key", "run").sortWithinPartitions("key", "run", "t", "seq")
    return dealt.mapInArrow(run, T.StructType([*rows.schema.fields[:3], T.StructField("ok", T.BooleanType())]))


def fresh_entries(entries: DataFrame, now: float) -> DataFrame:
    """Cache entries (payload, fetched_at) that may still be used: a hit for 90 days, a known miss (null payload) for one day."""
    age = F.lit(float(now)) - F.col("fetched_at")
    return entries.filter(F.when(F.col("payload").isNull(), age < MISS_SECONDS).otherwise(age <= HIT_SECONDS))


def race(answers: DataFrame, keys: list[str], leader: str, hedge: float) -> DataFrame:
    """The winning answer of each key: (provider, payload, at).

    The leader starts at 0, the others after hedge seconds, or when the leader misses if that is
    sooner; the first answer that is not null wins; ties go by provider. took: seconds to answer.
    """
    lead = answers.filter(F.col("provider") == leader).groupBy(*keys).agg(F.min(F.when(F.col("payload").isNull(), F.col("took"))).alias("missed"))
    a = answers.join(lead, keys, "left")
    start = F.when(F.col("provider") == leader, 0.0).otherwise(F.least(F.lit(float(hedge)), F.coalesce("missed", F.lit(float(hedge)))))
    a = a.withColumn("at", start + F.col("took")).filter("payload is not null")
    best = a.groupBy(*keys).agg(F.min_by(F.struct("provider", "payload", "at"), F.struct("at", "provider")).alias("r"))
    return best.select(*keys, "r.*")


def coalesced(requests: DataFrame, keys: list[str], work) -> DataFrame:
    """Requests joined with work(distinct keys): equal requests share one piece of work."""
    return requests.join(work(requests.select(*keys).distinct()), keys, "left")


# What may be set, with type and default; preferences that follow a reader; bounds of reading numbers.
KNOBS = {
    "catalog_full": ("boolean", "false"),
    "dict_providers": ("string", "wiktionary,datamuse,dictionaryapi"),
    "dict_timeout_s": ("double", "3.0"),
    "dict_hedge_ms": ("int", "700"),
    "translate_enabled": ("boolean", "true"),
    "translate_timeout_s": ("double", "4.0"),
}
PREFERENCES = ("voice", "voices", "speed", "theme")
NUMBERS = {"speed": (1.0, 0.5, 3.0), "rate": (1.0, 0.5, 2.0)}


def number(stored: Column) -> Column:
    """A number written as JSON; null for anything else."""
    return F.when(F.trim(stored).rlike(r"^-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?$"), F.trim(stored).try_cast("double"))


def setting(stored: Column, name: str) -> Column:
    """A number stored as JSON text, its default where null or corrupt, inside its bounds."""
    default, low, high = NUMBERS[name]
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(number(stored), F.lit(default))))


def coerced(value: Column, kind: str) -> Column:
    """JSON text as the text of a knob of a kind; null for null (a reset) and for what cannot be one."""
    bare = F.nullif(F.trim(value), F.lit("null"))
    string = F.when(bare.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), bare, F.lit("}")), "$.v")).otherwise(bare)
    truth = ~(bare.isin("false", '""', "[]", "{}") | F.coalesce(number(bare) == 0, F.lit(False)))
    return {
        "boolean": F.when(bare.isNotNull(), truth.cast("string")),
        "int": F.coalesce(number(string), F.when(bare == "true", 1.0).when(bare == "false", 0.0)).cast("long").cast("string"),
        "double": F.coalesce(number(string), F.when(bare == "true", 1.0).when(bare == "false", 0.0)).cast("string"),
        "string": string,
    }[kind]


def knobs_after(patches: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(settings, rejected) of patches (keys, key, value as JSON, seq): every knob of everyone (keys) with its value as text, and patches of unknown knobs.

    The last patch of a knob counts; null resets it to its default. A patch of an unknown knob changes nothing.
    """
    who = keys or []
    known = F.col("key").isin(*KNOBS)
    text = F.when(F.lit(False), "")
    for name, (kind, _) in KNOBS.items():
        text = text.when(F.col("key") == name, coerced(F.col("value"), kind))
    last = patches.filter(known).withColumn("_v", text).groupBy(*who, "key").agg(F.max_by(F.struct(F.col("_v").alias("v")), "seq").alias("_r"))
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(d).alias("default")) for k, (_, d) in KNOBS.items()])).alias("k")
    owners = patches.select(*who).distinct() if who else patches.sparkSession.range(1)
    full = owners.select(*who, every).select(*who, "k.key", "k.default").join(last, [*who, "key"], "left")
    return full.select(*who, "key", F.coalesce(F.col("_r.v"), "default").alias("value")), patches.filter(~F.coalesce(known, F.lit(False)))


def preferences(patches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, prefs): the map of preferences that are set, as JSON; a null or JSON null takes one away; other keys are not read."""
    mine = patches.filter(F.col("key").isin(*PREFERENCES)).groupBy(*keys, "key").agg(F.max_by(F.struct("value"), "seq").alias("r"))
    there = mine.filter("r.value is not null and trim(r.value) <> 'null'")
    return there.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "r.value")))).alias("prefs"))


def reading_defaults(prefs: Column, voice: str = "af_heart", speed: float = 1.0) -> Column:
    """(voice, speed) that a document is read with where nothing of its own says otherwise."""
    said = coerced(F.try_element_at(prefs, F.lit("voice")), "string")
    fast = F.nullif(number(F.try_element_at(prefs, F.lit("speed"))), F.lit(0.0))
    return F.struct(F.coalesce(F.nullif(said, F.lit("")), F.lit(voice)).alias("voice"), F.coalesce(fast, F.lit(speed)).alias("speed"))


def first_found(words: DataFrame, cache: DataFrame) -> DataFrame:
    """(word, spelling, payload): the first spelling of each word that the cache knows with a payload."""
    tried = words.select("word", F.posexplode(X.spellings(X.normal_word(F.col("word")))).alias("pos", "spelling"))
    have = cache.filter("payload is not null").select(F.col("word").alias("spelling"), "payload")
    found = tried.join(have, "spelling").groupBy("word").agg(F.min_by(F.struct("spelling", "payload"), "pos").alias("r"))
    return words.select("word").distinct().join(found.select("word", "r.*"), "word", "left")


# How a dictionary says that a word is a form of another.
INFLECTED = (
    r"(?i)^(?:(?:simple |past |present |third-person |first-person |second-person |singular |plural |comparative |superlative |indicative |subjunctive |imperative |participle "
    r"|form |tense |alternative |obsolete |archaic |dated |nonstandard |misspelling |spelling |inflection |and |of |the |a )*)"
    r"(?:participle|past|plural|form|spelling|inflection|present|singular|tense|comparative|superlative|misspelling)[^:;.]*? of ([A-Za-zÀ-ɏ'’-]{2,})\b"
)


def base_word(senses: Column) -> Column:
    """The word that all senses are an inflection of, by the first; null if any sense says something else."""
    bases = F.transform(senses, lambda s: F.lower(F.regexp_extract(s, INFLECTED, 1)))
    return F.when((F.size(bases) > 0) & F.forall(bases, lambda b: b != ""), F.get(bases, F.lit(0)))


def clean_sense(text: Column) -> Column:
    """A definition without tags, character references and runs of white space; an editor's placeholder is empty."""
    told = X.flat(X.unescaped(F.regexp_replace(text, r"<[^>]+>", "")))
    return X.bound(told, lambda t: F.when(t.rlike(r"(?i)\{\{|rfdef|needs a definition|This term needs"), "").otherwise(t))


SENSES = "array<struct<pos:string,definition:string,example:string>>"
# Parts of speech as one provider writes them.
PARTS = {"n": "noun", "v": "verb", "adj": "adjective", "adv": "adverb", "u": "", "prop": "proper noun"}


def entry(payload: Column, provider: Column, word: Column, lang: Column, most: int = 4) -> Column:
    """(phonetic, senses) of a provider's JSON answer; null where it has no sense that is one.

    One sense a part of speech or block, the first that is not empty, at most so many. One provider
    gives sections by language (the own one, else English, else the first); the others know English
    only, and one of them may answer with another word.
    """

    def first_of(pos: Column, listed: Column) -> Column:
        clean = F.transform(listed, lambda d: F.struct(pos.alias("pos"), clean_sense(d.definition).alias("definition"), clean_sense(d.example).alias("example")))
        return F.get(F.filter(clean, lambda d: d.definition != ""), F.lit(0))

    blocks = "array<struct<partOfSpeech:string,definitions:array<struct<definition:string,examples:array<string>,example:string>>>>"
    shown = lambda b: F.transform(b.definitions, lambda d: F.struct(d.definition.alias("definition"), F.coalesce(F.get(d.examples, F.lit(0)), d.example).alias("example")))
    by_block = lambda listed, low: F.filter(F.transform(listed, lambda b: first_of(F.lower(b.partOfSpeech) if low else b.partOfSpeech, shown(b))), lambda d: d.isNotNull())
    answer = lambda phonetic, senses: F.struct(phonetic.alias("phonetic"), F.slice(senses, 1, most).alias("senses"))
    silent = F.lit(None).cast("string")
    # Each provider's branch reads the payload once: what is read is bound, and so is what a lambda names often.

    def wiktionary(sections: Column) -> Column:
        of = lambda key: X.bound(F.try_element_at(sections, key), lambda s: F.when(F.size(s) > 0, s))
        return answer(silent, by_block(F.coalesce(of(lang), of(F.lit("en")), F.get(F.map_values(sections), F.lit(0))), True))

    def datamuse(pairs: Column) -> Column:
        short = lambda d: F.substring_index(d, "\t", 1)
        part = lambda d: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PARTS.items() for x in kv]), short(d)), short(d))
        told = F.filter(F.transform(pairs.defs, lambda d: F.struct(part(d).alias("pos"), clean_sense(F.regexp_extract(d, r"(?s)\t(.*)$", 1)).alias("definition"), silent.alias("example"))), lambda d: d.definition != "")
        once = X.bound(told, lambda t: F.filter(t, lambda d, i: ~F.exists(F.slice(t, F.lit(1), i), lambda e: e.pos == d.pos)))
        return F.when(F.lower(pairs.word) == word, answer(silent, once))

    def dictionaryapi(book: Column) -> Column:
        sounds = F.filter(F.transform(book.phonetics, lambda p: F.trim(p.text)), lambda t: t != "")
        return answer(F.coalesce(F.nullif(F.trim(book.phonetic), F.lit("")), F.get(sounds, F.lit(0))), by_block(book.meanings, False))

    first = lambda kind: F.get(F.from_json(payload, f"array<struct<{kind}>>"), F.lit(0))
    english_only = lang == "en"
    found = (
        F.when(provider == "wiktionary", X.bound(F.from_json(payload, f"map<string,{blocks}>"), wiktionary))
        .when((provider == "datamuse") & english_only, X.bound(first("word:string,defs:array<string>"), datamuse))
        .when((provider == "dictionaryapi") & english_only, X.bound(first(f"word:string,phonetic:string,phonetics:array<struct<text:string>>,meanings:{blocks}"), dictionaryapi))
    )
    return X.bound(found, lambda e: F.when(F.size(e.senses) > 0, F.struct(e.phonetic.alias("phonetic"), e.senses.cast(SENSES).alias("senses"))))


def defined(words: DataFrame, entries: DataFrame) -> DataFrame:
    """(word, found, form_of, senses): the first spelling of each word that has an entry; of a mere inflection the base word's entry, one hop on.

    entries (word, senses: array of texts) are answers and cached ones that may still be used, in one language; of several of a word
    the least counts. An inflection whose base has none stays itself. lookup.define() asks and writes back.
    """
    known = entries.groupBy("word").agg(F.min("senses").alias("senses"))
    first = first_found(words, known.withColumnRenamed("senses", "payload")).withColumn("base", base_word(F.col("payload")))
    hop = first_found(first.filter("base is not null and base <> spelling").select(F.col("base").alias("word")), known.withColumnRenamed("senses", "payload"))
    hop = hop.filter("spelling is not null").select(F.col("word").alias("base"), F.col("spelling").alias("_to"), F.col("payload").alias("_senses"))
    d = first.join(hop, "base", "left")
    moved = F.col("_to").isNotNull() & (F.col("base") != F.col("spelling"))
    return d.select(
        "word", F.when(moved, F.col("_to")).otherwise(F.col("spelling")).alias("found"), F.when(moved, F.col("spelling")).alias("form_of"),
        F.when(moved, F.col("_senses")).otherwise(F.col("payload")).alias("senses"),
    )


def top_senses(senses: DataFrame, n: int = 4) -> DataFrame:
    """At most n senses a word: the first of each part of speech, in order. senses: (word, pos, place, text)."""
    first = senses.groupBy("word", "pos").agg(F.min_by(F.struct("place", "text"), "place").alias("s"))
    lists = first.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("s.place", "pos", "s.text"))).alias("all"))
    return lists.select("word", F.inline(F.slice("all", 1, n))).select("word", "pos", "place", "text")


def target_languages(listed: Column, most: int = 4) -> Column:
    """Two-letter codes of a comma list, lower case, distinct, at most so many."""
    codes = F.transform(F.split(listed, ","), lambda x: F.lower(F.trim(x)))
    return F.slice(F.array_distinct(F.filter(codes, lambda c: c.rlike(r"^\p{L}{2}$"))), 1, most)


def preferred(sub: Column, page: Column) -> Column:
    """Translations of a word: those of its page of translations where there are any, else of its own page."""
    return F.when(F.coalesce(F.size(sub), F.lit(0)) > 0, sub).otherwise(F.coalesce(page, F.array().cast("array<string>")))


def translatable(word: Column, src: Column, dst: Column) -> Column:
    """The word to look up, or null where nothing is to be asked: same language, no two-letter code, an empty or a very long word."""
    a, b = F.substring(F.lower(F.coalesce(src, F.lit("en"))), 1, 2), F.substring(F.lower(dst), 1, 2)
    base = X.normal_word(word)
    return F.when((a != b) & b.rlike("^[a-z]{2}$") & (F.length(base) > 0) & (F.length(base) <= 64), base)


def sound_key(text: Column, voice: Column) -> Column:
    """The key of a cached sound. Fixed value: the speed that once was a part of keys stays in them."""
    return F.sha1(F.concat_ws("|", voice, F.lit("1.00"), F.coalesce(text, F.lit(""))))
