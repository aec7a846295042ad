"""From catalog records to rows of books: hard rules, rights, content rules, genres, files.

A record is (gid, type, rights, languages, title, creators, agents, subjects, shelves,
downloads, description, files); agents are (name, birth, death), files (url, extent).
Rules are Column expressions over one record, so a corpus of any size is one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X

# Years of the rights rule, and languages that are kept.
DEATH_CUTOFF, BIRTH_CUTOFF = 1971, 1850
LANGUAGES = ["en", "fr", "es", "it", "pt", "hi"]
# A genre and the words of subjects and shelves that give it; the broad one is last.
GENRES = {
    "Mystery & Crime": ["detective", "mystery", "crime"],
    "Science Fiction": ["science fiction"],
    "Fantasy": ["fantasy"],
    "Horror & Gothic": ["horror", "ghost", "gothic", "supernatural"],
    "Adventure": ["adventure"],
    "Romance": ["love stories", "romance"],
    "Children's": ["juvenile", "children", "fairy tales", "nursery"],
    "Poetry": ["poetry", "poems", "verse"],
    "Drama": ["drama", "plays", "tragedies", "comedies"],
    "Philosophy": ["philosophy", "ethics", "logic"],
    "History": ["history", "historical", "world war", "civil war"],
    "Biography": ["biography", "autobiography", "memoir", "diaries", "correspondence"],
    "Humor": ["humor", "humour", "satire", "wit and humor", "parodies"],
    "Travel": ["travel", "voyages", "description and travel", "exploration"],
    "Religion": ["religion", "bible", "christian", "theology", "hymns", "sermons"],
    "Science & Nature": ["science", "natural history", "mathematics", "physics", "astronomy", "biology", "botany", "zoology", "chemistry", "geology", "evolution"],
    "Myths & Folklore": ["mythology", "folklore", "legends", "folk tales", "epic"],
    "Short Stories": ["short stories"],
    "Essays": ["essays"],
    "Westerns": ["western stories", "west (u.s.)"],
    "War & Military": ["war stories", "military", "naval"],
    "Fiction": ["fiction"],
}
# A word of subjects, and (part of title, part of authors), that mark explicit works.
EXPLICIT_SUBJECT = "erotic"
EXPLICIT_WORKS = [
    ("thousand nights and a night", "burton"), ("supplemental nights", "burton"), ("thousand nights and one night", "payne"), ("memoirs", "casanova"),
    ("decameron", "boccaccio"), ("", "petronius"), ("tales of the heptameron", ""), ("ulysses", "joyce"),
]


def skip_reason(type_: Column, rights: Column, languages: Column, files: Column, gid: Column) -> Column:
    """The first hard rule that a record fails, or null."""
    lang = F.get(F.filter(languages, lambda x: x != ""), F.lit(0))
    plain = F.coalesce(F.exists(files, lambda f: f.url.rlike(r"\.txt(\.utf-?8)?$")), F.lit(False))
    return (
        F.when(gid.isNull(), "no_id")
        .when(~F.coalesce(F.trim(type_) == "Text", F.lit(False)), "not_text")
        .when(~F.lower(F.trim(F.coalesce(rights, F.lit("")))).startswith("public domain"), "not_pd_usa")
        .when(~F.coalesce(lang.isin(LANGUAGES), F.lit(False)), "language")
        .when(~plain, "no_plaintext")
    )


def person_reason(agent: Column, death_cutoff: int = DEATH_CUTOFF, birth_cutoff: int = BIRTH_CUTOFF) -> Column:
    """Why a person's work may not be free: died too late, or of unknown death and not surely born early enough."""
    return F.when(agent.death.isNotNull(), F.when(agent.death > death_cutoff, "death_too_recent")).when(
        agent.birth.isNull() | (agent.birth > birth_cutoff), "unverifiable_person"
    )


def explicit(title: Column, authors: Column, hay: Column) -> Column:
    named = F.lit(False)
    for t, a in EXPLICIT_WORKS:
        named = named | (F.contains(F.lower(title), F.lit(t)) & F.contains(F.lower(authors), F.lit(a)))
    return F.contains(hay, F.lit(EXPLICIT_SUBJECT)) | named


def held_back(denied: Column, agents: Column, title: Column, authors: Column, hay: Column, death_cutoff: int = DEATH_CUTOFF) -> Column:
    """Distinct reasons against a record, in the order of the rules. A later cutoff year moves the birth cutoff with it."""
    people = F.coalesce(agents, F.array())
    birth = death_cutoff - (DEATH_CUTOFF - BIRTH_CUTOFF)
    listed = F.array(F.when(denied, "racist_ideology"), F.when(F.size(people) == 0, "no_agents"))
    all_ = F.concat(listed, F.transform(people, lambda a: person_reason(a, death_cutoff, birth)), F.array(F.when(explicit(title, authors, hay), "explicit")))
    return F.array_distinct(F.array_compact(all_))


def genres_of(hay: Column) -> Column:
    """Every genre one of whose words occurs in the lower-cased subjects and shelves."""
    found = []
    for genre, words in GENRES.items():
        any_ = F.lit(False)
        for w in words:
            any_ = any_ | F.contains(hay, F.lit(w))
        found.append(F.when(any_, genre))
    return F.array_compact(F.array(*found))


def haystack(subjects: Column, shelves: Column) -> Column:
    return F.lower(F.array_join(F.concat(subjects, shelves), " | "))


def life_span(birth: Column, death: Column) -> Column:
    year = lambda y: F.when(y < 0, F.concat((-y).cast("string"), F.lit(" BCE"))).otherwise(F.coalesce(y.cast("string"), F.lit("?")))
    return F.when(birth.isNull() & death.isNull(), "").otherwise(F.concat(F.lit(" ("), year(birth), F.lit("–"), year(death), F.lit(")")))


def parsed(records: DataFrame, denied: DataFrame, death_cutoff: int = DEATH_CUTOFF) -> DataFrame:
    """Rows of books with skip (a hard rule, or null), excluded and curated.

    denied (gid): works that are held back by name; a small list, looked up by a join on gid.
    """
    r = records.join(denied.select("gid").distinct().withColumn("_denied", F.lit(True)), "gid", "left")
    subjects = F.filter(F.transform(F.coalesce("subjects", F.array()), lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike("^[A-Z]{1,3}$"))
    shelf = F.transform(F.coalesce("shelves", F.array()), lambda s: F.trim(F.regexp_replace(F.trim(s), "^Category: ", "")))
    people = F.coalesce("agents", F.array())
    creators = F.transform(F.filter(F.coalesce("creators", F.array()), lambda c: F.trim(c) != ""), lambda c: X.display_name(F.trim(c)))
    first = F.get(people, F.lit(0))["name"]
    authors = F.when(F.size(creators) > 0, F.array_join(creators, ", ")).when(F.size(people) > 0, X.display_name(F.coalesce(first, F.lit("")))).otherwise("Unknown")
    full = F.array_join(F.transform(people, lambda a: F.concat(X.display_name(F.coalesce(a["name"], F.lit(""))), life_span(a.birth, a.death))), "; ")
    hay = haystack(subjects, shelf)
    title = X.display_title(F.coalesce("title", F.lit("")))
    reasons = held_back(F.coalesce("_denied", F.lit(False)), people, title, F.concat_ws(" ", authors, full), hay, death_cutoff)
    texts = F.filter(F.coalesce("files", F.array()), lambda f: f.url.rlike(r"\.txt(\.utf-?8)?$"))
    size = F.coalesce(F.array_max(F.transform(texts, lambda f: F.when(F.trim(f.extent).rlike(r"^\d+$"), F.trim(f.extent).cast("long")))), F.lit(0))
    lang = F.get(F.filter("languages", lambda x: x != ""), F.lit(0))
    about = F.regexp_replace(F.trim(F.coalesce("description", F.lit(""))), r"\s*\(This is an automatically generated summary\.?\)\s*$", "")
    return r.select(
        "gid", title.alias("title"), authors.alias("authors"), full.alias("authors_full"), lang.alias("language"), F.coalesce("downloads", F.lit(0)).alias("downloads"),
        F.array_join(subjects, "; ").alias("subjects"), F.array_join(shelf, "; ").alias("shelves"), F.array_join(genres_of(hay), ", ").alias("genres"), about.alias("description"),
        size.alias("text_bytes"), F.coalesce(F.exists("files", lambda f: f.url.endswith("cover.medium.jpg")), F.lit(False)).alias("has_cover"), F.lit(False).alias("has_text"),
        (F.size(reasons) == 0).alias("curated"), F.array_join(reasons, ", ").alias("excluded"),
        skip_reason(F.col("type"), F.col("rights"), F.coalesce("languages", F.array()), F.coalesce("files", F.array()), F.col("gid")).alias("skip"),
    )


def kept(rows: DataFrame) -> DataFrame:
    """Rows that pass the hard rules, the last of each gid by downloads and title."""
    ok = rows.filter("skip is null").drop("skip")
    return ok.groupBy("gid").agg(F.max_by(F.struct(*[c for c in ok.columns if c != "gid"]), F.struct("downloads", "title")).alias("r")).select("gid", "r.*")


def reason_counts(rows: DataFrame) -> DataFrame:
    """(kind, reason, count): skipped and held-back rows by reason; a row counts under each of its reasons."""
    held = F.transform(F.filter(F.split("excluded", ", "), lambda x: x != ""), lambda x: F.struct(F.lit("excluded").alias("kind"), x.alias("reason")))
    why = F.when(F.col("skip").isNotNull(), F.array(F.struct(F.lit("skip").alias("kind"), F.col("skip").alias("reason")))).otherwise(held)
    return rows.select(F.inline(why)).groupBy("kind", "reason").agg(F.count("*").alias("count"))
