"""A catalog of books: visibility, shelves, facets, full-text search with BM25, pages.

Rows are books (gid, title, authors, language, downloads, subjects, shelves, genres,
description, text_bytes, has_cover, has_text, curated, excluded); genres is a list in text,
parted by ``, ``. Ties in downloads go to the smaller gid.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.sources import sinks

# Shelves of the front page in display order, and labels of languages.
SHELVES = [
    "Fiction", "Mystery & Crime", "Adventure", "Science Fiction", "Romance", "Children's", "Fantasy", "Horror & Gothic", "Philosophy",
    "Poetry", "History", "Biography", "Humor", "Drama", "Myths & Folklore", "Science & Nature", "Travel", "Short Stories",
]
LABELS = {"en": "English", "fr": "French", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "hi": "Hindi"}
LEAST_ON_SHELF, POOL, TERMS = 4, 400, 8


BOOKS = (
    "gid long, title string, authors string, authors_full string, language string, downloads long, subjects string, shelves string, genres string, description string, "
    "text_bytes long, has_cover boolean, has_text boolean, curated boolean, excluded string"
)


def stored(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """The published catalog (a store of quire.sources.sinks), and whether there is one; an absent catalog has no books and is no error."""
    found = sinks.published(spark, path)
    return (spark.createDataFrame([], BOOKS), False) if found is None else (found, True)


def genre_list(genres: Column) -> Column:
    return F.filter(F.split(F.coalesce(genres, F.lit("")), ", "), lambda g: g != "")


def visible(books: DataFrame, need_text: bool = True, full: bool = False) -> DataFrame:
    """Books that are served: with a text, and curated unless all are asked for or the column is missing."""
    if need_text:
        books = books.filter("has_text")
    return books if full or "curated" not in books.columns else books.filter("curated")


def cards(books: DataFrame, *more: str) -> DataFrame:
    """The short form of books that lists show."""
    genres = genre_list(F.col("genres"))
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return books.select(
        "gid", "title", "authors", "language", F.coalesce(F.try_element_at(labels, F.col("language")), "language").alias("language_label"),
        "downloads", F.get(genres, F.lit(0)).alias("genre"), genres.alias("genres"), X.reading_minutes(F.col("text_bytes")).alias("minutes"), "has_cover", *more,
    )


def shelves(books: DataFrame, sizes: tuple[int, int, int] = (10, 15, 12)) -> DataFrame:
    """(section, shelf, place, gid, ...) of the front page, one pass over the books.

    Sections in order: featured (with cover), top, one a genre (with cover), French. A shelf
    with fewer than LEAST_ON_SHELF books is left out. Descriptions are cut to 220 on the first.
    """
    featured, top, genre = sizes
    order = {g: k + 2 for k, g in enumerate(SHELVES)}
    own = F.transform(
        F.array_intersect(genre_list(F.col("genres")), F.array(*[F.lit(g) for g in SHELVES])),
        lambda g: F.struct(F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), g).alias("section"), F.concat(F.lit("genre:"), g).alias("shelf"), F.lit(genre).alias("size")),
    )
    entry = lambda k, name, n: F.array(F.struct(F.lit(k).alias("section"), F.lit(name).alias("shelf"), F.lit(n).alias("size")))
    none = F.slice(entry(0, "", 0), 1, 0)
    on = F.concat(
        F.when(F.col("has_cover"), F.concat(entry(0, "featured", featured), own)).otherwise(none),
        entry(1, "top", top),
        F.when(F.col("language") == "fr", entry(len(SHELVES) + 2, "lang:fr", genre)).otherwise(none),
    )
    narrow = visible(books).select("gid", "downloads", F.inline(on))
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("downloads"), "gid"))
    best = narrow.withColumn("place", place).filter(F.col("place") <= max(sizes)).filter(F.col("place") <= F.col("size"))
    best = best.withColumn("n", F.count("*").over(Window.partitionBy("section"))).filter(F.col("n") >= LEAST_ON_SHELF)
    blurb = F.when(F.col("section") == 0, F.when(F.length("description") > 220, F.concat(F.substring("description", 1, 220), F.lit("…"))).otherwise(F.col("description")))
    # At most a few hundred rows are left; only they fetch their other columns.
    return best.select("section", "shelf", "place", "gid").join(cards(books, "description"), "gid").withColumn("description", blurb)


def genre_counts(books: DataFrame) -> DataFrame:
    """(place, genre, count) of shelf genres that have visible books, in display order."""
    own = F.array_intersect(genre_list(F.col("genres")), F.array(*[F.lit(g) for g in SHELVES]))
    counts = visible(books).select(F.explode(own).alias("genre")).groupBy("genre").agg(F.count("*").alias("count"))
    place = F.array_position(F.array(*[F.lit(g) for g in SHELVES]), F.col("genre"))
    return counts.select(place.cast("int").alias("place"), "genre", "count")


def book(books: DataFrame, gid: int, full: bool = False) -> DataFrame:
    """One book's full form, with at most 12 subjects; no row if it is not visible."""
    subjects = F.slice(F.filter(F.split(F.coalesce("subjects", F.lit("")), "; "), lambda s: s != ""), 1, 12)
    found = visible(books.filter(F.col("gid") == gid), need_text=False, full=full)
    return cards(found.withColumn("_subjects", subjects), "authors_full", "description", F.col("_subjects").alias("subjects"), "has_text")


def accents() -> tuple[str, str]:
    """Small Latin letters with marks, and the plain letters that they are without."""
    marked = [chr(c) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if chr(c).islower()]
    plain = [(c, unicodedata.normalize("NFKD", c)[0]) for c in marked]
    plain = [(c, b) for c, b in plain if b.isascii() and b.isalpha()]
    return "".join(c for c, _ in plain), "".join(b for _, b in plain)


FOLD = accents()


def terms(*columns: str) -> Column:
    """Tokens of some columns: lower case, without accents, runs of letters and digits."""
    text = F.translate(F.lower(F.concat_ws(" ", *columns)), *FOLD)
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(books: DataFrame) -> DataFrame:
    """(term, gid, tf): the inverted index over titles, authors and subjects."""
    each = books.select("gid", F.explode(terms("title", "authors", "subjects")).alias("term"))
    return each.groupBy("term", "gid").agg(F.count("*").alias("tf"))


def query_terms(q: str | None) -> list[str]:
    """At most TERMS words of a query, folded like the index."""
    return [w.lower().translate(str.maketrans(*FOLD)) for w in re.findall(r"\w+", q or "")[:TERMS]]


def beginning(w: str):
    return lambda x: x.startswith(w)


def ranked(books: DataFrame, q: str) -> DataFrame:
    """(gid, rank) of books that have a word beginning with each term of q: BM25, lowest first is best.

    One pass counts terms and lengths; a second scores the matching rows alone.
    """
    wanted = query_terms(q)
    if not wanted:
        raise ValueError("the query has no word")
    tokens = books.select("gid", terms("title", "authors", "subjects").alias("t"))
    tf = [F.size(F.filter("t", beginning(w))) for w in wanted]
    counted = tokens.select("gid", F.size("t").alias("len"), *[c.alias(f"f{k}") for k, c in enumerate(tf)])
    totals = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count(F.when(F.col(f"f{k}") > 0, 1)).alias(f"n{k}") for k in range(len(wanted))]).first()
    rank = F.lit(0.0)
    for k in range(len(wanted)):
        n = totals[f"n{k}"]
        idf = F.log((F.lit(float(totals.n)) - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        f = F.col(f"f{k}")
        rank = rank - idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("len") / F.lit(float(totals.avg or 1.0))))
    every = F.lit(True)
    for k in range(len(wanted)):
        every = every & (F.col(f"f{k}") > 0)
    return counted.filter(every).select("gid", rank.alias("rank"))


def pool(books: DataFrame, q: str) -> DataFrame:
    """The POOL best matches of a query; a cap that belongs to the search itself."""
    return ranked(books, q).orderBy(F.round("rank", 9), "gid").limit(POOL)


def search(books: DataFrame, q: str = "", genre: str = "", language: str = "", page: int = 0, per: int = 40, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """(a page of cards by falling downloads, the total as one row). Filters apply after the pool is drawn."""
    page, per = max(0, page), min(max(per, 1), 60)
    found = visible(books, full=full)
    if query_terms(q):
        found = found.join(pool(books, q).select("gid"), "gid", "left_semi")
    if genre:
        found = found.filter(F.array_contains(genre_list(F.col("genres")), genre))
    if language:
        found = found.filter(F.col("language") == language)
    rows = found.orderBy(F.desc("downloads"), "gid").offset(page * per).limit(per)
    return cards(rows), found.agg(F.count("*").alias("total"))


def top(books: DataFrame, n: int) -> DataFrame:
    """gid of the n most fetched curated books, best first."""
    return books.filter("curated").orderBy(F.desc("downloads"), "gid").limit(n).select("gid", "downloads")
