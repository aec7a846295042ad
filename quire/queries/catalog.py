"""Queries on the catalog; documents stand in for books."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import catalog as C
from quire.operators import search as S
from quire.plans.staging import new_path, removed, staged
from quire.plans.tables import table
from quire.queries import query

_GENRES = "[" + ", ".join("'" + g.replace("'", "''") + "'" for g in C.SHELVES) + "]"
BOOKS_SQL = f"""
    books AS (
      SELECT *, array_to_string(list_distinct([{_GENRES}[k % 18 + 1]]) || CASE WHEN k % 18 <> (k * 7 + 3) % 18 THEN [{_GENRES}[(k * 7 + 3) % 18 + 1]] ELSE [] END, ', ') AS genres FROM (
        SELECT doc_id AS gid, left(string_split(coalesce(text, ''), chr(10))[1], 60) AS title, source AS authors, lang AS language, (doc_id * 7919) % 10007 AS downloads,
          coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '\\d+') AS INTEGER), 0) AS k, coalesce(source, '') || '; ' || coalesce(lang, '') AS subjects, coalesce(text, '') AS description, n_chars AS text_bytes,
          doc_id % 3 <> 0 AS has_cover, doc_id % 7 <> 0 AS has_text,
          NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND NOT (l.quality = 1 AND l.toxic = 0)) AS curated FROM documents d)),
    vis AS (SELECT * FROM books WHERE has_text AND curated)"""


def book_table(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    bad = table(spark, sf_dir, "labels").filter("not (quality = 1 and toxic = 0)").select("doc_id").distinct()
    d = d.join(bad.withColumn("_bad", F.lit(True)), "doc_id", "left")
    k = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.coalesce("source", F.lit("")), r"\d+", 0), F.lit("")), F.lit("999999")).cast("int"), F.lit(0))
    named = F.array(*[F.lit(g) for g in C.SHELVES])
    genres = F.array_distinct(F.array(F.get(named, k % 18), F.get(named, (k * 7 + 3) % 18)))
    text = F.coalesce("text", F.lit(""))
    return d.select(
        i.alias("gid"), F.substring(F.get(F.split(text, "\n"), F.lit(0)), 1, 60).alias("title"), F.col("source").alias("authors"), F.col("lang").alias("language"),
        ((i * 7919) % 10007).alias("downloads"), F.concat(F.coalesce("source", F.lit("")), F.lit("; "), F.coalesce("lang", F.lit(""))).alias("subjects"), text.alias("description"), F.col("n_chars").alias("text_bytes"),
        (i % 3 != 0).alias("has_cover"), (i % 7 != 0).alias("has_text"), F.col("_bad").isNull().alias("curated"), F.array_join(genres, ", ").alias("genres"), F.col("source").alias("authors_full"),
    )


_CARD = """gid, title, authors, language, CASE language WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' WHEN 'it' THEN 'Italian' WHEN 'pt' THEN 'Portuguese' WHEN 'hi' THEN 'Hindi' ELSE language END AS language_label,
      downloads, string_split(genres, ', ')[1] AS genre, CAST(floor(greatest(text_bytes - 18000, 0) / 6.0 / 155) AS INTEGER) AS minutes, has_cover"""


def flat(cards):
    """Cards with their list of genres left out, as lists compare badly across engines."""
    return cards.drop("genres")


@query("store_home", f"""
    WITH {BOOKS_SQL}, g AS (SELECT *, unnest(string_split(genres, ', ')) AS g FROM vis),
    s AS (
      SELECT 0 AS section, 'featured' AS shelf, 10 AS size, gid, downloads FROM vis WHERE has_cover UNION ALL SELECT 1, 'top', 15, gid, downloads FROM vis
      UNION ALL SELECT list_position({_GENRES}, g) + 1, 'genre:' || g, 12, gid, downloads FROM g WHERE has_cover UNION ALL SELECT 20, 'lang:fr', 12, gid, downloads FROM vis WHERE language = 'fr'),
    r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY downloads DESC, gid) AS place FROM s),
    t AS (SELECT *, count(*) OVER (PARTITION BY section) AS n FROM r WHERE place <= size)
    SELECT CAST(t.section AS INTEGER) AS section, shelf, CAST(place AS INTEGER) AS place, b.* FROM t JOIN (SELECT {_CARD}, description AS full_text FROM books) b0 USING (gid)
      JOIN (SELECT {_CARD} FROM books) b USING (gid) WHERE n >= 4""".replace("b.* FROM t JOIN (SELECT", "b0.* EXCLUDE (full_text), CASE WHEN section = 0 THEN CASE WHEN length(full_text) > 220 THEN left(full_text, 220) || '…' ELSE full_text END END AS description FROM t JOIN (SELECT").replace(f"\n      JOIN (SELECT {_CARD} FROM books) b USING (gid)", ""))
def store_home(spark, sf_dir):
    return flat(C.shelves(book_table(spark, sf_dir)))


@query("genre_facets", f"""
    WITH {BOOKS_SQL} SELECT CAST(list_position({_GENRES}, g) AS INTEGER) AS place, g AS genre, count(*) AS count FROM (SELECT unnest(string_split(genres, ', ')) AS g FROM vis) GROUP BY g""")
def genre_facets(spark, sf_dir):
    return C.genre_counts(book_table(spark, sf_dir))


@query("store_browse", f"WITH {BOOKS_SQL} SELECT {_CARD} FROM vis WHERE list_contains(string_split(genres, ', '), 'Poetry') AND language = 'en' ORDER BY downloads DESC, gid LIMIT 20 OFFSET 5")
def store_browse(spark, sf_dir):
    """A page of the shelf; the limit is the page."""
    books = book_table(spark, sf_dir)
    found = C.visible(books).filter(F.array_contains(C.genre_list(F.col("genres")), "Poetry") & (F.col("language") == "en"))
    return flat(C.cards(found.orderBy(F.desc("downloads"), "gid").offset(5).limit(20)))


@query("book_detail", f"WITH {BOOKS_SQL} SELECT {_CARD}, authors AS authors_full, description, has_text, len(list_filter(string_split(subjects, '; '), lambda x: x <> '')) AS n_subjects FROM books WHERE gid = 11 AND curated")
def book_detail(spark, sf_dir):
    d = C.book(book_table(spark, sf_dir), 11)
    return flat(d).withColumn("n_subjects", F.size("subjects").cast("long")).drop("subjects")


@query("top_books", f"WITH {BOOKS_SQL} SELECT gid, downloads FROM books WHERE curated ORDER BY downloads DESC, gid LIMIT 100")
def top_books(spark, sf_dir):
    return C.top(book_table(spark, sf_dir), 100)


_FOLDED = f"""translate(lower(concat_ws(' ', title, authors, subjects)), '{C.FOLD[0]}', '{C.FOLD[1]}')"""


@query("search_postings", f"""
    WITH {BOOKS_SQL} SELECT term, gid, count(*) AS tf FROM (SELECT gid, unnest(regexp_extract_all({_FOLDED}, '[\\p{{L}}\\p{{N}}]+')) AS term FROM books) GROUP BY ALL""")
def search_postings(spark, sf_dir):
    return C.postings(book_table(spark, sf_dir))


def _pool_sql(wanted):
    f = ", ".join(f"len(list_filter(t, lambda x: starts_with(x, '{w}'))) AS f{k}" for k, w in enumerate(wanted))
    idf = lambda k: f"(SELECT CASE WHEN ln((count(*) - sum((f{k} > 0)::INT) + 0.5) / (sum((f{k} > 0)::INT) + 0.5)) <= 0 THEN 1e-6 ELSE ln((count(*) - sum((f{k} > 0)::INT) + 0.5) / (sum((f{k} > 0)::INT) + 0.5)) END FROM f)"
    rank = " ".join(f"- {idf(k)} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM f)))" for k in range(len(wanted)))
    return f"""f AS (SELECT gid, len(t) AS len, {f} FROM (SELECT gid, regexp_extract_all({_FOLDED}, '[\\p{{L}}\\p{{N}}]+') AS t FROM books)),
    ranks AS (SELECT gid, {rank} AS score FROM f WHERE {' AND '.join(f'f{k} > 0' for k in range(len(wanted)))}),
    pool AS (SELECT gid, score FROM ranks ORDER BY round(score, 9), gid LIMIT 400)"""


@query("search_pool", f"WITH {BOOKS_SQL}, {_pool_sql(['th', 'src'])} SELECT gid, round(score, 6) AS rank FROM pool")
def search_pool(spark, sf_dir):
    """The pool's bound is part of the search."""
    found = C.ranked(book_table(spark, sf_dir), "Th src").orderBy(F.round("rank", 9), "gid").limit(C.POOL)
    return found.select("gid", F.round("rank", 6).alias("rank"))


@query("search_page", f"WITH {BOOKS_SQL}, {_pool_sql(['th', 'src1'])} SELECT {_CARD} FROM vis WHERE gid IN (SELECT gid FROM pool) AND language = 'en' ORDER BY downloads DESC, gid LIMIT 40")
def search_page(spark, sf_dir):
    return flat(C.search(book_table(spark, sf_dir), "th src1", language="en")[0])


_INDEXED = (["th", "src"], ["src1"], ["de", "src10"])


@query("search_indexed", " UNION ALL ".join(
    f"SELECT '{' '.join(w)}' AS q, gid, round(score, 6) AS rank FROM (WITH {BOOKS_SQL}, {_pool_sql(w)} SELECT gid, score FROM pool)" for w in _INDEXED
))
def search_indexed(spark, sf_dir):
    """Queries on a stored index of two segments, the second of which replaces books of the first; the pool's bound is part of the search."""
    books, path = staged(book_table(spark, sf_dir).select("gid", "title", "authors", "subjects"), "books"), new_path(spark, "index")
    early = F.col("gid") % 3 > 0
    # The first segment has other titles for a part of the books, which the second puts right.
    S.add(books.filter(early).withColumn("title", F.when(F.col("gid") % 3 == 1, "a thing of old").otherwise(F.col("title"))), path)
    S.add(books.filter(F.col("gid") % 3 < 2), path)
    found = None
    for k, w in enumerate(_INDEXED):
        if k == 1:
            S.merge(spark, path)
        one = S.pool(spark, path, " ".join(w)).select(F.lit(" ".join(w)).alias("q"), "gid", F.round("rank", 6).alias("rank"))
        found = one if found is None else found.unionByName(one)
    found = staged(found, "search-found")
    removed(spark, path)
    return found
