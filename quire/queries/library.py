"""Queries on the library; events of the driver's table stand in for its writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import library as L
from quire.operators import structure as S
from quire.plans.tables import table
from quire.queries import query
from quire.queries.catalog import BOOKS_SQL, book_table
from quire.queries.structure import PIECES_SQL, piece_table
from quire.sources.files import body_source

_S = f"{PIECES_SQL}, s AS (SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(idx // 12 + 1 AS INTEGER) AS page, text FROM pieces)"
_E = """
    ev AS (SELECT user_id AS doc_id, CAST(event_id % 5 AS INTEGER) AS idx, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS kind, value AS created_at, props AS note, event_type AS color FROM events),
    g AS (SELECT doc_id, idx, max(seq) FILTER (WHERE kind = 'delete') AS gone FROM ev GROUP BY ALL),
    liv AS (SELECT ev.* FROM ev JOIN g USING (doc_id, idx) WHERE gone IS NULL OR seq > gone),
    b AS (SELECT doc_id, idx, arg_min(created_at, seq) AS created_at, arg_max(note, seq) AS note FROM liv GROUP BY ALL)"""


def sentences(spark, sf_dir, of=None):
    return piece_table(spark, sf_dir, of).select("doc_id", "idx", (F.floor(F.col("idx") / 12) + 1).cast("int").alias("page"), "text")


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("doc_id"), (F.col("event_id") % 5).cast("int").alias("idx"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("kind"), F.col("value").alias("created_at"), F.col("props").alias("note"), F.col("event_type").alias("color"),
    )


@query("bookmarks", f"WITH {_E} SELECT * FROM b")
def bookmarks(spark, sf_dir):
    return L.bookmarks(events(spark, sf_dir))


@query("bookmarks_with_snippet", f"WITH {_S}, {_E} SELECT b.*, s.text AS snippet, coalesce(page, 1) AS page FROM b LEFT JOIN s ON s.doc_id = b.doc_id AND s.idx = b.idx")
def bookmarks_with_snippet(spark, sf_dir):
    marks = bookmarks(spark, sf_dir)
    return L.with_sentence(marks, sentences(spark, sf_dir, marks))


@query("highlights", f"""
    WITH {_S}, ev AS (SELECT user_id AS doc_id, CAST(event_id % 3 AS INTEGER) AS idx, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS kind, value AS created_at, event_type AS color,
      CAST(event_id % 4 * 10 AS INTEGER) AS cs, CAST(event_id % 4 * 10 + 15 AS INTEGER) AS ce FROM events),
    c AS (SELECT ev.* EXCLUDE (cs, ce), greatest(0, least(cs, length(text))) AS cs, greatest(0, least(ce, length(text))) AS ce, text FROM ev JOIN s USING (doc_id, idx)),
    f AS (SELECT *, substr(text, CAST(cs + 1 AS BIGINT), CAST(ce - cs AS BIGINT)) AS part FROM c WHERE ce > cs),
    g AS (SELECT *, max(CASE WHEN kind = 'delete' THEN seq END) OVER (PARTITION BY doc_id, idx, cs, ce) AS gone FROM f)
    SELECT doc_id, idx, CAST(cs AS INTEGER) AS cs, CAST(ce AS INTEGER) AS ce, arg_min(created_at, seq) AS created_at, arg_min(part, seq) AS text, arg_max(color, seq) AS color FROM g WHERE gone IS NULL OR seq > gone GROUP BY ALL""")
def highlights(spark, sf_dir):
    i = F.col("seq")
    e = events(spark, sf_dir).withColumns({"idx": (i % 3).cast("int"), "cs": (i % 4 * 10).cast("int"), "ce": (i % 4 * 10 + 15).cast("int")})
    return L.highlights(e, sentences(spark, sf_dir, e))


_D = "d AS (SELECT doc_id, CAST(doc_id % 5 AS INTEGER) AS current_idx, n_chars AS num_sentences, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 END AS folder_id, (doc_id * 7919) % 10007 AS updated_at, CASE WHEN doc_id % 2 = 0 THEN 'book' ELSE 'text' END AS kind, 'pg:' || doc_id * 2 AS source_url FROM documents)"
_M = "m AS (SELECT page_id % 50 AS doc_id, CAST(page_id // 50 AS INTEGER) AS ord, CASE WHEN page_id % 3 > 0 THEN url END AS filename, CAST(page_id % 7 AS INTEGER) AS anchor_idx FROM pages)"


def docs(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", (i % 5).cast("int").alias("current_idx"), F.col("n_chars").alias("num_sentences"), F.when(i % 4 > 0, i % 4).alias("folder_id"), ((i * 7919) % 10007).alias("updated_at"),
        F.when(i % 2 == 0, "book").otherwise("text").alias("kind"), F.concat(F.lit("pg:"), (i * 2).cast("string")).alias("source_url"),
    )


def media(spark, sf_dir):
    i = F.col("page_id")
    return table(spark, sf_dir, "pages").select((i % 50).alias("doc_id"), F.floor(i / 50).cast("int").alias("ord"), F.when(i % 3 > 0, F.col("url")).alias("filename"), (i % 7).cast("int").alias("anchor_idx"))


@query("list_documents", f"""
    WITH {_E}, {_D}, {_M}, t AS (SELECT doc_id, min(ord) AS thumb_ord FROM m WHERE filename IS NOT NULL GROUP BY doc_id)
    SELECT d.*, EXISTS (SELECT 1 FROM b WHERE b.doc_id = d.doc_id) AS bookmarked, thumb_ord, CASE WHEN num_sentences > 0 THEN current_idx / num_sentences ELSE 0.0 END AS progress FROM d LEFT JOIN t USING (doc_id)""")
def list_documents(spark, sf_dir):
    return L.documents_listed(docs(spark, sf_dir), bookmarks(spark, sf_dir), media(spark, sf_dir))


@query("library_order", f"WITH {_D} SELECT doc_id, updated_at, CAST(row_number() OVER (ORDER BY updated_at DESC, doc_id) AS INTEGER) AS place FROM d")
def library_order(spark, sf_dir):
    """The order itself, as numbers: one list of documents, newest first."""
    return L.placed(docs(spark, sf_dir).select("doc_id", "updated_at"), *L.newest_first())


@query("created_documents", f"""
    WITH {_S}, n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
    SELECT documents.doc_id, CAST(greatest(0, least(documents.doc_id % 50 - 3, coalesce(n, 0) - 1)) AS INTEGER) AS current_idx, coalesce(n, 0) AS num_sentences FROM documents LEFT JOIN n USING (doc_id)""")
def created_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50 - 3).cast("int").alias("current_idx"))
    return L.created(d, sentences(spark, sf_dir))


@query("progress_saved", """
    WITH r AS (SELECT user_id AS doc_id, event_id AS seq, CAST(event_id % 6 AS INTEGER) AS idx, CASE WHEN event_id % 4 = 0 THEN event_type END AS voice FROM events),
    l AS (SELECT doc_id, arg_max(idx, seq) AS idx, arg_max(voice, seq) AS voice FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(idx, 1) AS current_idx, CASE WHEN d.doc_id % 3 > 0 THEN coalesce(voice, 'v') END AS voice_override FROM documents d LEFT JOIN l USING (doc_id)""")
def progress_saved(spark, sf_dir):
    i = F.col("event_id")
    reads = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), i.alias("seq"), (i % 6).cast("int").alias("idx"), F.when(i % 4 == 0, F.col("event_type")).alias("voice"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("current_idx"), F.when(F.col("doc_id") % 3 > 0, "v").alias("voice_override"))
    return L.progressed(d, reads)


@query("documents_of_kinds", f"WITH {_D} SELECT doc_id, source_url FROM d WHERE kind IN ('book', 'url')")
def documents_of_kinds(spark, sf_dir):
    return L.of_kinds(docs(spark, sf_dir), "book", "url").select("doc_id", "source_url")


@query("folders_named", r"""
    WITH e AS (SELECT user_id AS folder_id, event_id AS seq, event_type = 'error' AS gone, value AS created_at,
      CASE WHEN event_id % 3 > 0 THEN nullif(left(trim(regexp_replace(event_type || '  ' || event_id || chr(10), '\s+', ' ', 'g')), 200), '') END AS name FROM events),
    g AS (SELECT folder_id, max(seq) FILTER (WHERE gone) AS last FROM e GROUP BY folder_id),
    k AS (SELECT e.* FROM e JOIN g ON e.folder_id IS NOT DISTINCT FROM g.folder_id WHERE NOT gone AND name IS NOT NULL AND (last IS NULL OR seq > last))
    SELECT folder_id, arg_min(created_at, seq) AS created_at, arg_max(name, seq) AS name FROM k GROUP BY folder_id""")
def folders_named(spark, sf_dir):
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("folder_id"), i.alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("kind"), F.col("value").alias("created_at"),
        F.when(i % 3 > 0, F.concat("event_type", F.lit("  "), i.cast("string"), F.lit("\n"))).when(i % 2 == 0, " \n ").alias("name"),
    )
    return L.folders(e)


@query("books_addable", rf"""
    WITH {BOOKS_SQL}, {_D} SELECT gid, title FROM books WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.kind = 'book' AND d.source_url = 'pg:' || books.gid)
      AND EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = books.gid AND length(x.text) >= 200 AND regexp_matches(x.text, '[^\s]'))""")
def books_addable(spark, sf_dir):
    bodies = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("gid"), "text")
    return L.addable(book_table(spark, sf_dir), bodies, docs(spark, sf_dir)).select("gid", "title")


@query("page_counts", f"""
    WITH {_S}, p AS (SELECT doc_id AS id, unnest(range(1, 8)) AS page FROM documents), n AS (SELECT doc_id AS id, page, count(*) AS c FROM s WHERE page % 2 = 1 GROUP BY ALL)
    SELECT id, CAST(page AS INTEGER) AS page, CAST(coalesce(sum(coalesce(c, 0)) OVER (PARTITION BY id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, coalesce(c, 0) AS count FROM p LEFT JOIN n USING (id, page)""")
def page_counts(spark, sf_dir):
    """Seven pages a document, the even ones without sentences."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("page"))
    return S.page_index(sentences(spark, sf_dir).filter("page % 2 = 1").withColumnRenamed("doc_id", "id"), pages)


@query("page_of_sentences", f"WITH {_S} SELECT doc_id, idx, text FROM s WHERE doc_id = 4 AND page = 1")
def page_of_sentences(spark, sf_dir):
    """One page of one document; the page is the feature."""
    return L.page_sentences(sentences(spark, sf_dir, spark.range(4, 5).toDF("doc_id")), 4, 1).select("doc_id", "idx", "text")


@query("highlights_with_page", f"""
    WITH {_S}, h AS (SELECT user_id AS doc_id, CAST(event_id % 3 AS INTEGER) AS idx, event_id AS seq, CAST(event_id % 4 * 10 AS INTEGER) AS cs, CAST(event_id % 4 * 10 + 15 AS INTEGER) AS ce, event_type AS color FROM events),
    f AS (SELECT h.doc_id, h.idx, greatest(0, least(cs, length(text))) AS cs, greatest(0, least(ce, length(text))) AS ce, seq, color, page FROM h JOIN s ON s.doc_id = h.doc_id AND s.idx = h.idx)
    SELECT doc_id, idx, CAST(cs AS INTEGER) AS cs, CAST(ce AS INTEGER) AS ce, arg_max(color, seq) AS color, coalesce(any_value(page), 1) AS page FROM f WHERE ce > cs GROUP BY ALL HAVING true""")
def highlights_with_page(spark, sf_dir):
    i = F.col("seq")
    e = events(spark, sf_dir).withColumns({"kind": F.lit("put"), "idx": (i % 3).cast("int"), "cs": (i % 4 * 10).cast("int"), "ce": (i % 4 * 10 + 15).cast("int")})
    cut = sentences(spark, sf_dir, e)
    return L.with_sentence(L.highlights(e, cut), cut).select("doc_id", "idx", "cs", "ce", "color", "page")


@query("folder_counts", f"WITH {_D}, f AS (SELECT unnest(range(1, 7)) AS folder_id) SELECT folder_id, (SELECT count(*) FROM d WHERE d.folder_id = f.folder_id) AS count FROM f")
def folder_counts(spark, sf_dir):
    return L.folder_counts(spark.range(1, 7).withColumnRenamed("id", "folder_id"), docs(spark, sf_dir))


@query("doc_assembled", f"""
    WITH {_M}, {_S}, toc AS (SELECT doc_id, idx AS ord, text AS title FROM s WHERE idx < 3)
    SELECT doc_id, (SELECT string_agg(ord || ':' || title, '|' ORDER BY ord) FROM toc WHERE toc.doc_id = documents.doc_id) AS toc,
      (SELECT string_agg(ord || ':' || anchor_idx, '|' ORDER BY ord) FROM m WHERE m.doc_id = documents.doc_id AND filename IS NOT NULL) AS media FROM documents""")
def doc_assembled(spark, sf_dir):
    toc = sentences(spark, sf_dir).filter("idx < 3").select("doc_id", F.col("idx").alias("ord"), F.lit(1).alias("level"), F.col("text").alias("title"), F.col("idx").alias("sentence_idx"))
    out = L.assembled(docs(spark, sf_dir).select("doc_id"), toc, media(spark, sf_dir))
    told = lambda c, f: F.array_join(F.transform(c, lambda x: F.concat(x.ord.cast("string"), F.lit(":"), x[f].cast("string"))), "|").alias(c)
    return out.select("doc_id", told("toc", "title"), told("media", "anchor_idx"))


@query("patched_documents", f"""
    WITH {_D}, p AS (SELECT user_id AS doc_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 9 END AS folder_id, event_type IN ('click', 'view') AS on_folder, event_type AS kind, event_type = 'purchase' AS on_kind FROM events),
    f AS (SELECT doc_id, arg_max_null(folder_id, seq) AS v FROM p WHERE on_folder GROUP BY doc_id), k AS (SELECT doc_id, arg_max(kind, seq) AS v FROM p WHERE on_kind GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN f.doc_id IS NOT NULL THEN f.v ELSE d.folder_id END AS folder_id, CASE WHEN k.doc_id IS NOT NULL THEN k.v ELSE d.kind END AS kind FROM d LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)""")
def patched_documents(spark, sf_dir):
    i = F.col("event_id")
    p = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), i.alias("seq"), F.when(i % 3 != 0, i % 9).alias("folder_id"), F.col("event_type").isin("click", "view").alias("folder_id_set"),
        F.col("event_type").alias("kind"), (F.col("event_type") == "purchase").alias("kind_set"),
    )
    return L.patched(docs(spark, sf_dir), p, "doc_id", ["folder_id", "kind"]).select("doc_id", "folder_id", "kind")


@query("deleted_cascade", f"WITH {_S} SELECT doc_id, count(*) AS n FROM s WHERE doc_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND user_id IS NOT NULL) GROUP BY doc_id")
def deleted_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("doc_id"))
    return L.without(sentences(spark, sf_dir), gone, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("released_folders", f"WITH {_D} SELECT doc_id, CASE WHEN folder_id IN (1, 3) THEN NULL ELSE folder_id END AS folder_id FROM d")
def released_folders(spark, sf_dir):
    return L.released(docs(spark, sf_dir), spark.range(1, 4, 2).withColumnRenamed("id", "folder_id")).select("doc_id", "folder_id")


@query("books_to_add", f"WITH {BOOKS_SQL}, {_D} SELECT gid, title FROM books WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.kind = 'book' AND d.source_url = 'pg:' || books.gid)")
def books_to_add(spark, sf_dir):
    return L.not_yet_added(book_table(spark, sf_dir), docs(spark, sf_dir)).select("gid", "title")


@query("sentence_window", f"WITH {_S} SELECT doc_id, idx, page, text FROM s WHERE doc_id = 3 AND idx >= 2 ORDER BY idx LIMIT 10")
def sentence_window(spark, sf_dir):
    """A window of one document; the limit is the window."""
    return L.sentence_window(sentences(spark, sf_dir, spark.range(3, 4).toDF("doc_id")), 3, 2, 10)


@query("latest_settings", "SELECT user_id, event_type, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props FROM events GROUP BY ALL")
def latest_settings(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("seq", F.col("event_id"))
    return L.latest(e, ["user_id", "event_type"], ["value", "props"])


@query("folder_names", r"SELECT doc_id, nullif(left(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 60), '') AS name FROM documents")
def folder_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normal_title(F.coalesce("text", F.lit("")), 60).alias("name"))


@query("text_sources", """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id * 2 END AS gid, CASE WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN 'https://h.example/' || doc_id END AS url FROM documents""")
def text_sources(spark, sf_dir):
    i = F.col("doc_id")
    url = F.when(i % 2 == 0, F.concat(F.lit("pg:"), (i * 2).cast("string"))).when(i % 3 == 0, F.concat(F.lit("https://h.example/"), i.cast("string"))).otherwise("file:///x")
    found = body_source(F.when(i % 2 == 0, "book").otherwise("url"), url)
    return table(spark, sf_dir, "documents").select("doc_id", found["gid"].alias("gid"), found["url"].alias("url"))


@query("reading_order", """
    WITH b AS (SELECT user_id AS id, CAST(event_id % 3 AS INTEGER) AS page, value AS x0, value * 7 % 100 AS y0, event_type AS text FROM events)
    SELECT id, page, text, round(x0, 6) AS x0, CAST(row_number() OVER (PARTITION BY id, page ORDER BY round_even(y0 / 4, 0), x0, y0, text) - 1 AS INTEGER) AS ord FROM b""")
def reading_order(spark, sf_dir):
    v = F.col("value")
    b = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.col("event_id") % 3).cast("int").alias("page"), v.alias("x0"), (v * 7 % 100).alias("y0"), F.col("event_type").alias("text"))
    return S.reading_order(b).select("id", "page", "text", F.round("x0", 6).alias("x0"), "ord")


@query("content_revisions", "SELECT user_id AS doc_id, count(*) + 1 AS content_rev FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def content_revisions(spark, sf_dir):
    return S.revisions(table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("doc_id")))
