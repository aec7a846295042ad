"""A library of documents, sentences, folders, bookmarks and highlights as tables and folds of events.

Parquet has no upsert: a change is an event row with a sequence number, and the state is a
fold by key. A fold takes one shuffle on its key; what it keeps of a key is a few values, so
a key with very many events does not gather in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import normal_title
from quire.plans.staging import staged


def live_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events after the last delete of their key (kind ``delete``, seq says the order)."""
    gone = F.max(F.when(F.col("kind") == "delete", F.col("seq")))
    last = events.groupBy(*keys).agg(gone.alias("_gone"))
    joined = events.join(last.filter("_gone is not null"), keys, "left")
    return joined.filter(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone"))).drop("_gone")


def upserted(events: DataFrame, keys: list[str], first: list[str], latest: list[str]) -> DataFrame:
    """Rows as upserts leave them: columns first from the first event after a delete, latest from the last one."""
    return live_events(events, keys).groupBy(*keys).agg(
        *[F.min_by(c, "seq").alias(c) for c in first], *[F.max_by(c, "seq").alias(c) for c in latest]
    )


def bookmarks(events: DataFrame) -> DataFrame:
    """(doc_id, idx, created_at, note): a repeated bookmark keeps its date and takes the new note."""
    return upserted(events, ["doc_id", "idx"], ["created_at"], ["note"])


def highlights(events: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, idx, cs, ce, text, color, created_at): spans are cut to their sentence; empty spans are dropped.

    A repeated span takes the new colour only.
    """
    e = events.join(sentences.select("doc_id", "idx", F.col("text").alias("_t")), ["doc_id", "idx"])
    n = F.length("_t")
    e = e.withColumns({"cs": F.greatest(F.lit(0), F.least("cs", n)), "ce": F.greatest(F.lit(0), F.least("ce", n))}).filter("ce > cs")
    e = e.withColumn("text", F.substring(F.col("_t"), F.col("cs") + 1, F.col("ce") - F.col("cs")))
    return upserted(e, ["doc_id", "idx", "cs", "ce"], ["created_at", "text"], ["color"])


def with_sentence(marks: DataFrame, sentences: DataFrame) -> DataFrame:
    """Marks with snippet and page; a mark whose sentence is gone stays, with page 1."""
    s = sentences.select("doc_id", "idx", F.col("text").alias("snippet"), "page")
    return marks.join(s, ["doc_id", "idx"], "left").withColumn("page", F.coalesce("page", F.lit(1)))


def documents_listed(docs: DataFrame, marks: DataFrame, media: DataFrame) -> DataFrame:
    """Documents with bookmarked (anywhere), thumb_ord (least ready media) and progress; in_order() puts them in a library's order."""
    marked = marks.select("doc_id").distinct().withColumn("_m", F.lit(True))
    thumbs = media.filter("filename is not null").groupBy("doc_id").agg(F.min("ord").alias("thumb_ord"))
    d = docs.join(marked, "doc_id", "left").join(thumbs, "doc_id", "left")
    progress = F.when(F.col("num_sentences") > 0, F.col("current_idx") / F.col("num_sentences")).otherwise(0.0)
    return d.select(*docs.columns, F.col("_m").isNotNull().alias("bookmarked"), "thumb_ord", progress.alias("progress"))


def newest_first(newest: str = "updated_at", key: str = "doc_id") -> list[Column]:
    return [F.desc_nulls_last(newest), F.col(key)]


def in_order(rows: DataFrame, newest: str = "updated_at", key: str = "doc_id") -> DataFrame:
    """Newest first; equal times by key. Documents go by updated_at, folders by created_at."""
    return rows.orderBy(*newest_first(newest, key))


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place, from 1, in an order of the whole table: sorted in ranges, numbered within them, the ranges before added.

    The sorted rows are written once, so that their numbers and the sums of the ranges agree.
    """
    held = staged(rows.sort(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part, before, total = F.shiftright("_at", 33).cast("int"), [], 0
    for r in held.groupBy(part.alias("part")).count().orderBy("part").collect():  # as many as the sort had tasks
        before += [total] * (r.part + 1 - len(before))
        total += r["count"]
    start = F.element_at(F.array(*[F.lit(n).cast("long") for n in before or [0]]), part + 1)
    return held.withColumn("place", (start + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("_at")


def created(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """New documents (doc_id, current_idx, ...) with num_sentences, their place brought inside [0, num_sentences - 1].

    chunks (doc_id, idx, ...) are their rows of sentences; contents and media go along as tables of
    their own, published with sinks.replace_documents under the same doc_id. A document without
    chunks has place 0.
    """
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("_n"))
    d = docs.join(n, "doc_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    place = F.greatest(F.lit(0), F.least(F.coalesce("current_idx", F.lit(0)), F.col("_n") - 1)).cast("int")
    columns = [place.alias(c) if c == "current_idx" else F.col(c) for c in docs.columns if c != "num_sentences"]
    return d.select(*columns, F.col("_n").cast("long").alias("num_sentences"))


def progressed(docs: DataFrame, reads: DataFrame) -> DataFrame:
    """docs after reads (doc_id, idx, voice, seq): the last place; a document that pins a voice takes the last one it was read in, others none."""
    last = reads.groupBy("doc_id").agg(
        F.max_by("idx", "seq").alias("_idx"), F.max_by("voice", F.when(F.col("voice").isNotNull(), F.col("seq"))).alias("_voice")
    )
    change = {
        "current_idx": F.coalesce("_idx", "current_idx"),
        "voice_override": F.when(F.col("voice_override").isNotNull(), F.coalesce("_voice", "voice_override")),
    }
    return docs.join(last, "doc_id", "left").select(*[change[c].alias(c) if c in change else c for c in docs.columns])


def of_kinds(docs: DataFrame, *kinds: str) -> DataFrame:
    """Documents of some kinds that have an address, by id."""
    return docs.filter(F.col("kind").isin(*kinds) & F.col("source_url").isNotNull()).orderBy("doc_id")


def folders(events: DataFrame) -> DataFrame:
    """(folder_id, name, created_at) of folders made and renamed (kind ``put``) and deleted: the first date, the last name that is one.

    Names are levelled and cut; an event without a name changes none, and makes no folder.
    """
    named = events.withColumn("name", normal_title(F.col("name"))).filter((F.col("kind") == "delete") | F.col("name").isNotNull())
    return upserted(named, ["folder_id"], ["created_at"], ["name"])


def addable(books: DataFrame, bodies: DataFrame, docs: DataFrame, least: int = 200) -> DataFrame:
    """Books not added yet whose body (gid, text) has least characters or more and something to read."""
    usable = bodies.filter((F.length("text") >= least) & F.col("text").rlike(r"(?U)\S")).select("gid").distinct()
    return not_yet_added(books, docs).join(usable, "gid", "left_semi")


def page_sentences(sentences: DataFrame, doc_id: int, page: int) -> DataFrame:
    """The sentences of one page, in order."""
    return sentences.filter((F.col("doc_id") == doc_id) & (F.col("page") == page)).orderBy("idx")


def folder_counts(folders: DataFrame, docs: DataFrame) -> DataFrame:
    """Folders with the number of their documents, 0 included."""
    n = docs.filter("folder_id is not null").groupBy("folder_id").agg(F.count("*").alias("count"))
    return folders.join(n, "folder_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def assembled(docs: DataFrame, toc: DataFrame, media: DataFrame) -> DataFrame:
    """Documents with their contents and ready media as ordered lists."""
    nest = lambda d, cols, name: d.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *cols))).alias(name))
    out = docs.join(nest(toc, ["level", "title", "sentence_idx"], "toc"), "doc_id", "left")
    return out.join(nest(media.filter("filename is not null"), ["anchor_idx"], "media"), "doc_id", "left")


def patched(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows after partial updates: patches (key, seq, c, c_set, ...) change a column only where c_set; null may be set."""
    last = patches.groupBy(key).agg(
        *[F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(f"{c}_set"), F.col("seq"))).alias(f"_{c}") for c in columns],
        *[F.max(F.col(f"{c}_set")).alias(f"_{c}_set") for c in columns],
    )
    out = rows.join(last, key, "left")
    return out.select(*[F.when(F.coalesce(f"_{c}_set", F.lit(False)), F.col(f"_{c}")["v"]).otherwise(F.col(c)).alias(c) if c in columns else c for c in rows.columns])


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A delete's cascade: rows whose key is not among the gone ones."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def released(docs: DataFrame, gone_folders: DataFrame) -> DataFrame:
    """Documents of deleted folders go back to the top."""
    g = gone_folders.select("folder_id").distinct().withColumn("_g", F.lit(True))
    return docs.join(g, "folder_id", "left").select(*[F.when(F.col("_g").isNull(), F.col(c)).alias(c) if c == "folder_id" else c for c in docs.columns])


def not_yet_added(books: DataFrame, docs: DataFrame) -> DataFrame:
    """Books that no document of kind ``book`` was made of (its source_url is ``pg:`` and the book's number)."""
    have = docs.filter(F.col("kind") == "book").select("source_url")
    return books.join(have, F.concat(F.lit("pg:"), books.gid.cast("string")) == have.source_url, "left_anti")


def latest(events: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The last event's columns for each key."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*columns), "seq").alias("_r")).select(*keys, "_r.*")


def sentence_window(sentences: DataFrame, doc_id: int, start: int, n: int) -> DataFrame:
    """At most n (1 to 2000) sentences of a document from start on."""
    return sentences.filter((F.col("doc_id") == doc_id) & (F.col("idx") >= max(0, start))).orderBy("idx").limit(min(max(n, 1), 2000))


def first_per(rows: DataFrame, keys: list[str], order: str, n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark keeps n rows a key and task before it shuffles."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_n") <= n).drop("_n")
