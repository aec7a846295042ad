"""Documents as tables: paragraphs, chapters, chunks, page furniture.

A document is cut into paragraphs inside its own row and then exploded, so from there on
steps work on rows of paragraphs or sentences. Windows and counts are partitioned by document: its rows meet in
one task, which passes them as a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import reading as R
from quire.functions import text as X
from quire.plans.staging import staged


def paragraph_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, para, text) of cleaned paragraphs, numbered from 0; documents without any give no row."""
    return R.exploded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), "_text", R.paragraphs, "para", "id")


def sentence_table(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """(columns keep, idx, text): the chunks of whole documents, numbered from 0; nothing is shuffled."""
    return R.exploded(docs, text_col, R.units, "idx", *keep)


def those(docs: DataFrame, of: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that rows of another table name, so that no others are cut into sentences.

    The ids are written first: of a table of known size Spark sends few ids to the texts, and shuffles texts only where they are many.
    """
    return docs.join(staged(of.select(key).distinct(), "asked-for"), key, "left_semi")


def heading_levels(paras: DataFrame) -> DataFrame:
    """paras with level: 1 or 2 for chapter headings, 0 for body text.

    Numerals count from two on; numbered titles from three on if four fifths of them ascend;
    capitals from two on in a document that has chapters, else three, and are level 2 then.
    A document with one heading, over 55 % headings, or more than 400 and 8 % has none.
    """
    doc, order = Window.partitionBy("id"), Window.partitionBy("id").orderBy("para")
    d = paras.withColumn("kind", X.heading_kind(F.col("text")))
    of = lambda k: F.count(F.when(F.col("kind") == k, 1)).over(doc)
    value = F.when(F.col("kind") == "numtitle", X.roman(F.substring_index("text", ".", 1)))
    d = d.withColumn("value", value)
    d = d.withColumn("before", F.last("value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rising = F.sum(F.when(F.col("value") >= F.col("before"), 1).otherwise(0)).over(doc)
    d = d.withColumns({"ne": of("explicit"), "nn": of("numeral"), "nt": of("numtitle"), "nc": of("allcaps"), "up": rising, "n": F.count("*").over(doc)})
    run = (F.col("nt") >= 3) & (F.col("up") >= 0.8 * (F.col("nt") - 1))
    chaptered = (F.col("ne") > 0) | (F.col("nn") >= 2) | run
    level = (
        F.when(F.col("kind") == "explicit", 1)
        .when((F.col("kind") == "numeral") & (F.col("nn") >= 2), 1)
        .when((F.col("kind") == "numtitle") & run, 1)
        .when((F.col("kind") == "allcaps") & (F.col("nc") >= F.when(chaptered, 2).otherwise(3)), F.when(chaptered, 2).otherwise(1))
        .otherwise(0)
    )
    d = d.withColumn("level", level)
    found = F.count(F.when(F.col("level") > 0, 1)).over(doc)
    d = d.withColumn("found", found)
    veto = (F.col("found") < 2) | (F.col("found") > 0.55 * F.col("n")) | (F.col("found") > F.greatest(F.lit(400), 0.08 * F.col("n")))
    return d.select(*paras.columns, F.when(veto, 0).otherwise(F.col("level")).alias("level"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with idx: their place in the document, from 0 on, by the order columns."""
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("id").orderBy(*order)) - 1)


def chunk_table(paras: DataFrame) -> DataFrame:
    """(id, idx, para, level, text): the units in which documents are read."""
    units = R.exploded(paras, "text", R.chunks, "pos", "id", "para", "level")
    return numbered(units, "para", "pos").select("id", "idx", "para", "level", "text")


def contents(chunks: DataFrame) -> DataFrame:
    """(id, level, title, idx) of headings: the first chunk of each heading paragraph, its title cut to 120."""
    heads = chunks.filter("level > 0").groupBy("id", "para").agg(F.min_by(F.struct("level", "text", "idx"), "idx").alias("h"))
    return heads.select("id", "h.level", F.substring("h.text", 1, 120).alias("title"), "h.idx")


def page_index(chunks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(id, page, start, count); start is the number of chunks on earlier pages.

    pages (id, page) lists all pages, also those without chunks; else pages that have chunks are listed.
    """
    per = chunks.groupBy("id", "page").agg(F.count("*").alias("count"))
    if pages is not None:
        per = pages.select("id", "page").distinct().join(per, ["id", "page"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    before = Window.partitionBy("id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("id", "page", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"), "count")


def furniture_key(text: Column) -> Column:
    """Text of a page edge with digits levelled, so running heads and page numbers look alike on all pages."""
    return F.substring(F.regexp_replace(F.lower(X.flat(text)), r"\d+", "#"), 1, 80)


def furniture(blocks: DataFrame) -> DataFrame:
    """blocks (id, page, page_height, y0, y1, text) with furniture: whether a block is a repeated edge or a page number.

    Edges are the upper and lower 12 % of a page. An edge repeats if the same key stands at the
    same height on at least max(3, 40 % of the document's pages) pages.
    """
    band = F.when(F.col("y0") < 0.12 * F.col("page_height"), "top").when(F.col("y1") > 0.88 * F.col("page_height"), "bottom")
    b = blocks.withColumn("_band", band)
    b = b.withColumn("_key", F.when(F.col("_band").isNotNull(), F.struct("_band", F.bround(F.col("y0") / 8).cast("long").alias("at"), furniture_key(F.col("text")).alias("text"))))
    pages = b.groupBy("id").agg(F.count_distinct("page").alias("n"))
    often = b.filter("_key is not null").groupBy("id", "_key").agg(F.count_distinct("page").alias("k"))
    often = often.join(pages, "id").filter(F.col("k") >= F.greatest(F.lit(3), F.ceil(0.4 * F.col("n")))).select("id", "_key", F.lit(True).alias("_often"))
    number = F.trim("text").rlike(r"(?i)^(?:page\s+)?(?:[0-9]{1,4}|[ivxlcdm]{1,7})(?:\s*(?:of|/|—|-)\s*[0-9]{1,4})?$")
    found = b.join(often, ["id", "_key"], "left")
    return found.select(*blocks.columns, (F.col("_band").isNotNull() & (F.coalesce("_often", F.lit(False)) | number)).alias("furniture"))


def toc_targets(toc: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each toc row (id, ord, page) with idx of the first chunk on its page or a later one; 0 if there is none.

    An as-of join on the page index: per page the least idx of it and all later pages.
    """
    first = chunks.groupBy("id", "page").agg(F.min("idx").alias("idx"))
    both = first.select("id", "page", "idx", F.lit(None).cast("int").alias("ord")).unionByName(
        toc.select("id", F.greatest(F.lit(1), "page").alias("page"), F.lit(None).cast("int").alias("idx"), "ord")
    )
    later = Window.partitionBy("id").orderBy("page").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return both.withColumn("target", F.min("idx").over(later)).filter("ord is not null").select("id", "ord", F.coalesce("target", F.lit(0)).alias("idx"))


def moved_progress(old: DataFrame, new: DataFrame, places: DataFrame) -> DataFrame:
    """places (id, idx) in old chunks as places in new ones, by the characters that come before; else the last chunk.

    An as-of join: places and new chunks stand in one order by where they begin, and each place
    takes the least new chunk from there on.
    """
    before = Window.partitionBy("id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda d: d.select("id", "idx", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).alias("at"))
    asked = places.select("id", "idx").distinct().join(at(old), ["id", "idx"], "left")
    none = F.lit(None).cast("int")
    both = at(new).select("id", "at", F.col("idx").alias("new"), none.alias("old_idx")).unionByName(asked.select("id", "at", none.alias("new"), F.col("idx").alias("old_idx")))
    later = Window.partitionBy("id").orderBy(F.col("at").asc_nulls_last()).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = both.withColumns({"next": F.min("new").over(later), "end": F.max("new").over(Window.partitionBy("id"))}).filter("old_idx is not null")
    next_ = F.when(F.col("at").isNotNull(), F.coalesce("next", "end")).otherwise(F.col("end"))
    return both.select("id", "old_idx", F.when(F.col("old_idx") <= 0, 0).otherwise(next_).alias("idx"))


def dedup_paragraphs(paras: DataFrame, least: int = 200, prefix: int = 160) -> DataFrame:
    """paras without later long paragraphs of a document that begin like an earlier one."""
    key = F.when(F.length("text") >= least, F.lower(F.substring("text", 1, prefix)))
    d = paras.withColumn("_key", key)
    n = F.row_number().over(Window.partitionBy("id", "_key").orderBy("para"))
    return d.withColumn("_n", F.when(F.col("_key").isNotNull(), n).otherwise(1)).filter("_n = 1").drop("_key", "_n")


def plain_documents(docs: DataFrame, printed_lists: bool = True, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(chunks, starts) of plain texts: printed lists gone, chapters found; starts (id, start_idx) says where the body begins.

    A start is 0 where no list was dropped, where over 1000 characters stand before it, or where
    it lies past three tenths of the chunks.
    """
    from quire.operators.layout import strip_printed_lists

    paras = paragraph_table(docs, id_col, text_col)
    paras = strip_printed_lists(paras) if printed_lists else paras.withColumn("start", F.lit(0))
    chunks = chunk_table(heading_levels(paras.select("id", "para", "text")))
    bodies = paras.groupBy("id").agg(F.max("start").alias("start"), F.sum(F.when(F.col("para") < F.col("start"), F.length("text"))).alias("before"))
    n = chunks.groupBy("id").agg(F.count("*").alias("n"))
    first = chunks.join(bodies, "id").filter(F.col("para") >= F.col("start")).groupBy("id").agg(F.min("idx").alias("first"))
    starts = bodies.join(n, "id").join(first, "id", "left")
    late = (F.coalesce("before", F.lit(0)) > 1000) | (F.col("first") > 0.3 * F.col("n"))
    return chunks, starts.select("id", F.when(late | F.col("first").isNull(), 0).otherwise(F.col("first")).alias("start_idx"))


def rechunked(old: DataFrame, texts: DataFrame, places: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(new chunks, places in them) of documents whose text was fetched again; texts shorter than least are left alone.

    A place is never before the body's start.
    """
    chunks, starts = plain_documents(texts.filter(F.length("text") >= least))
    moved = moved_progress(old, chunks, places.join(starts.select("id"), "id", "left_semi"))
    return chunks, moved.join(starts, "id").select("id", "old_idx", F.greatest("idx", "start_idx").alias("idx"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks (id, page, x0, y0, text) with ord: from top to bottom in steps of 4, then from left to right; blank blocks are gone."""
    clean = blocks.withColumn("text", X.clean_paragraph(F.col("text"))).filter("text <> ''")
    order = Window.partitionBy("id", "page").orderBy(F.bround(F.col("y0") / 4), "x0", "y0", "text")
    return clean.withColumn("ord", F.row_number().over(order) - 1)


def revisions(writes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content_rev): one more than how often a document was written again."""
    return writes.groupBy(key).agg((F.count("*") + 1).alias("content_rev"))
