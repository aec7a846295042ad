"""Documents from files: text, e-books, catalog archives and text bundles; presence of files.

Single files are opened by Spark's readers, archives by the source in ``quire.sources.archives``, at any size.
Of a bundle only the members that are wanted are inflated.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import archives
from quire.sources.pages import markdown_of

#: Bytes of one e-book entry and of all its entries that are read.
ENTRY_BYTES, BOOK_BYTES = 8 << 20, 24 << 20


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files; bytes that are no UTF-8 are replaced, a mark at the start is dropped."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return raw.withColumn("text", F.regexp_replace("text", "^﻿+", ""))


def kind(path: Column) -> Column:
    """pdf, epub, markdown or text by a file's extension; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext == "epub", "epub").when(ext.isin("md", "markdown"), "markdown").when(ext.isin("txt", "text"), "text")


def file_title(path: Column) -> Column:
    """A title from a file's name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.trim(F.replace(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")))


def pasted_title(text: Column, given: Column) -> Column:
    """The given title, else the first line that is not blank, cut to 80 characters and an ellipsis."""
    line = F.trim(F.get(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != ""), F.lit(0)))
    cut = F.when(F.length(line) > 80, F.concat(F.substring(line, 1, 80), F.lit("…"))).otherwise(line)
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), cut)


def epub_markdown(content: bytes) -> tuple[str | None, str]:
    """(title, Markdown) of an e-book: its chapters in spine order, within the byte bounds. Documents with a DTD are refused."""

    def xml(data: bytes):
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
            raise ValueError("a document type is not accepted")
        return ET.fromstring(data)

    local = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        left = BOOK_BYTES

        def read(name: str) -> bytes:
            nonlocal left
            with z.open(name) as f:
                data = f.read(min(ENTRY_BYTES, left) + 1)
            if len(data) > min(ENTRY_BYTES, left):
                raise ValueError("an entry is too large")
            left -= len(data)
            return data

        root = next(e.get("full-path") for e in xml(read("META-INF/container.xml")).iter() if local(e) == "rootfile")
        opf = xml(read(root))
        title = next((e.text.strip() for e in opf.iter() if local(e) == "title" and e.text), None)
        items = {e.get("id"): e.get("href") for e in opf.iter() if local(e) == "item"}
        names, out = set(z.namelist()), []
        for ref in (e.get("idref") for e in opf.iter() if local(e) == "itemref"):
            href = items.get(ref)
            name = href and posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(href.split("#")[0])))
            if name in names:
                out.append(markdown_of(read(name).decode("utf-8", "replace")))
    return title, "\n\n".join(x for x in out if x)


def epubs(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, markdown, error) of e-books; a broken one gives its error and no text."""

    def run(frames):
        for frame in frames:
            rows = []
            for p, content in zip(frame.path, frame.content, strict=True):
                try:
                    rows.append((p, *epub_markdown(bytes(content)), None))
                except Exception as e:  # one bad file must not end the job; its error is a column
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "title", "markdown", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, title string, markdown string, error string")


RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
DC = "{http://purl.org/dc/terms/}"
RECORD = (
    "gid long, type string, rights string, languages array<string>, title string, creators array<string>, agents array<struct<name:string,birth:int,death:int>>, "
    "subjects array<string>, shelves array<string>, downloads long, description string, files array<struct<url:string,extent:string>>, skip string"
)


def record_of(data: bytes, terms: str) -> dict | None:
    """A catalog record from one RDF document; terms is the namespace of the catalog's own elements. None: no record in it."""
    if b"<!DOCTYPE" in data[:2048] or b"<!ENTITY" in data:
        return {"skip": "dtd_rejected"}
    ns = "{" + terms + "}"
    book = ET.fromstring(data).find(f"{ns}ebook")
    if book is None:
        return {"skip": "no_ebook"}
    number = re.search(r"(\d+)$", book.get(f"{RDF}about", ""))
    values = lambda path: [(v.text or "").strip() for v in book.findall(f"{path}/{RDF}Description/{RDF}value")]
    year = lambda e: int(m[1]) if e is not None and (m := re.match(r"\s*(-?\d+)", e.text or "")) else None
    name = lambda a: (a.findtext(f"{ns}name") or "").strip()
    fetched = (book.findtext(f"{ns}downloads") or "").strip()
    return {
        "gid": int(number[1]) if number else None, "type": next(iter(values(f"{DC}type")), None), "rights": (book.findtext(f"{DC}rights") or "").strip(),
        "languages": [x for x in values(f"{DC}language") if x], "title": book.findtext(f"{DC}title") or "", "creators": [name(a) for a in book.findall(f"{DC}creator/{ns}agent")],
        "agents": [{"name": name(a), "birth": year(a.find(f"{ns}birthdate")), "death": year(a.find(f"{ns}deathdate"))} for a in book.findall(f".//{ns}agent")],
        "subjects": values(f"{DC}subject"), "shelves": values(f"{ns}bookshelf"), "downloads": int(fetched) if fetched.isdigit() else 0,
        "description": book.findtext(f"{ns}marc520") or book.findtext(f"{DC}description") or "",
        "files": [{"url": f.get(f"{RDF}about", ""), "extent": f.findtext(f"{DC}extent")} for f in book.findall(f"{DC}hasFormat/{ns}file")], "skip": None,
    }


def records(spark: SparkSession, path: str, terms: str) -> DataFrame:
    """Catalog records of archives (zip, or tar of any compression) of RDF documents; unreadable documents have the reason in skip.

    Documents leave the task that reads an archive as they are and are parsed by as many tasks as there are cores.
    """
    fields = [c.split(" ")[0] for c in re.split(r", (?=\w+ )", RECORD)]

    def parsed(content):
        try:
            return record_of(bytes(content), terms)
        except ET.ParseError:
            return {"skip": "unparsable"}

    def run(frames):
        for frame in frames:
            found = [parsed(c) if c is not None else {"skip": "unreadable"} for c in frame.content]
            yield pd.DataFrame([[r.get(c) for c in fields] for r in found], columns=fields)

    raw = archives.members(spark, path, r"\.rdf$", content="all").select("content")
    return raw.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, RECORD)


#: Names of texts in a bundle: a folder of a number, and a file of the same.
MEMBER = r"(?:^|/)(\d+)/pg\1\.txt(?:\.utf-?8)?$"


def bundle_members(spark: SparkSession, path: str) -> DataFrame:
    """The texts in bundles (columns of archives.MEMBERS, and gid); only names are read, but for compressed tars, which pass whole."""
    return archives.members(spark, path, MEMBER).withColumn("gid", F.regexp_extract("name", MEMBER, 1).cast("long"))


def bundle_texts(spark: SparkSession, path: str, wanted: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """(gid, text) of the texts in bundles (zips, tars, tars in zips) whose number is wanted and not yet present.

    The names are joined with what is wanted before any member is inflated; a text that stands in
    several bundles is read from the first. Members that can't be read have a null text.
    """
    listed = bundle_members(spark, path)
    first = listed.groupBy("gid").agg(F.min(F.struct("path", "inside", "name", "at", "packed", "size", "method", "content", "error")).alias("m")).select("gid", "m.*")
    first = first.join(wanted.select("gid").distinct(), "gid", "left_semi")
    if present is not None:
        first = first.join(present.select("gid"), "gid", "left_anti")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return archives.fetched(first).select("gid", text.alias("text"))


def with_presence(books: DataFrame, listed: DataFrame) -> DataFrame:
    """books with has_text and has_cover as the listed paths (path) tell."""
    number = lambda pattern: F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")).cast("long")
    text, cover = number(r"(?:^|/)pg(\d+)\.txt$"), number(r"(?:^|/)pg(\d+)\.cover\.medium\.jpg$")
    have = listed.select(F.coalesce(text, cover).alias("gid"), text.isNotNull().alias("t"), cover.isNotNull().alias("c")).filter("gid is not null")
    have = have.groupBy("gid").agg(F.max("t").alias("_t"), F.max("c").alias("_c"))
    out = books.drop("has_text", "has_cover").join(have, "gid", "left")
    return out.withColumns({"has_text": F.coalesce("_t", F.lit(False)), "has_cover": F.coalesce("_c", F.lit(False))}).drop("_t", "_c").select(*books.columns)


def presence_sums(books: DataFrame) -> DataFrame:
    """One row: books, and those with a text, with a cover, and with both."""
    both = F.col("has_text") & F.col("has_cover")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return books.agg(F.count("*").alias("books"), count(F.col("has_text")).alias("texts"), count(F.col("has_cover")).alias("covers"), count(both).alias("complete"))


def fetched_page(content: Column, content_type: Column) -> Column:
    """What came from an address: pdf by its type or first bytes, else page."""
    head = F.substring(content, 1, 5).cast("string")
    return F.when(F.lower(F.coalesce(content_type, F.lit(""))).contains("application/pdf") | (F.coalesce(head, F.lit("")) == "%PDF-"), "pdf").otherwise("page")


def article_or_plain(article: Column, plain: Column, least: int = 40) -> Column:
    """The article of a page; where none was found its plain text, if that has least characters or more; else null."""
    bare = lambda c: F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))
    return F.coalesce(bare(article), F.when(F.length(bare(plain)) >= least, bare(plain)))


def stripped_book(text: Column, edges: dict[str, list[str]]) -> Column:
    """A book's own text: what is between the first start and the first end mark found, credits and picture notes gone.

    edges: patterns ``start`` and ``end`` of whole lines, tried in order; which lines these are depends on the publisher.
    """
    body = F.regexp_replace(text, "^﻿+", "")
    for rx, keep in ((edges["start"], 2), (edges["end"], 1)):
        cut = body
        for p in reversed(rx):
            line = rf"(?is)^(.*?)(?<=^|\n)(?:{p})[^\n]*(?=\n|$)(.*)$"
            cut = F.when(body.rlike(rf"(?im)^(?:{p})"), F.regexp_extract(body, line, keep)).otherwise(cut)
        body = cut
    body = F.regexp_replace(body, r"^\n+|\n+$", "")
    body = F.regexp_replace(body, r"(?i)^(?:Produced by|E-text prepared by|Transcribed from|This etext was prepared by)[^\n]*(?:\n[^\n]+)*", "")
    return F.regexp_replace(F.regexp_replace(body, r"\[Illustration[^\]]*\]", ""), r"(?U)^\s+|\s+$", "")


def body_source(kind_: Column, url: Column) -> Column:
    """Where a stored document's text is fetched again: (corpus number or null, web address or null)."""
    number = F.when((kind_ == "book") & url.rlike(r"^pg:\d+$"), F.regexp_extract(url, r"^pg:(\d+)$", 1).cast("long"))
    return F.struct(number.alias("gid"), F.when(number.isNull() & kind_.isin("url", "book") & url.rlike("(?i)^https?://"), url).alias("url"))
