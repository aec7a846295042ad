import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from quire import registry
from quire.operators import ingest
from quire.sources import files, pages, sinks
from tests.compare import both

NS = "http://example.org/terms/"


def rdf(gid, lang="en", death=1900):
    return f"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:t="{NS}"><t:ebook rdf:about="ebooks/{gid}">
    <dcterms:type><rdf:Description><rdf:value>Text</rdf:value></rdf:Description></dcterms:type><dcterms:rights>Public domain in the USA.</dcterms:rights><dcterms:title>A\nB</dcterms:title>
    <dcterms:language><rdf:Description><rdf:value>{lang}</rdf:value></rdf:Description></dcterms:language>
    <dcterms:creator><t:agent><t:name>Doe, Jane</t:name><t:birthdate>1850</t:birthdate><t:deathdate>{death}</t:deathdate></t:agent></dcterms:creator>
    <dcterms:subject><rdf:Description><rdf:value>Detective stories</rdf:value></rdf:Description></dcterms:subject><t:downloads>7</t:downloads>
    <dcterms:hasFormat><t:file rdf:about="x/pg{gid}.txt"><dcterms:extent>1234</dcterms:extent></t:file></dcterms:hasFormat></t:ebook></rdf:RDF>""".encode()


def test_catalog_archive(spark, tmp_path):
    with tarfile.open(f"{tmp_path}/a.tar.bz2", "w:bz2") as tar:
        for name, data in {"1.rdf": rdf(1), "2.rdf": rdf(2, "de"), "3.rdf": rdf(3, death=2000), "4.rdf": b"<!DOCTYPE x><x/>", "5.rdf": b"<broken", "6.txt": b""}.items():
            info = tarfile.TarInfo(f"d/{name}")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    raw = files.records(spark, f"{tmp_path}/a.tar.bz2", NS)
    assert {(r.gid, r.skip) for r in raw.collect()} == {(1, None), (2, None), (3, None), (None, "dtd_rejected"), (None, "unparsable")}
    rows = {r.gid: r for r in ingest.parsed(raw.filter("skip is null").drop("skip"), spark.createDataFrame([(9,)], "gid long")).collect()}
    assert rows[1].title == "A: B" and rows[1].authors_full == "Jane Doe (1850–1900)" and rows[1].genres == "Mystery & Crime" and rows[1].text_bytes == 1234 and rows[1].curated and rows[1].skip is None
    assert rows[2].skip == "language" and rows[3].excluded == "death_too_recent" and not rows[3].curated


def test_bundle_and_presence(spark, tmp_path):
    with zipfile.ZipFile(f"{tmp_path}/b.zip", "w") as z:
        for name in ("c/11/pg11.txt", "c/12/pg12.txt.utf8", "c/13/pg14.txt", "15/pg15.txt", "16/pg16.txt"):
            z.writestr(name, f"text {name}")
    gids = lambda *n: spark.createDataFrame([(k,) for k in n], "gid long")
    assert {r.gid for r in files.bundle_texts(spark, f"{tmp_path}/b.zip", gids(11, 12, 14, 15), gids(15)).collect()} == {11, 12}
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w:gz") as tar:
        for name in ("c/21/pg21.txt", "c/22/pg22.txt"):
            info = tarfile.TarInfo(name)
            info.size = 4
            tar.addfile(info, io.BytesIO(b"text"))
    with zipfile.ZipFile(f"{tmp_path}/t.zip", "w") as z:
        z.writestr("texts.tar.gz", inner.getvalue())
    (tmp_path / "u.tar.gz").write_bytes(inner.getvalue())
    for name in ("t.zip", "u.tar.gz"):
        assert [tuple(r) for r in files.bundle_texts(spark, f"{tmp_path}/{name}", gids(21, 22), gids(21)).collect()] == [(22, "text")]
    books = gids(1, 2).withColumns({"has_text": F.lit(True), "has_cover": F.lit(False)})
    listed = spark.createDataFrame([("/d/1/pg1.txt",), ("/d/2/pg2.cover.medium.jpg",), ("/d/x",)], "path string")
    assert {tuple(r) for r in files.with_presence(books, listed).collect()} == {(1, True, False), (2, False, True)}
    assert tuple(files.presence_sums(files.with_presence(books, listed)).first()) == (2, 1, 1, 0)
    got = spark.createDataFrame([(bytearray(b"%PDF-1.7"), "text/html"), (bytearray(b"<p>"), "application/pdf; q"), (bytearray(b"<p>"), None), (None, None)], "c binary, t string")
    assert [r[0] for r in got.select(files.fetched_page(F.col("c"), F.col("t"))).collect()] == ["pdf", "pdf", "page", "page"]
    got = spark.createDataFrame([(" a ", "x"), ("", "x" * 40), (None, "x" * 39)], "a string, p string")
    assert [r[0] for r in got.select(files.article_or_plain(F.col("a"), F.col("p"))).collect()] == ["a", "x" * 40, None]


def epub(chapters, extra=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", extra + b'<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="c%20{k}.xhtml#a"/>' for k in range(len(chapters)))
        z.writestr("o/c.opf", f"<package><metadata><title>T</title></metadata><manifest>{items}</manifest><spine>{''.join(f'<itemref idref=%si{k}%s/>' % (chr(34), chr(34)) for k in reversed(range(len(chapters))))}</spine></package>")
        for k, c in enumerate(chapters):
            z.writestr(f"o/c {k}.xhtml", c)
    return out.getvalue()


def test_epubs(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub(["<html><body><h1>One</h1><p>First &amp; last.</p></body></html>", "<p>Two.</p>"]))
    (tmp_path / "b.epub").write_bytes(epub(["<p>x</p>"], b'<!DOCTYPE x [<!ENTITY e SYSTEM "file:///etc/passwd">]>'))
    (tmp_path / "c.epub").write_bytes(b"no zip")
    got = {r.path[-6]: r for r in files.epubs(spark, f"{tmp_path}/*.epub").collect()}
    assert (got["a"].title, got["a"].markdown) == ("T", "Two.\n\n# One\n\nFirst & last.") and got["b"].markdown is None and "document type" in got["b"].error and got["c"].error


def test_article(spark):
    assert pages.markdown_of("<body><h2>H</h2><p>a<br>b</p><p></p><script>x</script></body>") == "## H\n\nab" and pages.markdown_of("<div>all of the text</div><p>x</p>") == "all of the textx" and pages.markdown_of(None) == ""
    long = "word " * 50
    d = spark.createDataFrame([(1, f"# A\n\n{long}\n\nshort\n\n{long}\n\n# a\n\nshort\n\n![p](x.png)", "http://h/b/"), (2, None, None)], "id int, markdown string, url string")
    got = [(r.level, r.text[:5]) for r in pages.article_blocks(d).orderBy("para").collect()]
    assert got == [(1, "A"), (0, "word "), (0, "short"), (0, "short")]
    assert [tuple(r) for r in pages.images(d).collect()] == [(1, 0, 6, "http://h/b/x.png", "p")]
    chunks = pages.article_chunks(pages.article_blocks(d)).orderBy("idx").collect()
    assert [r.anchor_idx for r in pages.anchored(pages.images(d), pages.article_chunks(pages.article_blocks(d))).collect()] == [len(chunks)]
    assert [r.idx for r in chunks] == list(range(len(chunks))) and [r.text[:5] for r in chunks][0] == "A" and len(chunks) >= 4


def test_references_cut_off():
    """A reference without its semicolon, or of no known name, stays as it is written, as in the SQL of article_blocks."""
    assert pages.markdown_of("<body><h1>a&amp;&amp;&amp</h1><p>b &lt c &#65; &#65 &nosuch; &ampx; &amp;lt; d</p></body>") == "# a&&&amp\n\nb &lt c A &#65 &nosuch; &ampx; &lt; d"


def test_chunks_of_references_cut_off(spark):
    p = spark.createDataFrame([(1, "<body><article><h1>Les&amp;&amp</h1><p>One&amp.</p></article></body>")], "page_id int, html string")
    got = pages.article_chunks(pages.article_blocks(pages.with_markdown(p), "page_id")).orderBy("idx")
    assert [(r.idx, r.level, r.text) for r in got.collect()] == [(0, 1, "Les&&amp"), (1, 0, "One&amp.")]


def test_chunks_of_odd_pages_equal_their_sql(spark, tmp_path):
    """Initials of two characters in lower case, cut-off references, Markdown marks, quotations and long texts, in the form of the tables' pages."""
    said = ["Here spoke İ. Smith of it. Then all of them left the room.", "Of A. B. Smith vs. them. “He left. Now” it is.", "### cut&amp;&amp", "*** x ** y. __z__ `a. B` &lt &quo", "word, " * 90, "Ω" * 361, "Same text. " * 30, "Same text. " * 30]
    html = [f"<html><body><article><h1>{t[:20]}</h1><p>{t}</p><p><b>{u}<br><p>{u} {t}</p></article><footer>&copy; x &middot; y</footer>" for t in said for u in said] + ["", None]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).toPandas().to_parquet(f"{tmp_path}/pages.parquet")
    got, want = both(registry.QUERIES["article_chunks"], registry.ORACLES["article_chunks"], spark, str(tmp_path))
    assert len(got) > 300 and got == want


def test_rules_of_blocks_run_once(spark):
    """Three passes for emphasis in a heading or a paragraph; a filter on the text must not repeat them."""
    plan = pages.article_blocks(spark.range(1).selectExpr("id", "string(id) as markdown"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(.+?)") == 6


def test_texts_and_titles(spark, tmp_path):
    (tmp_path / "my_book.txt").write_bytes(b"\xef\xbb\xbfHello")
    r = files.texts(spark, f"{tmp_path}/*.txt").select("text", files.file_title(F.col("path")).alias("t"), files.kind(F.col("path")).alias("k"), files.pasted_title(F.lit("\n " + "x" * 90), F.lit(" ")).alias("p")).first()
    assert (r.text, r.t, r.k, r.p) == ("Hello", "my book", "text", "x" * 80 + "…")
    (tmp_path / "latin.txt").write_bytes("caf\u00e9 ol\u00e9".encode("latin-1"))
    assert files.texts(spark, f"{tmp_path}/latin.txt").first().text == "caf\ufffd ol\ufffd"
    edges = {"start": [r"\*{3} START OF"], "end": [r"\*{3} END OF", "End of the text"]}
    raw = "head\n*** START OF THE BOOK\n\nProduced by A\nB\n\nBody [Illustration: x] here.\n*** END OF IT\ntail"
    assert spark.range(1).select(files.stripped_book(F.lit(raw), edges)).first()[0] == "Body  here."
    assert spark.range(1).select(files.stripped_book(F.lit("just text"), edges)).first()[0] == "just text"


def test_sinks(spark, tmp_path):
    path = f"{tmp_path}/t"
    d = spark.createDataFrame([(k, "old") for k in range(20)], "doc_id long, text string")
    sinks.replace_documents(d, path, 4)
    sinks.replace_documents(spark.createDataFrame([(3, "new"), (30, "new")], "doc_id long, text string"), path, 4)
    got = {r.doc_id: r.text for r in sinks.published(spark, path).collect()}
    assert got[3] == got[30] == "new" and got[4] == "old" and len(got) == 21
    first = set(sinks.folders(spark, path))
    sinks.replace_documents(spark.createDataFrame([(3, "newer"), (3, "twice")], "doc_id long, text string"), path, 4)
    assert len(first - set(sinks.folders(spark, path))) == 1  # only the part of document 3 was written again
    assert sorted(r.text for r in sinks.published(spark, path).filter("doc_id = 3").collect()) == ["newer", "twice"] and sinks.published(spark, path).count() == 22
    assert sinks.published(spark, f"{tmp_path}/p") is None
    sinks.publish(d, f"{tmp_path}/p")
    old = sinks.published(spark, f"{tmp_path}/p")
    sinks.publish(d.limit(5), f"{tmp_path}/p")
    assert sinks.published(spark, f"{tmp_path}/p").count() == 5 and old.count() == 20  # who reads the last version goes on
    sinks.publish(d.limit(6), f"{tmp_path}/p")
    assert len(list((tmp_path / "p").glob("data-*"))) == 2
    sinks.snapshot(spark, f"{tmp_path}/p", f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 6
    sinks.manifest(d.select(F.col("text").alias("path")), f"{tmp_path}/m")
    assert spark.read.text(f"{tmp_path}/m").count() == 20
    c = spark.createDataFrame([(1, k, "image/png", 5000) for k in range(30)] + [(1, 99, "image/gif", 5000), (2, 0, "image/png", 10)], "doc_id long, ord int, type string, bytes long")
    assert sinks.media_files(c).count() == 24
