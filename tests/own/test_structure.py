from quire.operators import catalog, ingest, structure

BODY = "This is a sentence that is long enough to stand alone. " * 3


def paras(spark, docs):
    return spark.createDataFrame([(k, p, t) for k, texts in docs.items() for p, t in enumerate(texts)], "id long, para int, text string")


def test_headings(spark):
    docs = {
        1: ["Chapter I", BODY, BODY, "THE FIRST DAY", "THE SECOND DAY", BODY, BODY, BODY],
        2: ["Chapter I", BODY],  # one is noise
        3: ["1. The Door", BODY, BODY, "2. The Room", BODY, BODY, "3. The Key", BODY, BODY],
        4: ["3. The Door", BODY, BODY, "2. The Room", BODY, BODY, "1. The Key", BODY, BODY],
        5: ["SHOUT ONE", BODY, BODY, "SHOUT TWO", BODY, BODY],
        6: ["SHOUT ONE", "SHOUT TWO", "SHOUT THREE", BODY, BODY, BODY],
        7: ["CHAPTER I", "CHAPTER II", "CHAPTER III", BODY],  # mostly headings
    }
    found = structure.heading_levels(paras(spark, docs)).collect()
    got = {k: [r.level for r in sorted(found, key=lambda r: r.para) if r.id == k] for k in docs}
    assert got[1] == [1, 0, 0, 2, 2, 0, 0, 0] and got[2] == [0, 0] and got[3] == [1, 0, 0, 1, 0, 0, 1, 0, 0]
    assert not any(got[4]) and not any(got[5]) and got[6] == [1, 1, 1, 0, 0, 0] and not any(got[7])
    chunks = structure.chunk_table(structure.heading_levels(paras(spark, {1: docs[1]})))
    assert [(r.level, r.title, r.idx) for r in structure.contents(chunks).orderBy("idx").collect()][0] == (1, "Chapter I", 0)


def test_printed_list_and_start(spark):
    text = "\n\n".join(["Title page", "CONTENTS", "Chapter I. The Start 1", "Chapter II. The End 9", "Chapter III. After 12", "Chapter I. The Start", BODY, BODY, BODY, BODY, "Chapter II. The End", BODY, BODY])
    docs = spark.createDataFrame([(1, text), (2, None), (3, BODY)], "doc_id long, text string")
    chunks, starts = structure.plain_documents(docs)
    rows = chunks.filter("id = 1").orderBy("idx").collect()
    assert rows[0].text.startswith("Title page") and not any("CONTENTS" in r.text for r in rows)
    assert {r.id: r.start_idx for r in starts.collect()} == {1: 1, 3: 0}


def test_progress_never_leaves_the_document(spark):
    old = spark.createDataFrame([(1, 0, "aa"), (1, 1, "bb"), (1, 2, "cc")], "id long, idx int, text string")
    new = spark.createDataFrame([(1, 0, "aabb"), (1, 1, "c")], "id long, idx int, text string")
    at = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "id long, idx int")
    assert {r.old_idx: r.idx for r in structure.moved_progress(old, new, at).collect()} == {0: 0, 1: 1, 2: 1}


def test_search_and_rules(spark):
    books = spark.createDataFrame(
        [(1, "War and Peace", "Tolstoy", "en", 50, "war", "History", True), (2, "Guerre", "X", "fr", 99, "warfare", "History", True), (3, "Peace", "Y", "en", 70, "", "Poetry", True), (4, "War", "Z", "en", 90, "", "", False)],
        "gid long, title string, authors string, language string, downloads int, subjects string, genres string, has_text boolean",
    ).selectExpr("*", "1000000 AS text_bytes", "true AS has_cover", "true AS curated", "'' AS description")
    page, total = catalog.search(books, "WAR")
    assert [r.gid for r in page.collect()] == [2, 1] and total.first().total == 2
    assert [r.gid for r in catalog.search(books, "war peace")[0].collect()] == [1]
    assert [r.gid for r in catalog.search(books, genre="History", language="fr")[0].collect()] == [2] and catalog.search(books, "zzz")[0].count() == 0
    assert [r.gid for r in catalog.search(books, page=1, per=2)[0].collect()] == [1]
    records = spark.createDataFrame([(7, "Text", "Public domain", ["en"], "Ulysses", ["Joyce, James"], [("Joyce, James", 1882, 1941), ("N", None, None)], ["Erotic fiction", "PR"], None, 3, None, [("a.txt", "9")])],
                                    "gid long, type string, rights string, languages array<string>, title string, creators array<string>, agents array<struct<name:string,birth:int,death:int>>, subjects array<string>, shelves array<string>, downloads long, description string, files array<struct<url:string,extent:string>>")
    r = ingest.parsed(records, spark.createDataFrame([(7,)], "gid long")).first()
    assert r.excluded == "racist_ideology, unverifiable_person, explicit" and r.skip is None and r.subjects == "Erotic fiction" and ingest.kept(ingest.parsed(records, records.select("gid"))).count() == 1


def test_furniture(spark):
    rows = [(1, p, 1000.0, y, y + 10, t) for p in range(1, 6) for y, t in ((20.0, f"Journal {p}"), (500.0, "same body"), (950.0, f"page {p} of 5"))]
    found = structure.furniture(spark.createDataFrame(rows, "id long, page int, page_height double, y0 double, y1 double, text string")).collect()
    assert {r.y0 for r in found if r.furniture} == {20.0, 950.0} and sum(r.furniture for r in found) == 10
