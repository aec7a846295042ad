import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import kernels as K
from quire.functions import reading as R
from quire.functions import text as X
from quire.operators import layout

SF = "/root/testdata/sf0.001"


def slow_sentences(paragraph):
    """The rules, one after the other, on plain strings."""
    cut = re.sub(r"([.!?])([\"'”’)\]]?)\s+([\"'“‘(\[A-Z0-9])", "\\1\\2\x01\\3", paragraph)
    out = []
    for p in filter(None, map(str.strip, cut.split("\x01"))):
        m = re.search(r"(\b[\w.]+)\.$", out[-1]) if out else None
        word = m.group(1).lower().rstrip(".") if m else ""
        if m and (word in X.ABBREVIATIONS or len(word) == 1 and word.isalpha()):
            out[-1] += " " + p
        else:
            out.append(p)
    done = []
    for p in out:
        last = done[-1] if done else ""
        curly = last.count("“") - last.count("”")
        is_open = curly > 0 if curly else "“" not in last and last.count('"') % 2 == 1
        if done and is_open and len(last) + len(p) < X.MAX_CHARS:
            done[-1] += " " + p
        else:
            done.append(p)
    return done


def slow_chunks(paragraph):
    joined = []
    for s in slow_sentences(paragraph):
        if joined and len(joined[-1]) < X.MIN_CHARS:
            joined[-1] += " " + s
        else:
            joined.append(s)
    out = []
    for s in joined:
        while len(s) > X.MAX_CHARS:
            head = s[: X.MAX_CHARS]
            cut = max(head.rfind(m) for m in ("; ", ": ", ", "))
            cut = cut if cut >= X.MAX_CHARS * 0.4 else head.rfind(" ")
            size = X.MAX_CHARS if cut <= 0 else cut + 1
            out.append(s[:size].strip())
            s = s[size:].strip()
        out.append(s)
    return [s for s in out if s]


def test_chunks_equal_the_slow_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    rows = [r.text for r in docs.collect() if r.text]
    flat = [" ".join(t.split()) for t in rows] + ["Mr. A. Smith said no. Then “he left. Now” it is. Ok.", "", "x" * 900, "a; " * 300, 'He said "Stop. Listen" twice. And "so. On', "É. Été. No. 5 is it."]
    got = [list(r.c) for r in spark.createDataFrame([(k, t) for k, t in enumerate(flat)], "k int, t string").select("k", X.chunks(F.col("t")).alias("c")).orderBy("k").collect()]
    assert got == [slow_chunks(t) for t in flat]


def test_kernels_equal_the_column_functions(spark):
    """Units of whole texts, by folds on the JVM and by kernels in Arrow batches."""
    rng = random.Random(6)
    bits = ["Mr.", "A.", "he said", "“No.", "Yes!”", '"Why?', 'So."', "etc.", "(i.e.", "e.g.)", "x" * 40, "y, " * 60, "z" * 800, ". ", "! ", "? A", "é.", "É", "\u2003", "\xa0", "\u00a0 ", "-\n", "\n", "\n\n", "\r\n", "\r", "\t", " \n \n", "\x85", "\u3000", "1.", "‐\nb", "ß.", "\u0301.", "…", ";", ": "]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    both = frame.select("k", X.clean_paragraphs(F.col("t")).alias("p"), X.units(F.col("t")).alias("u")).collect()
    for r in both:
        assert R.paragraphs(texts[r.k]) == list(r.p), texts[r.k]
        assert R.units(texts[r.k]) == list(r.u), texts[r.k]


def test_initials_of_two_characters_in_lower_case(spark):
    """İ with a full stop is an initial, in the kernel and in the column functions."""
    t = "Here spoke İ. Smith of it. Then all of them left the room."
    want = ["Here spoke İ. Smith of it.", "Then all of them left the room."]
    assert R.sentences(t) == want and one(spark, X.sentences(F.lit(t))) == want


def test_exploded_texts(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS", 3)
    rows = [(k, t, k % 2 == 0) for k, t in enumerate(["a b", "", None, "c d e f g", "h i", "j"] * 3)]
    frame = spark.createDataFrame(rows, "k int, t string, w boolean").coalesce(1)
    split = lambda t: (t or "").split()
    got = [tuple(r) for r in R.exploded(frame, "t", split, "n", "k").collect()]
    assert got == [(k, n, x) for k, t, _ in rows for n, x in enumerate(split(t))]
    got = [tuple(r) for r in R.exploded(frame, "t", split, "n", "k", "t", to="x", whole="w").collect()]
    assert got == [(k, t, n, x) for k, t, w in rows for n, x in enumerate([t] if w else split(t))]
    assert R.exploded(frame.limit(0), "t", split, "n", "k").count() == 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.text(alphabet="aB .!?;,:\"“”'1É", max_size=600), min_size=1, max_size=12))
def test_chunks_lose_nothing(spark, texts):
    flat = [" ".join(t.split()) for t in texts]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(flat)], "k int, t string").select("k", "t", X.chunks(F.col("t")).alias("c")).collect()
    for r in got:
        assert "".join("".join(r.c).split()) == "".join(r.t.split()) and all(len(c) <= X.MAX_CHARS for c in r.c)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("one\ntwo\n\nthree\n \nfour", ["one\ntwo", "three", "four"]), ("a.\nb.\nc.", ["a.", "b.", "c."]), ("wrapped\nlines that\ngo on\nand on.", ["wrapped\nlines that\ngo on\nand on."]),
        ("a\r\nb", ["a", "b"]), (" \n ", []), (None, []),
    ],
)
def test_paragraphs(spark, text, want):
    assert one(spark, X.paragraphs(F.lit(text).cast("string"))) == want


def test_small_functions(spark):
    assert one(spark, X.clean_paragraph(F.lit("infor-\nmation  is\n here  "))) == "information is here"
    assert [one(spark, X.roman(F.lit(s))) for s in ("IV.", "xii", "12", "MCMXC", "abc", "")] == [4, 12, 12, 1990, None, None]
    assert [one(spark, X.heading_kind(F.lit(s))) for s in ("Chapter IV. The End", "XII.", "3. The Door", "THE END", "Plain words", "A" * 91)] == ["explicit", "numeral", "numtitle", "allcaps", None, None]
    assert one(spark, X.inline_markdown(F.lit("> **Bold _and_ so** [link](http://a) \\*"))) == "Bold and so link *"
    assert one(spark, X.spellings(F.lit("running"))) == ["running", "runn", "runne"] and one(spark, X.spellings(F.lit("cities"))) == ["cities", "city", "citi", "citie"]
    assert one(spark, X.normal_word(F.lit("“Wha­le's!”"))) == "whale's"
    assert one(spark, X.display_name(F.lit("Chambers, Robert W. (Robert William)"))) == "Robert W. Chambers"
    assert one(spark, X.display_title(F.lit("A : $b tale\n\nof two"))) == "A : tale: of two" and one(spark, X.reading_minutes(F.lit(500_000))) == 518


def test_hosts_and_addresses(spark):
    assert [one(spark, K.web_address(F.lit(t))) for t in ("example.org/x", "http://a.b", "ftp://a.b", "nodot")] == ["https://example.org/x", "http://a.b", None, None]


def test_audio_seconds():
    frame = b"\xff\xfb\x90\x00" + b"\0" * 413  # MPEG 1, 128 kbit/s, 44.1 kHz: 417 bytes
    assert abs(K.seconds_of(frame * 10) - 10 * 1152 / 44100) < 1e-9
    tag = bytearray(frame)
    tag[36:44] = b"Xing\0\0\0\0"
    tag[44:48] = b"LAME"
    tag[65:68] = (576 << 12 | 100).to_bytes(3, "big")
    assert abs(K.seconds_of(b"ID3\4\0\0\0\0\0\3abc" + bytes(tag) + frame * 10) - (11520 - 676) / 44100) < 1e-9
    assert K.seconds_of(b"") == K.seconds_of(b"\xff" * 9) == 0


def slow_stitch(pages):
    """The rule page by page: {page: paragraphs}, each page seen as the one before left it."""
    out = {k: list(v) for k, v in pages.items()}
    for k in sorted(out):
        here, there = out[k], out.get(k + 1)
        if not here or not there:
            continue
        tail, head = here[-1], there[0]
        cut_word = re.search(r"[^\W_][-‐]$", tail)
        if not cut_word and (re.search(r"[.!?][\"'”’)\]]*$", tail) or len(tail) < 40 or not head[:1].islower()):
            continue
        m = re.search(r"[.!?][\"'”’)\]]*(?=\s|$)", head)
        moved, rest = (head[: m.end()], head[m.end() :].strip()) if m else (head, "")
        here[-1] = tail[:-1] + moved if cut_word and moved[:1].isalnum() else f"{tail} {moved}"
        out[k + 1] = ([rest] if rest else []) + there[1:]
    return out


def stitched(spark, docs):
    rows = [(d, k, n, t) for d, pages in enumerate(docs) for k, paras in pages.items() for n, t in enumerate(paras)]
    table = spark.createDataFrame(rows, "id long, page int, para int, text string").repartition(3)
    out = [{} for _ in docs]
    for r in layout.stitch(table).orderBy("id", "page", "para").collect():
        out[r.id].setdefault(r.page, []).append(r.text)
    return out


def test_stitched_pages(spark):
    tail = "this is a long paragraph that does not end on its own page"
    rng = random.Random(6)
    texts = [tail, "but here. Next one.", "and this.", "X.", "a bro-", "ken word. More.", "no end at all", "Capital", tail + ". and so on, " + tail, "1-", "short. " + tail, "é ça! " + tail, '"q" it. ' + tail + "-", "a:", tail + ":"]
    docs = [{1: [tail], 2: ["but here. Next one."], 3: ["X."]}, {1: [tail], 2: ["and this."], 3: ["no."]}, {1: [tail], 3: ["and this."]}]
    docs += [{k: [rng.choice(texts) for _ in range(rng.choice([1, 1, 1, 2]))] for k in range(1, 9) if rng.random() < 0.95} for _ in range(150)]
    want = [{k: v for k, v in slow_stitch(d).items() if v} for d in docs]
    assert stitched(spark, docs) == want
    assert want[0][1] == [tail + " but here."] and 2 not in want[1] and want[2][1] == [tail]
    assert layout.stitch(spark.createDataFrame([], "id long, page int, para int, text string")).count() == 0


def test_printed_lists(spark):
    body = ["Chapter I. The Start", "It was a long time ago that all of this took place, " * 4, "More."]
    front = ["CONTENTS", "Chapter I. The Start 1", "Chapter II. The End 20", "Chapter III. After 31"]
    pictures = ["List of Illustrations", "The mill", "The house", "The old bridge", "A fair day"]
    letters = "Contents " + " ".join(f"Letter {k}" for k in range(9))
    prose = "Nobody knew where the road went or who had made it, and so they stayed at home. " * 3
    cases = [
        (["Title", *front, *body], ["Title", *body], 1), (["Title", *body], ["Title", *body], 0), ([letters, *body], body, 0),
        ([*front, *pictures, prose, *body], [*pictures[2:], prose, *body], 0), ([*front[:3], *body], [*front[:3], *body], 0), (["x"] * 200 + front, ["x"] * 200 + front, 0),
        (["Contents", "stray", "stray", *front[1:], "stray", "stray", prose], ["stray", "stray", prose], 0), ([], [], 0),
    ]
    rows = [(k, n, t) for k, (paras, _, _) in enumerate(cases) for n, t in enumerate(paras)]
    got = layout.strip_printed_lists(spark.createDataFrame(rows, "id int, para int, text string")).orderBy("id", "para").collect()
    for k, (_, want, start) in enumerate(cases):
        mine = [r for r in got if r.id == k]
        assert [r.text for r in mine] == want and {r.start for r in mine} <= {start} and [r.para for r in mine] == list(range(len(want))), k


def test_located_words():
    sentence = "The happy-go-lucky café is in-­formal today"
    page = "x The happy-go-lucky cafe is infor mal today".split()
    got = layout.located(sentence, page)
    assert [sentence[a:b] for a, b, _ in got] == sentence.split() and got[4][2] == [5, 6]
    assert layout.located("Nothing here at all", page) == [] and layout.located("", []) == []
    twice = "the dog ran the dog ran home the end".split()
    assert [p for *_, at in layout.located("the dog ran home", twice) for p in at] == [3, 4, 5, 6]
    far = "one two x x x x x three four".split()
    assert len(layout.located("one two three four", far)) == 4 and layout.located("one z", ["one"]) == []


def test_located_whole_sentences(monkeypatch):
    """A sentence that stands on its page is placed as the longest chain would place it, without any cells."""
    import random

    from quire.operators import layout

    r = random.Random(7)
    cases = []
    for _ in range(2000):
        page = ["".join(r.choice("ab-") for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 12))]
        at = r.randrange(len(page))
        cases.append((" ".join(page[at : at + r.randint(1, 8)]), page))
    got = [layout.located(*c) for c in cases]
    with monkeypatch.context() as m:
        m.setattr(layout, "whole", lambda tokens, page: None)
        assert got == [layout.located(*c) for c in cases]
    long = [f"w{k % 50}" for k in range(20_000)]
    monkeypatch.setattr(layout, "cells_of", None)
    assert [at for *_, at in layout.located(" ".join(long), long)] == [[k] for k in range(len(long))]


def test_word_boxes_by_pages(spark):
    """Sentences meet the words of their page, null keys too; a word that a page breaks has the box of its parts, marks between aside."""
    from quire.operators import layout

    said = spark.createDataFrame([(1, 1, 0, "One infor-mal word"), (1, 1, 1, "and more"), (None, 1, 0, "One two"), (2, 1, 0, "no page")], "id int, page int, idx int, text string")
    words = [(1, 1, k, 10.0 * k, 5.0, 10.0 * k + 9, 9.0 + k, w) for k, w in enumerate(["One", "infor", "--", "mal", "word", "and", "more"])]
    words += [(None, 1, k, 1.0, 1.0, 2.0, 2.0, w) for k, w in ((1, "two"), (0, "One"))]
    page = spark.createDataFrame(words, "id int, page int, ord int, x0 double, y0 double, x1 double, y1 double, word string")
    got = sorted((tuple(r) for r in layout.word_boxes(said, layout.paged(page)).collect()), key=str)
    assert got == [
        (1, 1, 0, 0, 3, 0.0, 5.0, 9.0, 9.0), (1, 1, 0, 14, 18, 40.0, 5.0, 49.0, 13.0), (1, 1, 0, 4, 13, 10.0, 5.0, 39.0, 12.0),
        (1, 1, 1, 0, 3, 50.0, 5.0, 59.0, 14.0), (1, 1, 1, 4, 8, 60.0, 5.0, 69.0, 15.0), (None, 1, 0, 0, 3, 1.0, 1.0, 2.0, 2.0), (None, 1, 0, 4, 7, 1.0, 1.0, 2.0, 2.0),
    ]


def test_words_are_heard_in_small_parts(monkeypatch):
    """A batch of many rows gives its spans part by part, whole and in order, empty rows and long ones too."""
    import pyarrow as pa

    from quire.operators import align

    class Rows:
        schema = type("Schema", (), {"fields": []})()

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(align, "AT_ONCE", 64)
    texts = [*[f"word{k} and “more” of {k}" for k in range(100)], "", None, "long " * 200]
    kind = pa.list_(pa.struct([("word", pa.string()), ("start", pa.float64()), ("end", pa.float64())]))
    said = [[{"word": w, "start": k * 0.5, "end": k + 0.5} for k, w in enumerate((t or "").split())] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([*said[:-3], None, [], said[-1]], kind)], names=["text", "words"])
    got = list(align.aligned(Rows())([batch]))
    assert len(got) > 5 and [t for b in got for t in b.column("text").to_pylist()] == texts
    want = [align.heard(t or "", [(w["word"], w["start"], w["end"]) for w in ws]) for t, ws in zip(texts, said, strict=True)]
    assert [[tuple(s.values()) for s in row] for b in got for row in b.column("spans").to_pylist()] == want


def test_long_texts_leave_in_parts(monkeypatch):
    """A batch's texts leave a kernel when they have so many characters, whatever their number."""
    import pyarrow as pa

    class Docs:
        schema = {"id": None}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(R.T, "StructType", lambda fields: fields)
    batch = pa.RecordBatch.from_pydict({"id": list(range(9)), "text": ["a" * 600_000 + "\n\nb"] * 8 + [None]})
    got = list(R.exploded(Docs(), "text", R.paragraphs, "para", "id")([batch]))
    assert [r for b in got for r in zip(b["id"].to_pylist(), b["para"].to_pylist(), strict=True)] == [(k, p) for k in range(8) for p in (0, 1)]
    assert len(got) >= 4 and max(sum(map(len, b["text"].to_pylist())) for b in got) < 2 * R.CHARS


def test_only_documents_with_openers_are_marked(spark, monkeypatch):
    """Lines are marked only where one of the first opens a list; the others pass as they are."""
    seen, marked = [], layout.marked
    monkeypatch.setattr(layout, "marked", lambda d: seen.append(d) or marked(d))
    lines = ["CONTENTS", "Chapter I. 1", "Chapter II. 20", "Chapter III. 31", "A verse"]
    prose = "It was a long time ago, and nobody knew where he was, or why he had gone there, or when he would be home again. " * 2
    rows = [(1, k, t) for k, t in enumerate([*lines, prose, prose])] + [(2, k, prose) for k in range(3)]
    rows += [(3, k, prose) for k in range(layout.LOOK)] + [(3, layout.LOOK + k, t) for k, t in enumerate(lines)]
    got = layout.strip_printed_lists(spark.createDataFrame(rows, "id int, para int, text string"))
    assert [r.id for r in seen[0].select("id").distinct().collect()] == [1]
    kept = got.groupBy("id").count().collect()
    assert {r.id: r["count"] for r in kept} == {1: 3, 2: 3, 3: layout.LOOK + 5}
