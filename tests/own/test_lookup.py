import json

from pyspark.sql import functions as F

from quire.operators import lookup as L
from quire.operators import state
from quire.sources import pages, sinks

DAY = 86_400.0


def muse(word, *defs):
    return json.dumps([{"word": word, "defs": list(defs)}])


ANSWERS = [
    ("cat", "en", "datamuse", muse("cat", "n\tan animal"), 0.2),
    ("papered", "en", "datamuse", muse("papered", "v\tsimple past of paper"), 0.2), ("paper", "en", "datamuse", muse("paper", "n\ta sheet"), 0.3),
    ("mice", "en", "wiktionary", json.dumps({"en": [{"partOfSpeech": "Noun", "definitions": [{"definition": "plural of mousse"}]}]}), 0.1),
    ("two", "en", "wiktionary", json.dumps({"en": [{"partOfSpeech": "Numeral", "definitions": [{"definition": "one more than one"}]}]}), 0.5),
    ("two", "en", "datamuse", muse("two", "n\tlate"), 0.1), ("blank", "en", "datamuse", muse("other", "n\tno"), 0.1),
    ("chat", "fr", "wiktionary", json.dumps({"fr": [{"partOfSpeech": "Nom", "definitions": [{"definition": "un <b>animal</b>"}]}]}), 0.4),
]


def teller(spark):
    asked = []
    told = spark.createDataFrame(ANSWERS, "word string, lang string, provider string, payload string, took double")

    def ask(missing):
        asked.append(sorted((r.word, r.lang) for r in missing.collect()))
        return told.join(missing, ["word", "lang"], "left_semi")

    return ask, asked


def test_read_through(spark, tmp_path):
    ask, asked = teller(spark)
    path = f"{tmp_path}/cache"
    words = [("Cats", "en-GB", 1), ("papered", None, 2), ("mice", "en", 3), ("two", "en", 4), ("blank", "en", 5), ("chats", "fr", 6), ("chat", "FR", 7), ("", "en", 8), ("x" * 65, "en", 9), (None, None, 10), ("two", "en", 11)]
    requests = spark.createDataFrame(words, "word string, lang string, found int").withColumnRenamed("found", "n")

    def run(now):
        asked.clear()
        rows = {r.n: r for r in L.define(requests, path, ask, now).collect()}
        return {n: (r.found, r.form_of, r.provider, r.senses and r.senses[0].definition, r.cached) for n, r in rows.items()}

    want = {
        1: ("cat", None, "datamuse", "an animal"), 2: ("paper", "papered", "datamuse", "a sheet"), 3: ("mice", None, "wiktionary", "plural of mousse"), 4: ("two", None, "wiktionary", "one more than one"),
        7: ("chat", None, "wiktionary", "un animal"), 11: ("two", None, "wiktionary", "one more than one"),
    }
    full = {n: (*want.get(n, (None,) * 4), False if n in want else None) for n in range(1, 12)}
    assert run(1000.0) == full
    # Spellings after a hit are not asked for; base words are, in a second round; no word is asked for twice.
    assert asked[0] == sorted([("cats", "en"), ("papered", "en"), ("mice", "en"), ("two", "en"), ("blank", "en"), ("chats", "fr"), ("chat", "fr")])
    assert asked[1] == [("cat", "en")] and asked[2] == [("mousse", "en"), ("paper", "en")] and len(asked) == 3
    # Hits and misses are known now.
    again = run(2000.0)
    assert asked == [] and {n: v[:4] for n, v in again.items()} == {n: v[:4] for n, v in full.items()} and all(again[n][4] for n in want)
    # After a day the misses are asked for again, hits are not.
    run(1000.0 + DAY)
    assert asked == [[("blank", "en"), ("cats", "en"), ("chats", "fr")], [("mousse", "en")]]
    run(1000.0 + 90 * DAY + 1)
    assert ("two", "en") in asked[0]
    assert sinks.published(spark, path).count() == 10  # one row a word and language


def test_empty_requests(spark, tmp_path):
    ask, asked = teller(spark)
    assert L.define(spark.createDataFrame([], "word string, lang string"), f"{tmp_path}/c", ask, 0.0).count() == 0 and asked == []
    assert L.cached(spark, f"{tmp_path}/c").count() == 0


def test_translations_of_a_page_of_their_own_come_first(spark):
    rows = spark.createDataFrame([(1, ["a"], ["b"]), (2, [], ["b"]), (3, None, ["b"]), (4, None, None)], "k int, sub array<string>, page array<string>")
    assert [r[0] for r in rows.orderBy("k").select(state.preferred(F.col("sub"), F.col("page"))).collect()] == [["a"], ["b"], ["b"], []]


def test_character_set_of_a_page(spark):
    rows = [(1, "text/html; Charset='ISO-8859-1'", b""), (2, "text/html", b'<META http-equiv=x content="text/html; charset=windows-1252">'), (3, None, b"<p>"), (4, "text/html", None), (5, None, b" " * 5000 + b"<meta charset=x>")]
    got = spark.createDataFrame([(k, t, h and bytearray(h)) for k, t, h in rows], "k int, t string, h binary").orderBy("k").select(pages.charset(F.col("t"), F.col("h")))
    assert [r[0] for r in got.collect()] == ["iso-8859-1", "windows-1252", "utf-8", "utf-8", "utf-8"]


def test_sounds_are_cached_by_key(spark, tmp_path):
    kind = "key string, audio binary, duration double, text string, words array<string>, spans array<int>, aligned_by string"
    put = lambda *rows: sinks.sounds(spark.createDataFrame(rows, kind), f"{tmp_path}/s", 4)
    put(("a", bytearray(b"1"), 1.0, "t", ["t"], [0], "v1"), ("b", bytearray(b"2"), 2.0, "u", [], [], "v1"))
    put(("a", bytearray(b"3"), 3.0, "t", None, None, "v2"))
    assert sorted((r.key, bytes(r.audio), r.aligned_by) for r in sinks.published(spark, f"{tmp_path}/s").collect()) == [("a", b"3", "v2"), ("b", b"2", "v1")]
