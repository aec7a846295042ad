"""Queries on keyed state and dictionary look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import state as S
from quire.operators.align import has_speech, speakable, word_times
from quire.plans.tables import spread, table
from quire.queries import query


def attempts(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return e.select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("event_id").alias("seq"))


@query("limiter", """
    WITH RECURSIVE a AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS t, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error'),
    f AS (
      SELECT key, seq, n, TRUE AS ok, [t] AS held FROM a WHERE n = 1
      UNION ALL
      SELECT a.key, a.seq, a.n, len(list_filter(f.held, lambda x: a.t - x <= 259200)) < 3,
        CASE WHEN len(list_filter(f.held, lambda x: a.t - x <= 259200)) < 3 THEN list_append(list_filter(f.held, lambda x: a.t - x <= 259200), a.t) ELSE f.held END
      FROM f JOIN a ON a.key = f.key AND a.n = f.n + 1)
    SELECT key, seq, ok FROM f""")
def limiter(spark, sf_dir):
    return S.admitted(attempts(spark, sf_dir), 3, 259_200).select("key", "seq", "ok")


@query("ttl_cache", """
    SELECT event_id, user_id FROM events, (SELECT max(epoch_us(ts) / 1e6) AS now FROM events)
    WHERE CASE WHEN event_type = 'error' THEN now - epoch_us(ts) / 1e6 < 86400 ELSE now - epoch_us(ts) / 1e6 <= 90 * 86400 END""")
def ttl_cache(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.when(F.col("event_type") != "error", F.col("props")).alias("payload"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("fetched_at")
    )
    now = e.agg(F.max("fetched_at")).first()[0] or 0.0
    return S.fresh_entries(e, now).select("event_id", "user_id")


@query("hedged_race", """
    WITH a AS (SELECT user_id, event_type AS provider, CASE WHEN event_id % 4 > 0 THEN props END AS payload, value AS took FROM events),
    l AS (SELECT user_id, min(took) AS missed FROM a WHERE provider = 'view' AND payload IS NULL GROUP BY user_id),
    s AS (SELECT a.*, took + CASE WHEN provider = 'view' THEN 0 ELSE least(5, coalesce(missed, 5)) END AS t0 FROM a LEFT JOIN l USING (user_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t0, provider) AS n FROM s WHERE payload IS NOT NULL)
    SELECT user_id, provider, round(t0, 6) AS at FROM r WHERE n = 1""")
def hedged_race(spark, sf_dir):
    i = F.col("event_id")
    a = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("provider"), F.when(i % 4 > 0, F.col("props")).alias("payload"), F.col("value").alias("took"))
    return S.race(a, ["user_id"], "view", 5.0).select("user_id", "provider", F.round("at", 6).alias("at"))


@query("coalesced_requests", "WITH w AS (SELECT DISTINCT props, sha1(props) AS h FROM events) SELECT event_id, h FROM events LEFT JOIN w USING (props)")
def coalesced_requests(spark, sf_dir):
    return S.coalesced(table(spark, sf_dir, "events").select("event_id", "props"), ["props"], lambda d: d.withColumn("h", F.sha1("props"))).select("event_id", "h")


@query("settings_coerced", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE greatest(0.5, least(3.0, value)) END AS speed FROM events")
def settings_coerced(spark, sf_dir):
    stored = F.when(F.col("event_id") % 4 == 0, "{bad").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", S.setting(stored, "speed").alias("speed"))


#: Events stand in for patches: each user sets knobs, takes them back, and tries one that does not exist.
_PATCHES = """
    p AS (SELECT user_id, event_id AS seq, ['catalog_full', 'dict_timeout_s', 'dict_hedge_ms', 'dict_providers', 'nothing'][event_id % 5 + 1] AS key, event_id % 7 = 0 AS reset, value FROM events),
    v AS (SELECT *, CASE WHEN reset THEN NULL WHEN key = 'catalog_full' THEN CASE WHEN seq % 2 = 0 THEN 'true' ELSE 'false' END WHEN key = 'dict_timeout_s' THEN CAST(seq % 9 + 0.5 AS VARCHAR)
      WHEN key = 'dict_hedge_ms' THEN CAST(seq % 900 AS VARCHAR) ELSE 'p' || seq END AS text FROM p)"""


def patches(spark, sf_dir):
    i = F.col("event_id")
    key = F.get(F.array(*[F.lit(x) for x in ("catalog_full", "dict_timeout_s", "dict_hedge_ms", "dict_providers", "nothing")]), (i % 5).cast("int"))
    text = (
        F.when(i % 7 == 0, "null").when(key == "catalog_full", F.when(i % 2 == 0, "true").otherwise("0")).when(key == "dict_timeout_s", (i % 9 + 0.5).cast("string"))
        .when(key == "dict_hedge_ms", F.concat((i % 900).cast("string"), F.lit(".75"))).otherwise(F.concat(F.lit('"p'), i.cast("string"), F.lit('"')))
    )
    return table(spark, sf_dir, "events").select("user_id", key.alias("key"), text.alias("value"), i.alias("seq"))


_DEFAULTS = ", ".join(f"('{k}', '{d}')" for k, (_, d) in S.KNOBS.items())


@query("settings_after", f"""
    WITH {_PATCHES}, l AS (SELECT user_id, key, arg_max_null(text, seq) AS text FROM v GROUP BY ALL), d(key, standard) AS (VALUES {_DEFAULTS}),
    u AS (SELECT DISTINCT user_id FROM p) SELECT u.user_id, d.key, coalesce(l.text, standard) AS value FROM u CROSS JOIN d LEFT JOIN l ON l.user_id IS NOT DISTINCT FROM u.user_id AND l.key = d.key""")
def settings_after(spark, sf_dir):
    return S.knobs_after(patches(spark, sf_dir), ["user_id"])[0]


@query("settings_rejected", f"WITH {_PATCHES} SELECT user_id, seq, key FROM v WHERE key = 'nothing'")
def settings_rejected(spark, sf_dir):
    return S.knobs_after(patches(spark, sf_dir), ["user_id"])[1].select("user_id", "seq", "key")


@query("reading_defaults", """
    WITH v AS (SELECT user_id, arg_max(event_id, event_id) AS last FROM events WHERE event_id % 3 = 0 GROUP BY user_id),
    s AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_id % 3 = 1 GROUP BY user_id)
    SELECT coalesce(v.user_id, s.user_id) AS user_id, CASE WHEN v.last % 2 = 0 THEN 'v' || v.last ELSE 'af_heart' END AS voice, CASE WHEN s.last % 4 > 0 THEN s.last % 4 / 2.0 ELSE 1.0 END AS speed
    FROM v FULL JOIN s ON v.user_id = s.user_id WHERE v.last % 2 = 0 OR s.last IS NOT NULL""")
def reading_defaults(spark, sf_dir):
    i = F.col("event_id")
    key = F.get(F.array(F.lit("voice"), F.lit("speed"), F.lit("other")), (i % 3).cast("int"))
    value = F.when(key == "voice", F.when(i % 2 == 0, F.concat(F.lit('"v'), i.cast("string"), F.lit('"')))).otherwise((i % 4 / 2.0).cast("string"))
    p = table(spark, sf_dir, "events").select("user_id", key.alias("key"), value.alias("value"), i.alias("seq"))
    found = S.reading_defaults(F.col("prefs"))
    return S.preferences(p, ["user_id"]).select("user_id", found["voice"].alias("voice"), found["speed"].alias("speed"))


@query("provider_entries", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'noun|a & b “' || event_type || '”;verb|to go' WHEN 1 THEN 'noun|' || event_type || ' one;|x < y' WHEN 2 THEN CASE WHEN event_id % 8 = 2 THEN 'noun|said ' || event_type END END AS senses,
      CASE WHEN event_id % 8 = 2 THEN '/p/' END AS phonetic FROM events""")
def provider_entries(spark, sf_dir):
    """Answers of three providers, made from events, read into senses."""
    i, kind = F.col("event_id"), F.col("event_type")
    wiki = F.concat(F.lit('{"fr": [{"partOfSpeech": "X", "definitions": [{"definition": "no"}]}], "en": [{"partOfSpeech": "Noun", "definitions": [{"definition": "{{rfdef}}"}, {"definition": "<b>a</b> &amp; b &#8220;'), kind, F.lit('&#x201d;", "examples": ["e"]}]}, {"partOfSpeech": "Verb", "definitions": [{"definition": "to go"}, {"definition": "more"}]}]}'))
    muse = F.concat(F.lit('[{"word": "W", "defs": ["n\\t'), kind, F.lit(' one", "n\\tagain", "u\\tx &lt; y", "v\\t"]}]'))
    api = F.concat(F.lit('[{"word": "w", "phonetic": " ", "phonetics": [{"text": ""}, {"text": "/p/"}], "meanings": [{"partOfSpeech": "noun", "definitions": [{"definition": "said '), kind, F.lit('", "example": "x"}]}, {"partOfSpeech": "verb", "definitions": []}]}]'))
    provider = F.get(F.array(*[F.lit(x) for x in ("wiktionary", "datamuse", "dictionaryapi", "none")]), (i % 4).cast("int"))
    payload = F.when(i % 4 == 0, wiki).when(i % 4 == 1, muse).otherwise(api)
    lang = F.when((i % 4 == 2) & (i % 8 != 2), "fr").otherwise("en")
    found = spread(table(spark, sf_dir, "events")).select("event_id", S.entry(payload, provider, F.lit("w"), lang).alias("e"))
    told = F.array_join(F.transform("e.senses", lambda s: F.concat(s.pos, F.lit("|"), s.definition)), ";")
    return found.select("event_id", told.alias("senses"), F.col("e.phonetic").alias("phonetic"))


_WORDS = r"w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(coalesce(text, ''), '\p{L}+'))) AS word FROM documents WHERE doc_id < 1000000)"
_SPELL = """
    sp AS (SELECT word, list_filter([word, CASE WHEN word LIKE '%ies' AND length(word) > 4 THEN word[:-4] || 'y' END, CASE WHEN word LIKE '%es' AND length(word) > 4 THEN word[:-3] END,
      CASE WHEN word LIKE '%s' AND word NOT LIKE '%ss' AND length(word) > 3 THEN word[:-2] END, CASE WHEN word LIKE '%ing' AND length(word) > 5 THEN word[:-4] END, CASE WHEN word LIKE '%ing' AND length(word) > 5 THEN word[:-4] || 'e' END,
      CASE WHEN word LIKE '%ed' AND length(word) > 4 THEN word[:-3] END, CASE WHEN word LIKE '%ed' AND length(word) > 4 THEN word[:-2] END], lambda x: x IS NOT NULL) AS c FROM w)""".replace("[:-4]", "[:length(word) - 3]").replace("[:-3]", "[:length(word) - 2]").replace("[:-2]", "[:length(word) - 1]")
_WORDS = _WORDS.replace(" WHERE doc_id < 1000000", "")


def distinct_words(spark, sf_dir):
    each = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{L}+"), F.lit(0)))
    return table(spark, sf_dir, "documents").select(each.alias("word")).select(F.lower("word").alias("word")).distinct()


@query("word_lookup", f"""
    WITH {_WORDS}, {_SPELL}, cache AS (SELECT word, md5(word) AS payload FROM w WHERE NOT (word LIKE '%s' OR word LIKE '%ed')),
    t AS (SELECT word, unnest(c) AS spelling, generate_subscripts(c, 1) AS pos FROM sp),
    f AS (SELECT t.word, arg_min(spelling, pos) AS spelling, arg_min(payload, pos) AS payload FROM t JOIN cache ON cache.word = t.spelling GROUP BY t.word)
    SELECT w.word, spelling, payload FROM w LEFT JOIN f USING (word)""")
def word_lookup(spark, sf_dir):
    w = distinct_words(spark, sf_dir)
    cache = w.filter("not (word like '%s' or word like '%ed')").withColumn("payload", F.md5("word"))
    return S.first_found(w, cache)


@query("definitions", f"""
    WITH {_WORDS}, {_SPELL}, e AS (SELECT word, CASE WHEN word LIKE '%e' AND length(word) > 3 THEN ['plural of ' || word[:length(word) - 1]] ELSE ['sense of ' || word, 'more'] END AS senses FROM w WHERE word NOT LIKE '%s'),
    t AS (SELECT word, unnest(c) AS spelling, generate_subscripts(c, 1) AS pos FROM sp),
    f AS (SELECT t.word, arg_min(spelling, pos) AS spelling, arg_min(senses, pos) AS senses FROM t JOIN e ON e.word = t.spelling GROUP BY t.word),
    b AS (SELECT *, CASE WHEN senses[1] LIKE 'plural of %' THEN senses[1][11:] END AS base FROM f),
    spb AS (SELECT base AS word, list_filter([base, CASE WHEN base LIKE '%ies' AND length(base) > 4 THEN base[:length(base) - 3] || 'y' END, CASE WHEN base LIKE '%es' AND length(base) > 4 THEN base[:length(base) - 2] END,
      CASE WHEN base LIKE '%s' AND base NOT LIKE '%ss' AND length(base) > 3 THEN base[:length(base) - 1] END, CASE WHEN base LIKE '%ing' AND length(base) > 5 THEN base[:length(base) - 3] END, CASE WHEN base LIKE '%ing' AND length(base) > 5 THEN base[:length(base) - 3] || 'e' END,
      CASE WHEN base LIKE '%ed' AND length(base) > 4 THEN base[:length(base) - 2] END, CASE WHEN base LIKE '%ed' AND length(base) > 4 THEN base[:length(base) - 1] END], lambda x: x IS NOT NULL) AS c FROM (SELECT DISTINCT base FROM b WHERE base IS NOT NULL)),
    h AS (SELECT base, arg_min(spelling, pos) AS too, arg_min(senses, pos) AS senses FROM (SELECT word AS base, unnest(c) AS spelling, generate_subscripts(c, 1) AS pos FROM spb) JOIN e ON e.word = spelling GROUP BY base)
    SELECT w.word, coalesce(h.too, b.spelling) AS found, CASE WHEN h.too IS NOT NULL THEN b.spelling END AS form_of, array_to_string(coalesce(h.senses, b.senses), ';') AS senses
    FROM w LEFT JOIN b USING (word) LEFT JOIN h ON h.base = b.base""")
def definitions(spark, sf_dir):
    """Every word of the documents; words in s have no entry of their own, some in e are said to be plurals."""
    w = distinct_words(spark, sf_dir)
    plural = F.array(F.concat(F.lit("plural of "), F.expr("substring(word, 1, length(word) - 1)")))
    senses = F.when(F.col("word").endswith("e") & (F.length("word") > 3), plural).otherwise(F.array(F.concat(F.lit("sense of "), "word"), F.lit("more")))
    entries = w.filter("not word like '%s'").select("word", senses.alias("senses"))
    return S.defined(w, entries).select("word", "found", "form_of", F.array_join("senses", ";").alias("senses"))


@query("speakable_texts", r"""
    SELECT conv_id, turn, translate(regexp_replace('[a] {b} | -- ' || coalesce(text, ''), '--+', '—', 'g'), '[]{}|', '()(),') AS said, regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]') AS speech FROM conversations""")
def speakable_texts(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", speakable(F.concat(F.lit("[a] {b} | -- "), t)).alias("said"), has_speech(t).alias("speech"))


@query("word_estimate", r"""
    WITH s AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
    w AS (SELECT *, regexp_extract_all(text, '[\p{L}\p{N}_][\p{L}\p{N}_''’-]*') AS t FROM s),
    e AS (SELECT conv_id, turn, generate_subscripts(t, 1) - 1 AS k, unnest(t) AS word, length(text) / 15.0 AS d, len(t) AS n, length(array_to_string(t, '')) AS chars FROM w),
    c AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY conv_id, turn ORDER BY k) AS done FROM e)
    SELECT conv_id, turn, CAST(k AS INTEGER) AS k, word, round(d * (done - length(word) - 1) / (chars + n), 3) AS start, round(d * done / (chars + n), 3) AS "end" FROM c""")
def word_estimate(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    found = word_times(s.withColumn("seconds", F.length("text") / 15.0), "text", "seconds", "conv_id", "turn")
    return found.select("conv_id", "turn", "k", "word", "start", "end")


@query("cache_keys", "SELECT conv_id, turn, sha1(CASE WHEN role = 'user' THEN 'af_heart' ELSE 'ef_dora' END || '|1.00|' || coalesce(text, '')) AS key FROM conversations")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.sound_key(F.col("text"), F.when(F.col("role") == "user", "af_heart").otherwise("ef_dora")).alias("key"))


@query("senses_on_top", """
    WITH s AS (SELECT user_id AS word, event_type AS pos, event_id AS place, props AS text, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
    f AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY place) AS k FROM s WHERE n = 1)
    SELECT word, pos, place, text FROM f WHERE k <= 4""")
def senses_on_top(spark, sf_dir):
    """Users stand in for words, types of events for parts of speech."""
    e = table(spark, sf_dir, "events")
    return S.top_senses(e.select(F.col("user_id").alias("word"), F.col("event_type").alias("pos"), F.col("event_id").alias("place"), F.col("props").alias("text")))


@query("normal_words", r"SELECT conv_id, turn, lower(regexp_replace(replace(coalesce(text, ''), chr(173), ''), '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')) AS word FROM conversations")
def normal_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.normal_word(F.coalesce("text", F.lit(""))).alias("word"))


@query("lookup_guards", r"""
    WITH d AS (SELECT conv_id, turn, ['fr', 'en', 'x1', 'DE-at'][turn % 4 + 1] AS dst, lower(regexp_replace(replace(coalesce(text, ''), chr(173), ''), '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')) AS w FROM conversations)
    SELECT conv_id, turn, CASE WHEN dst IN ('fr', 'DE-at') AND length(w) BETWEEN 1 AND 64 THEN w END AS word FROM d""")
def lookup_guards(spark, sf_dir):
    dst = F.get(F.array(*[F.lit(x) for x in ("fr", "en", "x1", "DE-at")]), (F.col("turn") % 4).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.translatable(F.coalesce("text", F.lit("")), F.lit(None).cast("string"), dst).alias("word"))


@query("printable_log", r"SELECT event_id, left(regexp_replace(chr(7) || props || chr(10) || event_type, '[\x00-\x1f\x7f-\x{9f}]', ' ', 'g'), 20) AS line FROM events")
def printable_log(spark, sf_dir):
    said = F.concat(F.lit("\x07"), F.col("props"), F.lit("\n"), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", X.printable(said, 20).alias("line"))
