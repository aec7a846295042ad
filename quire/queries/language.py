"""Queries on language detection and voices."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import language as L
from quire.operators import structure as S
from quire.plans.tables import spread, table
from quire.queries import query
from quire.queries.structure import PIECES_SQL, piece_table

_LISTS = ", ".join(f"({k}, '{lang}', [{', '.join(repr(w) for w in ws)}])" for k, (lang, ws) in enumerate(L.WORDS.items()))
_ACCENTS = ", ".join(f"('{lang}', '{c}')" for c, lang in L.ACCENTS.items())
_SCORES = rf"""
    d AS (SELECT doc_id, lower(left(coalesce(text, ''), {L.MAX_TEXT})) AS low, left(coalesce(text, ''), {L.MAX_TEXT}) AS t FROM documents),
    w AS (SELECT doc_id, low, t, regexp_extract_all(low, '\p{{L}}+') AS tok FROM d),
    lists(o, lang, listed) AS (VALUES {_LISTS}),
    accents(lang, c) AS (VALUES {_ACCENTS}),
    hit AS (SELECT doc_id, lang, count(*) AS n, count(DISTINCT x) AS k FROM (SELECT doc_id, unnest(tok) AS x FROM w) JOIN (SELECT lang, unnest(listed) AS y FROM lists) ON x = y GROUP BY ALL),
    acc AS (SELECT doc_id, lang, sum(least((length(low) - length(replace(low, c, ''))) / len(tok), {L.ACCENT_CAP})) AS a FROM w, accents WHERE len(tok) > 0 GROUP BY ALL),
    score AS (
      SELECT w.doc_id, o, lists.lang, len(tok) AS total, coalesce(hit.n, 0) / len(tok) + coalesce(a, 0) AS s, coalesce(k, 0) AS k
      FROM w CROSS JOIN lists LEFT JOIN hit ON hit.doc_id = w.doc_id AND hit.lang = lists.lang LEFT JOIN acc ON acc.doc_id = w.doc_id AND acc.lang = lists.lang WHERE len(tok) > 0)"""


@query("lang_scores", f"WITH {_SCORES} SELECT doc_id, lang, CAST(k AS INTEGER) AS distinct_words, round(s, 6) AS score FROM score")
def lang_scores(spark, sf_dir):
    d = L.scored(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", F.inline("_ranked"))
    return d.select("doc_id", "lang", F.col("distinct").alias("distinct_words"), F.round(-F.col("minus"), 6).alias("score"))


@query("lang_detect", rf"""
    WITH {_SCORES}, r AS (
      SELECT doc_id, total, s, k, lang, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, o) AS n, lead(s) OVER (PARTITION BY doc_id ORDER BY s DESC, o) AS next FROM score),
    l AS (
      SELECT doc_id, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\x{{0900}}-\x{{097F}}]|[^\p{{L}}]', '', 'g')) AS dev,
        length(regexp_replace(t, '[^\x{{3040}}-\x{{30FF}}]|[^\p{{L}}]', '', 'g')) AS kana, length(regexp_replace(t, '[^\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}]|[^\p{{L}}]', '', 'g')) AS han,
        length(regexp_replace(t, '[^\x{{AC00}}-\x{{D7AF}}]|[^\p{{L}}]', '', 'g')) AS hangul, length(regexp_replace(t, '[^\x{{0041}}-\x{{024F}}]|[^\p{{L}}]', '', 'g')) AS latin FROM d),
    s AS (
      SELECT doc_id, CASE WHEN letters < 40 THEN NULL WHEN dev / letters >= 0.15 THEN 'hi' WHEN kana / letters >= 0.05 THEN 'ja'
        WHEN han / letters >= 0.15 THEN CASE WHEN kana > han * 0.1 THEN 'ja' ELSE 'zh' END WHEN hangul / letters >= 0.15 OR latin / letters < 0.5 THEN '' END AS script FROM l)
    SELECT s.doc_id, CASE WHEN script IS NOT NULL THEN nullif(script, '')
      WHEN total >= 25 AND r.s >= 0.045 AND k >= 8 AND (next = 0 OR r.s >= next * 1.30) THEN lang END AS detected
    FROM s LEFT JOIN r ON r.doc_id = s.doc_id AND r.n = 1""")
def lang_detect(spark, sf_dir):
    return L.detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "detected")


@query("lang_sample", f"""
    WITH {PIECES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM pieces),
    c AS (SELECT *, CASE WHEN n >= 20 THEN n // 10 ELSE 0 END AS start, length(trim(text)) AS size FROM n WHERE length(trim(text)) >= 12),
    s AS (
      SELECT *, coalesce(sum(CASE WHEN idx >= start THEN size END) OVER w, 0) AS s1, coalesce(sum(size) OVER w, 0) AS s0,
        coalesce(sum(CASE WHEN idx >= start THEN size END) OVER (PARTITION BY doc_id), 0) AS total
      FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT doc_id AS id, string_agg(trim(text), ' ' ORDER BY idx) AS text FROM s WHERE CASE WHEN total >= 400 THEN idx >= start AND s1 < 8000 ELSE s0 < 8000 END GROUP BY doc_id""")
def lang_sample(spark, sf_dir):
    return L.sample(piece_table(spark, sf_dir).select(F.col("doc_id").alias("id"), "idx", "text"))


@query("voice_resolve", """
    WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'it' ELSE lang END AS l,
      CASE WHEN doc_id % 11 = 0 THEN 'zf_xiaoni' END AS pin, CASE WHEN doc_id % 3 = 0 THEN 'em_alex' ELSE 'bm_george' END AS main FROM documents),
    v(l, first, def) AS (VALUES ('en','a','af_heart'),('en','b','af_heart'),('es','e','ef_dora'),('fr','f','ff_siwis'),('it','i','if_sara'),('pt','p','pf_dora'),('hi','h','hf_alpha'),('ja','j','jf_alpha'),('zh','z','zf_xiaoxiao'))
    SELECT doc_id, CASE WHEN pin IS NOT NULL THEN pin WHEN l = 'fr' THEN 'ff_other'
      WHEN l IN (SELECT l FROM v) AND NOT EXISTS (SELECT 1 FROM v WHERE v.l = d.l AND v.first = left(d.main, 1)) THEN (SELECT any_value(def) FROM v WHERE v.l = d.l) ELSE main END AS voice FROM d""")
def voice_resolve(spark, sf_dir):
    i = F.col("doc_id")
    lang = F.when(i % 5 == 0, None).when(i % 5 == 1, "it").otherwise(F.col("lang"))
    main, pin = F.when(i % 3 == 0, "em_alex").otherwise("bm_george"), F.when(i % 11 == 0, "zf_xiaoni")
    return table(spark, sf_dir, "documents").select("doc_id", L.resolve(lang, F.create_map(F.lit("fr"), F.lit("ff_other")), main, pin).alias("voice"))


@query("voice_scopes", """
    WITH d AS (SELECT doc_id, lang, ['af_x', 'ef_y', 'ff_z', 'xx'][doc_id % 4 + 1] AS v FROM documents)
    SELECT doc_id, CASE WHEN v = 'xx' THEN NULL WHEN lang IS NULL OR lang NOT IN ('en','es','fr','it','pt','hi','ja','zh') OR (lang = 'en' AND v = 'af_x') OR (lang = 'es' AND v = 'ef_y') OR (lang = 'fr' AND v = 'ff_z') THEN 'language' ELSE 'document' END AS scope FROM d""")
def voice_scopes(spark, sf_dir):
    voice = F.get(F.array(*[F.lit(v) for v in ("af_x", "ef_y", "ff_z", "xx")]), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", L.pick_scope(voice, F.col("lang")).alias("scope"))


@query("listed_voices", """
    SELECT event_id, array_to_string(list_sort(list_distinct([event_type, 'v' || event_id % 7, 'af_x'])), ',') AS voices FROM events""")
def listed_voices(spark, sf_dir):
    """Answers of voice servers in three forms, made of events; repeats and empty names in them."""
    i, kind = F.col("event_id"), F.col("event_type")
    names = F.array(kind, F.concat(F.lit("v"), (i % 7).cast("string")), F.lit("af_x"), F.lit(""), kind)
    objects = F.to_json(F.transform(names, lambda n: F.struct(n.alias("id"), F.lit("x").alias("label"))))
    payload = F.when(i % 3 == 0, F.to_json(names)).when(i % 3 == 1, F.concat(F.lit('{"voices": '), F.to_json(names), F.lit("}"))).otherwise(F.concat(F.lit('{"data": '), objects, F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(L.voices_listed(payload), ",").alias("voices"))
