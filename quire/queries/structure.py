"""Queries on paragraphs, sentences and chapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import structure as S
from quire.plans.tables import spread, table
from quire.queries import query
from quire.sources.files import stripped_book

_W = r"[\s\x0B\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ABBREVIATIONS = ", ".join(f"'{w}'" for w in X.ABBREVIATIONS)


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _merged(listed: str, joins: str) -> str:
    """A list of texts, each added to the one before where joins (of a.l, the last text so far, and b.l) holds."""
    each = f"list_transform({listed}, lambda x: {{'d': CAST([] AS VARCHAR[]), 'l': x}})"
    step = f"CASE WHEN {joins} THEN {{'d': a.d, 'l': a.l || ' ' || b.l}} ELSE {{'d': list_append(a.d, a.l), 'l': b.l}} END"
    return f"CASE WHEN len({listed}) > 0 THEN list_transform([list_reduce({each}, lambda a, b: {step})], lambda r: list_append(r.d, r.l))[1] ELSE [] END"


def _lost(x: str, mark: str) -> str:
    return f"(length({x}) - length(replace({x}, '{mark}', '')))"


_WORD = r"rtrim(ltrim(lower(regexp_extract(a.l, '([\p{L}\p{M}\p{N}_.]+)\.$', 1)), '.'), '.')"
_INITIAL = rf"regexp_matches({_WORD}, '^\p{{L}}$')"
_OPEN = (
    f"CASE WHEN {_lost('a.l', '“')} <> {_lost('a.l', '”')} THEN {_lost('a.l', '“')} > {_lost('a.l', '”')} WHEN contains(a.l, '“') OR contains(a.l, '”') THEN false"
    f" ELSE {_lost('a.l', chr(34))} % 2 = 1 END"
)
_SOFT = rf"{_W}*(.{{1,{X.MAX_CHARS}}}\z|.{{{X.MAX_CHARS * 2 // 5},{X.MAX_CHARS - 2}}}[;:,] |.{{1,{X.MAX_CHARS - 1}}} |.{{{X.MAX_CHARS}}})"
#: Paragraphs of whole texts, cleaned, and the sentences in which they are read: pieces, merged after abbreviations, in
#: open quotations and while short, cut where long. Every step is the rule itself, text by text.
PARAGRAPHS_SQL = rf"""
    raw AS (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents),
    lines AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: {_trim("x")} <> '') AS w FROM raw),
    counted AS (
      SELECT *, len(list_filter(w, lambda x: length({_trim("x")}) <= 80)) AS short,
        len(list_filter(w, lambda x: regexp_matches(x, '[.!?:;]["''”’)\]]?{_W}*$'))) AS ended FROM lines),
    blocks AS (
      SELECT doc_id, lang, CASE WHEN len(w) = 0 THEN []
        WHEN regexp_matches(t, '\n[ \t]*\n') THEN list_filter(regexp_split_to_array(t, '\n[ \t]*\n[ \t\n]*'), lambda x: {_trim("x")} <> '')
        WHEN len(w) > 2 AND short / len(w) > 0.8 AND ended / len(w) < 0.5 THEN [t] ELSE w END AS p FROM counted),
    paras AS (
      SELECT doc_id, lang, para, {_trim(r"regexp_replace(regexp_replace(regexp_replace(text, '([\p{L}\p{M}\p{N}_])[-‐]\n([\p{L}\p{M}\p{N}_])', '\1\2', 'g'), '[ \t]*\n[ \t]*', ' ', 'g'), '[ \t\x{A0}]{2,}', ' ', 'g')")} AS text
      FROM (SELECT doc_id, lang, generate_subscripts(p, 1) - 1 AS para, unnest(p) AS text FROM blocks)),
    full_paras AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY para) - 1 AS para, text FROM paras WHERE text <> '')"""
#: The units of full_paras, and all of a document numbered.
UNITS_SQL = rf"""
    split AS (
      SELECT doc_id, lang, para, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])(["''”’)\]]?){_W}+(["''“‘(\[A-Z0-9])', '\1\2' || chr(1) || '\3', 'g'), chr(1)),
        lambda x: {_trim("x")}), lambda x: x <> '') AS p FROM full_paras),
    whole AS (SELECT doc_id, lang, para, {_merged("p", f"{_WORD} IN ({_ABBREVIATIONS}) OR {_INITIAL}")} AS p FROM split),
    quoted AS (SELECT doc_id, lang, para, {_merged("p", f"({_OPEN}) AND length(a.l) + length(b.l) < {X.MAX_CHARS}")} AS p FROM whole),
    joined AS (SELECT doc_id, lang, para, {_merged("p", f"length(a.l) < {X.MIN_CHARS}")} AS p FROM quoted),
    cut AS (
      SELECT doc_id, lang, para, flatten(list_transform(p, lambda x: CASE WHEN length(x) <= {X.MAX_CHARS} THEN [x]
        ELSE list_filter(list_transform(regexp_extract_all(x, '{_SOFT}', 1, 's'), lambda y: {_trim("y")}), lambda y: y <> '') END)) AS p FROM joined),
    units AS (SELECT doc_id, lang, para, generate_subscripts(p, 1) - 1 AS pos, unnest(p) AS text FROM cut),
    pieces AS (SELECT doc_id, lang, para, row_number() OVER (PARTITION BY doc_id ORDER BY para, pos) - 1 AS idx, text FROM units)"""
PIECES_SQL = f"{PARAGRAPHS_SQL},{UNITS_SQL}"


def piece_table(spark, sf_dir, of=None):
    """(doc_id, lang, idx, text): the sentences of whole texts, as they are read; of: the documents (doc_id) that are asked for."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return S.sentence_table(spread(docs) if of is None else S.those(docs, of), "doc_id", "lang")


@query("sentence_stats", f"""
    WITH {PIECES_SQL}
    SELECT lang, count(*)::BIGINT AS n_sentences, sum(length(text))::BIGINT AS n_chars FROM pieces GROUP BY lang""")
def sentence_stats(spark, sf_dir):
    p = piece_table(spark, sf_dir)
    return p.groupBy("lang").agg(F.count("*").alias("n_sentences"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("sentence_split", f"WITH {PIECES_SQL} SELECT doc_id, CAST(idx AS INTEGER) AS idx, text FROM pieces")
def sentence_split(spark, sf_dir):
    return piece_table(spark, sf_dir).select("doc_id", "idx", "text")


@query("page_sentences", f"""
    WITH {PIECES_SQL}, n AS (SELECT doc_id, CAST(idx // 12 + 1 AS INTEGER) AS page, count(*) AS c FROM pieces GROUP BY ALL)
    SELECT doc_id AS id, page, CAST(coalesce(sum(c) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
      CAST(c AS BIGINT) AS count FROM n""")
def page_sentences(spark, sf_dir):
    p = piece_table(spark, sf_dir)
    return S.page_index(p.select(F.col("doc_id").alias("id"), (F.floor(F.col("idx") / 12) + 1).cast("int").alias("page")))


@query("paragraph_split", f"WITH {PARAGRAPHS_SQL} SELECT doc_id AS id, CAST(para AS INTEGER) AS para, text FROM full_paras")
def paragraph_split(spark, sf_dir):
    return S.paragraph_table(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


#: Headings by their form, then by how many of each form a document has; \b and (?i) agree in both engines.
HEADINGS_SQL = rf"""
    numerals AS (SELECT unnest(['M', 'CM', 'D', 'CD', 'C', 'XC', 'L', 'XL', 'X', 'IX', 'V', 'IV', 'I']) AS s, unnest([1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1]) AS v),
    formed AS (
      SELECT *, length(regexp_replace(text, '\P{{L}}', '', 'g')) AS letters, regexp_extract(text, '^([IVXLCDM]{{1,8}}|\d{{1,3}})\.', 1) AS num FROM full_paras),
    kinds AS (
      SELECT *, CASE WHEN length(text) > 90 OR contains(text, chr(10)) THEN NULL
        WHEN regexp_matches(text, '{X.HEADING["explicit"]}') THEN 'explicit' WHEN regexp_matches(text, '{X.HEADING["numeral"]}') THEN 'numeral'
        WHEN regexp_matches(text, '{X.HEADING["numtitle"].replace("'", "''")}') THEN 'numtitle'
        WHEN regexp_matches(text, '{X.HEADING["allcaps"]}') AND letters >= greatest(2, floor(length(text) / 2)) THEN 'allcaps' END AS kind FROM formed),
    valued AS (
      SELECT *, CASE WHEN kind = 'numtitle' THEN CASE WHEN regexp_matches(num, '^\d') THEN CAST(num AS INTEGER) ELSE
        CAST(list_sum(list_transform(range(1, length(num) + 1), lambda i: CASE WHEN i < length(num) AND
          [1, 5, 10, 50, 100, 500, 1000][instr('IVXLCDM', num[i + 1])] > [1, 5, 10, 50, 100, 500, 1000][instr('IVXLCDM', num[i])] THEN -1 ELSE 1 END
          * [1, 5, 10, 50, 100, 500, 1000][instr('IVXLCDM', num[i])])) AS INTEGER) END END AS value FROM kinds),
    before AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM valued),
    totals AS (
      SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE kind = 'explicit') AS ne, count(*) FILTER (WHERE kind = 'numeral') AS nn, count(*) FILTER (WHERE kind = 'numtitle') AS nt,
        count(*) FILTER (WHERE kind = 'allcaps') AS nc, count(*) FILTER (WHERE value >= prev) AS up FROM before GROUP BY doc_id),
    ruled AS (SELECT *, nt >= 3 AND up >= 0.8 * (nt - 1) AS run FROM totals),
    first AS (
      SELECT b.doc_id, para, n, CASE WHEN kind = 'explicit' OR (kind = 'numeral' AND nn >= 2) OR (kind = 'numtitle' AND run) THEN 1
        WHEN kind = 'allcaps' AND (ne > 0 OR nn >= 2 OR run) AND nc >= 2 THEN 2 WHEN kind = 'allcaps' AND nc >= 3 AND NOT (ne > 0 OR nn >= 2 OR run) THEN 1 ELSE 0 END AS level
      FROM before b JOIN ruled USING (doc_id)),
    found AS (SELECT doc_id, count(*) FILTER (WHERE level > 0) AS f FROM first GROUP BY doc_id),
    levels AS (SELECT doc_id, para, CASE WHEN f < 2 OR f > 0.55 * n OR f > greatest(400, 0.08 * n) THEN 0 ELSE level END AS level FROM first JOIN found USING (doc_id))"""
CHUNKS_SQL = f"{PIECES_SQL}, {HEADINGS_SQL}, chunks AS (SELECT doc_id AS id, CAST(idx AS INTEGER) AS idx, CAST(para AS INTEGER) AS para, CAST(level AS INTEGER) AS level, text FROM pieces JOIN levels USING (doc_id, para))"


@query("document_chunks", f"WITH {CHUNKS_SQL} SELECT * FROM chunks")
def document_chunks(spark, sf_dir):
    """The full chunk pipeline."""
    paras = S.heading_levels(S.paragraph_table(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))
    return S.chunk_table(paras)


@query("document_contents", f"WITH {CHUNKS_SQL} SELECT id, arg_min(level, idx) AS level, left(arg_min(text, idx), 120) AS title, min(idx) AS idx FROM chunks WHERE level > 0 GROUP BY id, para")
def document_contents(spark, sf_dir):
    return S.contents(document_chunks(spark, sf_dir))


@query("toc_targets", f"""
    WITH {PIECES_SQL}, c AS (SELECT doc_id, idx, idx // 5 * 2 + 1 AS page FROM pieces),
    t AS (SELECT DISTINCT doc_id, unnest(range(0, 6)) AS ord FROM pieces)
    SELECT t.doc_id AS id, CAST(ord AS INTEGER) AS ord, CAST(coalesce(min(c.idx), 0) AS INTEGER) AS idx
    FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.page >= greatest(1, t.ord * 3) GROUP BY ALL""")
def toc_targets(spark, sf_dir):
    c = piece_table(spark, sf_dir).select(F.col("doc_id").alias("id"), "idx", (F.floor(F.col("idx") / 5) * 2 + 1).cast("int").alias("page"))
    toc = c.filter("idx = 0").select("id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("ord")).withColumn("page", F.col("ord") * 3)
    return S.toc_targets(toc, c)


@query("page_furniture", r"""
    WITH l AS (
      SELECT doc_id, generate_subscripts(w, 1) - 1 AS k, unnest(w) AS text FROM (
        SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS w FROM documents)),
    b AS (
      SELECT doc_id, CAST(k // 4 + 1 AS INTEGER) AS page, k % 4 AS slot,
        CASE WHEN k % 4 = 0 THEN 'Running head ' || (k // 4 + 1) WHEN k % 4 = 3 AND doc_id % 2 = 0 THEN CAST(k // 4 + 1 AS VARCHAR) ELSE text END AS text FROM l),
    e AS (SELECT *, CASE WHEN slot = 0 THEN 'top' WHEN slot = 3 THEN 'bottom' END AS band, left(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '\d+', '#', 'g'), 80) AS key FROM b),
    n AS (SELECT doc_id, count(DISTINCT page) AS n FROM b GROUP BY doc_id),
    o AS (SELECT doc_id, band, key, count(DISTINCT page) AS k FROM e WHERE band IS NOT NULL GROUP BY ALL)
    SELECT e.doc_id AS id, count(*) AS n_blocks, CAST(count(*) FILTER (WHERE e.band IS NOT NULL AND (o.k >= greatest(3, ceil(0.4 * n.n))
      OR regexp_matches(trim(e.text), '(?i)^(?:page\s+)?(?:[0-9]{1,4}|[ivxlcdm]{1,7})(?:\s*(?:of|/|—|-)\s*[0-9]{1,4})?$'))) AS BIGINT) AS n_furniture
    FROM e JOIN n USING (doc_id) LEFT JOIN o ON o.doc_id = e.doc_id AND o.band = e.band AND o.key = e.key GROUP BY e.doc_id""")
def page_furniture(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")).alias("k", "text")
    )
    page, slot = (F.floor(F.col("k") / 4) + 1).cast("int"), F.col("k") % 4
    said = F.when(slot == 0, F.concat(F.lit("Running head "), page)).when((slot == 3) & (F.col("id") % 2 == 0), page.cast("string")).otherwise(F.col("text"))
    y0 = F.element_at(F.array(*[F.lit(y) for y in (20.0, 300.0, 500.0, 960.0)]), slot + 1)
    blocks = lines.select("id", page.alias("page"), F.lit(1000.0).alias("page_height"), y0.alias("y0"), (y0 + 15).alias("y1"), said.alias("text"))
    return S.furniture(blocks).groupBy("id").agg(F.count("*").alias("n_blocks"), F.count(F.when(F.col("furniture"), 1)).alias("n_furniture"))


@query("progress_map", f"""
    WITH {PIECES_SQL}, n AS (SELECT doc_id, idx // 2 AS idx, string_agg(text, ' ' ORDER BY idx) AS text FROM pieces GROUP BY ALL),
    a AS (SELECT doc_id, idx, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM pieces),
    b AS (SELECT doc_id, idx, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM n),
    p AS (SELECT * FROM a WHERE idx = doc_id % 7)
    SELECT p.doc_id AS id, CAST(p.idx AS INTEGER) AS old_idx, CAST(CASE WHEN p.idx <= 0 THEN 0 ELSE coalesce(min(b.idx) FILTER (WHERE b.at >= p.at), max(b.idx)) END AS INTEGER) AS idx
    FROM p JOIN b ON b.doc_id = p.doc_id GROUP BY p.doc_id, p.idx""")
def progress_map(spark, sf_dir):
    old = piece_table(spark, sf_dir).select(F.col("doc_id").alias("id"), "idx", "text")
    new = old.groupBy("id", F.floor(F.col("idx") / 2).cast("int").alias("k")).agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("t"))
    new = new.select("id", F.col("k").alias("idx"), F.array_join(F.col("t.text"), " ").alias("text"))
    return S.moved_progress(old, new, old.filter("idx = id % 7").select("id", "idx"))


@query("dedup_paragraphs", r"""
    WITH l AS (
      SELECT doc_id, generate_subscripts(w, 1) - 1 AS para, unnest(w) AS text FROM (
        SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS w FROM documents)),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN length(text) >= 200 THEN lower(left(text, 160)) END ORDER BY para) AS n FROM l)
    SELECT doc_id AS id, CAST(para AS INTEGER) AS para, CAST(length(text) AS INTEGER) AS n_chars FROM n WHERE n = 1 OR length(text) < 200""")
def dedup_paragraphs(spark, sf_dir):
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")
    paras = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.posexplode(lines).alias("para", "text"))
    return S.dedup_paragraphs(paras).select("id", "para", F.length("text").alias("n_chars"))


#: No document of the tables has a printed list, so a body starts at once.
@query("plain_documents", f"WITH {PIECES_SQL} SELECT doc_id AS id, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars, 0 AS start_idx FROM pieces GROUP BY doc_id")
def plain_documents(spark, sf_dir):
    """Chunks and where the body starts, printed lists gone, from whole texts."""
    chunks, starts = S.plain_documents(table(spark, sf_dir, "documents"))
    return chunks.groupBy("id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).cast("long").alias("n_chars")).join(starts, "id")


#: The old sentences are pairs of the new ones.
@query("rechunked_documents", f"""
    WITH {PIECES_SQL}, long AS (SELECT p.doc_id, idx, p.text FROM pieces p JOIN documents d USING (doc_id) WHERE length(d.text) >= 100),
    o AS (SELECT doc_id, idx // 2 AS idx, string_agg(text, ' ' ORDER BY idx) AS text FROM long GROUP BY ALL),
    a AS (SELECT doc_id, idx, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM o),
    b AS (SELECT doc_id, idx, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM long),
    p AS (SELECT * FROM a WHERE idx = doc_id % 7)
    SELECT p.doc_id AS id, CAST(p.idx AS INTEGER) AS old_idx, CAST(CASE WHEN p.idx <= 0 THEN 0 ELSE coalesce(min(b.idx) FILTER (WHERE b.off >= p.off), max(b.idx)) END AS INTEGER) AS idx
    FROM p JOIN b ON b.doc_id = p.doc_id GROUP BY p.doc_id, p.idx""")
def rechunked_documents(spark, sf_dir):
    new = piece_table(spark, sf_dir).select(F.col("doc_id").alias("id"), F.floor(F.col("idx") / 2).cast("int").alias("k"), "idx", "text")
    old = new.groupBy("id", "k").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("t")).select("id", F.col("k").alias("idx"), F.array_join(F.col("t.text"), " ").alias("text"))
    return S.rechunked(old, table(spark, sf_dir, "documents"), old.filter("idx = id % 7").select("id", "idx"))[1]


@query("book_bodies", rf"""
    SELECT doc_id, {_trim("coalesce(text, '')")} AS body FROM documents""")
def book_bodies(spark, sf_dir):
    """Every document between a publisher's marks, of two forms, with credits and a picture's note within; what is left is the document."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    edges = {"start": [r"\*{3} START OF", r"\*BEGIN\*"], "end": [r"\*{3} END OF", "End of the text"]}
    before = F.when(i % 2 == 0, "A title\n*** START OF THE BOOK ***\n").otherwise("*BEGIN* here\n")
    raw = F.concat(before, F.lit("\nProduced by A\nand B\n\n[Illustration: a mill]"), text, F.when(i % 3 == 0, "\n*** END OF THE BOOK\nLicense").otherwise("\nEnd of the text, a book\nLicense"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", stripped_book(raw, edges).alias("body"))
