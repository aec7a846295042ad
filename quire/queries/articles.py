"""Queries on pages, printed lists, page layout, translations and covers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import addresses as A
from quire.functions import kernels as K
from quire.operators import align, layout
from quire.operators import structure as S
from quire.plans.tables import spread, table
from quire.queries import query
from quire.queries.structure import PARAGRAPHS_SQL, UNITS_SQL, _trim
from quire.sources import pages as P


_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")]


def _bare(x: str) -> str:
    """Text of HTML: comments and tags gone, references of the tables' pages undone, white space levelled."""
    x = f"regexp_replace(regexp_replace({x}, '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'g')"
    for name, char in _ENTITIES:
        x = f"replace({x}, '{name}', '{char}')"
    return rf"trim(regexp_replace({x}, '[\s\x{{A0}}]+', ' ', 'g'))"


def _inline(x: str) -> str:
    """Inline Markdown to text; RE2 has no back references, so each mark is an alternative."""
    x = rf"regexp_replace({x}, '\[([^\]]*)\]\([^)]*\)', '\1', 'g')"
    for _ in range(3):
        x = rf"regexp_replace({x}, '\*\*(.+?)\*\*|__(.+?)__|\*(.+?)\*|_(.+?)_|`(.+?)`', '\1\2\3\4\5', 'gs')"
    x = rf"regexp_replace(regexp_replace({x}, '^>\s?', ''), '^[-*+]\s+', '')"
    return _trim(rf"regexp_replace({x}, '\\([\\`*_{{}}\[\]()#+.!-])', '\1', 'g')")


#: Headings and paragraphs of the pages as they are written, a paragraph ending where the next begins; all text of the body as
#: one block where these hold under half of it; then the Markdown rules.
_BLOCKS = rf"""
    art AS (SELECT page_id AS doc_id, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h, {_bare("regexp_extract(coalesce(html, ''), '<body>(.*)$', 1, 's')")} AS body FROM pages),
    parts AS (SELECT doc_id, generate_subscripts(w, 1) AS n, unnest(w) AS raw FROM (SELECT doc_id, regexp_split_to_array(h, '</p>|</h1>|<p>|<h1>') AS w FROM art)),
    heads AS (SELECT doc_id, body, regexp_extract_all(h, '<h1>(.*?)</h1>', 1, 's') AS hs FROM art),
    plain AS (SELECT doc_id, n, body, {_bare("raw")} AS text, list_contains(hs, raw) AND row_number() OVER (PARTITION BY doc_id, raw ORDER BY n) = 1 AS head FROM parts JOIN heads USING (doc_id)),
    full_text AS (SELECT doc_id, sum(length(text)) < length(any_value(body)) / 2 AS few FROM plain GROUP BY doc_id),
    written AS (
      SELECT doc_id, n, CASE WHEN head THEN '# ' || text ELSE text END AS md FROM plain JOIN full_text USING (doc_id) WHERE text <> '' AND NOT few
      UNION ALL SELECT doc_id, 0, body FROM art JOIN full_text USING (doc_id) WHERE few AND body <> ''),
    headed AS (SELECT *, regexp_extract(md, '^(#{{1,6}})\s+.*\S\s*$', 1) AS hd, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS para FROM written),
    listed AS (
      SELECT doc_id, para, least(3, length(hd)) AS level, CASE WHEN hd <> '' THEN {_inline(r"regexp_extract(md, '^#{1,6}\s+(.*\S)\s*$', 1)")}
        ELSE {_trim(r"regexp_replace(" + _inline("md") + r", '[ \t\x{A0}]{2,}', ' ', 'g')")} END AS text FROM headed),
    known AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN level > 0 OR length(text) >= 200 THEN lower(CASE WHEN level > 0 THEN text ELSE left(text, 160) END) END ORDER BY para) AS k
      FROM listed WHERE text <> ''),
    kept AS (SELECT doc_id, NULL AS lang, para, CAST(level AS INTEGER) AS level, text FROM known WHERE k = 1 OR NOT (level > 0 OR length(text) >= 200))"""


@query("article_blocks", f"WITH {_BLOCKS} SELECT doc_id AS id, CAST(para AS INTEGER) AS para, level, text FROM kept")
def article_blocks(spark, sf_dir):
    """Headings and paragraphs of every page."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    return P.article_blocks(P.with_markdown(pages), "page_id")


@query("article_chunks", f"""
    WITH {_BLOCKS}, full_paras AS (SELECT doc_id, lang, para, text FROM kept WHERE level = 0), {UNITS_SQL},
    every AS (SELECT doc_id, para, pos, 0 AS level, text FROM units UNION ALL SELECT doc_id, para, 0, level, text FROM kept WHERE level > 0)
    SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para, pos) - 1 AS INTEGER) AS idx, CAST(para AS INTEGER) AS para, level, text FROM every""")
def article_chunks(spark, sf_dir):
    return P.article_chunks(article_blocks(spark, sf_dir))


def _v4(networks) -> str:
    """Rows (first, after) of networks of version 4, as numbers."""
    return ", ".join(f"({a - A.MAPPED}, {b - A.MAPPED})" for n in networks if ":" not in n for a, b in A.spans(n))


#: Every event names an address: one near a border of a range, in one of four spellings, or a name.
@query("public_hosts", f"""
    WITH closed(a, b) AS (VALUES {_v4(A.CLOSED)}), open(a, b) AS (VALUES {_v4(A.OPEN)}),
    ends AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS k FROM (SELECT a AS x FROM closed UNION SELECT b FROM closed UNION SELECT a FROM open UNION SELECT b FROM open)),
    e AS (SELECT event_id, user_id, event_id % 5 AS form, event_id // 5 AS i FROM events),
    n AS (SELECT e.*, (CASE WHEN i % 3 = 0 THEN (i * 2654435761) % 4294967296 ELSE greatest(0, least(4294967295, x + user_id % 3 - 1)) END) AS v FROM e JOIN ends ON k = i % (SELECT count(*) FROM ends)),
    t AS (SELECT *, (v >> 24) || '.' || ((v >> 16) & 255) || '.' || ((v >> 8) & 255) || '.' || (v & 255) AS quad,
      EXISTS (SELECT 1 FROM closed WHERE v >= a AND v < b) AND NOT EXISTS (SELECT 1 FROM open WHERE v >= a AND v < b) AS shut FROM n)
    SELECT event_id, CASE form WHEN 0 THEN quad WHEN 1 THEN '::ffff:' || quad WHEN 2 THEN CAST(v AS VARCHAR) WHEN 3 THEN 'h' || quad || '.example' ELSE '::FFFF:' || printf('%x:%x', v >> 16, v & 65535) END AS host,
      CASE form WHEN 2 THEN false WHEN 3 THEN NULL ELSE NOT shut END AS public FROM t""")
def public_hosts(spark, sf_dir):
    """Addresses near all borders of version 4, mapped ones, numbers in an old spelling, and names."""
    ends = sorted({x - A.MAPPED for n in (*A.CLOSED, *A.OPEN) if ":" not in n for s in A.spans(n) for x in s})
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 5).alias("form"), F.floor(F.col("event_id") / 5).alias("i"))
    border = F.element_at(F.array(*[F.lit(x).cast("long") for x in ends]), (F.col("i") % len(ends)).cast("int") + 1)
    near = F.greatest(F.lit(0), F.least(F.lit(4294967295), border + F.col("user_id") % 3 - 1))
    e = e.withColumn("v", F.when(F.col("i") % 3 == 0, F.expr("i * 2654435761L % 4294967296L")).otherwise(near))
    part = lambda k: F.shiftright("v", k).bitwiseAND(255).cast("string")
    quad = F.concat_ws(".", part(24), part(16), part(8), part(0))
    low = F.concat(F.lower(F.hex(F.shiftright("v", 16))), F.lit(":"), F.lower(F.hex(F.col("v").bitwiseAND(65535))))
    host = F.when(F.col("form") == 0, quad).when(F.col("form") == 1, F.concat(F.lit("::ffff:"), quad)).when(F.col("form") == 2, F.col("v").cast("string"))
    host = host.when(F.col("form") == 3, F.concat(F.lit("h"), quad, F.lit(".example"))).otherwise(F.concat(F.lit("::FFFF:"), low))
    return e.select("event_id", host.alias("host")).select("event_id", "host", A.public_host(F.col("host")).alias("public"))


@query("article_images", r"""
    SELECT page_id AS id, 0 AS ord, 1 AS para, url || '/x.png' AS src_url, 'a' AS alt, 1 AS anchor_idx FROM pages WHERE regexp_matches(url, '^https?://[^\s)]*$')
    UNION ALL SELECT page_id, 1, 2, 'https://h.example/z.jpg', '', 1 FROM pages WHERE regexp_matches(url, '^https?://[^\s)]*$')""")
def article_images(spark, sf_dir):
    """Pictures of a page with one sentence before them and one behind, and where they are anchored."""
    mark = F.concat(F.lit("One sentence.\n\n![a]("), F.col("url"), F.lit("/x.png) ![b](y.gif) ![a]("), F.col("url"), F.lit("/x.png)\n\n![](https://h.example/z.jpg) Another sentence."))
    marked = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", mark.alias("markdown"))
    return P.anchored(P.images(marked), P.article_chunks(P.article_blocks(marked)))


@query("page_charsets", r"""
    WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/html; charset="Latin-1"' WHEN 1 THEN 'text/html' WHEN 2 THEN NULL ELSE 'x; Charset=utf-16' END AS t,
      CASE WHEN page_id % 3 = 0 THEN '<meta name="x" charset=''KOI8-R''>' ELSE '' END || coalesce(html, '') AS h FROM pages)
    SELECT page_id, coalesce(nullif(lower(regexp_extract(coalesce(t, ''), '(?i)charset=["'']?([\w.:-]+)', 1)), ''), nullif(lower(regexp_extract(left(h, 4096), '(?i)<meta[^>]+charset=["'']?([\w.:-]+)', 1)), ''), 'utf-8') AS charset FROM p""")
def page_charsets(spark, sf_dir):
    i = F.col("page_id")
    said = F.when(i % 4 == 0, 'text/html; charset="Latin-1"').when(i % 4 == 1, "text/html").when(i % 4 == 3, "x; Charset=utf-16")
    head = F.concat(F.when(i % 3 == 0, "<meta name=\"x\" charset='KOI8-R'>").otherwise(""), F.coalesce("html", F.lit(""))).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", P.charset(said, head).alias("charset"))


@query("web_addresses", r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#\s]*\.[^/?#\s]*') THEN url END AS address FROM pages")
def web_addresses(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", K.web_address(F.col("url")).alias("address"))


_PROSE = "It was a long time ago, and nobody knew. " * 4
#: What is put before a document, by its number: a list's lines (taken away) and others (with +, left), and at which of the others the body begins.
_FRONTS = [
    (["CONTENTS", "Chapter I. 1", "Chapter II. 20", "+Chapter III. 31"], 0),  # the last entry before prose is a heading
    (["Contents Chapter I. 1 Chapter II. 20 Chapter III. 31"], 0),  # a list in one line
    (["+A foreword", "CONTENTS", "I. One . . . . 3", "II. Two . . . . 9", "III. Three . . . . 12", "+Some words before"], 1),
    (["+CONTENTS", "+Chapter I. 1"], 0),  # too short to be a list
    (["CONTENTS", "Chapter I. The start 1", "Chapter II. The end 20", "Chapter III. After 31", "+Chapter I. The start"], 0),  # an echo opens the body
    (["LIST OF ILLUSTRATIONS", "A mill", "The sea", "A boat", "The old town", "Frontispiece", "+One", "+Two", "+Three"], 0),  # captions, none before prose
    (["CONTENTS", "The mill 7", "An odd line", "The sea 21", "The boat 55", "CONTENTS", "The town 63", "+Not of it"], 0),  # a stray and a second title within
    (["CONTENTS", "Chapter I. 1", "Chapter II. 20", "Chapter III. 31", "+A verse", "+Another verse", "+And a third", "ILLUSTRATIONS", "Plate 1 . . . . 4", "Plate 2 . . . . 9", "Plate 3 . . . . 12", "+Here it begins"], 3),
]
_LEFT = ", ".join(f"({k}, {n}, '{line[1:]}', {start})" for k, (lines, start) in enumerate(_FRONTS) for n, line in enumerate([*lines, f"+{_PROSE}", f"+{_PROSE}"]) if line[0] == "+")


@query("printed_lists", f"""
    WITH {PARAGRAPHS_SQL}, front(shape, n, text, start) AS (VALUES {_LEFT}),
    ids AS (SELECT DISTINCT doc_id FROM documents),
    every AS (
      SELECT doc_id, n, text FROM ids JOIN front ON doc_id % {len(_FRONTS)} = shape UNION ALL SELECT doc_id, 100 + para, text FROM full_paras)
    SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS para, text, start
    FROM every JOIN (SELECT DISTINCT shape, start FROM front) s ON doc_id % {len(_FRONTS)} = s.shape""")
def printed_lists(spark, sf_dir):
    """Every document with one of several printed lists put before it, and what is left of both."""
    docs = table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select("doc_id", "text")
    paras = S.paragraph_table(docs)
    lines = F.array(*[F.array(*[F.lit(x.removeprefix("+")) for x in [*ls, _PROSE, _PROSE]]) for ls, _ in _FRONTS])
    front = docs.select(F.col("doc_id").alias("id")).distinct().select("id", F.posexplode(F.get(lines, (F.col("id") % len(_FRONTS)).cast("int"))).alias("para", "text"))
    both = front.unionByName(paras.withColumn("para", F.col("para") + 100))
    return layout.strip_printed_lists(both)


#: Page by page, each seen as the one before left it.
_STITCHED = rf"""
    WITH RECURSIVE {PARAGRAPHS_SQL},
    pg AS (SELECT doc_id AS id, CAST(para // 3 + 1 AS INTEGER) AS page, list(text ORDER BY para) AS ps FROM full_paras GROUP BY ALL),
    walk AS (
      SELECT id, page, ps AS cur, CAST([] AS VARCHAR[]) AS done FROM pg WHERE page = 1
      UNION ALL
      SELECT id, page, CASE WHEN NOT goes THEN ps WHEN {_trim("rest")} = '' THEN ps[2:] ELSE list_prepend({_trim("rest")}, ps[2:]) END,
        CASE WHEN NOT goes THEN cur ELSE list_append(cur[:len(cur) - 1], CASE WHEN hyphen AND regexp_matches(moved, '^[\p{{L}}\p{{N}}]') THEN tail[:length(tail) - 1] || moved ELSE tail || ' ' || moved END) END
      FROM (
        SELECT *, substr(head, length(moved) + 1) AS rest, len(cur) > 0 AND (hyphen OR (NOT regexp_matches(tail, '[.!?]["''”’)\]]*$') AND length(tail) >= 40 AND regexp_matches(head, '^\p{{Ll}}'))) AS goes
        FROM (
          SELECT *, coalesce(nullif(regexp_extract(head, '^(.*?[.!?]["''”’)\]]*)(\s|$)', 1, 's'), ''), head) AS moved, coalesce(regexp_matches(tail, '[\p{{L}}\p{{N}}][-‐]$'), false) AS hyphen
          FROM (SELECT w.id, n.page, w.cur, n.ps, w.cur[-1] AS tail, n.ps[1] AS head FROM walk w JOIN pg n ON n.id = w.id AND n.page = w.page + 1)))),
    ends AS (SELECT id, max(page) AS page FROM pg GROUP BY id),
    out AS (SELECT id, page - 1 AS page, done AS ps FROM walk WHERE page > 1 UNION ALL SELECT id, page, cur FROM walk SEMI JOIN ends USING (id, page))
    SELECT id, CAST(page AS INTEGER) AS page, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS para, unnest(ps) AS text FROM out"""


@query("stitched_pages", _STITCHED)
def stitched_pages(spark, sf_dir):
    paras = S.paragraph_table(table(spark, sf_dir, "documents"))
    return layout.stitch(paras.select("id", (F.floor(F.col("para") / 3) + 1).alias("page"), "para", "text"))


@query("sentence_boxes", r"""
    WITH t AS (SELECT conv_id AS id, CAST(turn AS INTEGER) AS page, coalesce(text, '') AS text FROM conversations),
    w AS (SELECT id, page, regexp_extract_all(text, '\S+') AS tok, regexp_split_to_array(text, '\S+') AS gaps FROM t),
    e AS (SELECT id, page, generate_subscripts(tok, 1) AS k, unnest(tok) AS word, unnest(gaps[:len(tok)]) AS gap, CASE WHEN gaps[1] <> '' THEN 1 ELSE 0 END AS lead FROM w),
    c AS (SELECT *, sum(length(gap) + length(word)) OVER (PARTITION BY id, page ORDER BY k) AS ce, count(*) FILTER (WHERE regexp_matches(word, '[\p{L}\p{N}]')) OVER (PARTITION BY id, page) AS n FROM e)
    SELECT id, page, 0 AS idx, CAST(ce - length(word) AS INTEGER) AS cs, CAST(ce AS INTEGER) AS ce, 10.0 AS x0, (k - 1 + lead) * 12.0 AS y0, 90.0 AS x1, (k - 1 + lead) * 12.0 + 10 AS y1
    FROM c WHERE n >= 2 AND regexp_matches(word, '[\p{L}\p{N}]')""")
def sentence_boxes(spark, sf_dir):
    """Boxes of the words of every turn, its page being the turn's own words one under another."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").cast("int").alias("page"), F.lit(0).alias("idx"), F.coalesce("text", F.lit("")).alias("text"))
    at = lambda w, k: F.struct(F.lit(10.0).alias("x0"), (k * 12.0).alias("y0"), F.lit(90.0).alias("x1"), (k * 12.0 + 10).alias("y1"), w.alias("word"))
    return layout.word_boxes(turns, turns.select("id", "page", F.transform(F.split("text", r"\s+"), at).alias("words")))


@query("page_hits", """
    WITH b AS (SELECT event_id AS ord, user_id AS id, CAST(event_id % 3 AS INTEGER) AS page, CAST(event_id % 40 AS INTEGER) AS idx, value * 3 AS x0, value * 2 AS y0 FROM events WHERE event_type = 'view'),
    p AS (SELECT user_id AS id, CAST(event_id % 3 AS INTEGER) AS page, event_id AS point, value * 3 AS x, value * 2 AS y FROM events WHERE event_type = 'click'),
    j AS (SELECT p.id, point, b.idx, b.ord, x >= x0 - 2 AND x <= x0 + 32 AND y >= y0 - 2 AND y <= y0 + 12 AS inside, pow(x - (x0 + x0 + 30) / 2, 2) + pow(y - (y0 + y0 + 10) / 2, 2) AS far FROM p JOIN b ON p.id = b.id AND p.page = b.page),
    r AS (SELECT *, row_number() OVER (PARTITION BY id, point ORDER BY NOT inside, CASE WHEN inside THEN 0 ELSE far END, ord) AS n FROM j)
    SELECT id, point, idx FROM r WHERE n = 1""")
def page_hits(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    x, y, page = F.col("value") * 3, F.col("value") * 2, (i % 3).cast("int").alias("page")
    boxes = e.filter("event_type = 'view'").select(i.alias("ord"), F.col("user_id").alias("id"), page, (i % 40).cast("int").alias("idx"), x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 10).alias("y1"))
    points = e.filter("event_type = 'click'").select(F.col("user_id").alias("id"), page, i.alias("point"), x.alias("x"), y.alias("y"))
    return align.hit(points, boxes)


@query("line_boxes", """
    WITH w AS (SELECT user_id AS id, CAST(event_id % 4 AS INTEGER) AS block, CAST(event_id % 5 AS INTEGER) AS line, value AS x0, value * 2 AS y0 FROM events)
    SELECT id, min(x0) AS x0, min(y0) AS y0, max(x0 + 9) AS x1, max(y0 + 5) AS y1 FROM w GROUP BY id, block, line""")
def line_boxes(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    w = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (i % 4).cast("int").alias("block"), (i % 5).cast("int").alias("line"), v.alias("x0"), (v * 2).alias("y0"), (v + 9).alias("x1"), (v * 2 + 5).alias("y1"))
    return align.line_boxes(w)


@query("generated_covers", """
    WITH p AS (SELECT user_id AS gid, CAST(event_id % 150 AS INTEGER) AS y, CASE WHEN event_id % 150 < 30 AND user_id % 2 = 0 THEN 250 ELSE CAST(event_id * (1 + user_id % 5 * 7) % 256 AS INTEGER) END AS r FROM events),
    c AS (SELECT gid, r // 16 AS b, count(*) AS n FROM p GROUP BY ALL),
    s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY gid ORDER BY n DESC, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY gid) AS total FROM c),
    f AS (SELECT gid, count(*) FILTER (WHERE before < 0.85 * total) AS buckets FROM s GROUP BY gid),
    w AS (SELECT gid, count(*) FILTER (WHERE y < 30 AND r > 235) / nullif(count(*) FILTER (WHERE y < 30), 0) AS white FROM p GROUP BY gid)
    SELECT gid, buckets, round(white, 9) AS white, white >= 0.35 AND buckets <= 14 AS generated FROM f JOIN w USING (gid)""")
def generated_covers(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    y = (i % 150).cast("int")
    r = F.when((y < 30) & (u % 2 == 0), 250).otherwise((i * (1 + u % 5 * 7) % 256).cast("int"))
    p = table(spark, sf_dir, "events").select(u.alias("gid"), F.lit(0).alias("x"), y.alias("y"), r.alias("r"), r.alias("g"), r.alias("b"))
    return align.generated_cover(p).withColumn("white", F.round("white", 9))


_EDGES = "[\"''“”‘’()\\[\\].,!?;:—–-]"


@query("spoken_words", rf"""
    WITH t AS (SELECT conv_id, turn, string_split(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), ' ') AS w, coalesce(text, '') AS text FROM conversations),
    e AS (SELECT conv_id, turn, generate_subscripts(w, 1) AS n, unnest(w) AS word FROM t),
    p AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY conv_id, turn ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, (n - 1) * 0.3 + 0.25 AS until,
      regexp_replace(word, '^{_EDGES}+|{_EDGES}+$', '', 'g') AS bare FROM e),
    g AS (SELECT *, count(*) FILTER (WHERE bare <> '') OVER (PARTITION BY conv_id, turn ORDER BY n) AS g FROM p)
    SELECT conv_id, turn, CAST(g - 1 AS INTEGER) AS k, round(min(n - 1) * 0.3, 6) AS start, round(max(until), 6) AS "end",
      CAST(min(off + length(word) - length(ltrim(word, '"''“”‘’()[].,!?;:—–-'))) AS INTEGER) AS cs,
      CAST(min(off + length(word) - length(ltrim(word, '"''“”‘’()[].,!?;:—–-')) + length(bare)) FILTER (WHERE bare <> '') AS INTEGER) AS ce
    FROM g WHERE g > 0 GROUP BY conv_id, turn, g""")
def spoken_words(spark, sf_dir):
    """Every turn's words, white space levelled, said at a steady pace and held against its text: each is heard for itself."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("text"))
    said = F.transform(F.split("text", r"\s+"), lambda w, k: F.struct(w.alias("word"), (k * 0.3).alias("start"), (k * 0.3 + 0.25).alias("end")))
    found = align.aligned(t.withColumn("words", said)).select("conv_id", "turn", F.posexplode("spans").alias("k", "s"))
    return found.select("conv_id", "turn", "k", F.round("s.start", 6).alias("start"), F.round("s.end", 6).alias("end"), "s.cs", "s.ce")


_N = "(event_id % 9999 + 1)"
_COUNT = f"(CASE WHEN {_N} >= 1000 THEN 2 ELSE 0 END + CASE WHEN {_N} % 1000 >= 100 THEN 2 ELSE 0 END + CASE WHEN {_N} % 100 = 0 THEN 0 WHEN {_N} % 100 < 20 OR {_N} % 10 = 0 THEN 1 ELSE 2 END)"
_SUFFIX = f"CASE WHEN {_N} % 100 BETWEEN 11 AND 13 THEN 'th' WHEN {_N} % 10 = 1 THEN 'st' WHEN {_N} % 10 = 2 THEN 'nd' WHEN {_N} % 10 = 3 THEN 'rd' ELSE 'th' END"
_TIMES = "list_transform(range({}), lambda x: {})"


#: What each spoken word stands for in the text, by what kind of sentence an event says.
@query("spoken_numbers", f"""
    WITH e AS (
      SELECT event_id, CASE event_id % 5
        WHEN 0 THEN ['Pay'] || {_TIMES.format(f"{_COUNT} + 1", f"'$' || {_N}")} || ['to', event_type]
        WHEN 1 THEN ['The'] || {_TIMES.format(_COUNT, f"{_N} || {_SUFFIX}")} || [event_type, 'then']
        WHEN 2 THEN ['About'] || {_TIMES.format(_COUNT, f'CAST({_N} AS VARCHAR)')} || ['percent', 'of', event_type]
        WHEN 3 THEN ['Room'] || {_TIMES.format(_COUNT, f'CAST({_N} AS VARCHAR)')} || [event_type]
        ELSE ['He', 'said', event_type || ' hm', 'today'] END AS w FROM events)
    SELECT event_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS k, unnest(w) AS said FROM e""")
def spoken_numbers(spark, sf_dir):
    """Sentences with amounts of money, ordinals, shares and plain numbers said in words, and some in which a word is said that nobody wrote."""
    i, kind = F.col("event_id"), F.col("event_type")
    n, number = (i % 9999 + 1).cast("int"), (i % 9999 + 1).cast("string")
    ones, tens = (F.array(*[F.lit(w) for w in ws]) for ws in (["", *align.CARDINALS[1:20]], ["", "", *align.CARDINALS[20:28]]))
    none, pick = F.array().cast("array<string>"), lambda words, k: F.get(words, F.floor(k).cast("int"))
    rest = F.when(n % 100 == 0, none).when(n % 100 < 20, F.array(pick(ones, n % 100))).when(n % 10 == 0, F.array(pick(tens, n % 100 / 10))).otherwise(F.array(pick(tens, n % 100 / 10), pick(ones, n % 10)))
    words = F.concat(
        F.when(n >= 1000, F.array(pick(ones, n / 1000), F.lit("thousand"))).otherwise(none), F.when(n % 1000 >= 100, F.array(pick(ones, n % 1000 / 100), F.lit("hundred"))).otherwise(none), rest
    )
    last = F.element_at(words, -1)
    ordinal = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in align.IRREGULAR.items() for x in kv]), last), F.when(last.endswith("ty"), F.regexp_replace(last, "y$", "ieth")).otherwise(F.concat(last, F.lit("th"))))
    ordinals = F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.array(ordinal))
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    lit = lambda *ws: F.array(*[F.lit(w) if isinstance(w, str) else w for w in ws])
    forms = [
        (F.concat(F.lit("Pay $"), number, F.lit(" to "), kind, F.lit(".")), F.concat(lit("pay"), words, lit("dollars", "to", kind))),
        (F.concat(F.lit("The "), number, suffix, F.lit(" "), kind, F.lit(", then.")), F.concat(lit("the"), ordinals, lit(kind, "then"))),
        (F.concat(F.lit("About "), number, F.lit(" percent of "), kind), F.concat(lit("about"), words, lit("percent", "of", kind))),
        (F.concat(F.lit("Room "), number, F.lit(": “"), kind, F.lit("”")), F.concat(lit("room"), words, lit(kind))),
        (F.concat(F.lit("He said "), kind, F.lit(" hm today")), lit("he", "said", "zzz", "today")),
    ]
    case = lambda j: F.coalesce(*[F.when(i % 5 == k, f[j]) for k, f in enumerate(forms)])
    t = table(spark, sf_dir, "events").select("event_id", case(0).alias("text"), case(1).alias("said"))
    timed = t.withColumn("words", F.transform("said", lambda w, k: F.struct(w.alias("word"), (k * 0.3).alias("start"), (k * 0.3 + 0.25).alias("end"))))
    found = align.aligned(timed.select("event_id", "text", "words")).select("event_id", "text", F.posexplode("spans").alias("k", "s"))
    return found.select("event_id", "k", F.substring("text", F.col("s.cs") + 1, F.col("s.ce") - F.col("s.cs")).alias("said"))


@query("translation_terms", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'mot' || event_id % 7 || '|Mo' ELSE 'page' END AS terms FROM events""")
def translation_terms(spark, sf_dir):
    i = F.col("event_id")
    first = F.concat(F.lit("{{trans-top|a}}\n* {{t+|de|Wort}}\n{{trans-bottom}}\n{{trans-top|b}}\n* {{t|fr|mot"), (i % 7).cast("string"), F.lit("}}, {{tt+|fr|Mo|m}}, {{t|fr|MO}}, {{t|fr|[x]}}\n{{trans-bottom}}\n{{trans-top|c}}{{t|fr|non}}{{trans-bottom}}"))
    text = F.when(i % 3 == 0, "nothing").when(i % 3 == 1, first).otherwise("{{t|fr|page}}")
    return table(spark, sf_dir, "events").select("event_id", F.array_join(K.translations(text, "fr"), "|").alias("terms"))
