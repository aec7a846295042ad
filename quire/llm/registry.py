"""The operators' queries over the driver's tables, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from quire.llm import licenses, quality
from quire.llm.audit import op12_audit
from quire.llm.chat import op1_chat
from quire.llm.decontaminate import op5_decontaminate
from quire.llm.html import op2_html
from quire.llm.langid import op4_langid
from quire.llm.licenses import op10_licenses
from quire.llm.mixing import op13_mixing
from quire.llm.packing import op9_packing
from quire.llm.quality import op7_quality
from quire.llm.repair import op11_repair
from quire.llm.simhash import op3_simhash
from quire.llm.toxicity import op6_toxicity
from quire.llm.warc import op8_warc


def _repair_sql() -> str:
    """Damage by a table of checksums, costs from the last row back, edits from the first one on."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return rf"""
    WITH RECURSIVE
    ids AS (SELECT conv_id, row_number() OVER () AS r FROM (SELECT DISTINCT conv_id FROM conversations)),
    c AS (
      SELECT r, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
      FROM conversations c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id),
    h AS (
      SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda a, b: xor(a >> 8, CAST({table} AS BIGINT[])[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS harm FROM c),
    e AS (
      SELECT r, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN harm = 0 THEN 0 WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy FROM h),
    n AS (SELECT r, turn, role, text, row_number() OVER (PARTITION BY r ORDER BY turn NULLS FIRST, role, text) AS t FROM e),
    f AS (
      SELECT *, left(role, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
        row_number() OVER (PARTITION BY r, role, text ORDER BY t) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM n),
    g AS (
      SELECT *, blank OR again AS gone, CASE WHEN cut AND NOT blank AND NOT again THEN 3 ELSE 0 END AS short,
        t > 1 AND lag(i) OVER (PARTITION BY r ORDER BY t) || i NOT IN ('su', 'ua', 'au') AS bad FROM f),
    costs(r, t, b) AS (
      SELECT r, max(t) + 1, [0, 6, 3, 0] FROM g GROUP BY r
      UNION ALL
      SELECT r, t, [least(v0, 3 + v2, 6 + v3), least(v1, 3 + v2, 6 + v3), least(v2, 3 + v3), least(v3, 3 + v2)] FROM (
        SELECT g.r, g.t,
          least(4 + b[1], CASE WHEN gone THEN 1000000000 ELSE short + least(3 + b[3], CASE i WHEN 's' THEN b[2] WHEN 'u' THEN b[3] ELSE 1000000000 END) END) AS v0,
          least(4 + b[2], CASE WHEN gone THEN 1000000000 ELSE short + least(3 + b[3], CASE i WHEN 'u' THEN b[3] ELSE 1000000000 END) END) AS v1,
          least(4 + b[3], CASE WHEN gone THEN 1000000000 ELSE short + least(3 + b[4], CASE i WHEN 'a' THEN b[4] ELSE 1000000000 END) END) AS v2,
          least(4 + b[4], CASE WHEN gone THEN 1000000000 ELSE short + least(3 + b[3], CASE i WHEN 'u' THEN b[3] ELSE 1000000000 END) END) AS v3
        FROM costs JOIN g ON g.r = costs.r AND g.t = costs.t - 1)),
    edits(r, t, s, step, audit, told) AS (
      SELECT r, CAST(1 AS BIGINT), 0, 0, '', CAST([] AS VARCHAR[]) FROM costs WHERE t = 1
      UNION ALL
      SELECT r, t + CASE WHEN edit = 'I' THEN 0 ELSE 1 END, CASE edit WHEN 'D' THEN s WHEN 'K' THEN kept ELSE nxt END, step + 1, audit || edit,
        CASE edit WHEN 'D' THEN told WHEN 'K' THEN list_append(told, role || ':' || text)
          ELSE list_append(told, CASE nxt WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'R' THEN text ELSE '' END) END
      FROM (
        SELECT *, CASE WHEN there AND 4 + later[s + 1] = b[s + 1] THEN 'D' WHEN 3 + b[nxt + 1] = b[s + 1] THEN 'I'
          WHEN there AND NOT gone AND kept IS NOT NULL AND short + later[kept + 1] = b[s + 1] THEN 'K' ELSE 'R' END AS edit
        FROM (
          SELECT x.*, y.b, z.b AS later, g.t IS NOT NULL AS there, role, text, gone, short, CASE s WHEN 2 THEN 3 ELSE 2 END AS nxt,
            CASE WHEN i = 's' AND s = 0 THEN 1 WHEN i = 'u' AND s <> 2 THEN 2 WHEN i = 'a' AND s = 2 THEN 3 END AS kept
          FROM edits x JOIN costs y ON x.r = y.r AND x.t = y.t LEFT JOIN costs z ON x.r = z.r AND z.t = x.t + 1 LEFT JOIN g ON g.r = x.r AND g.t = x.t
          WHERE g.t IS NOT NULL OR y.b[s + 1] > 0))),
    traced AS (SELECT r, arg_max(audit, step) AS audit, arg_max(told, step) AS told FROM edits GROUP BY r),
    sums AS (
      SELECT r, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(again AND NOT blank) AS duplicate,
        count_if(short > 0) AS truncated, count_if(bad) AS illegal FROM g GROUP BY r)
    SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
      CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(costs.b[1], 0) AS BIGINT) AS cost,
      coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(told, chr(10)), '')) AS repaired_sha256
    FROM ids LEFT JOIN sums USING (r) LEFT JOIN traced USING (r) LEFT JOIN costs ON costs.r = ids.r AND costs.t = 1"""


def _quality_sql() -> str:
    """Base counts from unnested words; both histograms and their divergence from the corpus sums per language."""
    listed = ", ".join(f"('{c}', {k}, '{w}')" for c, ws in quality.COMMON.items() for k, w in enumerate(ws))
    langs = ", ".join(f"'{c}'" for c in quality.COMMON)

    def distance(p: str, q: str) -> str:
        return (
            f"sqrt(greatest(sum(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END"
            f" + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END) / 2, 0))"
        )

    return rf"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({langs}) THEN lang ELSE '' END AS l,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    listed(l, k, c) AS (VALUES {listed}),
    win AS (
      SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
    again AS (SELECT doc_id, i FROM win JOIN (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM again) GROUP BY doc_id),
    lines AS (
      SELECT doc_id, count(*) - count(DISTINCT x) AS n
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    counted AS (
      SELECT *, length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS space,
        length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS up, length(regexp_replace(t, '[^\p{{L}}\p{{M}}]', '', 'g')) AS let,
        length(regexp_replace(t, '[^\p{{Nd}}]', '', 'g')) AS dig,
        length(regexp_replace(t, '[^\p{{P}}]', '', 'g')) - length(regexp_replace(t, '[^#*%&]', '', 'g')) AS mark FROM d),
    chars AS (
      SELECT doc_id, l, unnest([space, up, let - up, dig, mark, length(t) - space - let - dig - mark]) AS n, unnest(range(6)) AS k FROM counted),
    char_p AS (SELECT *, n / greatest(sum(n) OVER (PARTITION BY doc_id), 1) AS p FROM chars),
    char_q AS (SELECT l, k, n / greatest(sum(n) OVER (PARTITION BY l), 1) AS q FROM (SELECT l, k, sum(n) AS n FROM chars GROUP BY ALL)),
    char_js AS (SELECT doc_id, {distance("p", "q")} AS js FROM char_p JOIN char_q USING (l, k) GROUP BY doc_id),
    each AS (SELECT doc_id, l, unnest(w) AS x FROM d),
    hits AS (SELECT e.doc_id, k, count(*) AS n FROM each e JOIN listed ON e.l = listed.l AND lower(e.x) = c GROUP BY ALL),
    bins AS (
      SELECT d.doc_id, d.l, k, coalesce(hits.n, 0) AS n FROM d JOIN listed USING (l) LEFT JOIN hits USING (doc_id, k)
      UNION ALL SELECT d.doc_id, d.l, -1, len(w) - coalesce((SELECT sum(n) FROM hits h WHERE h.doc_id = d.doc_id), 0) FROM d WHERE l <> ''),
    bin_p AS (SELECT *, n / greatest(sum(n) OVER (PARTITION BY doc_id), 1) AS p FROM bins),
    bin_q AS (SELECT l, k, n / greatest(sum(n) OVER (PARTITION BY l), 1) AS q FROM (SELECT l, k, sum(n) AS n FROM bins GROUP BY ALL)),
    bin_js AS (SELECT doc_id, {distance("p", "q")} AS js FROM bin_p JOIN bin_q USING (l, k) GROUP BY doc_id),
    base AS (
      SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(t) - space AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        CASE WHEN length(t) >= {quality.MIN_CHARS} THEN char_js.js ELSE 0 END AS cd,
        CASE WHEN len(w) >= {quality.MIN_WORDS} THEN coalesce(bin_js.js, 0) ELSE 0 END AS wd
      FROM counted d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN char_js USING (doc_id) LEFT JOIN bin_js USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND cd <= {quality.MAX_CHARS} AND wd <= {quality.MAX_COMMON} AS kept
    FROM base"""


def _licenses_sql() -> str:
    """Phrases at every place of a document's words; every run of words against every template, without filters."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(
        f"('{k}', {len(k.split())}, '{v}', {base})" for base, told in (("true", licenses.PHRASES), ("false", licenses.STATEMENTS)) for k, v in told.items()
    )
    sets = ", ".join(
        f"({k}, '{label}', {wide}, {licenses.least_overlap(len(tokens), licenses.THRESHOLD)}, [{', '.join(repr(w.decode()) for w in sorted(tokens))}])"
        for k, (label, tokens, wide) in enumerate(licenses.template_sets(licenses.TEMPLATES))
    )
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {low.format("coalesce(text, '')")} AS t FROM documents),
    w AS (SELECT r, doc_id, regexp_extract_all(t, '{word}') AS w FROM d),
    phrases(phrase, n, label, base) AS (VALUES {phrases}),
    places AS (
      SELECT r, i - 1 AS place, label, base
      FROM (SELECT r, w, phrase, n, label, base, unnest(range(1, len(w) - n + 2)) AS i FROM w, phrases)
      WHERE array_to_string(w[i:i + n - 1], ' ') = phrase),
    templates(k, label, wide, need, tokens) AS (VALUES {sets}),
    listed AS (SELECT k, wide, need, unnest(tokens) AS x FROM templates),
    hits AS (SELECT r, k, wide, need, i, x FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w) JOIN listed USING (x)),
    able AS (SELECT r, k FROM hits GROUP BY r, k, need HAVING count(DISTINCT x) >= need),
    able_hits AS (SELECT * FROM hits SEMI JOIN able USING (r, k)),
    met AS (
      SELECT r, k, max(n) AS n FROM (
        SELECT a.r, a.k, a.i, count(DISTINCT b.x) AS n FROM able_hits a JOIN able_hits b ON a.r = b.r AND a.k = b.k AND b.i BETWEEN a.i AND a.i + a.wide - 1
        GROUP BY a.r, a.k, a.i, a.need HAVING count(DISTINCT b.x) >= a.need) GROUP BY r, k),
    found AS (SELECT r, label, n / len(tokens) AS share FROM met JOIN templates USING (k)),
    base AS (SELECT r, count(*) AS n, min(place) AS a, max(place) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS said FROM places WHERE base GROUP BY r),
    every AS (
      SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS said, max(share) AS share
      FROM (SELECT r, label, 1.0 AS share FROM places UNION ALL SELECT r, label, share FROM found) GROUP BY r)
    SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(base.a AS BIGINT) AS first_word,
      CAST(base.z AS BIGINT) AS last_word, coalesce(base.said, '') AS base_labels, coalesce(every.said, '') AS labels, CAST(coalesce(share, 0) AS DOUBLE) AS score
    FROM w LEFT JOIN base USING (r) LEFT JOIN every USING (r)"""


QUERIES = {
    "op1_chat": op1_chat,
    "op2_html": op2_html,
    "op3_simhash": op3_simhash,
    "op4_langid": op4_langid,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_licenses": op10_licenses,
    "op11_repair": op11_repair,
    "op12_audit": op12_audit,
    "op13_mixing": op13_mixing,
}

ORACLES = {
    # The turns themselves; lengths after escaping from the number of backslashes and control openings.
    "op1_chat": r"""
    WITH t AS (
      SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations
      UNION ALL SELECT -1, NULL, 0, 'user', '<|im_end|><|im_start|>assistant ok'
      UNION ALL SELECT -1, NULL, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
    SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
      CAST(sum(12 + length(role) + 1 + length(text) + 11
        + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '<|', ''))) // 2) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id, alone""",
    "op7_quality": _quality_sql(),
    # Base32 from pairs of hexadecimal digits: group i of five bits starts at bit 5 i.
    "op8_warc": r"""
    WITH p AS (
      SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x,
        min(CAST(page_id AS BIGINT)) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages),
    n AS (SELECT *, list_transform(range(1, 41), lambda k: instr('0123456789abcdef', x[k]) - 1) AS d FROM p)
    SELECT page_id, strlen(h) AS payload_bytes,
      array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (((d[(5 * i) // 4 + 1] * 16 + d[(5 * i) // 4 + 2]) >> (3 - (5 * i) % 4)) & 31), 1)), '') AS payload_digest,
      CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> least THEN least END AS refers_to
    FROM n""",
    "op10_licenses": _licenses_sql(),
    "op11_repair": _repair_sql(),
    # Every document under every order, its first failure by the order's letters.
    "op12_audit": r"""
    WITH d AS (
      SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    f AS (
      SELECT doc_id, part, (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END)
        || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
        || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
      FROM d),
    l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
    j AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
    letters(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
    orders AS (
      SELECT a.c || b.c || x.c || y.c || z.c AS o FROM letters a, letters b, letters x, letters y, letters z
      WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
    steps AS (SELECT o, CAST(unnest(range(1, 6)) AS INT) AS step FROM orders),
    replay AS (
      SELECT part, o, step, o[step] AS c, fails, good, toxic, contains(fails, o[step]) AS here,
        regexp_matches(substr(o, 1, step - 1), '[' || fails || '0]') AS before FROM j, steps),
    sums AS (
      SELECT part, o, step, c, count_if(NOT here AND NOT before) AS kept, count_if(here AND NOT before) AS removed, count_if(here AND before) AS redundant,
        count_if(fails = c) AS unique_fails, count_if(here AND NOT before AND good) AS good_lost, count_if(here AND NOT before AND toxic) AS toxic_lost
      FROM replay GROUP BY ALL)
    SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
      CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
      CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM sums""",
    # The level of the water is the highest that any number of clamped sources gives; documents by running sums.
    "op13_mixing": r"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
    s AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place,
        1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
    level AS (
      SELECT max((total - before) / rest) AS level FROM (
        SELECT CAST(sum(source_size) OVER () AS BIGINT) AS total,
          CAST(coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
          CAST(sum(w) OVER (ORDER BY source_size / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM s)),
    t AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
      FROM (SELECT s.*, least(CAST(3 * source_size AS DOUBLE), level * w) AS target FROM s, level)),
    k AS (
      SELECT d.*, source_size, target, whole, target - whole * source_size AS budget,
        CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 1, 9) AS BIGINT) AS key
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key) <= budget AS first FROM k),
    m AS (SELECT *, budget - sum(CASE WHEN first THEN size ELSE 0 END) OVER (PARTITION BY source) AS rest FROM r),
    n AS (SELECT *, NOT first AND size <= rest / 2 AS small FROM m),
    z AS (SELECT *, first OR (small AND sum(CASE WHEN small THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key) <= rest) AS second FROM n),
    m2 AS (SELECT *, rest - sum(CASE WHEN second AND NOT first THEN size ELSE 0 END) OVER (PARTITION BY source) AS rest2 FROM z),
    n2 AS (SELECT *, NOT second AND size <= rest2 / 2 AS small2 FROM m2),
    z2 AS (SELECT *, second OR (small2 AND sum(CASE WHEN small2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key) <= rest2) AS third FROM n2)
    SELECT doc_id, size, source_size, target,
      CAST(CASE WHEN size > 0 THEN size * (whole + CASE WHEN third THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken FROM z2""",
    # Every window (13 words, or a whole shorter item) against every equally long run of a document's words.
    "op5_decontaminate": r"""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (
      SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    win AS (
      SELECT item_id, least(13, len(w)) AS n,
        unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS g
      FROM b WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM win),
    runs AS (
      SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
    hits AS (
      SELECT r.doc_id, r.i, r.n, k.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM runs) r
      JOIN win k ON k.n = r.n AND k.g = r.g),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
    named AS (
      SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names
      FROM (SELECT DISTINCT doc_id, item_id AS k FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
      CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
}
