"""Text as Column functions: paragraphs, sentence pieces, headings, names, words.

All work on the JVM inside code generation or higher-order functions; no Python runs.
Offsets and lengths are code points. Null texts give null or an empty array, as stated.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS, MIN_CHARS = 350, 30
# Words before a full stop that do not end a sentence.
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr st vs etc inc ltd co corp dept fig no vol pp eg ie al ca cf ph approx gen gov sen rep ave blvd rd mt ft i.e e.g"
).split()
# Fixed value: a sentence ends at . ! or ?, a closing mark may follow, then white space and what may begin a sentence.
ENDS = r"([.!?])([\"'”’)\]]?)(?U:\s+)([\"'“‘(\[A-Z0-9])"
CUT = "\u0001"


def flat(text: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_paragraph(text: Column) -> Column:
    """Words broken at a line's end are joined, lines of a paragraph are joined by a space, blank runs collapse."""
    joined = F.regexp_replace(text, r"(?U)(\w)[-‐]\n(\w)", "$1$2")
    spaced = F.regexp_replace(joined, r"[ \t]*\n[ \t]*", " ")
    return F.regexp_replace(F.regexp_replace(spaced, r"[ \t\u00A0]{2,}", " "), r"(?U)^\s+|\s+$", "")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")


def not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)[^\s]")


def paragraphs(text: Column) -> Column:
    """Array of raw paragraphs: at blank lines if there are any; hard-wrapped lines stay one block; else one a line.

    Hard-wrapped: more than two lines, over 0.8 of them at most 80 long, under half ending like a sentence.
    """
    t = unix_lines(text)
    blocks = F.filter(F.split(t, r"\n[ \t]*\n[ \t\n]*"), not_blank)
    lines = F.filter(F.split(t, "\n"), not_blank)
    short = F.size(F.filter(lines, lambda x: F.length(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")) <= 80))
    ended = F.size(F.filter(lines, lambda x: x.rlike(r"[.!?:;][\"'”’)\]]?(?U:\s*)$")))
    wrapped = (F.size(lines) > 2) & (short / F.size(lines) > 0.8) & (ended / F.size(lines) < 0.5)
    return (
        F.when(~not_blank(t), F.array().cast("array<string>"))
        .when(t.rlike(r"\n[ \t]*\n"), blocks)
        .when(wrapped, F.array(t))
        .otherwise(lines)
    )


def pieces(paragraph: Column) -> Column:
    """The parts of a paragraph between sentence ends, before any are merged again; empty parts are gone."""
    parts = F.split(F.regexp_replace(paragraph, ENDS, f"$1$2{CUT}$3"), CUT)
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def abbreviated(piece: Column) -> Column:
    """Whether a piece ends in a known abbreviation or a single letter and a full stop; İ, of two characters in lower case on the JVM, is one."""
    word = F.regexp_replace(F.lower(F.translate(F.regexp_extract(piece, r"(?U)(\b[\w.]+)\.$", 1), "İ", "i")), r"\.+$", "")
    return word.isin(ABBREVIATIONS) | word.rlike(r"^\p{L}$")


def count_of(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what)))


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once though use may name it often."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def runs(parts: Column, joins: Column) -> Column:
    """An array of texts with each that joins (an array of booleans) added to the one before, after a space."""

    def put(p: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(p.parts) - 1), lambda i: ~F.get(p.joins, i))
        text = lambda s, k, all_: F.array_join(F.slice(p.parts, s + 1, F.coalesce(F.get(all_, k + 1), F.size(p.parts)) - s), " ")
        return bound(starts, lambda all_: F.transform(all_, lambda s, k: text(s, k, all_)))

    whole = F.struct(parts.alias("parts"), joins.alias("joins"))
    return F.when(F.exists(joins, lambda j: j), bound(whole, put)).otherwise(parts)


#: Elements that a fold takes at a time, so that its result is put together from few pieces.
STEP = 256


def folded(items: Column, zero: Column, step, field: str = "joins", kind: str = "boolean") -> Column:
    """Fold an array from the state zero; step(state, item) gives the next state, whose field of that name and kind is collected. Linear in the array."""

    def inner(a: Column, x: Column) -> Column:
        return bound(step(a.state, x), lambda s: F.struct(s.alias("state"), F.concat(a.done, F.array(s[field])).alias("done")))

    def outer(a: Column, block: Column) -> Column:
        part = F.aggregate(block, F.struct(a.state.alias("state"), F.array().cast(f"array<{kind}>").alias("done")), inner)
        return bound(part, lambda p: F.struct(p.state.alias("state"), F.concat(a.done, F.array(p.done)).alias("done")))

    def put(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda k: F.slice(v, k * STEP + 1, F.lit(STEP)))
        start = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("done"))
        return F.when(F.size(v) > 0, F.aggregate(blocks, start, outer, lambda a: F.flatten(a.done))).otherwise(F.array().cast(f"array<{kind}>"))

    return bound(items, put)


def sentences(paragraph: Column) -> Column:
    """Sentences of a paragraph: pieces, joined again after abbreviations and inside an open quotation (under MAX_CHARS)."""
    whole = bound(pieces(paragraph), lambda v: runs(v, F.transform(v, lambda p, i: (i > 0) & F.coalesce(abbreviated(F.get(v, i - 1)), F.lit(False)))))

    def quoted(v: Column) -> Column:
        marks = F.transform(v, lambda p: F.struct(count_of(p, "“").alias("o"), count_of(p, "”").alias("c"), count_of(p, '"').alias("s"), F.length(p).alias("n")))
        zero = F.struct(F.lit(0).alias("o"), F.lit(0).alias("c"), F.lit(0).alias("s"), F.lit(MAX_CHARS).alias("n"), F.lit(False).alias("joins"))

        def step(a: Column, m: Column) -> Column:
            is_open = F.when(a.o != a.c, a.o > a.c).when((a.o > 0) | (a.c > 0), False).otherwise(a.s % 2 == 1)
            more = lambda k: F.when(j, a[k]).otherwise(0) + m[k]
            j = is_open & (a.n + m.n < MAX_CHARS)
            n = F.when(j, a.n + 1).otherwise(0) + m.n
            return F.struct(more("o").alias("o"), more("c").alias("c"), more("s").alias("s"), n.alias("n"), j.alias("joins"))

        quotes = F.exists(v, lambda p: p.rlike('["“”]'))
        return F.when(quotes, runs(v, folded(marks, zero, step))).otherwise(v)

    return bound(whole, quoted)


def soft_split(sentence: Column) -> Column:
    """Cut a long sentence into parts of at most MAX_CHARS: after the last clause mark past two fifths of that, else the last space, else there."""
    n, least = MAX_CHARS, MAX_CHARS * 2 // 5
    part = rf"(?s)(?U:\s*+)(.{{1,{n}}}\z|.{{{least},{n - 2}}}[;:,](?= )|.{{1,{n - 1}}} |.{{{n}}})"
    parts = F.transform(F.regexp_extract_all(sentence, F.lit(part), F.lit(1)), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.when(F.length(sentence) <= n, F.array(sentence)).otherwise(F.filter(parts, lambda p: p != ""))


def chunks(paragraph: Column) -> Column:
    """The units in which a paragraph is read: sentences, joined while the last is under MIN_CHARS, long ones cut."""

    def joined(v: Column) -> Column:
        zero = F.struct(F.lit(MIN_CHARS).alias("n"), F.lit(False).alias("joins"))

        def step(a: Column, n: Column) -> Column:
            return F.struct((F.when(a.n < MIN_CHARS, a.n + 1).otherwise(0) + n).alias("n"), (a.n < MIN_CHARS).alias("joins"))

        short = F.exists(v, lambda p: F.length(p) < MIN_CHARS)
        return F.when(short, runs(v, folded(F.transform(v, lambda p: F.length(p)), zero, step))).otherwise(v)

    return F.flatten(F.transform(bound(sentences(paragraph), joined), lambda s: soft_split(s)))


def clean_paragraphs(text: Column) -> Column:
    """Cleaned paragraphs of a text, without empty ones."""
    return F.filter(F.transform(paragraphs(text), clean_paragraph), lambda p: p != "")


def units(text: Column) -> Column:
    """The chunks of all paragraphs of a text, in order."""
    return F.flatten(F.transform(clean_paragraphs(text), chunks))


def roman(numeral: Column) -> Column:
    """Value of a roman or decimal numeral; null if it is neither. A trailing full stop is ignored."""
    s = F.upper(F.regexp_replace(F.trim(numeral), r"\.+$", ""))
    value = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in kv]), c)
    digits = F.transform(F.split(s, ""), value)
    signed = F.transform(digits, lambda v, i: F.when(F.get(digits, i + 1) > v, -v).otherwise(v))
    total = F.aggregate(signed, F.lit(0), lambda a, v: a + v)
    return F.when(s.rlike(r"^\d+$"), s.cast("int")).when(s.rlike(r"^[IVXLCDM]+$"), total)


# Forms of chapter headings.
HEADING = {
    "explicit": r"(?i)^(chapter|part|book|canto|act|scene|stave|letter|prologue|epilogue|preface|foreword|introduction|afterword|conclusion|appendix)\b[\s.:—–-]*([ivxlcdm]+|\d{1,4}|[a-z]+)?\b.{0,70}$",
    "numeral": r"^(?:[IVXLCDM]{1,8}|\d{1,3})\.?$",
    "numtitle": r"^(?:[IVXLCDM]{1,8}|\d{1,3})\.\s+[\"'“‘(]?[A-Z].{0,60}$",
    "allcaps": r"^[^a-z]{2,60}$",
}


def heading_kind(paragraph: Column) -> Column:
    """explicit, numeral, numtitle or allcaps for a paragraph that may be a heading; else null."""
    letters = F.length(F.regexp_replace(paragraph, r"\P{L}", ""))
    shouts = paragraph.rlike(HEADING["allcaps"]) & (letters >= F.greatest(F.lit(2), F.floor(F.length(paragraph) / 2)))
    numbered = paragraph.rlike(HEADING["numtitle"])
    return F.when(
        (F.length(paragraph) <= 90) & (F.locate("\n", paragraph) == 0),
        F.when(paragraph.rlike(HEADING["explicit"]), "explicit")
        .when(paragraph.rlike(HEADING["numeral"]), "numeral")
        .when(numbered, F.when(roman(F.substring_index(paragraph, ".", 1)).isNotNull(), "numtitle"))
        .when(shouts, "allcaps"),
    )


def inline_markdown(text: Column) -> Column:
    """Plain text of a block of Markdown: links become their label, emphasis (three deep), a quote and a bullet mark go, escapes are undone."""
    t = F.regexp_replace(text, r"(?<!!)\[([^\]]*)\]\([^)]*\)", "$1")
    for _ in range(3):
        t = F.regexp_replace(t, r"(?s)(\*\*|__|\*|_|`)(.+?)\1", "$2")
    t = F.regexp_replace(F.regexp_replace(t, r"\A>\s?", ""), r"\A[-*+]\s+", "")
    return F.regexp_replace(F.regexp_replace(t, r"\\([\\`*_{}\[\]()#+.!-])", "$1"), r"(?U)\A\s+|\s+\z", "")


def unescaped(text: Column) -> Column:
    """Character references undone: decimal, hexadecimal and by name; unknown ones stay."""
    mark = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][0-9A-Za-z]{1,10});"
    names = F.create_map(*[F.lit(x) for name, code in sorted({**name2codepoint, "apos": 39}.items()) for x in (name, chr(code))])

    def by_number(p: Column) -> Column:
        base = F.when(p.rlike("^&#[xX]"), 16).otherwise(10)
        read = F.when(base == 16, F.conv(F.regexp_extract(p, "^&#[xX](.*);$", 1), 16, 10)).otherwise(F.regexp_extract(p, "^&#(.*);$", 1)).try_cast("long")
        valid = lambda n: (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        return bound(read, lambda n: F.when(valid(n), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))

    def char(p: Column) -> Column:
        return F.coalesce(F.when(p.startswith("&#"), by_number(p)).otherwise(F.try_element_at(names, F.substring(p, F.lit(2), F.length(p) - 2))), p)

    def undone(t: Column) -> Column:
        parts = F.regexp_extract_all(t, F.lit(rf"{mark}|[^&]+|&"), F.lit(0))
        return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("&") & (F.length(p) > 1), char(p)).otherwise(p)), "")

    return bound(text, lambda t: F.when(t.contains("&"), undone(t)).otherwise(t))


def normal_word(word: Column) -> Column:
    """A looked-up word: soft hyphens and what is no word character at its ends are gone; lower case."""
    return F.lower(F.regexp_replace(F.replace(word, F.lit("\u00ad")), r"(?U)^[^\w]+|[^\w]+$", ""))


def spellings(word: Column) -> Column:
    """Spellings to try for an English word, the given one first, without repeats."""
    n, less = F.length(word), lambda k: F.expr("null") if k is None else F.substring(word, F.lit(1), F.length(word) - k)
    tried = [
        (F.lit(True), word),
        (word.endswith("ies") & (n > 4), F.concat(less(3), F.lit("y"))),
        (word.endswith("es") & (n > 4), less(2)),
        (word.endswith("s") & ~word.endswith("ss") & (n > 3), less(1)),
        (word.endswith("ing") & (n > 5), less(3)),
        (word.endswith("ing") & (n > 5), F.concat(less(3), F.lit("e"))),
        (word.endswith("ed") & (n > 4), less(2)),
        (word.endswith("ed") & (n > 4), less(1)),
    ]
    return F.array_distinct(F.array_compact(F.array(*[F.when(ok, c) for ok, c in tried])))


def printable(text: Column, limit: int = 200) -> Column:
    return F.substring(F.regexp_replace(text, r"[\x00-\x1f\x7f-\x9f]", " "), 1, limit)


def reading_minutes(text_bytes: Column) -> Column:
    """Whole minutes to hear a text of so many bytes, at 6 bytes a word and 155 words a minute, 18 000 bytes of front matter aside."""
    return F.floor(F.greatest(text_bytes - 18_000, F.lit(0)) / 6.0 / 155).cast("int")


def display_name(name: Column) -> Column:
    """Given name first; bracketed parts go; names with no comma or several, or with dates after it, stay."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", "")), ",+$", "")
    parts = F.transform(F.split(bare, ","), lambda p: F.trim(p))
    two = (F.size(parts) == 2) & (F.get(parts, F.lit(1)) != "") & ~F.get(parts, F.lit(1)).rlike(r"^\d")
    return F.when(two, F.concat(F.get(parts, F.lit(1)), F.lit(" "), F.get(parts, F.lit(0)))).otherwise(bare)


def display_title(title: Column) -> Column:
    """Lines joined by ``: ``, subfield marks gone; ``Untitled`` if nothing is left."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(title, r"\s*\$[a-z]\s*", " "), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.array_join(lines, ": ")).otherwise("Untitled")


def normal_title(title: Column, limit: int = 200) -> Column:
    """A title or folder name with white space levelled, cut to limit; null if nothing is left."""
    return F.nullif(F.substring(flat(title), 1, limit), F.lit(""))
