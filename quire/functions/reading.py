"""Units of reading in Arrow batches: what text.paragraphs() and text.chunks() say, as kernels over whole batches.

The column functions spell the same rules as folds of arrays, which the JVM interprets element by
element; over large tables these kernels take a tenth of the time. Each rule marks
which pieces join the one before, by a running state, and the marked runs are put together once.
"""

from __future__ import annotations

import re
from itertools import accumulate, chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.functions.text import ABBREVIATIONS, MAX_CHARS, MIN_CHARS

#: White space of Unicode; words of the rules are letters, marks, digits and the underscore.
W = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CLOSING, CUT = "\"'”’)]", "\x01"
BLANK_LINES, HYPHEN = re.compile(r"\n[ \t]*\n[ \t\n]*"), regex.compile(r"([\p{L}\p{M}\p{N}_])[-‐]\n([\p{L}\p{M}\p{N}_])")
LINE_END, SPACES = re.compile(r"[ \t]*\n[ \t]*"), re.compile(r"[ \t\u00a0]{2,}")
ENDS = re.compile(rf"([.!?])([\"'”’)\]]?)[{W}]+([\"'“‘(\[A-Z0-9])")
LAST_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_.]+\.$")
#: Characters at a piece's end among which its last word is looked for first.
TAIL = 10
PART = re.compile(rf"(?s)[{W}]*+(.{{1,{MAX_CHARS}}}\Z|.{{{MAX_CHARS * 2 // 5},{MAX_CHARS - 2}}}[;:,](?= )|.{{1,{MAX_CHARS - 1}}} |.{{{MAX_CHARS}}})")
SHORT_NAMES = frozenset(ABBREVIATIONS)
#: Rows and characters of output in a batch, but for the last text's.
ROWS, CHARS = 1 << 12, 1 << 20


def ends_line(line: str) -> bool:
    """Whether a line ends as a sentence or clause does, a closing mark aside."""
    tail = line.rstrip(W)[-2:]
    return tail[-1:] in tuple(".!?:;") or (tail[-1:] in tuple(CLOSING) and tail[:-1] in tuple(".!?:;"))


def blocks(text: str) -> list[str]:
    """Raw paragraphs of a text with unix lines."""
    if BLANK_LINES.search(text):
        return [b for b in BLANK_LINES.split(text) if b.strip(W)]
    lines = [x for x in text.split("\n") if x.strip(W)]
    n = len(lines)
    if n > 2 and sum(len(x.strip(W)) <= 80 for x in lines) > 0.8 * n and 2 * sum(map(ends_line, lines)) < n:
        return [text]
    return lines


def cleaned(block: str) -> str:
    flat = LINE_END.sub(" ", HYPHEN.sub(r"\1\2", block)) if "\n" in block else block
    return SPACES.sub(" ", flat).strip(W)


def paragraphs(text: str | None) -> list[str]:
    """Cleaned paragraphs of a text, without empty ones."""
    unix = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    return [p for p in map(cleaned, blocks(unix)) if p]


def put_together(parts: list[str], joins) -> list[str]:
    """Parts, each that joins added to the one before after a space."""
    runs = accumulate(not j for j in joins)
    return [" ".join(p for _, p in run) for _, run in groupby(zip(runs, parts, strict=True), key=itemgetter(0))]


def is_short_name(piece: str) -> bool:
    """Whether a piece ends in a known abbreviation or a single letter and a full stop.

    İ is one letter, as in the SQL; Python's lower case of it has two characters.
    """
    if piece[-1:] != ".":
        return False
    found = LAST_WORD.search(piece, max(0, len(piece) - TAIL))
    if found and found.start() == len(piece) - TAIL:  # a long word, or many full stops
        found = LAST_WORD.search(piece)
    word = found[0].replace("İ", "i").lower().strip(".") if found else ""
    return word in SHORT_NAMES or (len(word) == 1 and word.isalpha())


def still_open(curly: int, any_curly: bool, straight: int) -> bool:
    return curly > 0 if curly else not any_curly and straight % 2 == 1


def quote_joins(parts: list[str]):
    """Which parts continue a double quotation that the parts joined so far leave open, under MAX_CHARS."""
    told = [(p.count("“") - p.count("”"), "“" in p or "”" in p, p.count('"'), len(p)) for p in parts]

    def step(before, part):
        _, curly, some, straight, n = before
        c, s, q, m = part
        if still_open(curly, some, straight) and n + m < MAX_CHARS:
            return True, curly + c, some or s, straight + q, n + 1 + m
        return False, c, s, q, m

    return (s[0] for s in accumulate(told, step, initial=(False, 0, False, 0, MAX_CHARS)))


def sentences(paragraph: str) -> list[str]:
    """Sentences of a paragraph: pieces, joined again after abbreviations and inside an open quotation."""
    parts = [p for p in (x.strip(W) for x in ENDS.sub(rf"\1\2{CUT}\3", paragraph).split(CUT)) if p]
    if len(parts) > 1:
        after = [is_short_name(p) for p in parts[:-1]]
        if any(after):
            parts = put_together(parts, [False, *after])
    if len(parts) > 1 and any(m in paragraph for m in '"“”'):
        joins = quote_joins(parts)
        next(joins)
        parts = put_together(parts, joins)
    return parts


def cut(sentence: str) -> list[str]:
    """A long sentence in parts of at most MAX_CHARS."""
    return [sentence] if len(sentence) <= MAX_CHARS else [p for p in (m[1].strip(W) for m in PART.finditer(sentence)) if p]


def chunks(paragraph: str) -> list[str]:
    """The units in which a paragraph is read: sentences, joined while the last is under MIN_CHARS, long ones cut."""
    parts = sentences(paragraph)
    sizes = list(map(len, parts))
    if len(parts) > 1 and min(sizes) < MIN_CHARS:
        run = accumulate(sizes, lambda n, m: n + 1 + m if n < MIN_CHARS else m)
        parts = put_together(parts, [False, *(n < MIN_CHARS for n in list(run)[:-1])])
    return list(chain.from_iterable(map(cut, parts)))


def units(text: str | None) -> list[str]:
    """The chunks of all paragraphs of a text, in order."""
    return list(chain.from_iterable(map(chunks, paragraphs(text))))


def exploded(df: DataFrame, text_col: str, rule, place: str, *keep: str, to: str = "text", whole: str | None = None) -> DataFrame:
    """Columns keep of df with a row for each of the texts that rule gives of text_col, numbered from 0.

    whole: a boolean column; where it is true the text stays one.
    """
    base = df.select(*dict.fromkeys([*keep, text_col, *([whole] if whole else [])]))

    def run(batches):
        for batch in batches:
            texts, first = batch.column(batch.schema.get_field_index(text_col)), 0
            stays = batch.column(batch.schema.get_field_index(whole)).to_pylist() if whole else [False] * len(texts)
            held, counts, size = [], [], 0
            for k in range(len(texts)):
                found = [texts[k].as_py()] if stays[k] else rule(texts[k].as_py())
                held += found
                counts.append(len(found))
                size += sum(map(len, filter(None, found)))
                if len(held) >= ROWS or size >= CHARS or k == len(texts) - 1:
                    rows = np.repeat(np.arange(first, k + 1), counts)
                    number = np.concatenate([np.arange(n, dtype=np.int32) for n in counts]) if counts else np.zeros(0, np.int32)
                    columns = [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows)) for c in keep]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(number, pa.int32()), pa.array(held, pa.string())], names=[*keep, place, to])
                    held, counts, size, first = [], [], 0, k + 1

    fields = [base.schema[c] for c in keep]
    return base.mapInArrow(run, T.StructType([*fields, T.StructField(place, T.IntegerType()), T.StructField(to, T.StringType())]))
