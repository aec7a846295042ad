"""Spans of text against times and places: estimated word times, spoken words, boxes on a page."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import bound, folded
from quire.plans.staging import staged

TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_'’-]*"
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("cs", T.IntegerType()), T.StructField("ce", T.IntegerType())]))


def estimated_words(text: Column, duration: Column) -> Column:
    """Spans (start, end, cs, ce) of a text's words, the duration dealt out by word length plus one; none if it is not above 0."""
    kind = "struct<start:double,end:double,cs:int,ce:int>"

    def spans(words: Column, gaps: Column) -> Column:
        pairs = F.transform(words, lambda w, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(w).alias("n")))
        total = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w) + 1)

        def step(a: Column, p: Column) -> Column:
            cs, done = a.at + p.gap, a.done + p.n + 1
            start, end = F.round(duration * a.done / a.total, 3), F.round(duration * done / a.total, 3)
            span = F.struct(start.alias("start"), end.alias("end"), cs.alias("cs"), (cs + p.n).alias("ce"))
            return F.struct((cs + p.n).alias("at"), done.alias("done"), a.total.alias("total"), span.cast(kind).alias("span"))

        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("done"), total.alias("total"), F.lit(None).cast(kind).alias("span"))
        return folded(pairs, zero, step, "span", kind)

    found = bound(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: bound(F.split(F.regexp_replace(text, TOKEN, "\u0001"), "\u0001"), lambda g: spans(w, g)))
    return F.when(duration > 0, found).otherwise(F.array().cast(SPAN))


def word_times(df: DataFrame, text_col: str, duration_col: str, *keep: str) -> DataFrame:
    """Columns keep of df with a row for each word of a text: k, word, cs, ce, start, end, as estimated_words() has them; none if the duration is not above 0.

    The sums run along a text in Arrow batches; times are worked out of them on the JVM.
    """
    base = df.filter(F.col(duration_col) > 0).select(*dict.fromkeys([*keep, text_col, duration_col]))
    kept = list(dict.fromkeys([*keep, duration_col]))
    token = regex.compile(TOKEN)

    def run(batches):
        for batch in batches:
            told = [[(m[0], *m.span()) for m in token.finditer(t or "")] for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            counts = np.array([len(w) for w in told])
            rows = np.repeat(np.arange(len(told)), counts)
            word, cs, ce = zip(*(x for w in told for x in w), strict=True) if len(rows) else ((), (), ())
            cs, ce = np.array(cs, np.int64), np.array(ce, np.int64)
            ends, starts = np.cumsum(counts), np.cumsum(counts) - counts
            sums = np.concatenate([[0], np.cumsum(ce - cs + 1)])
            columns = [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows)) for c in kept]
            first = starts[rows] if len(rows) else rows
            made = (np.arange(len(rows)) - first, cs, ce, sums[:-1] - sums[first], sums[1:] - sums[first], sums[ends[rows]] - sums[first])
            arrays = [pa.array(x.astype(np.int32)) for x in made]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(word, pa.string()), *arrays], names=[*kept, "word", "k", "cs", "ce", "_before", "_after", "_total"])

    fields = [base.schema[c] for c in kept] + [T.StructField("word", T.StringType())] + [T.StructField(c, T.IntegerType()) for c in ("k", "cs", "ce", "_before", "_after", "_total")]
    found = base.mapInArrow(run, T.StructType(fields))
    at = lambda c: F.round(F.col(duration_col) * F.col(c) / F.col("_total"), 3)
    return found.select(*keep, "k", "word", "cs", "ce", at("_before").alias("start"), at("_after").alias("end"))


# Words of spoken numbers, and words that may stand inside or after one; a number as it is written.
CARDINALS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion"
).split()
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
BETWEEN = frozenset("and point oh".split())
AFTER = frozenset("dollars dollar cents cent percent pounds pound euros euro".split())
WRITTEN = re.compile(r"(?<!\w)[$€£]?\d(?:[\d,.:/\-–—]*\d)?\w*")
EDGES = "\"'“”‘’()[].,!?;:—–-"
QUOTES = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"'})
#: How far ahead of the last place a word is looked for, in characters.
REACH = 80


def number_words() -> frozenset[str]:
    """Cardinals, their ordinals, and the plurals of tens and larger ones."""
    ordinals = [IRREGULAR.get(w, w[:-1] + "ieth" if w.endswith("ty") else w + "th") for w in CARDINALS if w not in ("zero", "trillion")]
    plurals = [w[:-1] + "ies" if w.endswith("y") else w + "s" for w in CARDINALS[20:] if w != "trillion"]
    return frozenset((*CARDINALS, *ordinals, *plurals))


NUMBERS = number_words()


def is_number(word: str) -> bool:
    parts = [p for p in word.split("-") if p]
    return bool(parts) and NUMBERS.issuperset(parts)


def is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


class Place:
    """Where a text was heard last, and the written number that a run of spoken number words is heard for."""

    def __init__(self, text: str):
        self.low, self.at, self.number = text.lower().translate(QUOTES), 0, None

    def literal(self, word: str) -> tuple[int, int] | None:
        """The word itself, whole, within reach."""
        stop, low = self.at + REACH + len(word), self.low
        at = low.find(word, self.at, stop)
        while at >= 0:
            end = at + len(word)
            if not (at and is_word(low[at - 1]) or end < len(low) and is_word(low[end])):
                return at, end
            at = low.find(word, at + 1, stop)
        return None

    def written(self, at: int) -> tuple[int, int] | None:
        """The next number as it is written, within reach."""
        m = WRITTEN.search(self.low, at)
        return m.span() if m and m.start() <= at + REACH else None

    def leave_number(self) -> None:
        if self.number:
            self.at, self.number = self.number[1], None

    def mark(self, marks: str) -> None:
        """A mark was heard: it ends a spoken number, unless it stands in the written one."""
        if self.number and marks not in self.low[slice(*self.number)]:
            self.leave_number()

    def hear(self, word: str, numeric: bool) -> tuple[int, int] | None:
        if not numeric:
            self.leave_number()
        said = self.literal(word)
        if numeric:
            number = self.number or self.written(self.at)
            if self.number and said:
                # Inside a run only the very next word can be meant itself, and only before another number.
                end, after = self.number[1], self.written(self.number[1])
                if said[0] < end or after and said[0] >= after[0] or re.search(r"\w", self.low[end : said[0]]):
                    said = None
            elif said and number and said[0] >= number[0]:
                said = None
            if not said and number:
                self.at, self.number = number[0], number
                return number
        if said:
            self.at, self.number = said[1], None
        return said


def heard(text: str, spoken: list[tuple[str, float | None, float | None]]) -> list[tuple[float | None, float | None, int, int]]:
    """(start, end, cs, ce) for each spoken (word, start, end): its time, and the span of text that it is heard for (-1 if none).

    Words are matched forward within REACH characters at word borders; a run of number words
    lights the next written number; what stays unmatched between two matches shares the text
    between them. A mark is no word of its own: the word before it lasts until the mark ends.
    """
    place, out = Place(text), []
    words = [w.strip().strip(EDGES).lower().translate(QUOTES) for w, _, _ in spoken]
    following = [""] * len(words)
    for k in range(len(words) - 2, -1, -1):
        following[k] = words[k + 1] or following[k + 1]
    for (raw, start, end), word, after in zip(spoken, words, following, strict=True):
        if not word:
            place.mark(raw.strip().translate(QUOTES))
            if out and end is not None and (out[-1][1] is None or end > out[-1][1]):
                out[-1] = (out[-1][0], end, *out[-1][2:])
            continue
        numeric = is_number(word) or place.number is not None and (word in AFTER or word in BETWEEN and is_number(after))
        out.append((start, end, *(place.hear(word, numeric) or (-1, -1))))
    return [(*o[:2], *span) for o, span in zip(out, _filled(text, [o[2:] for o in out]), strict=True)]


def _filled(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs without a span take the text between their neighbours, if there is a word in it."""
    out, k = list(spans), 0
    while k < len(out):
        end = k
        while end < len(out) and out[end] == (-1, -1):
            end += 1
        if end > k:
            a, b = out[k - 1][1] if k else 0, out[end][0] if end < len(out) else len(text)
            gap = text[a:b] if a < b else ""
            a += len(gap) - len(gap.lstrip(" \t\n\"'“”‘’([{,;:"))
            b = a + len(text[a:b].rstrip(" \t\n\"'“”‘’)]},;:")) if a < b else a
            if re.search(r"\w", text[a:b]):
                out[k:end] = [(a, b)] * (end - k)
        k = max(end, k + 1)
    return out


#: The version of the rules above; what an older one aligned is aligned again when it is read.
ALIGNED_BY = 2


#: Words that are heard before their spans leave a task.
AT_ONCE = 1 << 14


def aligned(rows: DataFrame) -> DataFrame:
    """rows (text, words: array of (word, start, end)) with spans; a small kernel a row, in Arrow batches.

    Of a batch only rows of about AT_ONCE words are held as Python values at a time.
    """
    names = ("start", "end", "cs", "ce")
    kinds = (pa.float64(), pa.float64(), pa.int32(), pa.int32())

    def heard_in(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns, counts = ([], [], [], []), [0]
        for text, words in zip(batch.column("text").to_pylist(), batch.column("words"), strict=True):
            spans = heard(text or "", [(w["word"] or "", w["start"], w["end"]) for w in words.as_py() or [] if w])
            for column, values in zip(columns, zip(*spans, strict=True), strict=False):
                column.extend(values)
            counts.append(len(spans))
        made = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        spans = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), made)
        return pa.RecordBatch.from_arrays([*batch.columns, spans], names=[*batch.schema.names, "spans"])

    def run(batches):
        for batch in batches:
            ends, first = np.asarray(batch.column("words").offsets), 0
            while first < len(batch):
                past = max(first + 1, int(np.searchsorted(ends, ends[first] + AT_ONCE, "right")) - 1)
                yield heard_in(batch.slice(first, past - first))
                first = past

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("spans", SPAN)]))


def realigned(entries: DataFrame, version: int = ALIGNED_BY) -> DataFrame:
    """Stored sounds (text, words, spans, aligned_by): those of another version that kept text and words are aligned again; others stay."""
    old = ~F.col("aligned_by").eqNullSafe(F.lit(version)) & (F.coalesce("text", F.lit("")) != "") & (F.coalesce(F.size("words"), F.lit(0)) > 0)
    again = aligned(entries.filter(old).drop("spans")).withColumn("aligned_by", F.lit(version)).select(*entries.columns)
    return entries.filter(~old).unionByName(again)


def speakable(text: Column) -> Column:
    """A text as it is sent to a voice: dashes of two hyphens as one mark, brackets round, upright bars as commas; no word changes."""
    return F.translate(F.regexp_replace(text, "--+", "—"), "[]{}|", "()(),")


def has_speech(text: Column) -> Column:
    """Whether there is a letter or digit to say."""
    return F.coalesce(speakable(text).rlike(r"[\p{L}\p{N}]"), F.lit(False))


def line_boxes(words: DataFrame, most: int = 24) -> DataFrame:
    """(id, x0, y0, x1, y1): the union box of each line's words, the first so many in reading order."""
    box = words.groupBy("id", "block", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    n = F.row_number().over(Window.partitionBy("id").orderBy("y0", "x0"))
    return box.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n", "block", "line")


#: Cells of a page's grid along a side, at most.
SIDE = 1 << 10


def gridded(boxes: DataFrame, slack: float) -> DataFrame:
    """(id, page, left, top, width, height, side): a grid for each page, of about as many cells as it has boxes."""
    stats = boxes.groupBy("id", "page").agg(
        F.min("x0").alias("left"), F.min("y0").alias("top"), F.max("x1").alias("right"), F.max("y1").alias("bottom"), F.least(F.lit(SIDE), F.greatest(F.lit(1), F.ceil(F.sqrt(F.count("*"))))).cast("int").alias("side")
    )
    size = lambda a, b: F.greatest((F.col(b) - F.col(a) + 2 * slack) / F.col("side"), F.lit(1e-9))
    return stats.select("id", "page", (F.col("left") - slack).alias("left"), (F.col("top") - slack).alias("top"), size("left", "right").alias("width"), size("top", "bottom").alias("height"), "side")


def cell(x: Column, start: str, size: str) -> Column:
    """The cell of a place along one side of a grid; places beyond the grid are in its outer cells."""
    return F.least(F.col("side") - 1, F.greatest(F.lit(0), F.floor((x - F.col(start)) / F.col(size)))).cast("int")


def candidates(points: DataFrame, boxes: DataFrame, slack: float) -> DataFrame:
    """Points with the boxes that meet their cell; both have the columns of their page's grid."""
    along = lambda lo, hi, start, size: F.explode(F.sequence(cell(F.col(lo) - slack, start, size), cell(F.col(hi) + slack, start, size)))
    spread = boxes.select("id", "page", "ord", "idx", "x0", "y0", "x1", "y1", "top", "height", "side", along("x0", "x1", "left", "width").alias("cx"))
    spread = spread.select("id", "page", "ord", "idx", "x0", "y0", "x1", "y1", "cx", along("y0", "y1", "top", "height").alias("cy"))
    at = points.select("id", "page", "point", "x", "y", cell(F.col("x"), "left", "width").alias("cx"), cell(F.col("y"), "top", "height").alias("cy"))
    return at.join(spread, ["id", "page", "cx", "cy"])


def neighbours(points: DataFrame, middles: DataFrame, level: int) -> DataFrame:
    """Points with the middles of boxes in the nine cells around them, of a grid whose cells are 2 ** level as large, and reach: how far they surely see."""
    coarse = lambda c, start, size: F.shiftright(cell(c, start, size), level)
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    at = points.withColumns({"px": coarse(F.col("x"), "left", "width"), "py": coarse(F.col("y"), "top", "height")})
    last = F.shiftright(F.col("side") - 1, level)
    far = F.lit(float("inf"))

    def reach(p: str, x: str, start: str, size: str) -> Column:
        step = F.col(size) * (1 << level)
        low = F.when(F.col(p) - 1 > 0, F.col(x) - F.col(start) - (F.col(p) - 1) * step).otherwise(far)
        high = F.when(F.col(p) + 1 < last, F.col(start) + (F.col(p) + 2) * step - F.col(x)).otherwise(far)
        return F.least(low, high)

    at = at.withColumn("reach", F.least(reach("px", "x", "left", "width"), reach("py", "y", "top", "height")))
    at = at.select("id", "page", "point", "x", "y", "reach", "py", near("px").alias("cx")).select("id", "page", "point", "x", "y", "reach", "cx", near("py").alias("cy"))
    there = middles.select("id", "page", "ord", "idx", "mx", "my", coarse(F.col("mx"), "left", "width").alias("cx"), coarse(F.col("my"), "top", "height").alias("cy"))
    return at.join(there, ["id", "page", "cx", "cy"])


def hit(points: DataFrame, boxes: DataFrame, slack: float = 2.0) -> DataFrame:
    """(id, point, idx): the first box (by ord) of a page that holds the point, else the one with the nearest middle (equal ones by ord).

    points (id, page, point, x, y), a point being named once; boxes (id, page, ord, idx, x0, y0, x1, y1). Each page has a grid of about as many
    cells as boxes; a box is in all cells that it meets, so a point meets the boxes of its own cell. Points in no box look for middles
    in the cells around them, of a grid twice as coarse each round, until one is nearer than
    what they have not seen; a page's boxes never all meet its points.
    """
    grid = staged(gridded(boxes, slack), "hit-grid")
    placed, there = staged(points.join(grid, ["id", "page"]), "hit-points"), staged(boxes.join(grid, ["id", "page"]), "hit-boxes")
    inside = (F.col("x") >= F.col("x0") - slack) & (F.col("x") <= F.col("x1") + slack) & (F.col("y") >= F.col("y0") - slack) & (F.col("y") <= F.col("y1") + slack)
    found = staged(candidates(placed, there, slack).filter(inside).groupBy("id", "point").agg(F.min_by("idx", "ord").alias("idx")), "hit-inside")
    rest = staged(placed.join(found, ["id", "point"], "left_anti"), "hit-rest")
    middles = there.withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2})
    level = 0
    while not rest.isEmpty():
        square = F.pow(F.col("x") - F.col("mx"), F.lit(2)) + F.pow(F.col("y") - F.col("my"), F.lit(2))
        best = neighbours(rest, middles, level).withColumn("far", square).groupBy("id", "point").agg(
            F.min_by(F.struct("idx", "far"), F.struct("far", "ord")).alias("b"), F.first("reach").alias("reach")
        )
        sure = staged(best.filter(F.col("b.far") < F.pow("reach", F.lit(2))).select("id", "point", "b.idx"), "hit-near")
        found = found.unionByName(sure)
        rest, level = staged(rest.join(sure, ["id", "point"], "left_anti"), "hit-rest"), level + 1
        if 1 << (level - 1) > SIDE:
            raise ValueError("points without a place")
    return found


def generated_cover(pixels: DataFrame, height: int = 150) -> DataFrame:
    """(gid, buckets, white, generated) of cover pixels (gid, x, y, r, g, b).

    buckets: the fewest 16-level colours that cover 85 %; white: share of near-white pixels in the
    top fifth. A cover of few colours under a white band was generated.
    """
    level = lambda c: F.floor(F.col(c) / 16).cast("int")
    p = pixels.withColumn("_c", F.struct(level("r"), level("g"), level("b")))
    counts = p.groupBy("gid", "_c").agg(F.count("*").alias("n"))
    run = Window.partitionBy("gid").orderBy(F.desc("n"), "_c")
    c = counts.withColumns({"before": F.coalesce(F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("gid"))})
    few = c.groupBy("gid").agg(F.count(F.when(F.col("before") < 0.85 * F.col("all"), 1)).alias("buckets"))
    top = F.col("y") < height // 5
    white = p.groupBy("gid").agg((F.count(F.when(top & (F.least("r", "g", "b") > 235), 1)) / F.count(F.when(top, 1))).alias("white"))
    return few.join(white, "gid").withColumn("generated", (F.col("white") >= 0.35) & (F.col("buckets") <= 14))


def with_tail(text: Column, spans: Column, duration: Column) -> Column:
    """Spans, and estimated ones for the text after them where the sound lasts over a second longer."""
    end = F.coalesce(F.array_max(F.transform(spans, lambda s: s.end)), F.lit(0.0))
    covered = F.coalesce(F.array_max(F.transform(F.filter(spans, lambda s: s.ce >= 0), lambda s: s.ce)), F.lit(0))
    rest = estimated_words(F.substring(text, covered + 1, F.lit(2147483647)), duration - end)
    moved = F.transform(
        rest, lambda s: F.struct(F.round(s.start + end, 3).alias("start"), F.round(s.end + end, 3).alias("end"), (s.cs + covered).alias("cs"), (s.ce + covered).alias("ce"))
    )
    return F.when(duration - end > 1.0, F.concat(spans, moved)).otherwise(spans)
