"""Quality rules by distribution divergence. Native: DataFrame functions only.

Two histograms of a text are held against references of its language: classes of
characters (CLASSES) and common words (COMMON of that language, and all other words). The
references are the sums of all documents' histograms of that language, so they cover the
whole table. The divergence is the Jensen-Shannon distance (base 2, 0 to 1). A text with
fewer than MIN_CHARS characters or MIN_WORDS words is too short for the respective test
and passes it.

Verdict: kept is false if a base rule fails (fewer than 50 words; over half of the words in
repeated three-word windows), if the characters diverge by more than MAX_CHARS, or if the
common words diverge by more than MAX_COMMON.

Defined results. Null and empty texts have no words and fail a base rule. A null or unlisted
language shares one reference, whose only test is that of characters. Repeated rows are
judged one by one. An empty table gives no rows. All columns of the documents are kept; the
results are one struct column whose name gets a number if it is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.columns import settled
from quire.plans.staging import fresh, staged

MIN_CHARS, MAX_CHARS = 200, 0.28
MIN_WORDS, MAX_COMMON = 50, 0.29
#: Common words of the languages that have a reference of their own.
COMMON = {
    "de": "der die das und in zu den mit von ist nicht sich ein eine auf für".split(),
    "en": "the of and to in a is that for it as was with be by on".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
    "fr": "de la le et les des en un une du que qui dans pour par est".split(),
}
OTHER = ""
SPACE = " \t\n\u000b\f\r"
#: Classes of characters: white space, capitals, other letters and marks, digits, punctuation, all others.
N_CLASSES = 6


def words(text: Column) -> Column:
    # A split at one plain character needs no regular expression.
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE)), " "), lambda w: w != "")


def language(lang: Column) -> Column:
    """The language whose reference applies."""
    return F.when(lang.isin(*COMMON), lang).otherwise(F.lit(OTHER))


def among(listed: list[str]):
    return lambda w: w.isin(*listed)


def characters(docs: DataFrame, text_col: str, at: str) -> DataFrame:
    """docs with the characters of each class, in the order named at N_CLASSES; each pass over the text is made once."""
    t, space, upper, rest, digit, mark = F.coalesce(F.col(text_col), F.lit("")), *(f"{at}_{k}" for k in ("space", "upper", "rest", "digit", "mark"))
    count = lambda c: F.length(c).cast("long")
    d = settled(
        docs,
        **{
            space: count(t) - count(F.translate(t, SPACE, "")),
            upper: count(F.regexp_replace(t, r"\P{Lu}+", "")),
            rest: F.regexp_replace(t, r"[\p{L}\p{M}\x20\x09-\x0D]+", ""),  # what is left is short
        },
    )
    d = settled(d, **{digit: count(F.regexp_replace(rest, r"\P{Nd}+", "")), mark: count(F.regexp_replace(rest, r"[\P{P}#*%&]+", ""))})
    letter = count(t) - F.col(space) - count(rest)
    classes = F.array(F.col(space), F.col(upper), letter - F.col(upper), F.col(digit), F.col(mark), count(rest) - F.col(digit) - F.col(mark))
    return d.withColumn(f"{at}_classes", classes).drop(space, upper, rest, digit, mark)


def measured(docs: DataFrame, text_col: str, lang_col: str, at: str) -> DataFrame:
    """docs with the language, the words and both histograms in columns that start with at."""
    lang, listed, common = f"{at}_lang", f"{at}_words", f"{at}_common"
    d = settled(characters(docs, text_col, at), **{lang: language(F.col(lang_col)), listed: words(F.col(text_col))})
    # The common words, each between spaces of its own, in one string: a word is counted by taking it out.
    found = F.when(F.lit(False), F.array(F.lit("")))
    for code, wanted in COMMON.items():
        found = found.when(F.col(lang) == code, F.filter(F.transform(listed, F.lower), among(wanted)))
    d = settled(d, **{common: F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" "))})

    def count(w: str) -> Column:
        return ((F.length(common) - F.length(F.replace(common, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long")

    each = F.when(F.lit(False), F.array(F.lit(0).cast("long")))
    for code, wanted in COMMON.items():
        each = each.when(F.col(lang) == code, F.array(*[count(w) for w in wanted]))
    d = settled(d, **{f"{at}_each": each})
    others = F.size(listed).cast("long") - F.aggregate(f"{at}_each", F.lit(0).cast("long"), lambda a, n: a + n)
    return settled(d, **{f"{at}_bins": F.concat(f"{at}_each", F.array(others))}).drop(common, f"{at}_each")


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, dict[str, list[float]]]:
    """For each language (at most one more than COMMON has) the shares of classes and of common words over all documents."""
    return summed(measured(docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")), "t", "l", "_q"), "_q")


def summed(m: DataFrame, at: str) -> dict[str, dict[str, list[float]]]:
    """References from the histograms of measured rows."""
    n_bins = 1 + max(map(len, COMMON.values()))
    sums = m.groupBy(f"{at}_lang").agg(
        F.array(*[F.sum(F.get(f"{at}_classes", F.lit(k))) for k in range(N_CLASSES)]).alias("classes"),
        F.array(*[F.sum(F.get(f"{at}_bins", F.lit(k))) for k in range(n_bins)]).alias("bins"),
    )
    out = {}
    for r in sums.collect():
        bins = [x for x in r.bins if x is not None]
        out[r[f"{at}_lang"]] = {k: [x / max(1, sum(v)) for x in v] for k, v in (("classes", r.classes), ("bins", bins))}
    return out


def jensen_shannon(counts: Column, reference: list[float]) -> Column:
    """Distance (0 to 1) of a histogram, given as counts, from reference shares."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    parts = F.zip_with(
        F.transform(counts, lambda x: x / F.greatest(total, F.lit(1))),
        F.array(*[F.lit(float(q)) for q in reference]),
        lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0) + F.when(q > 0, q * F.log2(2 * q / (p + q))).otherwise(0.0),
    )
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def prefix(columns) -> str:
    """A beginning that no column has."""
    at = "_quality"
    while any(c.lower().startswith(at) for c in columns):
        at += "_"
    return at


def counted(docs: DataFrame, text_col: str, lang_col: str, at: str, keep: list[str]) -> DataFrame:
    """keep, the histograms and the base counts (a struct), in columns that start with at."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    w, lines, hashed, sorted_, again = (f"{at}_{k}" for k in ("words", "lines", "hashes", "sorted", "again"))
    d = measured(docs, text_col, lang_col, at)
    # Every three-word window as its hash; where one is found again, hashes and places are sorted and equal neighbours are the repeats.
    hashes = f"slice(transform(`{w}`, (x, i) -> xxhash64(x, get(`{w}`, i + 1), get(`{w}`, i + 2))), 1, greatest(size(`{w}`) - 2, 0))"
    d = settled(d, **{lines: F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE, "") != ""), hashed: F.expr(hashes)})
    placed = F.expr(f"sort_array(transform(`{hashed}`, (h, i) -> named_struct('h', h, 'p', i)))")
    repeats = F.size(F.array_distinct(hashed)) < F.size(hashed)
    d = settled(d, **{sorted_: F.when(repeats, placed).otherwise(F.expr("cast(array() as array<struct<h:bigint,p:int>>)"))})
    twice = f"filter(`{sorted_}`, (e, i) -> e.h = get(`{sorted_}`, i - 1).h OR e.h = get(`{sorted_}`, i + 1).h)"
    d = settled(d, **{again: F.expr(f"sort_array(transform({twice}, e -> e.p))")})
    repeat = F.expr(
        f"aggregate(transform(`{again}`, (p, i) -> least(3, coalesce(get(`{again}`, i + 1) - p, 3))), 0L, (a, n) -> a + n)"
    )
    base = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        F.length(t).alias("n_chars"),
    )
    return settled(d, **{f"{at}_base": base}).select(*[F.col(f"`{c}`") for c in keep], f"{at}_lang", f"{at}_classes", f"{at}_bins", f"{at}_base")


def verdicts(d: DataFrame, refs: dict, at: str, keep: list[str], name: str) -> DataFrame:
    """keep and the result struct of counted rows."""
    by_class = by_word = F.lit(0.0)
    for code, ref in refs.items():
        mine = F.col(f"{at}_lang") == code
        by_class = F.when(mine, jensen_shannon(F.col(f"{at}_classes"), ref["classes"])).otherwise(by_class)
        if ref["bins"]:
            by_word = F.when(mine, jensen_shannon(F.col(f"{at}_bins"), ref["bins"])).otherwise(by_word)
    b = F.col(f"{at}_base")
    distances = {
        f"{at}_chars": F.when(b.n_chars >= MIN_CHARS, by_class).otherwise(0.0),
        f"{at}_common": F.when(b.n_words >= MIN_WORDS, by_word).otherwise(0.0),
    }
    d = settled(d, **distances)
    failed = (b.n_words < 50) | (100 * b.n_repeat_words > 50 * b.n_words)
    kept = ~failed & (F.col(f"{at}_chars") <= MAX_CHARS) & (F.col(f"{at}_common") <= MAX_COMMON)
    result = F.struct(
        *[b[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col(f"{at}_chars").alias("char_distance"), F.col(f"{at}_common").alias("word_distance"), failed.alias("base_failed"), kept.alias("kept"),
    )
    return d.select(*[F.col(f"`{c}`") for c in keep], result.alias(name))


def judge(
    docs: DataFrame, refs: dict | None = None, text_col: str = "text", lang_col: str = "lang", name: str = "quality", keep: list[str] | None = None
) -> tuple[DataFrame, str]:
    """The documents (columns keep, or all) with a struct of the base counts, both distances and the verdicts; and the struct's name.

    Without refs the references are those of all of docs. What is counted is then written to
    the shared folder once and serves both the references and the verdicts.
    """
    name, at = fresh(docs.columns, name), prefix(docs.columns)
    keep = docs.columns if keep is None else keep
    d = counted(docs, text_col, lang_col, at, keep)
    if refs is None:
        d = staged(d, "quality-counts")
        refs = summed(d, at)
    return verdicts(d, refs, at, keep, name), name


def op7_quality(spark, sf_dir: str) -> DataFrame:
    from quire.plans.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found, at = judge(docs, keep=["doc_id"])
    return found.select("doc_id", *[F.col(at)[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )])
