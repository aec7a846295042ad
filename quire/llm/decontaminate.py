"""Benchmark decontamination with an FM-index per training shard.

Each task cuts its batch of documents into shards of a bounded number of words, indexes a
shard (suffix order, wavelet tree over the last column, sampled suffix positions), runs
every window of the benchmark through backward search, locates the occurrences and merges
them into removal spans. Words that no benchmark item has end a phrase, so a run of them is
one break in the shard. Neighbouring shards overlap by a window less one word, so nothing
is missed where a shard ends.

The benchmark is written to the shared folder, its distinct items dealt to parts of about
ITEM_BYTES, and never passes through the driver. A task takes in documents up to CHUNK bytes,
then reads one part after another; the marks of all parts are united.

Defined results. Null and empty texts have no words: n_words and n_hit 0, not contaminated.
Items without words have no window. An item_id that stands in several rows is one item with the
windows of all of them; a null item_id is an item named by the empty string. Repeated documents are judged one by one. An empty
benchmark hits nothing; an empty table gives no rows. All columns of the documents are
kept; the results stand in one struct column whose name gets a number if it is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.fmindex import FMIndex
from quire.llm.text import alnum_words, opened, utf8
from quire.plans.staging import discard, fresh, new_path, staged

WINDOW = 13
#: Words of a shard, bytes of benchmark text that a task holds at a time, and bytes of documents.
SHARD_WORDS = 1 << 19
ITEM_BYTES, CHUNK = 32 << 20, 32 << 20

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


class Phrases:
    """The distinct windows of some benchmark items as rows of word numbers, by length."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        found: dict[tuple, set[str]] = {}
        for item, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text)]
            for k in range(max(len(ids) - window, 0) + 1 if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).add(self.names[item])
        self.by_length = [
            (n, np.array(rows := [p for p in found if len(p) == n], np.int64), [found[p] for p in rows])
            for n in sorted({len(p) for p in found})
        ]
        self.longest = max((n for n, _, _ in self.by_length), default=0)


def occurrences(words: np.ndarray, phrases: Phrases, shard_words: int = SHARD_WORDS):
    """(start, length, owners) arrays of every window found in words (0: no word of the benchmark, or a document's end)."""
    out = []
    if not phrases.longest:
        return out
    for cut in range(0, max(len(words), 1), shard_words):
        part = words[cut : cut + shard_words + phrases.longest - 1]
        keep = np.ones(len(part), bool)
        keep[1:] = (part[1:] != 0) | (part[:-1] != 0)  # a run of other words is one break
        at = np.concatenate((np.nonzero(keep)[0], [len(part)]))
        symbols = np.concatenate((part[keep], [0])).astype(np.int64)
        if not symbols.any():
            continue
        index = FMIndex(symbols, len(phrases.vocabulary))
        there = np.bincount(symbols, minlength=len(phrases.vocabulary) + 1) > 0
        for length, rows, owners in phrases.by_length:
            some = np.nonzero(there[rows].all(1))[0]  # windows with a word that the shard lacks are not searched
            if not len(some):
                continue
            lo, hi = index.search(rows[some])
            hit = np.nonzero(hi > lo)[0]
            if not len(hit):
                continue
            sizes = hi[hit] - lo[hit]
            which = np.repeat(np.arange(len(hit)), sizes)
            suffixes = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo[hit], sizes)
            out.append((cut + at[index.locate(suffixes)], length, some[hit][which], owners))
    return out


def marks(texts: list[bytes | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """(words, removal spans, items) of each text."""
    get = phrases.vocabulary.get
    parts, bounds, total = [], [0], 0
    for t in texts:
        words = alnum_words(t)
        parts += [np.fromiter((get(w, 0) for w in words), np.int32, len(words)), np.zeros(1, np.int32)]
        total += len(words) + 1
        bounds.append(total)
    words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    edges = np.array(bounds)
    change = np.zeros(len(words) + 1, np.int32)
    items: dict[int, set[str]] = {}
    for start, length, which, owners in occurrences(words, phrases):
        np.add.at(change, start, 1)
        np.add.at(change, start + length, -1)
        doc = np.searchsorted(edges, start, side="right") - 1
        for d, w in np.unique(np.stack((doc, which), 1), axis=0).tolist():
            items.setdefault(d, set()).update(owners[w])
    covered = np.cumsum(change[:-1]) > 0
    turn = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    starts, ends = np.nonzero(turn == 1)[0], np.nonzero(turn == -1)[0]
    first = np.searchsorted(starts, edges)
    out = []
    for d in range(len(texts)):
        a, b = first[d], first[d + 1]
        spans = list(zip((starts[a:b] - edges[d]).tolist(), (ends[a:b] - edges[d]).tolist(), strict=True))
        out.append((int(edges[d + 1] - edges[d] - 1), spans, items.get(d, set())))
    return out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def judge(texts: list[bytes | None], parts) -> list[dict]:
    """The result of each text, from the Phrases of all parts of the benchmark."""
    found: list = [(0, [], set())] * len(texts)
    for phrases in parts:
        found = [(n, united(spans + more), items | named) for (_, spans, items), (n, more, named) in zip(found, marks(texts, phrases), strict=True)]
    out = []
    for n, spans, items in found:
        hit = sum(e - s for s, e in spans)
        listed = [{"start": s, "end": e} for s, e in spans]
        out.append({"n_words": n, "n_hit": hit, "spans": listed, "items": sorted(items), "contaminated": hit > 0 and 20 * hit >= n})
    return out


class Parts:
    """The benchmark's parts, read from the shared folder by a task; one of them is held at a time."""

    def __init__(self, path: str, count: int, window: int):
        self.path, self.count, self.window, self.held = path, count, window, None

    def __iter__(self):
        for p in range(self.count):
            if self.held is None or self.held[0] != p:
                self.held = None
                self.held = (p, Phrases(self.read(p), self.window))
            yield self.held[1]

    def read(self, p: int) -> list[tuple[str, bytes | None]]:
        fs, local = opened(f"{self.path}/p={p}")
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(local, allow_not_found=True)) if f.path.endswith(".parquet")]
        tables = [pq.read_table(f, filesystem=fs, columns=["i", "t"], partitioning=None) for f in sorted(files)]
        return [row for t in tables for row in zip(t.column("i").to_pylist(), t.column("t").cast(pa.binary()).to_pylist(), strict=True)]


def dealt(benchmark: DataFrame, id_col: str, text_col: str, item_bytes: int) -> tuple[str, int]:
    """Where the distinct items of a benchmark were written, dealt to so many parts of about item_bytes."""
    named = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i")
    rows = staged(benchmark.select(named, F.col(text_col).alias("t")).filter(F.col("t").isNotNull()).distinct(), "benchmark-items")
    size = rows.agg(F.sum(F.octet_length("t") + 64).alias("n")).first().n or 0
    count = max(1, -(-size // item_bytes))
    path = new_path(benchmark.sparkSession, "benchmark")
    p = F.pmod(F.xxhash64("i", "t"), F.lit(count)).cast("int")
    rows.withColumn("p", p).repartition("p").write.partitionBy("p").parquet(path)
    discard(rows)
    return path, count


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    name: str = "decontamination",
    keep: list[str] | None = None,
    item_bytes: int = ITEM_BYTES,
) -> tuple[DataFrame, str]:
    """The documents (columns keep, or all) with a struct of n_words, n_hit, removal spans (in words), items, contaminated.

    Returns the table and the struct's name. A text is contaminated if hit words are a twentieth of its words or more.
    """
    name = fresh(docs.columns, name)
    kept = docs.columns if keep is None else keep
    base = docs.select(*dict.fromkeys([*kept, text_col]))
    kind = pa.struct(
        [
            ("n_words", pa.int64()), ("n_hit", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("items", pa.list_(pa.string())), ("contaminated", pa.bool_()),
        ]
    )
    path, count = dealt(benchmark, item_id, item_text, item_bytes)

    def run(batches):
        parts = Parts(path, count, window)

        def judged(held):
            found = iter(judge([t for b in held for t in utf8(b.column(text_col))], parts))
            for b in held:
                columns = [b.column(b.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([next(found) for _ in range(b.num_rows)], kind)], names=[*kept, name])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= CHUNK:
                yield from judged(held)
                held = []
        yield from judged(held)

    return base.mapInArrow(run, T.StructType([*[base.schema[c] for c in kept], T.StructField(name, RESULT)])), name


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    from quire.plans.tables import table

    found, at = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    r = F.col(at)
    return found.select(
        "doc_id", r.n_words.alias("n_words"), r.n_hit.alias("n_hit"),
        F.size(r["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(r["items"], ","), 256).alias("items_sha256"),
        r.contaminated.alias("contaminated"),
    )
