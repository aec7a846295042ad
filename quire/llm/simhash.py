"""SimHash near-duplicates through an inverted index of positional bytes.

Two 64-bit fingerprints that differ in at most d bits differ in at most d of their eight
bytes, so they share at least 8 - d positional bytes: the guaranteed minimum of the count
filter. A posting of a single byte would hold 1/256 of all fingerprints, and its pairs would
grow with the square of the input. So a key of the index is a set of 7 - d positions and the
bytes there, and a pair shares 8 - d keys or more exactly if it shares 8 - d bytes or more.
The keys that each pair shares are tallied, pairs that reach the minimum are retained, and
their bits are verified.

Exact copies are one fingerprint before they enter the index. A posting of more than SHORT
fingerprints hands on no pairs: its members go on with one byte more, in postings that agree
in all bytes but d and so hold at most 256**d fingerprints whatever the input's size. There
each is looked up with its flips of up to d bits, and a member hands on one link. A pair
within d bits that shares a long posting is found in it; if it shares none, its tally is whole.

Defined results. Null or empty texts have no words: fingerprint zero, linked like any
other. Fewer words than a shingle: the whole sequence is hashed once. Repeated rows and
ties share a fingerprint and thus a component. Null ids keep their row; they never name a
component unless all ids in it are null, then component_id is null. An empty table gives
no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.graph import connected_components
from quire.llm.text import space_words, utf8
from quire.plans.staging import discard, staged

SEED = 42
#: Shingles whose bits are counted at a time, so that a very long text needs little memory.
BLOCK = 1 << 15
#: Members of a posting whose pairs are tallied; longer postings are extended by a byte and probed.
SHORT = 32


def fingerprint(raw: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if set in over half of the shingles' XXH64."""
    words = space_words(raw)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), BLOCK):
        part = zip(starts[k : k + BLOCK], stops[k : k + BLOCK], strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in part], np.uint64)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = (counts * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns keep, fingerprint as a signed long) of every row, from whole texts."""
    narrow = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            fp = [fingerprint(t, shingle) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", *keep)), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["id", *keep, "fingerprint"]
            )

    schema = T.StructType([*(narrow.schema[c] for c in ("id", *keep)), T.StructField("fingerprint", T.LongType())])
    return narrow.mapInArrow(run, schema)


def posting_links(members: np.ndarray, free_bits: list[int], distance: int) -> list[tuple[int, int]]:
    """(least linked member, member) for the members of one posting (uint64, which agree outside free_bits)."""
    fps = np.unique(members)
    n = len(fps)
    if n == 2:
        return [(int(fps[0]), int(fps[1]))] if int(fps[0] ^ fps[1]).bit_count() <= distance else []
    label = np.arange(n)
    pairs_a, pairs_b = [], []
    for k in range(1, distance + 1):
        for bits in combinations(free_bits, k):
            mask = np.uint64(sum(1 << b for b in bits))
            at = np.searchsorted(fps, fps ^ mask)
            at[at == n] = 0
            hit = np.nonzero(fps[at] == fps ^ mask)[0]
            pairs_a.append(hit)
            pairs_b.append(at[hit])
    a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(fps[label[i]]), int(fps[i])) for i in np.nonzero(label != np.arange(n))[0]]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask(positions) -> int:
    """The bits of these byte positions, as a signed long."""
    return signed(sum(0xFF << 8 * p for p in positions))


def postings(table: DataFrame, sets: list[tuple[int, ...]], number: Column) -> tuple[DataFrame, Column]:
    """table with the number of a set of positions, and a column with the bytes at these positions."""
    masks = F.array(*[F.lit(mask(s)) for s in sets])
    return table.select("fingerprint", number.alias("positions")), F.col("fingerprint").bitwiseAND(F.get(masks, "positions"))


def short_postings(batches, masks: np.ndarray, most: int):
    """Pairs (a, b) of each run of equal keys of at most most members; (a, null) for each member of a longer run.

    Rows come sorted by positions and key; no more than most members of a run are held from one batch to the next.
    """
    none = np.zeros(0, np.int64)
    held_at, held, long_run = none, none, None
    for batch in batches:
        at = np.concatenate((held_at, np.asarray(batch.column(0), np.int64)))
        fps = np.concatenate((held, np.asarray(batch.column(1))))
        if not len(fps):
            continue
        keys = fps & masks[at]
        starts = np.nonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (at[1:] != at[:-1]))))[0]
        ends = np.append(starts[1:], len(fps))
        longer = ends - starts > most
        longer[0] |= (at[0], keys[0]) == long_run
        last = int(starts[-1])
        long_run = (at[-1], keys[-1]) if longer[-1] else None
        held_at, held = (none, none) if longer[-1] else (at[last:], fps[last:])
        lone = np.repeat(longer, ends - starts)
        closed = ~longer
        closed[-1] = False  # the last run may go on in the next batch
        yield _pairs(*_all_pairs(fps, starts[closed], ends[closed]), fps[lone], at[lone])
    yield _pairs(*_all_pairs(held, *(np.array([k]) for k in (0, len(held)))), none, none)


def _all_pairs(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (lesser, greater) of different members of each run."""
    size, a, b = ends - starts, [], []
    for n in np.unique(size[size > 1]).tolist():
        first, second = np.triu_indices(n, 1)
        at = starts[size == n][:, None]
        a.append(fps[at + first].ravel())
        b.append(fps[at + second].ravel())
    if not a:
        return fps[:0], fps[:0]
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]


def _pairs(a: np.ndarray, b: np.ndarray, lone: np.ndarray, lone_at: np.ndarray) -> pa.RecordBatch:
    no = np.zeros(len(lone), np.int64)
    second = pa.array(np.concatenate((b, no)), mask=np.arange(len(b) + len(no)) >= len(b))
    positions = pa.array(np.concatenate((np.zeros(len(a), np.int32), lone_at.astype(np.int32))), mask=np.arange(len(a) + len(no)) < len(a))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, lone))), second, positions], names=["a", "b", "positions"])


def links(distinct: DataFrame, distance: int = 2, short: int = SHORT) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints within distance."""
    if not 0 <= distance <= 2:
        raise ValueError("distance: 0, 1 or 2 bits")
    spark = distinct.sparkSession
    if distance == 0:
        return distinct.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b")).filter("false")
    sets = list(combinations(range(8), 7 - distance))
    least = 8 - distance  # of the 8 - distance shared bytes, so many sets leave one out
    masks = np.array([mask(s) for s in sets], np.int64)
    # The table is small in bytes and grows by the number of sets: it is dealt over all cores first.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wide, key = postings(distinct.repartition(tasks, "fingerprint"), sets, F.explode(F.sequence(F.lit(0), F.lit(len(sets) - 1))))
    dealt = wide.repartition("positions", key).sortWithinPartitions("positions", key).select("positions", "fingerprint")
    met = staged(dealt.mapInArrow(lambda batches: short_postings(batches, masks, short), "a long, b long, positions int"), "simhash-met")
    # Count filter: what a pair shares is tallied; pairs that reach the minimum are verified.
    tally = met.filter("b is not null").groupBy("a", "b").agg(F.count("*").alias("shared"))
    near = tally.filter((F.col("shared") >= least) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    return near.unionByName(long_links(met.filter("b is null"), sets, distance)).distinct()


def long_links(members: DataFrame, sets: list[tuple[int, ...]], distance: int) -> DataFrame:
    """Links (a, b) of the members (a, positions) of long postings, each extended by a further byte and probed."""
    full = list(combinations(range(8), 8 - distance))
    wider = F.array(*[F.array(*[F.lit(k) for k, t in enumerate(full) if set(s) < set(t)]) for s in sets])
    extended, key = postings(members.select(F.col("a").alias("fingerprint"), "positions"), full, F.explode(F.get(wider, "positions")))
    lists = extended.groupBy("positions", key.alias("bytes")).agg(F.collect_set("fingerprint").alias("members")).filter(F.size("members") > 1)

    def run(batches):
        for batch in batches:
            found = []
            for k, listed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                fps = np.asarray(listed.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                found += posting_links(fps, [8 * p + b for p in range(8) if p not in full[k] for b in range(8)], distance)
            ab = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    return lists.select("positions", "members").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, fingerprint long, component_id, columns keep, root) of every row; component_id is the least id of the linked group.

    root is one fingerprint of the group, the same for all of its rows; it comes with columns keep only.
    """
    fps = staged(fingerprints(docs, id_col, text_col, shingle, keep), "simhash")
    distinct = staged(fps.groupBy("fingerprint").agg(F.min("id").alias("least")), "simhash-distinct")
    edges = staged(links(distinct, distance), "simhash-links")
    roots = staged(connected_components(edges), "simhash-roots")
    # A root's least id, for the few fingerprints that are linked at all.
    linked = staged(
        roots.join(distinct, roots.node == distinct.fingerprint).select("fingerprint", "root", "least"), "simhash-linked"
    )
    heads = staged(linked.groupBy("root").agg(F.min("least").alias("head")), "simhash-heads")
    classes = staged(
        distinct.join(linked.join(heads, "root").select("fingerprint", "head", "root"), "fingerprint", "left").select(
            "fingerprint", F.least("least", F.coalesce("head", "least")).alias("component_id"), F.coalesce("root", "fingerprint").alias("root")
        ),
        "simhash-classes",
    )
    for done in (distinct, edges, roots, linked, heads):
        discard(done)
    return fps.join(classes, "fingerprint").select("id", "fingerprint", "component_id", *([*keep, "root"] if keep else []))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    from quire.plans.tables import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
