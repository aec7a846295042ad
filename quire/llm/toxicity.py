"""Toxicity: bags of subwords, embedded, averaged and put through a linear softmax.

A word is the bag of its character n-grams (3 to 6 UTF-8 bytes, word borders included),
each hashed to one of BUCKETS embeddings, so that misspelt words share n-grams with those
seen. Embeddings and softmax are trained together, in numpy, on a bounded sample of the
labelled rows: first on the averages of texts, then on stretches of STRETCH words, for
toxic rows those that the model finds worst, for others the worst and one at random. Toxic
rows whose worst stretch is like that of other rows sit out a round: their label is not told by their words.

Insults are few among the words of a long text and vanish in its average, so a text's score
is that of its worst stretch, put on a line that is fitted to the worst stretches of the
sample's whole texts. Every word of a whole text counts. As the average and the softmax are
linear, an n-gram's part in the score is one number: scoring adds up numbers.

A labelled text that is too long to be learned from at once is learned from twice: first a
piece at a hashed place, then the piece around the stretch of its whole text that the
first model finds worst. Both look-ups run in tasks over the picked rows, which are staged once.

Defined results. Null texts and texts without a word have the score of an average of
nothing: the bias alone. Rows whose label, text or id is null teach nothing; labels of one
class or none give every text the share of that class (0.5 without rows). Several labels of
one document each teach; rows that repeat id and text teach once for each label. Equal texts
have equal scores, however long. A text without any blank is one word. An empty table gives
no rows. All asked-for columns are kept; the result is a column whose name gets a number if
it is taken.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.langid import held_out
from quire.llm.sample import least_keys, row_key, rows_of
from quire.llm.text import _WORD_TABLE, utf8
from quire.plans.staging import discard, fresh, shipped, staged

#: Bounds of what is learned from: labelled rows of each class, and bytes of one piece of a text.
SAMPLE, SAMPLE_BYTES = 1500, 4000
BUCKETS, DIM, STRETCH, RATE, SEED = 1 << 19, 8, 3, 0.2, 7
#: Epochs on averages of texts, then rounds on worst stretches; worst stretches of a toxic and of another row in a round.
EPOCHS, ROUNDS, WORST = 4, 4, (2, 2)
#: A toxic row sits out a round if its worst stretch is under this quantile of those of other rows.
SIT_OUT = 0.9
SIZES = (3, 4, 5, 6)
#: Bytes of text whose n-grams are hashed at a time.
BLOCK = 1 << 20


def levelled(raw: bytes | None) -> np.ndarray:
    """The bytes of a text's words in lower case, with one space before, between and behind them; no words: nothing."""
    flat = np.frombuffer(b" " + (raw or b"").translate(_WORD_TABLE) + b" ", np.uint8)
    space = flat == 32
    flat = flat[np.concatenate(([True], ~(space[1:] & space[:-1])))]
    return flat if len(flat) > 1 else flat[:0]


def grams(flat: np.ndarray, start: int = 0, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of the n-grams that begin in levelled text from start on; words count from that of the first byte."""
    stop = len(flat) if size is None else min(len(flat), start + size)
    part = flat[start : stop + max(SIZES) - 1]
    inside = part != 32
    word = np.cumsum(~inside) - (1 if len(part) and not inside[0] else 0)  # a border belongs to the word after it
    value, count = part.astype(np.uint64), stop - start
    code, ok = value, np.ones(len(part), bool)
    buckets, owners = [], []
    for n in range(2, max(SIZES) + 1):
        if len(part) < n:
            break
        code = code[:-1] * np.uint64(1000003) + value[n - 1 :] + np.uint64(n)
        ok = ok[:-1] & inside[n - 2 : len(part) - 1] if n >= 3 else ok[:-1]  # no border within
        if n in SIZES:
            at = np.nonzero(ok[:count])[0]
            h = code[at]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((h >> np.uint64(40)).astype(np.int64) % BUCKETS)
            owners.append(word[at])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def word_scores(flat: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The mean weight of the n-grams of each word of a levelled text."""
    borders = np.nonzero(flat == 32)[0]
    n = max(0, len(borders) - 1)
    sums, counts = np.zeros(n), np.zeros(n)
    for start in range(0, len(flat), BLOCK):
        bucket, owner = grams(flat, start, BLOCK)
        first = int(np.searchsorted(borders, start, "right")) - 1  # the word that the first byte is in or before
        size = int(owner.max()) + 1 if len(owner) else 0
        sums[first : first + size] += np.bincount(owner, weights[bucket], size)
        counts[first : first + size] += np.bincount(owner, minlength=size)
    return sums / np.maximum(counts, 1)


def stretch_means(scores: np.ndarray) -> np.ndarray:
    """The mean of every STRETCH neighbouring words; of all if there are fewer; zero if there is none."""
    n = len(scores)
    if n <= STRETCH:
        return np.array([scores.mean()]) if n else np.zeros(1)
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    return (sums[STRETCH:] - sums[:-STRETCH]) / STRETCH


def around(flat: np.ndarray, at: int, size: int) -> bytes:
    """Whole words of a levelled text: the stretch at a word, and about size bytes on both sides of it together."""
    borders = np.nonzero(flat == 32)[0]
    end = min(at + STRETCH, len(borders) - 1)
    low = int(np.searchsorted(borders, borders[at] - size // 2))
    high = int(np.searchsorted(borders, borders[end] + size // 2, "right")) - 1
    return flat[borders[min(low, at)] : borders[max(high, end)]].tobytes()


class Model:
    """Numbers per bucket, and the line that turns a text's worst stretch into a probability."""

    def __init__(self, rows: list[tuple[bytes, int]], prior: float | None = None, rounds: int = ROUNDS):
        """rows: texts and labels; prior: the share of label 1 among all labelled rows, if the rows were picked by class."""
        self.weights, self.slope, self.bias = np.zeros(BUCKETS, np.float32), 0.0, 0.0
        positive = sum(y for _, y in rows)
        self.trained = 0 < positive < len(rows)
        if not self.trained:
            self.bias = 0.0 if not rows else 12.0 if positive else -12.0
            return
        self.rng = np.random.default_rng(SEED)
        self.embed = self.rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.soft = self.rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
        self.offset = np.zeros(2, np.float32)
        bags = [(*_bag(*grams(levelled(t))), y) for t, y in rows]
        self._learn(bags, EPOCHS, RATE)
        self.learn_worst(rows, rounds, prior)

    def _learn(self, bags: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, rate: float) -> None:
        """Adagrad over bags (buckets, their shares in the average, label); both classes weigh the same."""
        bags = [b for b in bags if len(b[0])]
        sides = [sum(1 for *_, y in bags if y == side) for side in (0, 1)]
        if not all(sides):
            return
        seen, seen_soft = np.full(BUCKETS, 1e-8, np.float32), 1e-6  # a bucket's mean square
        for _ in range(epochs):
            for i in self.rng.permutation(len(bags)).tolist():
                bucket, share, y = bags[i]
                mean = share @ self.embed[bucket]
                z = mean @ self.soft + self.offset
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                p *= 0.5 * len(bags) / sides[y]
                step = share[:, None] * (self.soft @ p)
                seen[bucket] += (step * step).mean(1)
                self.embed[bucket] -= rate * step / np.sqrt(seen[bucket])[:, None]
                g = np.outer(mean, p)
                seen_soft += float((g * g).mean())
                self.soft -= rate * g / math.sqrt(seen_soft)
                self.offset -= 0.01 * p
        self.weights = (self.embed @ (self.soft[:, 1] - self.soft[:, 0])).astype(np.float32)

    def learn_worst(self, rows: list[tuple[bytes, int]], rounds: int, prior: float | None = None) -> None:
        """Rounds of training on the stretches that the model finds worst, then the line."""
        texts = [levelled(t) for t, _ in rows]
        labels = np.array([y for _, y in rows])
        for _ in range(rounds):
            means = [stretch_means(word_scores(flat, self.weights)) for flat in texts]
            top = np.array([m.max() for m in means])
            least = np.quantile(top[labels == 0], SIT_OUT)
            bags = []
            for flat, m, t, y in zip(texts, means, top, labels.tolist(), strict=True):
                if not len(flat) or (y and t < least):
                    continue
                at = np.argsort(-m, kind="stable")[: WORST[0 if y else 1]].tolist()
                borders = np.nonzero(flat == 32)[0]
                for a in at if y else [*at, int(self.rng.integers(len(m)))]:
                    bags.append((*_bag(*grams(flat[borders[a] : borders[min(a + STRETCH, len(borders) - 1)] + 1])), y))
            self._learn(bags, 1, RATE / 2)
        x = np.array([stretch_means(word_scores(flat, self.weights)).max() for flat in texts])
        self.calibrate(x, labels, labels.mean() if prior is None else prior)

    def calibrate(self, x: np.ndarray, y: np.ndarray, share: float) -> None:
        """The logistic line through worst stretches and labels, by Newton's steps on a scaled axis."""
        mid, wide = x.mean(), x.std() + 1e-9
        z, w = np.stack(((x - mid) / wide, np.ones(len(x))), 1), np.zeros(2)
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = z.T @ (z * (weight * p * (1 - p) + 1e-6)[:, None]) + 1e-3 * np.eye(2)
            w = w + np.linalg.solve(h, z.T @ (weight * (y - p)) - 1e-3 * w)
        self.slope, self.bias = float(w[0] / wide), float(w[1] - w[0] * mid / wide)

    def scorer(self) -> "Model":
        """What scoring needs, for the tasks."""
        out = Model([])
        out.weights, out.slope, out.bias = self.weights, self.slope, self.bias
        return out

    def worst(self, raw: bytes | None) -> float:
        """The highest mean of a stretch of the whole text."""
        return float(stretch_means(word_scores(levelled(raw), self.weights)).max())

    def worst_piece(self, raw: bytes | None, size: int) -> tuple[float, bytes]:
        """The highest mean of a stretch, and the words around that stretch (about size bytes; the text itself if it is no longer)."""
        flat = levelled(raw)
        means = stretch_means(word_scores(flat, self.weights))
        at = int(means.argmax())
        return float(means[at]), (raw or b"") if len(raw or b"") <= size or not len(flat) else around(flat, at, size)

    def score(self, raw: bytes | None) -> float:
        z = self.slope * self.worst(raw) + self.bias
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _bag(bucket: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their shares in its average: n-grams weigh the same in a word, words in the text."""
    if not len(bucket):
        return bucket, np.zeros(0, np.float32)
    size = np.bincount(owner)
    listed, back = np.unique(bucket, return_inverse=True)
    return listed, np.bincount(back, 1 / (size[owner] * np.count_nonzero(size))).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", may_learn: Column | None = None) -> Model:
    """A model from at most SAMPLE rows of each class, those with the least hash of id and text."""
    y = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    ok = may_learn if may_learn is not None else F.lit(True)
    d = docs.filter(ok).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter("_id is not null and _t is not null")
    d = d.withColumn("_k", row_key("_id", "_t"))
    labelled = staged(d.select("_id", "_k").join(y, "_id").select("_k", "_y"), "toxicity-labelled")
    seen = {r[0]: r[1] for r in labelled.groupBy("_y").count().collect()}
    chosen = least_keys(labelled, "_y", "_k", SAMPLE)
    discard(labelled)
    if not chosen:
        return Model([])
    prior = seen.get(1, 0) / sum(seen.values())
    picked = staged(rows_of(d, "_k", set().union(*chosen.values())).select("_k", "_t"), "toxicity-picked")
    place = F.pmod(F.col("_k"), F.length("_t") - SAMPLE_BYTES + 1).cast("int")
    piece = F.when(F.length("_t") <= SAMPLE_BYTES, F.col("_t")).otherwise(F.substring(F.col("_t"), place + 1, F.lit(SAMPLE_BYTES)))

    def labelled_rows(found) -> list[tuple]:
        return [(value, side) for key, value in sorted(found) for side in sorted(chosen) if key in chosen[side]]

    first = picked.select("_k", piece.alias("t"), (F.length("_t") > SAMPLE_BYTES).alias("long")).collect()
    several = any(r.long for r in first)
    model = Model(labelled_rows((r[0], r.t.encode()) for r in first), prior, 1 if several else ROUNDS)
    if several and model.trained:
        # Of a long text the piece around its worst stretch is kept, wherever that stands.
        pieces = labelled_rows((r[0], bytes(r.t)) for r in _worst_pieces(picked, model, SAMPLE_BYTES).collect())
        model.learn_worst(pieces, ROUNDS - 1, prior)
        whole = labelled_rows((r[0], r.x) for r in _worst_pieces(picked, model, None).collect())
        model.calibrate(np.array([x for x, _ in whole]), np.array([side for _, side in whole]), prior)
    discard(picked)
    return model


def _worst_pieces(picked: DataFrame, model: Model, size: int | None) -> DataFrame:
    """(_k, x, t): the worst stretch of each whole text, and with a size the text itself or, if it is long, the piece around that stretch."""
    shared = shipped(picked.sparkSession, model.scorer())

    def run(batches):
        for batch in batches:
            found = [shared().worst_piece(t, size or 0) for t in utf8(batch.column("_t"))]
            texts = [None if size is None else t for _, t in found]
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array([x for x, _ in found], pa.float64()), pa.array(texts, pa.binary())], names=["_k", "x", "t"])

    return picked.mapInArrow(run, "_k long, x double, t binary")


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, name: str = "toxicity") -> tuple[DataFrame, str]:
    """The documents (columns keep, or all) with a score of the whole text from 0 to 1, and the score's column name."""
    name = fresh(docs.columns, name)
    kept = docs.columns if keep is None else keep
    base = docs.select(*dict.fromkeys([*kept, text_col]))
    shared = shipped(docs.sparkSession, model.scorer())

    def run(batches):
        for batch in batches:
            scores = pa.array([shared().score(t) for t in utf8(batch.column(text_col))], pa.float64())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, scores], names=[*kept, name])

    return base.mapInArrow(run, T.StructType([*[base.schema[c] for c in kept], T.StructField(name, T.DoubleType())])), name


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    from quire.plans.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), may_learn=~held_out("doc_id", 5, 0))
    found, at = toxicity(docs, model, keep=["doc_id"])
    return found.select(
        "doc_id",
        held_out("doc_id", 5, 0).alias("held_out"),
        F.col(at).alias("score"),
        F.when(F.col(at) >= 0.5, 1).otherwise(0).alias("predicted"),
    )
