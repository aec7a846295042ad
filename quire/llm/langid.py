"""Language identification with string kernels.

Kernel of two texts: the number of character n-grams (n = 1 to 3, a blended spectrum) that
are present in both, over the root of the product of their numbers of n-grams. A bounded
sample of labelled rows (SAMPLE rows for each label, however many labels there are) trains
one-versus-rest kernel ridge regressions; LANDMARKS of these rows per label approximate the
kernel (Nyström). A batch of texts is scored by a matrix product: n-gram presence times the
product of the landmarks' presence and the weights.

N-grams are of code points: lower-cased letters, each as it is in any script, and a border
for every run of other characters. An n-gram is known by its hash to one of BUCKETS. Whole
texts are read, in blocks, so that a very long one needs little memory; the rows that are
learned from hand on the buckets that they hold, not their texts.

The margins of a text sum to about 2 - k for k languages whatever it says, so the best of
them never falls under a floor and cannot tell that a text is in none of the languages. What
can fall is the share of its three-letter n-grams, repeats counted, that the landmarks of
the best language hold. Who wants to reject such texts asks for a least share, as the corpus pipeline does
(LEAST_KNOWN); without one every text with a letter has a language.

Defined results. Null texts, texts without a letter and texts under an asked-for share: ``und``, score 0. Rows whose label,
text or id is null, or whose text has no letter, teach nothing. With no labelled row at all every text is ``und``. Equal
scores: the language first in alphabetical order. Repeated rows are each scored, and teach once. An empty
table gives no rows. All asked-for columns are kept; the result is one struct column whose
name gets a number if it is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.sample import least_keys, row_key, rows_of
from quire.plans.staging import fresh, shipped

#: Bounds of what is learned from: labelled rows per label, and landmarks among them.
SAMPLE, LANDMARKS = 160, 40
BUCKETS = 1 << 20
#: sf0.1: held-out rows have 0.72 and more; random letters, Polish, Finnish, Italian and Dutch 0.53 and less.
LEAST_KNOWN = 0.55
RIDGE = 1e-2
BATCH = 64  # texts in one matrix product
BLOCK = 1 << 18  # characters whose n-grams are hashed at a time

RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def letters(text: str, before: int) -> np.ndarray:
    """Code points of a text in lower case, with one 0 for each run between letters; none if 0 stood before."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letter_table()[points], points, 0).astype(np.uint64)
    last = np.concatenate((np.array([before], np.uint64), points[:-1]))
    return points[(points != 0) | (last != 0)]


def hashed(symbols: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the n-grams of symbols."""
    code = np.full(max(0, len(symbols) - n + 1), n, np.uint64)
    for k in range(n):
        code = code * np.uint64(0x9E3779B97F4A7C15) + symbols[k : k + len(code)]
    code = (code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (code >> np.uint64(44)).astype(np.int64)


def blocks(text: str):
    """Buckets of n-grams (of one and two letters, of three; repeats included) of a text, a block of it at a time."""
    border = np.zeros(1, np.uint64)
    held = border[:0]
    for k in range(0, len(text), BLOCK):
        new = border if not k else border[:0]
        new = np.concatenate((new, letters(text[k : k + BLOCK], int((*held, *new)[-1]))))
        symbols = np.concatenate((held, new))
        if k + BLOCK >= len(text) and symbols[-1]:
            symbols = np.concatenate((symbols, border))
        n = len(held)
        yield np.concatenate((hashed(symbols[n:], 1), hashed(symbols[max(0, n - 1) :], 2))), hashed(symbols, 3)
        held = symbols[-2:]


_PLACE: list[np.ndarray] = []


def distinct(found: np.ndarray) -> np.ndarray:
    """Each bucket once: those at the place where their bucket was written last."""
    if not _PLACE:
        _PLACE.append(np.zeros(BUCKETS, np.int32))
    place, at = _PLACE[0], np.arange(len(found), dtype=np.int32)
    place[found] = at
    return found[place[found] == at]


def buckets(text: str) -> np.ndarray:
    """The distinct buckets of a text."""
    found = [distinct(np.concatenate(b)) for b in blocks(text)]
    return distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)


class Model:
    """Nyström features of the kernel, and one ridge regression per language."""

    def __init__(self, labels: list[str], grams: list[np.ndarray], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        """labels and distinct buckets of the rows that are learned from."""
        self.langs = sorted(set(labels))
        if not self.langs:
            return
        of = {lang: [k for k, y in enumerate(labels) if y == lang] for lang in self.langs}
        marks = [k for lang in self.langs for k in of[lang][:landmarks]]
        self.known = np.unique(np.concatenate([grams[k] for k in marks]))
        self.width = len(self.known)
        self._number()
        self.marks = np.concatenate([self.presence(grams[k])[None] for k in marks])
        # Which n-grams the landmarks of each language hold; none holds the column of unknown ones.
        holds = np.zeros((len(self.langs), self.width + 1), bool)
        for k, row in zip(marks, self.marks, strict=True):
            holds[self.langs.index(labels[k]), :-1] |= row > 0
        self.held = np.ascontiguousarray(holds.T)
        values, vectors = np.linalg.eigh((self.marks @ self.marks.T).astype(np.float64))
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        x = np.concatenate([(self.presence(g) @ self.marks.T)[None] for g in grams]).astype(np.float64) @ root
        x1 = np.hstack((x, np.ones((len(x), 1))))
        y = np.array([[1.0 if label == lang else -1.0 for lang in self.langs] for label in labels])
        share = np.array([1 / len(of[label]) for label in labels])[:, None]  # each language weighs the same
        share *= len(labels) / len(self.langs)
        w = np.linalg.solve(x1.T @ (share * x1) + ridge * np.eye(x1.shape[1]), x1.T @ (share * y))
        # Presence times the landmarks' presence times weights: the two constant matrices are multiplied once.
        self.weights, self.bias = np.ascontiguousarray(self.marks.T @ (root @ w[:-1]).astype(np.float32)), w[-1]

    def _number(self) -> None:
        self.column = np.full(BUCKETS, self.width, np.int32)
        self.column[self.known] = np.arange(self.width)

    def __getstate__(self) -> dict:
        """What scoring needs: the table of columns is made anew, the landmarks' presence is in the weights."""
        return {k: v for k, v in self.__dict__.items() if k not in ("column", "marks")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if self.langs:
            self._number()

    def presence(self, grams: np.ndarray) -> np.ndarray:
        """Which of the landmarks' n-grams a text of these distinct buckets holds, over the root of the number of all of them."""
        out = np.zeros(self.width + 1, np.float32)
        out[self.column[grams]] = 1
        return out[:-1] / np.sqrt(max(1, len(grams)))

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Presence of a text, and how many of its three-letter n-grams, repeats counted, each language holds, as a share."""
        seen, known, total = [], np.zeros(len(self.langs)), 0
        for short, triple in blocks(text):
            seen.append(distinct(np.concatenate((short, triple))))
            known += self.held[self.column[triple]].sum(0, dtype=np.int64)
            total += len(triple)
        found = seen[0] if len(seen) == 1 else distinct(np.concatenate(seen))
        return self.presence(found), known / max(1, total)

    def predict(self, texts: list[str | None], least_known: float = 0.0) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        use = [i for i, t in enumerate(texts) if self.langs and t and any(map(str.isalpha, t))]
        for k in range(0, len(use), BATCH):
            rows = use[k : k + BATCH]
            found = [self.row(texts[i]) for i in rows]
            margin = np.stack([p for p, _ in found]) @ self.weights + self.bias
            best = margin.argmax(1)
            score = np.clip((margin[np.arange(len(rows)), best] + 1) / 2, 0, 1)
            for i, (_, known), b, s in zip(rows, found, best.tolist(), score.tolist(), strict=True):
                if known[b] >= least_known:
                    out[i] = (self.langs[b], s)
        return out


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Rows that may not be learned from: crc32 of the id as text leaves this remainder."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", may_learn: Column | None = None) -> Model:
    """A model from at most SAMPLE labelled rows of each label, those with the least hash of id, label and text.

    The rows are picked by hash alone; the texts of the picked rows are then read where they lie, whole.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & F.col(id_col).isNotNull())
    if may_learn is not None:
        rows = rows.filter(may_learn)
    rows = rows.select(row_key(id_col, lang_col, text_col).alias("key"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    keys = set().union(*least_keys(rows, "label", "key", SAMPLE).values())
    if not keys:
        return Model([], [])

    def run(batches):
        for batch in batches:
            grams = [buckets(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(grams, pa.list_(pa.int32()))], names=["key", "label", "grams"])

    found = rows_of(rows, "key", keys).mapInArrow(run, "key long, label string, grams array<int>").toArrow()
    found = found.sort_by([("key", "ascending"), ("label", "ascending")])
    grams = [np.asarray(g.values.to_numpy(zero_copy_only=False), np.int64) for g in found.column("grams")]
    return Model(found.column("label").to_pylist(), grams)


def identify(
    docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, name: str = "language", least_known: float = 0.0
) -> tuple[DataFrame, str]:
    """The documents (columns keep, or all) with a struct of lang and score from the whole text, and the struct's name.

    least_known: the share of known three-letter n-grams under which a text is in none of the languages.
    """
    name = fresh(docs.columns, name)
    kept = docs.columns if keep is None else keep
    base = docs.select(*dict.fromkeys([*kept, text_col]))
    shared = shipped(docs.sparkSession, model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            found = [{"lang": a, "score": b} for a, b in shared().predict(batch.column(text_col).to_pylist(), least_known)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=[*kept, name])

    fields = [base.schema[c] for c in kept]
    return base.mapInArrow(run, T.StructType([*fields, T.StructField(name, RESULT)])), name


def op4_langid(spark, sf_dir: str) -> DataFrame:
    from quire.plans.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, may_learn=~held_out("doc_id", 4, 2))
    found, at = identify(docs, model, keep=["doc_id"])
    return found.select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        F.col(at).lang.alias("lang_pred"),
        F.col(at).score.alias("score"),
    )
