"""Language of texts: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, everything but letters becomes one space, and its n-grams of 1 to 4 characters
are hashed to features. Their weights are 1 + log(count) times the inverse document frequency over
all documents that may be learnt from, scaled to length 1. The regression is trained by
follow-the-regularised-leader: every feature has its own step size, an L1 penalty leaves most weights
at zero, an L2 penalty keeps the others small. A temperature fitted to documents kept out of the
training turns its outputs into probabilities.

Document frequencies come from all documents with a language. The weights are learnt from a bounded
sample, ``Shape.rows`` documents and ``Shape.characters`` characters of each language at most, in one
task; only the model reaches the driver.

A null text, or one without a letter, is ``und`` with score 0, and so is every text where nothing can
be learnt. Rows without an id are not learnt from. Repeated rows count as often as they occur. Of
languages with equal scores the first by name wins. Only the named columns are read; an empty table
gives no rows. Long texts are counted in pieces, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")
_PIECE = 1 << 20
_PARTS = 64
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Shape:
    """Bounds and penalties. ``bits``: features are numbered by so many bits of a hash."""

    orders: int = 4
    bits: int = 18
    rows: int = 1500
    characters: int = 2_000_000
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.003
    l2: float = 0.01


def gram_counts(text: str, shape: Shape = Shape()) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers of a text and how often each occurs."""
    found, counts = [], []
    shift, overlap = np.uint64(64 - shape.bits), shape.orders - 1
    plain = f" {_OTHER.sub(' ', text.lower()).strip()} "
    for start in range(0, len(plain), _PIECE):
        last = start + _PIECE >= len(plain)
        codes = np.frombuffer(plain[start : start + _PIECE + overlap].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        rolling, parts = np.zeros(len(codes), np.uint64), []
        for n in range(shape.orders):
            size = len(codes) - n
            if size <= 0:
                break
            rolling = rolling[:size] * _BASE + codes[n:] + np.uint64(1)
            own = rolling if last else rolling[:_PIECE]  # later places belong to the next piece
            mixed = (own ^ (own >> np.uint64(32))) * _SPREAD
            parts.append((mixed >> shift).astype(np.uint32))
        grams = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        found.append(grams[first])
        counts.append(np.diff(np.append(first, len(grams))))
    if len(found) == 1:
        return found[0], counts[0]
    grams, place = np.unique(np.concatenate(found), return_inverse=True)
    return grams, np.bincount(place, np.concatenate(counts)).astype(np.int64)


def weighted(text: str, idf: np.ndarray, shape: Shape = Shape()) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and TF-IDF weights of length 1."""
    grams, counts = gram_counts(text, shape)
    weights = (1 + np.log(counts)) * idf[grams]
    return grams, weights / np.sqrt((weights**2).sum())


def document_frequencies(texts: DataFrame, shape: Shape = Shape()) -> tuple[np.ndarray, int]:
    """In how many of ``texts(text)`` each feature occurs, and the number of texts.

    Each task adds up its own texts; one row per feature and task is shuffled, and the sums, one
    number per feature, reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((1 << shape.bits) + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                total[gram_counts(text.as_py(), shape)[0]] += 1
                n += 1
        total[-1] = n
        found = np.flatnonzero(total)
        for k in range(0, len(found), 1 << 16):
            some = found[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["gram", "docs"])

    sums = texts.mapInArrow(run, "gram int, docs long").groupBy("gram").agg(F.sum("docs").alias("docs")).toArrow()
    total = np.zeros((1 << shape.bits) + 1, np.int64)
    total[sums["gram"].to_numpy()] = sums["docs"].to_numpy()
    return total[:-1], int(total[-1])


def sample_of(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """``docs(id, lang, text)`` of the sample: per language the first by hash of the id, up to the
    bounds of ``shape``.

    Rows are cut in the tasks that read them, then in many parts of each language, then among what
    the parts have left: no task gets more than ``_PARTS`` times the bound of one language.
    """
    place = F.xxhash64("id")
    sized = docs.select("id", "lang", F.length("text").alias("n"), place.alias("place"))
    sized = sized.withColumn("part", F.pmod(F.xxhash64("place"), F.lit(_PARTS)))
    order = Window.partitionBy("lang").orderBy("place", "id", "n")
    for keys in (["lang", "part"], ["lang"]):
        own = Window.partitionBy(*keys).orderBy("place", "id", "n")
        sized = sized.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= shape.rows).drop("rank")
    running = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ids = sized.withColumn("upto", running).where(F.col("upto") <= shape.characters).select("id").distinct()
    return docs.join(ids, "id", "left_semi").select(place.alias("place"), "id", "lang", "text")


class Regression:
    """The state of follow-the-regularised-leader for several classes."""

    def __init__(self, classes: int, features: int, shape: Shape = Shape()):
        self.shape, self.z, self.n = shape, np.zeros((features, classes)), np.zeros((features, classes))

    def weights(self, at) -> np.ndarray:
        """The weights that minimise the penalised sum of the losses seen, for some features."""
        s, z = self.shape, self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(self.n[at])) / s.alpha + s.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        weights = self.weights(at)
        error = softmax(x @ weights)
        error[label] -= 1
        slope = x[:, None] * error[None, :]
        before = self.n[at]
        after = before + slope**2
        self.z[at] += slope - (np.sqrt(after) - np.sqrt(before)) / self.shape.alpha * weights
        self.n[at] = after


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fitted_temperature(outputs: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm.

    Each label counts as one more observation of every language, so that a sample without an error
    is no proof of certainty.
    """
    if not len(labels):
        return 1.0
    n, classes = outputs.shape
    target = np.full(outputs.shape, 1 / (n + classes))
    target[np.arange(n), labels] = (n + 1) / (n + classes)

    def loss(log_t: float) -> float:
        p = softmax(outputs / np.exp(log_t))
        return float(-(target * np.log(np.maximum(p, 1e-300))).sum(1).mean())

    low, high, ratio = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, right) if loss(left) <= loss(right) else (left, high)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class Model:
    """Languages in order, weights (features x languages) of the features that have any."""

    langs: list[str]
    grams: np.ndarray
    weights: np.ndarray
    temperature: float
    idf: np.ndarray
    shape: Shape

    def full(self) -> np.ndarray:
        table = np.zeros((1 << self.shape.bits, len(self.langs)))
        table[self.grams] = self.weights
        return table


def inverse_frequencies(docs: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + docs)) + 1


def fit(rows: list[tuple[str, str]], idf: np.ndarray, shape: Shape = Shape()) -> Model:
    """A model from (language, text) pairs in random order; every fifth one sets the temperature."""
    langs = sorted({lang for lang, _ in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    made = [(number[lang], *weighted(text, idf, shape)) for lang, text in rows]
    kept = [row for i, row in enumerate(made) if i % 5 != 4]
    apart = [row for i, row in enumerate(made) if i % 5 == 4]
    state = Regression(len(langs), 1 << shape.bits, shape)
    for _ in range(shape.epochs):
        for label, grams, x in kept:
            state.learn(grams, x, label)
    table = state.weights(slice(None))
    outputs = np.array([x @ table[grams] for _, grams, x in apart]).reshape(-1, len(langs))
    temperature = fitted_temperature(outputs, np.array([label for label, *_ in apart], np.int64))
    grams = np.flatnonzero(table.any(1))
    return Model(langs, grams, table[grams], temperature, idf, shape)


def train(docs: DataFrame, shape: Shape = Shape()) -> Model:
    """A model from ``docs(id, lang, text)``, all of which may be learnt from."""
    docs = docs.where("id is not null and lang is not null and text is not null")
    idf = inverse_frequencies(*document_frequencies(docs.select("text"), shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [pair for b in batches for pair in zip(b.column("lang").to_pylist(), b.column("text").to_pylist())]
        model = fit(rows, idf, shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.langs], pa.list_(pa.string())), pa.array([model.grams.astype(np.int32).tobytes()], pa.binary()),
             pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.temperature])],
            names=["langs", "grams", "weights", "temperature"],
        )

    # The sample is bounded by the number of languages; one task trains on it.
    ordered = sample_of(docs, shape).repartition(1).sortWithinPartitions("place", "id", "lang", "text")
    found = ordered.mapInArrow(run, "langs array<string>, grams binary, weights binary, temperature double").first()
    langs = list(found.langs) if found else []
    grams = np.frombuffer(found.grams, np.int32) if found else np.zeros(0, np.int32)
    weights = np.frombuffer(found.weights).reshape(-1, len(langs)) if langs else np.zeros((0, 0))
    return Model(langs, grams, weights, found.temperature if found else 1.0, idf, shape)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(id, text, held_out)`` with (lang_pred, score). One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, bounded by features x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = own.full()
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1):
                text = text.as_py()
                if text is None or not own.langs or not _LETTER.search(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                grams, x = weighted(text, own.idf, own.shape)
                p = softmax(x @ table[grams] / own.temperature)
                best = int(p.argmax())
                langs.append(own.langs[best])
                scores.append(float(min(p[best], 1.0)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["id", "held_out", "lang_pred", "score"],
            )

    return docs.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
              lang_col: str = "lang", shape: Shape = Shape()) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row; nothing is learnt from rows that ``held_out``
    marks, and the language column is read in the others alone."""
    marked = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(lang_col).cast("string").alias("lang"),
    )
    model = train(marked.where("not held_out").select("id", "lang", "text"), shape)
    return predicted(marked.select("id", "text", "held_out"), model)
