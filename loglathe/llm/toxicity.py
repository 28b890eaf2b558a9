"""A convolutional text classifier in numpy, for toxicity.

Each word is the sum of hashed embeddings: of the whole word and of its first letters (so inflected
forms share weights). Filters of several widths run over the words, each is max-pooled over the
whole text, and a logistic layer gives the score. All of it is trained by Adam on a bounded sample
of labelled texts. The threshold is calibrated for each language, which is recognised from the text
by lists of frequent words; a score is shifted so that its language's threshold is
``cutoff``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.llm.words import Words, mix, words

# Frequent words by which a language is told.
FREQUENT = {
    "de": "der die und das den von zu mit ist des auf nicht ein eine im dem sich auch".split(),
    "en": "the of and to in is that for was with on be by this are at from or".split(),
    "es": "el los las del que una por con para su como y se al lo no es en".split(),
    "fr": "le les des du et une est dans pour par sur au pas aux ce qui en un".split(),
}


@dataclass(frozen=True)
class Shape:
    """Sizes and training parameters. ``sample`` bounds the labelled texts that are learnt from."""

    buckets: int = 1 << 15
    dims: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 6
    prefixes: tuple[int, ...] = (4, 6)
    sample: int = 6000
    steps: int = 1200
    batch: int = 32
    rate: float = 0.01
    dropped: float = 0.3
    cutoff: float = 0.7


def features(found: Words, shape: Shape) -> np.ndarray:
    """Buckets of every word: of the word and of its prefixes, (words, 1 + prefixes)."""
    whole = found.hashes & np.uint64(shape.buckets - 1)
    columns = [whole]
    for k, n in enumerate(shape.prefixes):
        part = found.hash_until(np.minimum(found.starts + n, found.ends))
        columns.append(mix(part + np.uint64(k + 1)) & np.uint64(shape.buckets - 1))
    return np.stack(columns, 1).astype(np.int32)


_NAMES = sorted(FREQUENT)


def languages(found: Words) -> np.ndarray:
    """For every row the language with most frequent words in it (the first one, if there are none)."""
    lists = [Words(*_joined(FREQUENT[name])).hashes for name in _NAMES]
    votes = np.zeros((len(lists), len(found.hashes) + 1), np.int64)
    for k, frequent in enumerate(lists):
        np.cumsum(np.isin(found.hashes, frequent), out=votes[k, 1:])
    return (votes[:, found.bounds[1:]] - votes[:, found.bounds[:-1]]).argmax(0)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


@dataclass
class Conv:
    """Weights of the classifier; ``shift`` moves the logit of each language."""

    shape: Shape
    embed: np.ndarray
    kernels: list[np.ndarray]  # (width, dims, filters)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(_NAMES)))

    @classmethod
    def start(cls, shape: Shape) -> Conv:
        rng = np.random.default_rng(3)
        kernels = [rng.normal(0, 0.5 / np.sqrt(w), (w, shape.dims, shape.filters)).astype(np.float32) for w in shape.widths]
        n = shape.filters * len(shape.widths)
        embed = rng.normal(0, 0.1, (shape.buckets, shape.dims)).astype(np.float32)
        return cls(shape, embed, kernels, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32))

    def tables(self) -> np.ndarray:
        """What a bucket adds to every filter at every offset: (buckets, sum of widths, filters)."""
        return np.concatenate([np.einsum("bd,wdf->bwf", self.embed, k) for k in self.kernels], 1)

    def pooled(self, rows: np.ndarray, bounds: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each text and its place (-1 and 0 where there is
        none). Texts are followed by blank words, so that filters reach over their ends."""
        pad = max(self.shape.widths) - 1
        n, counts = len(bounds) - 1, np.diff(bounds)
        spread = np.repeat(np.arange(n) * pad, counts) + np.arange(len(rows))
        total = len(rows) + n * pad
        first = bounds[:-1] + np.arange(n) * pad
        table = self.tables() if table is None else table
        words_at = np.zeros((total + pad, *table.shape[1:]), np.float32)
        for c in range(rows.shape[1]):
            words_at[spread] += table[rows[:, c]]
        best, place, at = [], [], 0
        for width in self.shape.widths:
            reply = words_at[:total, at].copy()
            for k in range(1, width):
                reply += words_at[k : total + k, at + k]
            at += width
            reply[np.delete(np.arange(total), spread)] = -1e9
            if n:
                top = np.maximum.reduceat(reply, first, 0)
                best.append(top)
                if self._wants_places:
                    same = reply == np.repeat(top, counts + pad, 0)
                    index = np.where(same, np.arange(total)[:, None], total)
                    place.append(np.minimum.reduceat(index, first, 0))
        if not n:
            return np.zeros((0, len(self.bias)), np.float32), np.zeros((0, len(self.bias)), np.int64)
        best_all = np.concatenate(best, 1) + self.bias
        best_all[counts == 0] = 0
        return np.maximum(best_all, 0), np.concatenate(place, 1) if place else np.zeros(0)

    _wants_places = False

    def logits(self, rows: np.ndarray, bounds: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        return self.pooled(rows, bounds, table)[0] @ self.out + self.out_bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: list[str], labels: np.ndarray, shape: Shape = Shape()) -> Conv:
    """Weights from whole labelled texts: four of five to learn from, the fifth for thresholds."""
    model = Conv.start(shape)
    if len(texts) == 0 or len(set(labels.tolist())) < 2:
        model.out[:] = 0
        model.out_bias = 10.0 if len(texts) and labels[0] else -10.0
        return model
    data = [(features(w, shape), w.bounds, languages(w)) for _, _, w in words(pa.array(texts))]
    rows = np.concatenate([d[0] for d in data])
    counts = np.concatenate([np.diff(d[1]) for d in data])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    spoken = np.concatenate([d[2] for d in data])
    held = np.arange(len(texts)) % 5 == 4
    rng, learn = np.random.default_rng(8), np.flatnonzero(~held)
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-3), 0.5 / max(1 - labels.mean(), 1e-3))
    moments: dict[str, list] = {}
    model._wants_places = True
    step = 0
    while step < shape.steps:
        rng.shuffle(learn)
        for i in range(0, len(learn), shape.batch):
            part, step = learn[i : i + shape.batch], step + 1
            own = _thinned(*_taken(rows, bounds, part), shape.dropped, rng)
            _update(model, *own, labels[part], balance[part], moments, step)
    model._wants_places = False
    table, at, logits = model.tables(), 0, []
    while at < len(texts):
        part = np.arange(at, min(at + 500, len(texts)))
        logits.append(model.logits(*_taken(rows, bounds, part), table))
        at += 500
    logits = np.concatenate(logits)
    model.shift = _thresholds(logits, labels, spoken, held, shape.cutoff)
    return model


def train_on(sample: DataFrame, shape: Shape = Shape()) -> Conv:
    """Weights from a bounded sample (doc_id, text, label): one task trains, the driver gets the
    weights, whose size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            labels += batch.column("label").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(labels, np.int64), shape))])], names=["model"])

    ordered = sample.repartition(1).sortWithinPartitions("doc_id").select("text", "label")
    found = ordered.mapInArrow(run, "model binary").first()
    return pickle.loads(found.model) if found else train([], np.zeros(0, np.int64), shape)


def _taken(rows: np.ndarray, bounds: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = bounds[part + 1] - bounds[part]
    own = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(own[-1]) + np.repeat(bounds[part] - own[:-1], lengths)
    return rows[index], own


def _thinned(rows: np.ndarray, bounds: np.ndarray, dropped: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A part of the words left out at random, so that few telling words come to suffice."""
    keep = rng.random(len(rows)) >= dropped
    return rows[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def _update(model: Conv, rows: np.ndarray, bounds: np.ndarray, labels: np.ndarray, weight: np.ndarray, moments: dict, step: int) -> None:
    shape, pad = model.shape, max(model.shape.widths) - 1
    pooled, place = model.pooled(rows, bounds)
    wrong = ((_sigmoid(pooled @ model.out + model.out_bias) - labels) * weight / len(labels)).astype(np.float32)
    back = wrong[:, None] * model.out * (pooled > 0)
    n, counts = len(labels), np.diff(bounds)
    row_at = np.full(len(rows) + n * pad + pad, -1, np.int64)
    row_at[np.repeat(np.arange(n) * pad, counts) + np.arange(len(rows))] = np.arange(len(rows))
    embed, kernels, at = {}, [np.zeros_like(k) for k in model.kernels], 0
    index, values = [], []
    for j, width in enumerate(shape.widths):
        own = slice(at, at + shape.filters)
        at += shape.filters
        text, filt = np.nonzero(back[:, own])
        strength = back[:, own][text, filt]
        for k in range(width):
            word = row_at[place[:, own][text, filt] + k]
            real = word >= 0
            buckets = rows[word[real]]
            for c in range(buckets.shape[1]):
                index.append(buckets[:, c])
                values.append(strength[real, None] * model.kernels[j][k][:, filt[real]].T)
            vector = model.embed[buckets].sum(1)
            np.add.at(kernels[j][k].T, filt[real], strength[real, None] * vector)
    _adam(model.out, pooled.T @ wrong, "out", moments, step, shape.rate)
    bias = np.array([model.out_bias], np.float32)
    _adam(bias, np.array([wrong.sum()]), "out_bias", moments, step, shape.rate)
    model.out_bias = float(bias[0])
    _adam(model.bias, back.sum(0), "bias", moments, step, shape.rate)
    for j, grad in enumerate(kernels):
        _adam(model.kernels[j], grad, f"kernel{j}", moments, step, shape.rate)
    if index:
        where, inverse = np.unique(np.concatenate(index), return_inverse=True)
        grad = np.zeros((len(where), shape.dims), np.float32)
        np.add.at(grad, inverse, np.concatenate(values))
        # only the rows that were met: Adagrad
        if "embed" not in moments:
            moments["embed"] = [np.zeros((shape.buckets, 1), np.float32)]
        seen = moments["embed"][0]
        seen[where] += (grad**2).mean(1, keepdims=True)
        model.embed[where] -= 5 * shape.rate * grad / np.sqrt(seen[where] + 1e-10)


def _adam(weights: np.ndarray, grad: np.ndarray, name: str, moments: dict, step: int, rate: float) -> None:
    if name not in moments:
        moments[name] = [np.zeros_like(weights), np.zeros_like(weights)]
    first, second = moments[name]
    first += 0.1 * (grad - first)
    second += 0.001 * (grad**2 - second)
    weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)


def _thresholds(logits: np.ndarray, labels: np.ndarray, spoken: np.ndarray, held: np.ndarray, cutoff: float) -> np.ndarray:
    """For each language what moves its best threshold on held-back texts to ``cutoff``. The best one
    lies midway between the neighbours that leave fewest errors; with too few texts of either label
    the threshold of all languages holds."""

    def best(mask: np.ndarray) -> float | None:
        x, y = logits[mask], labels[mask]
        if y.sum() < 5 or (1 - y).sum() < 5:
            return None
        order = np.argsort(x)
        x, y = x[order], y[order]
        errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([[0], np.cumsum(1 - y)])[-1] - np.concatenate([[0], np.cumsum(1 - y)])
        least = np.flatnonzero(errors == errors.min())
        ends = [(x[max(0, i - 1)] + x[min(len(x) - 1, i)]) / 2 for i in least]
        return float(np.mean([ends[0], ends[-1]]))

    common = best(held)
    common = best(np.ones_like(held)) if common is None else common
    target = np.log(cutoff / (1 - cutoff))
    shifts = []
    for k in range(len(_NAMES)):
        own = best(held & (spoken == k))
        own = common if own is None else own
        shifts.append(target - own if own is not None else 0.0)
    return np.array(shifts)


def scored(docs: DataFrame, model: Conv, text_col: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a column ``into`` (0 to 1); one of that name gives way. A null or empty text has a
    score as well, that of no evidence. One pass, no shuffle; the weights (some MB, of fixed size)
    are broadcast."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != into or c == text_col])
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast((model, model.tables()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, table = sent.value
        for batch in batches:
            result = []
            for _, _, found in words(batch.column(at).cast(pa.large_string()), 1 << 18):
                logits = conv.logits(features(found, conv.shape), found.bounds, table)
                result.append(_sigmoid(logits + conv.shift[languages(found)]))
            score = np.concatenate(result) if result else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, into])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))
