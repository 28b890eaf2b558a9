"""Quality of documents by hierarchical empirical Bayes over hosts and paths.

A logistic classifier on surface features of the whole text gives each document its evidence, the
logarithm of a likelihood ratio. Summed over all documents of a host, and of a path of a host, the
classifier's probabilities give rates; a host's rate is shrunk toward the rate of all documents and a
path's rate toward its host's, the more the fewer documents there are. How strongly is estimated
from the spread of the rates themselves. A document's posterior odds are its likelihood ratio times
the odds of its path's rate without the document itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe.llm.sampling import labelled_sample
from loglathe.llm.toxicity import FREQUENT, _joined
from loglathe.llm.words import Words, words
from loglathe.sources.staging import stage

_FEATURES = 12
SAMPLE = 6000  # labelled texts that the classifier is fitted to, at most
_UPPER, _LETTER, _DIGIT, _END, _BAR, _SIGN, _LINE, _HIGH, _WHITE = range(9)
_CLASS = np.full(256, _SIGN, np.uint8)
for _name, _bytes in (
    (_UPPER, range(65, 91)), (_LETTER, range(97, 123)), (_DIGIT, range(48, 58)), (_END, b".,;:'\"()-?"),
    (_BAR, b"|"), (_LINE, b"\n\r"), (_HIGH, range(128, 256)), (_WHITE, b" \t\x0b\x0c"),
):
    _CLASS[list(_bytes)] = _name
_FREQUENT = np.unique(np.concatenate([Words(*_joined(w)).hashes for w in FREQUENT.values()]))


def features(column: pa.Array) -> np.ndarray:
    """Surface features of every whole text, one row each; zeros for an empty one."""
    rows = []
    for start, end, found in words(column):
        raw = column.slice(start, end - start).cast(pa.large_binary()).fill_null(b"")
        data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
        sizes = np.array([len(x) for x in raw.to_pylist()])
        kinds = _CLASS[data]
        at = np.concatenate([[0], np.cumsum(sizes)])
        share = []
        for kind in range(9):
            total = np.concatenate([[0], np.cumsum(kinds == kind)])[at]
            share.append(np.diff(total))
        share = np.stack(share, 1)
        count = np.diff(found.bounds)
        one = np.maximum(count, 1)
        letters = np.maximum(share[:, _UPPER] + share[:, _LETTER] + share[:, _HIGH], 1)
        owner = np.repeat(np.arange(len(count)), count)
        known = np.bincount(owner, np.isin(found.hashes, _FREQUENT), len(count))
        pairs = np.unique((owner.astype(np.uint64) << np.uint64(44)) | (found.hashes >> np.uint64(20)))
        distinct = np.bincount((pairs >> np.uint64(44)).astype(np.int64), minlength=len(count))
        length = np.bincount(owner, found.ends - found.starts, len(count))
        same = np.zeros(len(owner))
        same[1:] = (found.hashes[1:] == found.hashes[:-1]) & (owner[1:] == owner[:-1])
        repeat = np.bincount(owner, same, len(count))
        marks = share / np.maximum(sizes, 1)[:, None]
        made = np.stack(
            [
                share[:, _UPPER] / letters, *(marks[:, k] for k in (_DIGIT, _END, _BAR, _SIGN, _LINE)), known / one,
                distinct / np.sqrt(one), distinct / one, length / one / 10, repeat / one, np.log1p(count) / 10,
            ],
            1,
        )
        made[count == 0] = 0
        rows.append(made)
    return np.concatenate(rows) if rows else np.zeros((0, _FEATURES))


def _bent(x: np.ndarray) -> np.ndarray:
    """Features, their roots and squares, so that a linear rule can have thresholds."""
    return np.concatenate([np.ones((len(x), 1)), x, np.sqrt(np.abs(x)), x**2], 1)


@dataclass
class Evidence:
    """A logistic rule; ``prior`` is the log odds of the labels that it was fitted to."""

    weights: np.ndarray
    scale: np.ndarray
    prior: float

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of likelihood ratios, within what the sample size can support."""
        return np.clip((_bent(x) / self.scale) @ self.weights - self.prior, -12, 12)


def sample_features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a sample (doc_id, text, label), in the order of ids. The texts stay in
    the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1).cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    made = sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, x array<double>").toArrow()
    made = made.sort_by("doc_id")
    x = made["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return x.reshape(made.num_rows, _FEATURES), made["label"].to_numpy().astype(float)


def fit(x: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> Evidence:
    """Newton's method for a logistic rule with a small ridge, on rows of :func:`features`. Labels of
    one kind give no evidence."""
    x = _bent(x)
    scale = np.maximum(np.sqrt((x**2).mean(0)), 1e-9) if len(x) else np.ones(x.shape[1])
    x, weights = x / scale, np.zeros(x.shape[1])
    rate = (labels.sum() + 1) / (len(labels) + 2)
    prior = float(np.log(rate / (1 - rate)))
    if len(set(labels.tolist())) < 2:
        weights[0] = prior * scale[0]
        return Evidence(weights, scale, prior)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (labels - p) - ridge * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return Evidence(weights, scale, prior)


def with_evidence(docs: DataFrame, model: Evidence, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``_evidence``. One pass, no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio = model.ratio(features(batch.column(at).cast(pa.large_string())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratio)], names=[*batch.schema.names, "_evidence"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_evidence", T.DoubleType())]))


def _strength(groups: DataFrame, n: str, s: str, center: Column) -> float:
    """How many documents a prior counts as: by the method of moments from the spread of rates
    around their ``center`` beyond what chance gives."""
    rate = F.col(s) / F.col(n)
    inner = center * (1 - center)
    spread, chance, var, total = groups.where(F.col(n) > 1).agg(
        F.sum(F.col(n) * (rate - center) ** 2), F.sum(inner), F.sum(F.col(n) * inner), F.sum(n)
    ).first()
    if not total:
        return 10.0
    between = max((spread - chance) / total, 1e-6)
    return float(min(max(var / total / between - 1, 1.0), 1e5))


@dataclass(frozen=True)
class Sites:
    """Shrunk rates by path: (host, path, n, s, host_rate, path_strength)."""

    table: DataFrame
    rate: float
    strength: float


def sites(evidence: DataFrame, prior: float) -> Sites:
    """Rates of all documents by path and host, from columns _host, _path and _evidence.

    Sums are made in the tasks that have the rows before any shuffle, so a host with a third of all
    documents costs no more than others; only totals reach the driver.
    """
    p = 1 / (1 + F.exp(-(F.col("_evidence") + prior)))
    paths = evidence.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum(p).alias("s"))
    paths = stage(paths, "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    n, s = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    rate = (s + 1) / (n + 2) if n else 0.5
    a = _strength(hosts, "host_n", "host_s", F.lit(rate))
    hosts = hosts.withColumn("host_rate", (F.col("host_s") + a * rate) / (F.col("host_n") + a))
    both = stage(paths.join(hosts.select("_host", "host_rate"), "_host"), "sites")
    return Sites(both, rate, _strength(both, "n", "s", F.col("host_rate")))


def assessments(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    sample: int = SAMPLE,
    where: Column | None = None,
    cutoff: float = 0.5,
) -> DataFrame:
    """The rows of ``docs`` (``_row``) with (evidence, host_rate, path_rate, quality, good) (``_found``).

    ``quality`` is the posterior probability of a good document, ``good`` whether it reaches
    ``cutoff``. ``labels`` has (doc_id, quality); at most ``sample`` labelled texts are learnt from,
    those that ``where`` allows. Null hosts and paths are sites of their own, a null text counts as
    empty, repeated rows count as often as they occur; without labels every document is good.
    """
    model = fit(*sample_features(labelled_sample(docs, labels, "quality", sample, where)))
    # All columns of a row travel as one, so that no name of theirs matters here.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    site = [F.coalesce(x.cast("string"), F.lit("\0")).alias(name) for x, name in ((host, "_host"), (path, "_path"))]
    text = F.col("text").cast("string").alias("_text")
    known = sites(with_evidence(docs.select(text, *site), model, "_text").drop("_text"), model.prior)
    full = with_evidence(docs.select(row, text, *site), model, "_text").join(known.table, ["_host", "_path"])
    p = 1 / (1 + F.exp(-(F.col("_evidence") + model.prior)))
    b = known.strength
    rest = F.greatest(F.col("s") - p, F.lit(0.0)) + b * F.col("host_rate")
    full = full.withColumn("_rate", rest / (F.col("n") - 1 + b))
    odds = F.log(F.col("_rate") / (1 - F.col("_rate"))) + F.col("_evidence")
    full = full.withColumn("_quality", 1 / (1 + F.exp(-odds)))
    made = F.struct(
        F.col("_evidence").alias("evidence"), F.col("host_rate").alias("host_rate"), F.col("_rate").alias("path_rate"),
        F.col("_quality").alias("quality"), (F.col("_quality") >= cutoff).alias("good"),
    )
    return full.select("_row", made.alias("_found"))


def assessed(docs: DataFrame, *args, **options) -> DataFrame:
    """``docs`` with (evidence, host_rate, path_rate, quality, good); see :func:`assessments`. Columns
    of ``docs`` with one of these names give way."""
    found = assessments(docs, *args, **options)
    made = found.schema["_found"].dataType.names
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c not in made]
    return found.select(*kept, "_found.*")
