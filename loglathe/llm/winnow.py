"""Document fingerprints by winnowing.

Every run of ``gram`` code points has a rolling hash. Of each ``window`` consecutive hashes the
smallest is chosen, the rightmost of equal ones, and kept with its position. Two texts that share
``gram + window - 1`` code points share a chosen hash for certain (the guarantee), and none that
share fewer than ``gram`` do, but for hash collisions (the noise threshold). A text with fewer
grams than a window holds has one chosen hash, a text shorter than a gram is hashed whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.llm.words import mix

_BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Winnow:
    gram: int = 16
    window: int = 32

    def guarantee(self) -> int:
        return self.gram + self.window - 1


@dataclass(frozen=True)
class Fingerprint:
    """Chosen hashes (32 bits) and the positions of their grams, in text order."""

    hashes: np.ndarray
    positions: np.ndarray

    def text(self) -> str:
        """Both as base64 of little-endian unsigned 32-bit hashes and 16-bit or 32-bit gaps."""
        gaps = np.diff(self.positions, prepend=0)
        kind = "<u2" if not len(gaps) or gaps.max() < 65536 else "<u4"
        return f"{_encoded(self.hashes.astype('<u4'))}.{kind[-1]}.{_encoded(gaps.astype(kind))}"

    @classmethod
    def of_text(cls, text: str) -> Fingerprint:
        hashes, kind, gaps = text.split(".")
        gaps = np.frombuffer(base64.b64decode(gaps), f"<u{kind}")
        return cls(np.frombuffer(base64.b64decode(hashes), "<u4"), np.cumsum(gaps.astype(np.int64)))

    def likeness(self, other: Fingerprint) -> float:
        """Shared distinct hashes as a part of all distinct hashes; 1 if both have none."""
        a, b = np.unique(self.hashes), np.unique(other.hashes)
        both = np.concatenate([a, b])
        both.sort()
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return common / (len(both) - common) if len(both) else 1.0


def _encoded(x: np.ndarray) -> str:
    return base64.b64encode(x.tobytes()).decode()


def _spans(width: int) -> list[int]:
    """Shifts that grow a run of one to a run of ``width`` by at most doubling it."""
    shifts, have = [], 1
    while have < width:
        step = min(have, width - have)
        shifts.append(step)
        have += step
    return shifts


def winnow(text: str, rule: Winnow = Winnow()) -> Fingerprint:
    """The fingerprint of a whole text (nothing for an empty one)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(codes):
        return Fingerprint(np.zeros(0, np.uint32), np.zeros(0, np.int64))
    gram = min(rule.gram, len(codes))
    rolled, have = mix(codes + np.uint64(_BASE)), 1
    for step in _spans(gram):
        # run of have + step, from a run of have and one (which may overlap it) that ends it
        tail = rolled[step:]
        rolled = rolled[: len(tail)] * np.uint64(pow(_BASE, step, 1 << 64)) + tail
        have += step
    keys = (mix(rolled) >> np.uint64(32) << np.uint64(32)) | (
        np.uint64(0xFFFFFFFF) - np.arange(len(rolled), dtype=np.uint64)
    )
    for step in _spans(min(rule.window, len(keys))):
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
    chosen = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=chosen[1:])
    keys = keys[chosen]
    return Fingerprint(
        (keys >> np.uint64(32)).astype(np.uint32),
        (np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.int64),
    )


def fingerprints(docs: DataFrame, rule: Winnow = Winnow(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; a null text counts as empty. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [winnow(x.as_py() or "", rule).text() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], names=["id", "fingerprint"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "id long, fingerprint string")


def _ranges(docs: DataFrame, parts: int) -> list[int]:
    """The largest id, then ids of the table that cut it into about equal ranges, largest first."""
    shares = [i / parts for i in range(1, parts)] or [0.5]
    top, cuts = docs.agg(F.max("id"), F.percentile_approx("id", shares, 10 * parts)).first()
    return [] if top is None else [top, *sorted(set(cuts if parts > 1 else []) - {top}, reverse=True)]


def edited_fingerprints(
    docs: DataFrame, rule: Winnow = Winnow(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every text beside its next one in descending id order, and an edit that joins the two.

    The edit replaces the last third of the code points, rounded down, by the first as many of the
    next text (by all of it, if it is shorter); after the last text comes the first. Rows that
    share an id follow each other by text, a null id comes last, a null text is empty, and a table
    of one row is its own next one. Gives (id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next).

    The table is dealt into ranges of ids once, each sorted inside its task; the row that begins a
    range is sent to the range before it as well, so no row waits for another task.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = _ranges(chosen, parts)
    heads = np.array(cuts[::-1], np.int64)
    count = max(1, len(cuts))
    schema = pa.schema([("range", pa.int32()), ("lead", pa.bool_()), ("id", pa.int64()), ("text", pa.string())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            known = ~np.asarray(batch.column(0).is_null())
            whole = np.where(known, ids, np.iinfo(np.int64).min).astype(np.int64)
            # the range of an id begins with the smallest head that is not below it
            at = np.minimum(count - 1, len(heads) - np.searchsorted(heads, whole, "left") - 1)
            at = np.where(known, np.maximum(at, 0), count - 1)
            lead = known & np.isin(whole, heads)
            rows = np.concatenate([np.arange(len(ids)), np.flatnonzero(lead)])
            ranges = np.concatenate([at, (at[lead] - 1) % count]).astype(np.int32)
            if not known.all() and len(heads) == 0:
                rows = np.concatenate([rows, np.flatnonzero(~known)])
                ranges = np.concatenate([ranges, np.zeros((~known).sum(), np.int32)])
                lead = ~known
            flags = np.arange(len(rows)) >= len(ids)
            both = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(flags), both.column(0), both.column(1)], schema=schema)

    dealt = chosen.mapInArrow(deal, "range int, lead boolean, id long, text string")
    dealt = dealt.repartitionById(count, F.col("range")) if count > 1 else dealt.coalesce(1)
    dealt = dealt.sortWithinPartitions("range", "lead", F.desc_nulls_last("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        done = False
        for batch in batches:
            rows: list[tuple] = []
            for lead, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if done:
                    continue
                own = None if lead and held is None else winnow(text, rule)
                if held is not None:
                    rows.append(_edited(*held, text, own, rule))
                done = lead
                held = (doc_id, text, own) if not lead else None
            yield pa.RecordBatch.from_pylist(
                [dict(zip(_EDITED.names, r)) for r in rows], schema=_EDITED
            )

    return dealt.mapInArrow(
        run,
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


_EDITED = pa.schema(
    [
        ("id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _edited(doc_id: int | None, text: str, own: Fingerprint, after: str, following: Fingerprint, rule: Winnow) -> tuple:
    n = len(text)
    edited = text[: n - n // 3] + after[: n // 3]
    changed = winnow(edited, rule)
    return (
        doc_id,
        n,
        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        own.text(),
        changed.text(),
        own.likeness(changed),
        own.likeness(following),
    )
