"""Packing token sequences by exact complements.

Documents become pieces of at most ``size`` tokens. Only the number of pieces of each length matters
for how they fit together, and there are at most ``size`` lengths, so this small table of counts is
all that is solved in one place: from the longest length down, the gap that a piece leaves is looked
up among single lengths, sums of pairs and sums of triples; a combination that fills the gap exactly
is used as often as its counts allow. What finds no exact complement is packed by best fit, again by
counts. The solution is a list of runs (length, first rank, first sequence, offset), and every
piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglathe.sources.staging import stage

SIZE = 2048


def _pair(counts: np.ndarray, gap: int, spent: dict[int, int]) -> tuple[int, ...] | None:
    """Two available lengths with the sum ``gap``, the longest first; ``spent`` is in use already."""
    a = np.arange(gap - 1, (gap - 1) // 2, -1)
    b = gap - a
    left = counts.copy()
    for x, n in spent.items():
        left[x] -= n
    fits = (left[a] > 0) & (left[b] > 0) & ((a != b) | (left[a] > 1))
    at = int(fits.argmax()) if len(fits) else 0
    return (int(a[at]), int(b[at])) if len(fits) and fits[at] else None


def complement(counts: np.ndarray, gap: int, spent: dict[int, int]) -> tuple[int, ...] | None:
    """One, two or three available lengths that fill ``gap`` exactly, found by their sums."""
    if gap < 1:
        return None
    if counts[gap] > spent.get(gap, 0):
        return (gap,)
    if found := _pair(counts, gap, spent):
        return found
    for a in np.flatnonzero(counts[:gap])[::-1].tolist():
        if 3 * a < gap:
            break
        if counts[a] > spent.get(a, 0):
            rest = _pair(counts, gap - a, spent | {a: spent.get(a, 0) + 1})
            if rest and rest[0] <= a:
                return (a, *rest)
    return None


def solve(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) and how often each is used, for counts by length.

    ``counts[n]`` is the number of pieces of length n; the last index is the size of a sequence.
    """
    size, left = len(counts) - 1, counts.astype(np.int64).copy()
    left[0] = 0
    patterns: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...], most: int | None = None) -> None:
        need = dict(zip(*np.unique(lengths, return_counts=True)))
        times = min(int(left[n]) // int(k) for n, k in need.items())
        times = times if most is None else min(times, most)
        for n, k in need.items():
            left[n] -= k * times
        patterns.append((lengths, times))

    if left[size]:
        use((size,))
    open_bins: list[tuple[tuple[int, ...], int]] = []
    for length in range(size - 1, 0, -1):
        while left[length]:
            found = complement(left, size - length, {length: 1})
            if found is None:
                open_bins.append(((length,), int(left[length])))
                left[length] = 0
            else:
                use((length, *found))
    patterns += _best_fit(open_bins, size)
    return patterns


def _best_fit(residual: list[tuple[tuple[int, ...], int]], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of (length,) x count without exact complements."""
    bins: dict[int, list[list]] = {}  # by free space: [lengths, count]
    for (length,), count in residual:
        while count:
            free = min((f for f in bins if f >= length), default=None)
            if free is None:
                each = size // length
                full, part = divmod(count, each)
                for lengths, times in (((length,) * each, full), ((length,) * part, 1 if part else 0)):
                    if times:
                        bins.setdefault(size - sum(lengths), []).append([lengths, times])
                count = 0
                continue
            lengths, times = bins[free][-1]
            each = min(free // length, -(-count // times)) if count >= times else 1
            used = min(times, count // each)
            count -= used * each
            bins[free][-1][1] -= used
            if not bins[free][-1][1]:
                bins[free].pop()
                if not bins[free]:
                    del bins[free]
            bins.setdefault(free - each * length, []).append([lengths + (length,) * each, used])
    return [(tuple(lengths), times) for group in bins.values() for lengths, times in group]


def runs(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each place in each pattern: length, first and last rank of pieces there, the sequence of
    the first one, and the offset. Sorted by length and rank."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            first = taken.get(n, 0)
            rows.append((n, first, first + times, sequence, offset))
            taken[n] = first + times
            offset += n
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "end", "sequence", "offset"), columns))


@lru_cache(maxsize=2)
def _tokenizers(path: str, ranks_path: str | None, pattern: str | None, special: tuple[str, ...]) -> Callable[[str], np.ndarray]:
    """Ids by the tokenizer file. Where the same vocabulary is given as ranks, these are merged for
    texts without special tokens, which is faster and gives the same ids (tested)."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    if ranks_path is None:
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    import base64

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(x in text for x in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all are full but the first, which takes the rest."""
    first = n % size or min(n, size)
    starts = [0, *range(first, n, size)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])] if n else []


def pieces(
    docs: DataFrame,
    path: str,
    end_id: int = 0,
    size: int = SIZE,
    ranks_path: str | None = None,
    pattern: str | None = None,
    special: tuple[str, ...] = ("<|endoftext|>",),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, local): the pieces of every whole text, each with
    its rank among the pieces of its length in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = _tokenizers(path, ranks_path, pattern, special), np.zeros(size + 1, np.int64)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    crc = zlib.crc32(ids[start : start + length].tobytes())
                    for column, x in zip(rows, (i, k, start, length, crc, int(seen[length]))):
                        column.append(x)
                    seen[length] += 1
            longs = [pa.array(x, pa.int64()) for x in rows[2:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *longs],
                names=["id", "piece", "start", "length", "ids_crc32", "local"],
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = chosen.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, local long")
    return found.withColumn("task", F.spark_partition_id())


def pack(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` with (sequence_id, offset) added: every piece once, sequences without gaps.

    The driver holds one count for each length and the patterns made of them, whatever the number
    of pieces; the ranks come from counts per task and length.
    """
    staged = stage(cut_pieces, "pieces")
    by_task = staged.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = stage(by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    counts = np.zeros(size + 1, np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    table = runs(solve(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            # runs of one length are sorted by rank: one search over (length, rank)
            span = int(max(table["end"].max(initial=0), rank.max(initial=0))) + 1
            at = np.searchsorted(table["length"] * span + table["first"], length * span + rank, "right") - 1
            sequence = table["sequence"][at] + rank - table["first"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(table["offset"][at])], names=_PACKED
            )

    ranked = staged.join(by_task.drop("n"), ["length", "task"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank")
    )
    return ranked.mapInArrow(
        run, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


_PACKED = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
