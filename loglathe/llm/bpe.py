"""Byte-level BPE by a tree of halves.

A piece of text (one match of the splitting pattern) is cut into halves down to a few bytes; the
encodings of neighbours are joined up the tree. A token sequence is the encoding of its bytes
exactly if every two neighbours in it encode to themselves: as long as no merge has crossed a
border, merging goes on beside the border as it would for the two tokens alone. So to join two
encodings only their border matters: if its two tokens are stable together, the lists are
concatenated; else the bytes of a window around it are merged anew, and the window grows until both
of its own borders are stable. Decoding concatenates the bytes of tokens, halves first.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 1 << 20
MATCHES = 1 << 16
LEAF, LONG, NEVER = 16, 256, 1 << 40


class ByteBpe:
    """An encoder for one table of ranks. Its memos are emptied when they hold ``MEMO`` entries."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._parts: dict[bytes, tuple[int, ...]] = {}
        self._pieces: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        """Ranks from a file of lines ``base64(token) rank``."""
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def _merged(self, data: bytes) -> list[int]:
        """Plain merging: the pair of the lowest rank first, the leftmost of equal ones."""
        if len(data) > LONG:
            return self._merged_long(data)
        get = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            del ranks[i]
            new = parts[i] = parts[i] + parts.pop(i + 1)
            if i < len(ranks):
                ranks[i] = get(new + parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(parts[i - 1] + new, NEVER)
        return [self.ranks[p] for p in parts]

    def _merged_long(self, data: bytes) -> list[int]:
        """The same with a heap, for stretches where shifting lists would cost too much."""
        n, get = len(data), self.ranks.get
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one side has changed since
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := get(parts[x] + parts[y])) is not None:
                    heappush(heap, (r, x, len(parts[x]) + len(parts[y])))
        return [self.ranks[p] for p in parts if p is not None]

    def stable(self, a: int, b: int) -> bool:
        """Whether two tokens beside each other encode to themselves."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= MEMO:
                self._pairs.clear()
            known = self._merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            self._pairs[a, b] = known
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two neighbouring stretches of bytes from theirs: the monoid's product."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j, reach = len(left), 0, 1
        while True:
            i, j = max(0, i - reach), min(len(right), j + reach)
            middle = self._merged(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            fits_left = i == 0 or self.stable(left[i - 1], middle[0])
            fits_right = j == len(right) or self.stable(middle[-1], right[j])
            if fits_left and fits_right:
                return (*left[:i], *middle, *right[j:])
            reach *= 2

    def tree(self, data: bytes) -> tuple[int, ...]:
        """The merges of a stretch of bytes, halves first, short stretches merged plainly."""
        if len(data) <= LEAF:
            return tuple(self._merged(data))
        known = self._parts.get(data)
        if known is None:
            half = len(data) // 2
            known = self.join(self.tree(data[:half]), self.tree(data[half:]))
            if len(data) <= 64:
                if len(self._parts) >= MEMO:
                    self._parts.clear()
                self._parts[data] = known
        return known

    def piece(self, text: str) -> bytes:
        """Ids of one match of the pattern, as little-endian unsigned 32-bit integers. A piece that
        is a token as a whole is that token, whatever its merges give."""
        data = text.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else self.tree(data)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a whole text, in bounded runs of matches."""
        known, matches = self._pieces, self.pattern.finditer(text)
        if len(text) <= MATCHES:
            runs: Iterator[list[str]] = iter([self.pattern.findall(text)])
        else:
            runs = iter(lambda: [m.group() for m in islice(matches, MATCHES)], [])
        for run in runs:
            new = [p for p in set(run) if p not in known]
            if len(known) + len(new) > MEMO:
                known.clear()
                new = list(set(run))
            for piece in new:
                known[piece] = self.piece(piece)
            yield b"".join(map(known.__getitem__, run))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids: concatenated up a tree of halves, runs of tokens being leaves."""
        if len(ids) <= MATCHES:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteBpe:
    """One encoder for each Python worker."""
    return ByteBpe.from_file(path, pattern)


def round_trips(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded and decoded again.

    ``path``: the rank file's place on every executor. A null text is empty and has no tokens. One
    pass over the rows without a shuffle; nothing but digests leaves a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            rows = [_digest(bpe, text.as_py() or "") for text in batch.column(1)]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _digest(bpe: ByteBpe, text: str) -> tuple[int, str, str]:
    n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
    for ids in bpe.encode(text):
        n += len(ids) // 4
        ids_hash.update(ids)
        bytes_hash.update(bpe.decode(np.frombuffer(ids, "<u4")))
    return n, ids_hash.hexdigest(), bytes_hash.hexdigest()


def encodings(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids array<int>) of every whole text; a null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            rows = [np.frombuffer(b"".join(bpe.encode(x.as_py() or "")), "<u4").astype(np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["id", "ids"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "id long, ids array<int>")


