"""Two tokenizers aligned on the bytes of every text: merge-path partitioning of their token ends.

Where a token of A and a token of B end at the same byte, both are cut into groups; each A token of a
group is linked with each B token of it. Common ends are found by merging the two sorted lists of
ends. The merge is divided along diagonals: a binary search on each diagonal gives the point where
the merge path crosses it, and so pieces of equal work that know nothing of each other. A piece emits
the common ends in its own part; an end whose two sides fall into different pieces is found at their
border, and a group that reaches over borders is stitched from both sides.

A text is encoded and merged in units, the stretches between white space and the next space (a
character other than white space before a space ends tokens in both vocabularies: A splits there
before it merges, and B has no piece with a space after another character, which is checked). Units
met before are taken from a bounded memo.

Counting over the corpus goes by blocks of texts (about 8 MB each). A block gives its distinct id
pairs with the number of its documents that hold them; pairs are summed over blocks, and the sums go
back to the blocks, whose documents add them up. What is shuffled is a row per block and pair, not
per document and pair; no pair's documents are ever together in one task.

Texts that are null or empty, or that do not come back byte for byte from both vocabularies (a literal
U+2581, say), have no tokens: zeros and an empty digest. Repeated rows count as documents of their
own. Columns other than the two named are not read. An empty table gives no rows. Ties for an A id's
highest count all count as best.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.sources.staging import stage

BLOCK_BYTES = 1 << 23  # text of a block
PIECE = 1 << 15  # ends that one piece of a merge handles
MEMO_UNITS = 150_000  # units that a worker remembers, in each of two generations
PAIR_BITS = 32  # a pair's code is the A id times 2**32 plus the B id, whatever the vocabularies
_SLICE_CHARS = 1 << 22
_AT_ONCE = 1 << 15  # new units that are merged together
_JOINED = 400  # units that are encoded as one text
_LARGE = 4096  # links of a group beyond which it is multiplied by distinct ids
_UNSURE = re.compile(r"\s |^ ")
_CUT = re.compile(r"(?<=\S)(?= )")


@dataclass(frozen=True)
class Vocabularies:
    """Files of the two tokenizers: A byte-level BPE (JSON), B sentence pieces.

    A's vocabulary may be given as ranks and a pattern too; these are faster and give the same ids
    (tested).
    """

    a_path: str
    b_path: str
    a_ranks_path: str | None = None
    a_pattern: str | None = None


class Coders:
    """Ids and byte lengths of tokens in both vocabularies, for units that begin with a space."""

    def __init__(self, files: Vocabularies):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(files.a_path)
        slow.encode_special_tokens = True  # their strings in a text are text
        sizes = {i: len(token) for token, i in slow.get_vocab(with_added_tokens=False).items()}
        self.a_sizes = np.zeros(max(sizes) + 1, np.int64)  # a byte is one character of a token
        self.a_sizes[list(sizes)] = list(sizes.values())
        self.a = _by_ranks(files) if files.a_ranks_path else lambda t: np.array(slow.encode(t, add_special_tokens=False).ids, np.int64)
        self.b = sentencepiece.SentencePieceProcessor(model_file=files.b_path)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", name) for name in names):
            raise ValueError("vocabulary B has pieces that reach over the space between words")
        self.b_bytes = [
            bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(names)
        ]
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # The unit of a lone space is an empty text to B, so it is taken from behind a letter.
        self.b_space = self.b.encode("a ")[len(self.b.encode("a")) :]

    def encode(self, units: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(places of the units that come back whole, ids, number of ids of each): the last two for A
        and for B. Many units are encoded as one text, as both vocabularies split it between them."""
        joined = [u for u, unit in enumerate(units) if unit and not unit[-1].isspace()]
        alone = sorted(set(range(len(units))).difference(joined))
        todo = [joined[k : k + _JOINED] for k in range(0, len(joined), _JOINED)] + [[u] for u in alone]
        good, ids, counts = [], ([], []), ([], [])
        while todo:
            failed = []
            texts = [" ".join(units[u] for u in run) for run in todo]
            for run, text, b in zip(todo, texts, self.b.encode(texts, num_threads=1)):
                whole = (" " + text).encode()
                b = b if text else self.b_space
                ends = np.cumsum([len(units[u].encode()) + 1 for u in run])
                both = self.a(" " + text), np.array(b, np.int64)
                parts = [_parts(x, sizes, ends) for x, sizes in zip(both, (self.a_sizes, self.b_sizes))]
                if any(p is None for p in parts) or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
                    failed += [[u] for u in run] if len(run) > 1 else []
                    continue
                good += run
                for side in (0, 1):
                    ids[side].append(both[side])
                    counts[side].append(parts[side])
            todo = failed
        none = np.zeros(0, np.int64)
        return np.array(good, np.int64), *[[np.concatenate(x) if x else none for x in both] for both in (ids, counts)]


def _by_ranks(files: Vocabularies) -> Callable[[str], np.ndarray]:
    import base64

    import tiktoken

    with open(files.a_ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("a", pat_str=files.a_pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


def _parts(ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
    """How many tokens each unit has, None if a unit does not end where a token does."""
    reached = np.cumsum(sizes[ids])
    if not len(ids) or reached[-1] != ends[-1]:
        return None
    place = np.searchsorted(reached, ends)
    return np.diff(place, prepend=-1) if (reached[place] == ends).all() else None


@lru_cache(maxsize=2)
def coders(files: Vocabularies) -> Coders:
    return Coders(files)


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first d ends in merged order are from ``a``, for each diagonal d.

    Binary searches on all diagonals at once; of equal ends the one in ``a`` comes first.
    """
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        before = np.zeros(len(low), bool)
        i, d = middle[open_], diagonals[open_]
        before[open_] = a[i] <= b[d - 1 - i]
        low = np.where(open_ & before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)
    return low


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the ends that both have, in order.

    ``a`` and ``b`` are strictly increasing. Pieces are merged one by one, each within its own slices.
    """
    diagonals = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    i = crossings(a, b, diagonals)
    j = diagonals - i
    in_a, in_b = [], []
    for k in range(len(diagonals) - 1):
        mine, theirs = a[i[k] : i[k + 1]], b[j[k] : j[k + 1]]
        if k and i[k] and j[k] < len(b) and a[i[k] - 1] == b[j[k]]:  # the two sides of one end
            in_a.append(i[k : k + 1] - 1)
            in_b.append(j[k : k + 1])
        if len(mine) and len(theirs):
            place = np.searchsorted(theirs, mine)
            hit = np.flatnonzero(theirs[np.minimum(place, len(theirs) - 1)] == mine)
            in_a.append(i[k] + hit)
            in_b.append(j[k] + place[hit])
    none = np.zeros(0, np.int64)
    return (np.concatenate(in_a), np.concatenate(in_b)) if in_a else (none, none)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each stretch, one after another."""
    shift = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    return shift + np.arange(int(sizes.sum()))


def links(a_ids, b_ids, a_from, b_from, a_n, b_n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair code, times) for all links of groups given as stretches of the two id arrays.

    Small groups are written out; a large one is multiplied by distinct ids, so that a text without
    common ends costs memory by its vocabulary and not by its square.
    """
    small = np.flatnonzero(a_n * b_n <= _LARGE)
    sizes = a_n[small] * b_n[small]
    group = np.repeat(small, sizes)
    nth = _ragged(np.zeros(len(small), np.int64), sizes)
    i, j = a_from[group] + nth // b_n[group], b_from[group] + nth % b_n[group]
    parts = [(group, (a_ids[i] << PAIR_BITS) | b_ids[j], np.ones(len(group), np.int64))]
    for g in np.flatnonzero(a_n * b_n > _LARGE):
        xs, x_times = np.unique(a_ids[a_from[g] : a_from[g] + a_n[g]], return_counts=True)
        ys, y_times = np.unique(b_ids[b_from[g] : b_from[g] + b_n[g]], return_counts=True)
        codes = ((xs[:, None] << PAIR_BITS) | ys[None, :]).ravel()
        parts.append((np.full(len(codes), g), codes, (x_times[:, None] * y_times[None, :]).ravel()))
    return tuple(np.concatenate(column) for column in zip(*parts))


class Unit(NamedTuple):
    """What a unit adds to its text. ``codes`` are its distinct pairs, ``times`` how often each."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    digest: bytes
    codes: bytes
    times: bytes


def written(numbers: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in decimal, each with a byte after it (0: none): the bytes, and where each one ends."""
    width = len(str(int(numbers.max(initial=0))))
    table = np.zeros((len(numbers), width + 1), np.uint8)
    rest = numbers
    for k in range(width - 1, -1, -1):
        rest, digit = np.divmod(rest, 10)
        table[:, k] = np.where((digit > 0) | (rest > 0) | (k == width - 1), digit + 48, 0)
    table[:, width] = after
    return table[table > 0], np.cumsum((table > 0).sum(1))


def aligned(units: list[str], coder: Coders, piece: int = PIECE) -> list[Unit | None]:
    """The units aligned, None for those that do not come back whole. One merge serves them all."""
    found: list[Unit | None] = [None] * len(units)
    good, (a_ids, b_ids), (n_a, n_b) = coder.encode(units)
    if not len(good):
        return found
    cut_a, cut_b = common_ends(np.cumsum(coder.a_sizes[a_ids]), np.cumsum(coder.b_sizes[b_ids]), piece)
    # The end of a unit is an end in both, so no group reaches over it.
    size_a, size_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    from_a, from_b = cut_a + 1 - size_a, cut_b + 1 - size_b
    last_a = np.cumsum(n_a)
    owner = np.searchsorted(last_a, from_a, "right")
    group, code, times = links(a_ids, b_ids, from_a, from_b, size_a, size_b)
    unit = owner[group]
    order = np.lexsort((code, unit))
    unit, code, times = unit[order], code[order], times[order]
    first = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (code[1:] != code[:-1])))
    code, times, unit = code[first], np.add.reduceat(times, first), unit[first]
    # The text of the groups: A ids, then B ids of each, with what follows them.
    at_a, at_b = _ragged(from_a + from_b, size_a), _ragged(cut_a + 1 + from_b, size_b)
    numbers, after = np.empty(len(a_ids) + len(b_ids), np.int64), np.full(len(a_ids) + len(b_ids), ord(","), np.uint8)
    numbers[at_a], numbers[at_b] = a_ids, b_ids
    after[cut_a + from_b], after[cut_a + cut_b + 1] = ord("|"), ord(";")
    last = last_a + np.cumsum(n_b) - 1
    after[last] = 0
    text, reached = written(numbers, after)
    text, texts = text.tobytes(), [0, *reached[last].tolist()]
    n_links = np.bincount(owner, size_a * size_b, len(good)).astype(np.int64).tolist()
    groups = np.bincount(owner, minlength=len(good)).tolist()
    pairs = [0, *(8 * np.cumsum(np.bincount(unit, minlength=len(good)))).tolist()]
    codes, times = code.tobytes(), times.tobytes()
    for k, (u, x, y) in enumerate(zip(good.tolist(), n_a.tolist(), n_b.tolist())):
        p = slice(pairs[k], pairs[k + 1])
        found[u] = Unit(x, y, groups[k], n_links[k], text[texts[k] : texts[k + 1]], codes[p], times[p])
    return found


def units_of(text: str) -> Iterator[list[str]]:
    """The units of a text without their first spaces, a bounded slice of the text at a time (a unit
    may be longer)."""
    start = 0
    while start < len(text):
        end = start + _SLICE_CHARS
        while end < len(text):
            end = text.find(" ", end)
            if end < 0:
                break
            if not text[end - 1].isspace():
                break
            end += 1
        end = len(text) if end < 0 else min(end, len(text))
        part = text[start + (start > 0) : end]  # later slices begin with the space before a unit
        if _UNSURE.search(part):
            yield [unit[1:] for unit in _CUT.split(" " + part)]
        else:
            yield part.split(" ")
        start = end


class Memo:
    """Aligned units by their text, in two generations of bounded size."""

    def __init__(self, coder: Coders, size: int = MEMO_UNITS):
        self.coder, self.size, self.young, self.old = coder, size, {}, {}

    def look_up(self, units: list[str]) -> list[Unit | None]:
        missing = [u for u in units if u not in self.young and u not in self.old]
        made: dict[str, Unit | None] = {}
        for k in range(0, len(missing), _AT_ONCE):
            some = missing[k : k + _AT_ONCE]
            made.update(zip(some, aligned(some, self.coder)))
        found = [made[u] if u in made else self.young[u] if u in self.young else self.old[u] for u in units]
        for u, entry in zip(units, found):  # only now, as the generations move on
            if len(u) <= 64:
                self.young[u] = entry
                if len(self.young) > self.size:
                    self.young, self.old = {}, self.young
        return found


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(values: np.ndarray) -> bytes:
    return _PACK.compress(values.astype(np.int64).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(_UNPACK.decompress(data), np.int64)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCKS = (
    "block long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units binary, "
    "codes array<long>, docs array<long>, sizes binary, places binary, times binary"
)


def block_rows(number: int, ids: list, texts: list[str], memo: Memo) -> pa.RecordBatch:
    """A row per document, and on the first the block's pairs and its units' links.

    ``units`` numbers a document's units within the block, in ascending order as differences.
    ``codes`` are the block's distinct pairs and ``docs`` how many of its documents hold each;
    ``sizes``, ``places`` and ``times`` give each unit's links by places in ``codes``.
    """
    known: dict[str, int] = defaultdict(itertools.count().__next__)
    own = []
    for text in texts:
        parts = [np.array(list(map(known.__getitem__, part)), np.int32) for part in units_of(text)]
        own.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
    entries = memo.look_up(list(known))
    bad = np.array([e is None for e in entries], bool)
    own = [np.zeros(0, np.int32) if bad[units].any() else units for units in own]
    table = np.array([(0, 0, 0, 0) if e is None else e[:4] for e in entries], np.int64).reshape(-1, 4)
    digests = [b"" if e is None else e.digest for e in entries]
    code = np.frombuffer(b"".join(e.codes for e in entries if e), np.int64)
    times = np.frombuffer(b"".join(e.times for e in entries if e), np.int64)
    sizes = np.array([0 if e is None else len(e.codes) // 8 for e in entries], np.int64)
    codes, place = np.unique(code, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    held = np.zeros(len(codes), np.int64)
    distinct = [np.unique(units) for units in own]
    step = 256  # documents whose distinct pairs are counted at once
    for k in range(0, len(own), step):
        units = np.concatenate(distinct[k : k + step]).astype(np.int64)
        owner = np.repeat(np.arange(len(distinct[k : k + step])), [len(x) for x in distinct[k : k + step]])
        both = (np.repeat(owner, sizes[units]) << 40) | place[_ragged(starts[units], sizes[units])]
        held += np.bincount(np.unique(both) & ((1 << 40) - 1), minlength=len(codes))
    kept = held > 0  # pairs that only texts without tokens have are none
    moved = np.cumsum(kept) - 1
    sizes = sizes if kept.all() else np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept[place]], minlength=len(sizes))
    place, times = moved[place[kept[place]]], times[kept[place]]
    totals = np.array([table[units].sum(0) for units in own], np.int64).reshape(-1, 4)
    shas = [
        hashlib.sha256(b";".join(map(digests.__getitem__, units.tolist()))).hexdigest() if len(units) else ""
        for units in own
    ]
    rows = len(ids)
    only = lambda value, kind: pa.array([value] + [None] * (rows - 1), kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(rows, number)), pa.array(ids, pa.int64()), *[pa.array(totals[:, k]) for k in range(4)],
         pa.array(shas), pa.array([_packed(np.diff(np.sort(u), prepend=0)) for u in own], pa.binary()),
         only(codes[kept], pa.list_(pa.int64())), only(held[kept], pa.list_(pa.int64())),
         only(_packed(sizes), pa.binary()), only(_packed(place), pa.binary()), only(_packed(times), pa.binary())],
        names=[f.strip().split(" ")[0] for f in _BLOCKS.split(", ")],
    )


def block_tables(docs: DataFrame, files: Vocabularies, block_bytes: int) -> DataFrame:
    """The rows of :func:`block_rows` for ``docs(id, text)``. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, number = Memo(coders(files)), TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if size >= block_bytes:
                    yield block_rows(number, ids, texts, memo)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield block_rows(number, ids, texts, memo)

    return docs.mapInArrow(run, _BLOCKS)


_RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def block_sums(key: tuple, docs: pa.Table, priced: pa.Table) -> pa.Table:
    """The documents of one block with their sums over links, from the counts of its pairs."""
    place = priced["place"].to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = priced["count"].to_numpy(), priced["best"].to_numpy()
    at = int(np.flatnonzero(docs["sizes"].is_valid().to_numpy())[0])
    sizes, places, times = (_unpacked(docs[c][at].as_py()) for c in ("sizes", "places", "times"))
    sums, last = [], np.cumsum(sizes)
    for weight in (best, count):
        reached = np.append(0, np.cumsum(weight[places] * times))
        total = reached[last] - reached[last - sizes]
        units = (np.cumsum(_unpacked(x.as_py())) for x in docs["units"])
        sums.append([int(total[u].sum()) for u in units])
    return pa.table(
        {"id": docs["id"], **{c: docs[c] for c in _COUNTS}, "n_best": pa.array(sums[0], pa.int64()),
         "count_sum": pa.array(sums[1], pa.int64()), "groups_sha256": docs["groups_sha256"]}
    )


def alignments(docs: DataFrame, files: Vocabularies, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: id, tokens in A and B, groups, links, links whose pair is its A token's
    most frequent, the sum over links of the number of documents with the pair, and a digest of the
    groups."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tables = stage(block_tables(narrow, files, block_bytes), "aligned")
    pairs = tables.where("codes is not null").select(
        F.col("block").alias("owner"), F.posexplode(F.arrays_zip("codes", "docs")).alias("place", "pair")
    )
    pairs = pairs.select("owner", "place", F.col("pair.codes").alias("code"), F.col("pair.docs").alias("docs"))
    counted = stage(pairs.groupBy("code").agg(F.sum("docs").alias("count")), "pair-counts")
    a_id = F.shiftright("code", PAIR_BITS)
    highest = counted.groupBy(a_id.alias("a")).agg(F.max("count").alias("most"))
    # At most one row per entry of vocabulary A.
    judged = counted.join(F.broadcast(highest), a_id == F.col("a")).select(
        "code", "count", (F.col("count") == F.col("most")).cast("long").alias("best")
    )
    priced = pairs.drop("docs").join(judged, "code").select("owner", "place", "count", "best")
    own = tables.select("block", "id", *_COUNTS, "groups_sha256", "units", "sizes", "places", "times")
    return own.groupBy("block").cogroup(priced.groupBy("owner")).applyInArrow(block_sums, _RESULT)
