"""How far the sources of a language differ: a sparse merge of sorted term arrays per pair of sources.

Every source of a language gets sorted (term id, count) arrays. A pair task has the arrays of two
sources, finds their common terms by galloping through the longer array, and prices four kinds of
terms in both directions: those of both, of either one only, and of neither. Prices are integers and
all arithmetic is exact, so sums do not depend on how the work is cut.

No task holds a whole source. Terms are dealt into buckets by hash, each of a bounded number of
(source, term) rows, and a pair is priced bucket by bucket. Within a bucket, sources go to pair tasks
in blocks: a task has two blocks and merges each unordered pair of them, so an array is copied once
per block and not once per partner. A source with a third of all documents is as many small arrays as
there are buckets, like any other.

A term is a maximal run of ASCII letters and non-ASCII characters, with A-Z in lower case. Null
texts, languages and sources are read as empty ones; every row is a document of its own, repeated
ids included. Only the three named columns are read, so further columns do not matter. An empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglathe.sources.staging import stage

UNIT = 1_000_000_000  # prices are shares of this
LEAST_DOCUMENTS = 3  # a term in fewer documents of its language is not kept
TOP_TERMS = 200
BUCKET_ROWS = 1 << 18  # (source, term) rows of a bucket, on average
BLOCK_SOURCES = 64  # sources of a block, on average
_FLUSH_ENTRIES = 400_000
_SLICE_BYTES = 1 << 22
_RUN = 4096  # keys that one step of the galloping search places

_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def term_slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in slices of bounded size."""
    start = 0
    while len(text) - start > _SLICE_BYTES:
        piece = text[start : start + _SLICE_BYTES].translate(_LETTERS)
        cut = piece.rfind(b" ")
        if cut < 0:  # one term longer than a slice: take the text up to its end
            piece = text[start:].translate(_LETTERS)
            cut = piece.find(b" ")
            cut = len(piece) if cut < 0 else cut
        yield piece[:cut].split()
        start += max(cut, 1)
    yield text[start:].translate(_LETTERS).split()


def _as_strings(values: list[bytes]) -> pa.Array:
    options = pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True)
    return pc.cast(pa.array(values, pa.binary()), options=options)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences, and documents having the term.

    The term '' stands for a group itself: it occurs 0 times, in all documents of the group. Counts
    are made in the tasks that read the texts and again before the shuffle.
    """

    def flushed(groups: dict) -> pa.RecordBatch:
        langs, sources, terms, counts, having = [], [], [], [], []
        for (lang, source), (count, documents) in groups.items():
            langs += [lang] * len(documents)
            sources += [source] * len(documents)
            terms += documents
            counts += map(count.__getitem__, documents)
            having += documents.values()
        groups.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(sources, pa.string()), _as_strings(terms),
             pa.array(counts, pa.int64()), pa.array(having, pa.int64())],
            names=["lang", "source", "term", "count", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                if (lang, source) not in groups:
                    groups[lang, source] = Counter(), Counter()
                count, documents = groups[lang, source]
                before, own = len(documents), {b""}
                for terms in term_slices(text.as_py()):
                    count.update(terms)
                    own.update(terms)
                documents.update(own)
                entries += len(documents) - before
                if entries > _FLUSH_ENTRIES:
                    yield flushed(groups)
                    entries = 0
        if groups:
            yield flushed(groups)

    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = texts.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


_ARRAYS = (
    "lang string, source string, bucket int, n long, v long, ids array<int>, counts array<long>, "
    "totals array<long>, terms array<string>"
)


def sorted_arrays(key: tuple, rows: pa.Table) -> pa.Table:
    """One bucket of one language: the kept terms numbered in order, and each source's arrays of
    (id, count) with the terms and their occurrences in the whole language. ``v``, the number of
    kept terms, is in one row only, so that its sum over rows is right."""
    rows = rows.filter(pc.not_equal(rows["term"], ""))
    coded = rows["term"].combine_chunks().dictionary_encode()
    names = coded.dictionary.cast(pa.binary())
    code = coded.indices.to_numpy(zero_copy_only=False)
    count, docs = rows["count"].to_numpy(), rows["docs"].to_numpy()
    having, total = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    np.add.at(having, code, docs)
    np.add.at(total, code, count)
    order = pc.sort_indices(names).to_numpy()
    order = order[having[order] >= LEAST_DOCUMENTS]
    number = np.full(len(names), -1, np.int64)
    number[order] = np.arange(len(order))
    source = rows["source"].combine_chunks().dictionary_encode()
    owner = source.indices.to_numpy(zero_copy_only=False)
    places = np.flatnonzero(number[code] >= 0)
    places = places[np.lexsort((number[code[places]], owner[places]))]
    cuts = np.flatnonzero(np.diff(owner[places], prepend=-1)) if len(places) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(cuts, len(places)).astype(np.int32))
    held = code[places]
    sums = np.add.reduceat(count[places], cuts) if len(cuts) else np.zeros(0, np.int64)
    kept = np.zeros(len(cuts), np.int64)
    kept[:1] = len(order)
    listed = lambda values: pa.ListArray.from_arrays(offsets, values)
    return pa.table(
        {
            "lang": pa.array([key[0].as_py()] * len(cuts), pa.string()),
            "source": source.dictionary.take(pa.array(owner[places[cuts]])).cast(pa.string()),
            "bucket": pa.array(np.full(len(cuts), key[1].as_py(), np.int32)),
            "n": pa.array(sums), "v": pa.array(kept),
            "ids": listed(pa.array(number[held].astype(np.int32))),
            "counts": listed(pa.array(count[places])), "totals": listed(pa.array(total[held])),
            "terms": listed(coded.dictionary.take(pa.array(held)).cast(pa.string())),
        }
    )


def prices(count: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / whole), by long division: exact up to 9 * 10**15 occurrences."""
    rest, found = count + 1, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // whole
        rest = rest % whole
    return found + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q): below 2**63, as prices are at most UNIT + 1."""
    return (p - q) ** 2 // q


def gallop(few: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common keys of two sorted arrays without repeats.

    For each run of keys the reach in the longer array is doubled from where the run before ended
    until it covers the run; a binary search inside that reach places the keys.
    """
    mine, theirs, at = [], [], 0
    for start in range(0, len(few), _RUN):
        run, step = few[start : start + _RUN], len(few[start : start + _RUN])
        while at + step < len(many) and many[at + step] < run[-1]:
            step *= 2
        reach = many[at : at + step + 1]
        if not len(reach):
            break
        place = np.searchsorted(reach, run)
        hit = np.flatnonzero(reach[np.minimum(place, len(reach) - 1)] == run)
        mine.append(start + hit)
        theirs.append(at + place[hit])
        at += int(place[-1])
    none = np.zeros(0, np.int64)
    return (np.concatenate(mine), np.concatenate(theirs)) if mine else (none, none)


class _Side:
    """A source's part of a bucket, priced."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, whole: int):
        self.ids = ids
        self.p = prices(counts, whole)
        self.absent = prices(np.zeros(1, np.int64), whole)


def pair_sums(a: _Side, b: _Side) -> tuple[int, int, int]:
    """(value of a against b, of b against a) over the terms that either has, and their number."""
    i, j = gallop(a.ids, b.ids) if len(a.ids) <= len(b.ids) else gallop(b.ids, a.ids)[::-1]
    alone_a, alone_b = np.ones(len(a.ids), bool), np.ones(len(b.ids), bool)
    alone_a[i] = alone_b[j] = False
    left = np.concatenate([a.p[i], a.p[alone_a], np.broadcast_to(a.absent, alone_b.sum())])
    right = np.concatenate([b.p[j], np.broadcast_to(b.absent, alone_a.sum()), b.p[alone_b]])
    return int(differences(left, right).sum()), int(differences(right, left).sum()), len(left)


_PAIRS = "lang string, a string, b string, n_a long, n_b long, v long, ab long, ba long, either long"


def price_pairs(key: tuple, rows: pa.Table) -> pa.Table:
    """The unordered pairs of two blocks of sources in one bucket (of one block: each pair once)."""
    lang, _, low, high = (k.as_py() for k in key)
    sides: dict[str, tuple[int, int, int, _Side]] = {}
    empty = np.zeros(0, np.int64)
    for r in range(rows.num_rows):
        source, block, n, v = (rows[c][r].as_py() for c in ("source", "block", "n", "v"))
        ids, counts = rows["ids"][r], rows["counts"][r]
        if ids.is_valid:
            side = _Side(ids.values.to_numpy(), counts.values.to_numpy(), n + v)
        elif source in sides:
            continue
        else:
            side = _Side(empty, empty, n + v)
        sides[source] = block, n, v, side
    names = sorted(sides, key=str.encode)
    out: list[tuple] = []
    for first in names:
        for second in names:
            (x, n_a, v, a), (y, n_b, _, b) = sides[first], sides[second]
            wanted = first.encode() < second.encode() if low == high else (x, y) == (low, high)
            if wanted:
                out.append((lang, first, second, n_a, n_b, v, *pair_sums(a, b)))
    kinds = [pa.string()] * 3 + [pa.int64()] * 6
    columns = list(zip(*out)) if out else [()] * 9
    fields = [f.strip().split(" ")[0] for f in _PAIRS.split(",")]
    return pa.table({f: pa.array(c, k) for f, c, k in zip(fields, columns, kinds)})


def _best_terms(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                n, whole, v = (batch.column(c)[r].as_py() for c in ("n", "lang_n", "v"))
                counts, totals, terms = (batch.column(c)[r].values for c in ("counts", "totals", "terms"))
                p, q = prices(counts.to_numpy(), n + v), prices(totals.to_numpy(), whole + v)
                at = np.flatnonzero(p > q)
                value = differences(p[at], q[at])
                best = np.argsort(-value, kind="stable")[:top]  # terms are in order already
                size = len(best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("lang")[r].as_py()] * size, pa.string()),
                     pa.array([batch.column("source")[r].as_py()] * size, pa.string()),
                     terms.take(pa.array(at[best])), pa.array(value[best])],
                    names=["lang", "source", "item", "value"],
                )

    return run


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _whole(n: Column, v: Column) -> Column:
    """The price of a term that does not occur (1 where no term is kept)."""
    return F.lit(1) + F.when(n + v > 0, F.call_function("div", F.lit(UNIT), n + v)).otherwise(0)


def divergences(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, block_sources: int = BLOCK_SOURCES,
                top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs(lang, source, text)``.

    Part ``pair``: every other source of the language with the divergence from it. Part ``term``:
    the ``top`` terms that are likelier in the source than in the language. Ranks go by value, ties
    by item in UTF-8 order.
    """
    counted = stage(term_counts(docs), "terms")
    buckets = max(1, -(-counted.count() // bucket_rows))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    dealt = counted.where("term <> ''").withColumn("bucket", bucket)
    arrays = stage(dealt.groupBy("lang", "bucket").applyInArrow(sorted_arrays, _ARRAYS), "arrays")

    named = counted.where("term = ''").select("lang", "source")
    sums = arrays.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = arrays.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("v").alias("v"))
    zero = F.lit(0).cast("long")
    groups = stage(
        named.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
            "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "lang_n", "v")]
        ),
        "groups",
    )
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    blocks = max(1, -(-most // block_sources))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")

    # Every group shows up in every bucket, if only with its number of occurrences.
    numbered = groups.where("v > 0").withColumn("block", block)
    bare = numbered.select(
        "lang", "source", "block", "n", "v", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"),
        F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("array<long>").alias("counts"),
    )
    full = arrays.select("lang", "source", "bucket", "ids", "counts").join(numbered, ["lang", "source"])
    both = bare.unionByName(full.select(bare.columns))
    partner = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("partner")
    tasks = both.select("*", partner).select(
        "lang", "bucket", F.least("block", "partner").alias("low"), F.greatest("block", "partner").alias("high"),
        "source", "block", "n", "v", "ids", "counts",
    )
    priced = tasks.groupBy("lang", "bucket", "low", "high").applyInArrow(price_pairs, _PAIRS)
    summed = priced.groupBy("lang", "a", "b", "n_a", "n_b", "v").agg(
        *[F.sum(c).alias(c) for c in ("ab", "ba", "either")]
    )
    p, q = _whole(F.col("n_a"), F.col("v")), _whole(F.col("n_b"), F.col("v"))
    neither = F.col("v") - F.col("either")
    square = (p - q) * (p - q)
    valued = summed.select(
        "lang", "a", "b",
        (F.col("ab") + neither * F.call_function("div", square, q)).alias("ab"),
        (F.col("ba") + neither * F.call_function("div", square, p)).alias("ba"),
    )
    way = lambda s, i, x: F.struct(F.col(s).alias("source"), F.col(i).alias("item"), F.col(x).alias("value"))
    ways = valued.select("lang", F.inline(F.array(way("a", "b", "ab"), way("b", "a", "ba"))))
    # A language without a kept term has pairs of value 0.
    bald = groups.where("v = 0").select("lang", "source")
    other = bald.select("lang", F.col("source").alias("item"))
    nothing = bald.join(other, "lang").where("source <> item").select("lang", "source", "item", zero.alias("value"))
    terms = (
        arrays.drop("n", "v", "ids", "bucket").join(groups, ["lang", "source"])
        .mapInArrow(_best_terms(top), "lang string, source string, item string, value long")
    )
    return _ranked(ways.unionByName(nothing), "pair").unionByName(_ranked(terms, "term").where(F.col("rank") <= top))
