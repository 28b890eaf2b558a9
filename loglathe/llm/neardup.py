"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A signature has ``chunks`` chunks of ``symbols`` b-bit minimum hashes. Two signatures that differ in
fewer than ``chunks * (errors + 1)`` symbols have, by the pigeonhole principle, a chunk with at most
``errors`` differing symbols. So each chunk gives one key for every choice of symbols that may
differ, made of the others; such pairs share a key for certain. Pairs that share a key are
candidates, and exact shingle sets decide.

No bucket is ever expanded into all its pairs:

1. Documents with equal shingle sets are one representative from the start.
2. Every bucket's smallest id is its pivot; a member is checked against the pivot that it shares
   most buckets with.
3. What a bucket still holds in several components is compared by signatures inside bounded blocks,
   a longer signature for pairs that the first one lets through. First each member's ``best``
   partners in other components are checked on sets. Then the members of pairs that still lie in
   different components and agree enough meet once more with their sets, in the first bucket that a
   pair shares; there all such pairs are decided, and only links that join components come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglathe.llm.components import components
from loglathe.llm.words import mix, shingle_sets, words
from loglathe.sources.staging import small_batches, stage


@dataclass(frozen=True)
class NearDup:
    """Shingle width, similarity as a fraction, and the shape of signatures.

    ``agree`` and ``agree_long``: the fewest equal symbols, of the signature and of a longer one of
    one-byte symbols, for which step 3 checks sets. At a similarity of 0.75 a pair has 45 of 60 on
    average with a deviation of 3.4, and 180 of 240 with one of 6.7: 27 and 145 lie over five
    deviations below.
    """

    width: int = 5
    numerator: int = 75
    denominator: int = 100
    chunks: int = 12
    symbols: int = 5
    errors: int = 1
    bits: int = 16
    agree: int = 27
    long: int = 240
    agree_long: int = 145
    best: int = 3
    block: int = 1024
    block_grams: int = 1 << 20
    pivot_rows: int = 512
    batch_rows: int = 1024  # whole texts or sets that a task exchanges with its Python worker at a time

    @property
    def size(self) -> int:
        return self.chunks * self.symbols

    def kept(self) -> np.ndarray:
        """For each key, the places of its symbols in a signature."""
        inside = list(combinations(range(self.symbols), self.symbols - self.errors))
        return np.array([[c * self.symbols + i for i in s] for c in range(self.chunks) for s in inside])

    def first_key(self, equal: np.ndarray) -> np.ndarray:
        """The number of the first key that two signatures share, by where they are equal."""
        parts = equal.reshape(len(equal), self.chunks, self.symbols)
        chunk = (parts.sum(2) >= self.symbols - self.errors).argmax(1)
        inside = parts[np.arange(len(equal)), chunk]
        choices = self.kept()[: self.keys_per_chunk]
        return chunk * len(choices) + inside[:, choices].all(2).argmax(1)

    @property
    def keys_per_chunk(self) -> int:
        return comb(self.symbols, self.errors)


def _salts(n: int, seed: int = 75) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def sketches(docs: DataFrame, rule: NearDup, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, h1, h2, signature): set size, a 128-bit name of the set, b-bit minima (empty for none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, shift = _salts(rule.size)
        for batch in batches:
            n, h1, h2, signatures = [], [], [], []
            for _, _, found in words(batch.column(1)):
                for row in shingle_sets(found, rule.width):
                    n.append(len(row))
                    h1.append(int(np.add.reduce(mix(row)).astype(np.int64)))
                    h2.append(int(np.bitwise_xor.reduce(mix(row + np.uint64(77)), initial=np.uint64(0)).astype(np.int64)))
                    signatures.append(_signature(row, factor, shift, rule.bits) if len(row) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(signatures, pa.binary())],
                names=["id", "n", "h1", "h2", "signature"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "id long, n long, h1 long, h2 long, signature binary"
    )


def _signature(row: np.ndarray, factor: np.ndarray, shift: np.ndarray, bits: int) -> bytes:
    least = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(row), 2048):
        part = row[i : i + 2048, None] * factor + shift
        np.minimum(least, part.min(0), out=least)
    return (mix(least) >> np.uint64(64 - bits)).astype(np.uint32).tobytes()


def index_keys(signatures: DataFrame, rule: NearDup) -> DataFrame:
    """(key, number, id): the keys of every non-empty signature, and which of its keys each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = rule.kept()
        for batch in batches:
            table = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, rule.size)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(ids), 2000):
                part = table[i : i + 2000].astype(np.uint64)
                keys = np.tile(mix(np.arange(1, len(kept) + 1, dtype=np.uint64)), (len(part), 1))
                for k in range(kept.shape[1]):
                    keys = mix(keys ^ (part[:, kept[:, k]] + np.uint64(k << 40)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.ravel().view(np.int64)),
                        pa.array(np.tile(np.arange(len(kept), dtype=np.int16), len(part))),
                        pa.array(np.repeat(ids[i : i + 2000], len(kept))),
                    ],
                    names=["key", "number", "id"],
                )

    return signatures.select("id", "signature").mapInArrow(run, "key long, number short, id long")


def _sets(docs: DataFrame, ids: DataFrame, rule: NearDup, id_col: str, text_col: str) -> DataFrame:
    """(id, n, grams, signature): whole sorted shingle sets, and long signatures, of the documents
    named by ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, shift = _salts(rule.long, 7)
        for batch in batches:
            at = 0
            for _, end, found in words(batch.column(1)):
                rows = list(shingle_sets(found, rule.width))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary()),
                     pa.array([_signature(r, factor, shift, 8)[::4] if len(r) else b"" for r in rows], pa.binary())],
                    names=["id", "n", "grams", "signature"],
                )
                at = end

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(ids, "id", "left_semi").mapInArrow(run, "id long, n long, grams binary, signature binary")
    return found


def _verified(pairs: DataFrame, sets: DataFrame, rule: NearDup) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Sets of an id with many pairs are
    copied once per ``pivot_rows`` of them, so that no task joins all pairs of one id."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / rule.pivot_rows).cast("int").alias("copies"))
    right = (
        sets.join(many, F.col("id") == F.col("b"))
        .select("b", F.col("n").alias("m"), F.col("grams").alias("others"), "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
        .drop("copies")
    )
    left = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("salt"))
    left = left.join(sets.select(F.col("id").alias("a"), "n", "grams"), "a")
    close = left.join(right, ["b", "salt"]).where(
        (rule.denominator * F.least("n", "m") >= rule.numerator * F.greatest("n", "m"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([p, q]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(rule.denominator * common >= rule.numerator * (len(p) + len(q) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return close.select("a", "b", "grams", "others").mapInArrow(run, "a long, b long")


def _cells(buckets: DataFrame, labels: DataFrame, signatures: DataFrame, rule: NearDup) -> DataFrame:
    """(key, i, j, number, id, component, own): the buckets that hold several components, as pairs of
    blocks of bounded rows and bounded shingles; ``own`` is the block of the row itself."""
    rows = buckets.select("key", "number", "id").join(labels, "id", "left").join(signatures.select("id", "n"), "id")
    rows = rows.withColumn("component", F.coalesce("component", "id"))
    mixed = rows.groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("rows"), F.sum("n").alias("grams")
    )
    blocks = F.greatest(F.ceil(F.col("rows") / rule.block), F.ceil(F.col("grams") / rule.block_grams))
    rows = rows.join(mixed.where("x != y").select("key", blocks.cast("int").alias("blocks")), "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "number", "id", "component", "own")


def _outside(table: pa.Table, i: int, j: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a cell that is not in its largest component, and where its rows of other components
    are. Of two components one is not the largest, so these meet every pair."""
    component, own = table.column("component").to_numpy(), table.column("own").to_numpy()
    names, sizes = np.unique(component, return_counts=True)
    for k in np.flatnonzero(component != names[sizes.argmax()]):
        yield k, (own == (j if own[k] == i else i)) & (component != component[k])


def _agreeing(cells: DataFrame, signatures: DataFrame, sets: DataFrame, rule: NearDup, best: bool) -> DataFrame:
    """With ``best`` pairs (a, b): of each row of a cell the partners in other components that agree
    most. Else the rows of a cell with any such partner, where a pair counts in its first bucket only."""
    rows = cells.join(signatures.select("id", "n", "signature"), "id")
    rows = rows.join(sets.select("id", F.col("signature").alias("long")), "id")
    keep = ["key", "i", "j", "id", "component", "own"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        number = table.column("number")[0].as_py()
        view = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(len(ids), -1)
        marks, longer = view("signature", np.uint32), view("long", np.uint8)
        a, b, some = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(ids), bool)
        for k, near in _outside(table, key[1].as_py(), key[2].as_py()):
            at = np.flatnonzero(near & (rule.denominator * np.minimum(n, n[k]) >= rule.numerator * np.maximum(n, n[k])))
            equal = marks[at] == marks[k]
            close = equal.sum(1) >= rule.agree
            if not best:
                close[close] = rule.first_key(equal[close]) == number
            at = at[close]
            agree = (longer[at] == longer[k]).sum(1)
            at, agree = at[agree >= rule.agree_long], agree[agree >= rule.agree_long]
            if best:
                at = at[np.argsort(-agree, kind="stable")][: rule.best]
                a.append(np.maximum(ids[at], ids[k]))
                b.append(np.minimum(ids[at], ids[k]))
            elif len(at):
                some[at] = some[k] = True
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)}) if best else table.filter(pa.array(some)).select(keep)

    schema = "a long, b long" if best else "key long, i int, j int, id long, component long, own int"
    return rows.groupBy("key", "i", "j").applyInArrow(run, schema)


def _joining(cells: DataFrame, sets: DataFrame, rule: NearDup) -> DataFrame:
    """Links (a, b) that connect all components of each cell that similar sets connect: every pair of
    rows in different components is decided on whole sets, and a link that joins no more is left out."""
    rows = cells.join(sets.select("id", "n", "grams"), "id")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, n, component = (table.column(c).to_numpy() for c in ("id", "n", "component"))
        grams = np.frombuffer(b"".join(table.column("grams").to_pylist()), np.uint64)
        distinct, place = np.unique(grams, return_inverse=True)
        ends = np.cumsum(n)
        starts, has, group = ends - n, np.zeros(len(distinct), bool), component.copy()
        a, b = [], []
        for k, near in _outside(table, key[1].as_py(), key[2].as_py()):
            own = place[starts[k] : ends[k]]
            has[own] = True
            common = np.add.reduceat(has[place], starts, dtype=np.int64)
            has[own] = False
            for m in np.flatnonzero(near & (rule.denominator * common >= rule.numerator * (n + n[k] - common))):
                if group[m] != group[k]:
                    group[group == group[m]] = group[k]
                    a.append(max(ids[m], ids[k]))
                    b.append(min(ids[m], ids[k]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, rule: NearDup = NearDup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component): the component of a document under links of similar shingle sets.

    ``component`` is the smallest id reachable. Texts without words, nulls included, have no
    shingles and no links. A null id is never linked and is its own (null) component. Rows that
    repeat an id come out once per row, in the component that any of them reaches. An empty table
    gives an empty result; other columns of ``docs`` play no part.
    """
    with small_batches(docs.sparkSession, rule.batch_rows):  # every Python step runs in here, none in the result
        return _components_of(docs, rule, id_col, text_col)


def _components_of(docs: DataFrame, rule: NearDup, id_col: str, text_col: str) -> DataFrame:
    known = stage(sketches(docs, rule, id_col, text_col), "sketches")
    full = known.where("n > 0 and id is not null")
    classes = full.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"))
    member = stage(full.join(classes, ["h1", "h2", "n"]).select("id", "rep"), "classes")
    reps = member.where("id = rep").select("id").distinct()
    signatures = stage(full.join(reps, "id", "left_semi").dropDuplicates(["id", "h1", "h2"]), "signatures")

    keys = index_keys(signatures, rule)
    pivots = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).where("pivot != top")
    buckets = stage(keys.join(pivots.drop("top"), "key"), "buckets")
    met = buckets.where("id != pivot").groupBy(F.col("id").alias("a"), F.col("pivot").alias("b")).count()
    sets = stage(_sets(docs, buckets.select("id").distinct(), rule, id_col, text_col), "sets")

    tried = stage(met.groupBy("a").agg(F.max_by("b", F.struct("count", -F.col("b"))).alias("b")), "tried")
    copies = member.where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = stage(_verified(tried, sets, rule), "links")
    labels = stage(components(links, "a", "b"), "labels")
    close = _agreeing(_cells(buckets, labels, signatures, rule), signatures, sets, rule, best=True).distinct()
    close = stage(close.join(tried, ["a", "b"], "left_anti"), "close")
    links = links.unionByName(stage(_verified(close, sets, rule), "links"))
    labels = stage(components(links, "a", "b"), "labels")
    cells = stage(_agreeing(_cells(buckets, labels, signatures, rule), signatures, sets, rule, best=False), "cells")
    links = links.unionByName(stage(_joining(cells, sets, rule), "links"))
    final = components(links.unionByName(copies), "a", "b")
    return (
        known.select("id", F.col("n").alias("n_shingles"))
        .join(final, "id", "left")
        .select("id", "n_shingles", F.coalesce("component", "id").alias("component"))
    )
