"""Source divergence against a brute force with Python integers, and the galloping search."""

import re
from collections import Counter

import numpy as np
import pytest

from loglathe.llm import divergence
from loglathe.llm.divergence import divergences, gallop, prices, sorted_arrays, term_slices

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute_force(rows, top):
    docs = [(lang or "", source or "", text or "") for _, text, lang, source in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    having, counts = Counter(), Counter()
    for lang, source, text in docs:
        terms = [t.translate(lower) for t in TERM.findall(text)]
        counts.update((lang, source, t) for t in terms)
        having.update((lang, t) for t in set(terms))
    out = set()
    for lang in {d[0] for d in docs}:
        kept = sorted(t for (x, t), n in having.items() if x == lang and n >= 3)
        sources = sorted({d[1] for d in docs if d[0] == lang})

        def price(count, lang_kept=kept):
            whole = sum(count.values()) + len(lang_kept)
            return {t: 1 + 10**9 * (count[t] + 1) // whole for t in lang_kept}

        own = {s: Counter({t: counts[lang, s, t] for t in kept}) for s in sources}
        q = price(sum(own.values(), Counter()))
        p = {s: price(own[s]) for s in sources}
        for s in sources:
            pairs = [(i, sum((p[s][t] - p[i][t]) ** 2 // p[i][t] for t in kept)) for i in sources if i != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(ranked) if part == "pair" or k < top}
    return out


def rows():
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)] + ["É", "straße", "日本", "Ab"]
    made = []
    for k in range(160):
        lang, source = ("en", "de", "")[k % 3], f"s{min(k % 11, 6)}"
        weights = np.arange(1, len(words) + 1) ** -0.8
        text = " ".join(rng.choice(words, rng.integers(0, 60), p=weights / weights.sum()))
        made.append((k, text, lang, source))
    made += [
        (1000, None, None, None), (1001, "", "en", "empty"), (1001, "wa1wa wa", "en", "empty"), (1002, None, "en", None),
        (1003, "only here", "fr", "a"), (1004, "nothing kept", "fr", "b"), (None, "wa wb wa", "en", "s1"),
        (7, "WA aB x_y", "en", "s1"), (7, "WA aB x_y", "en", "s1"), (1005, "solo", "it", "one"),
    ]
    return made


def as_set(frame):
    found = frame.collect()
    result = {(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in found}
    assert len(result) == len(found)
    return result


@pytest.mark.parametrize("bucket_rows, block_sources", [(1 << 18, 64), (40, 2), (7, 1)])
def test_equals_brute_force_however_the_work_is_cut(spark, bucket_rows, block_sources):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    assert as_set(divergences(docs, bucket_rows, block_sources, top=9)) == brute_force(rows(), 9)


def test_hot_source_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "_FLUSH_ENTRIES", 20)
    hot = [(i, f"t{'abcdefgh'[i % 8]} common", "en", "hot" if i % 3 else f"s{i % 4}") for i in range(120)]
    assert as_set(divergences(spark.createDataFrame(hot, SCHEMA), 16, 2)) == brute_force(hot, 200)


def test_empty_table_and_further_columns(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert divergences(nothing).count() == 0
    clashing = "doc_id long, text string, lang string, source string, term string, bucket int, n long, v long, ids string"
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows()], clashing)
    assert as_set(divergences(docs)) == brute_force(rows(), 200)


def test_long_texts_are_read_in_slices(monkeypatch):
    text = ("word " * 40 + "x" * 300 + " Été." * 30).encode()
    whole = [t for part in term_slices(text) for t in part]
    monkeypatch.setattr(divergence, "_SLICE_BYTES", 64)
    sliced = list(term_slices(text))
    assert len(sliced) > 3 and [t for part in sliced for t in part] == whole == text.lower().replace(b".", b"").split()


def test_galloping_finds_the_common_keys(monkeypatch):
    rng = np.random.default_rng(3)
    for run in (1, 3, 4096):
        monkeypatch.setattr(divergence, "_RUN", run)
        for _ in range(60):
            a = np.unique(rng.integers(0, 400, rng.integers(0, 30)))
            b = np.unique(rng.integers(0, 400, rng.integers(0, 300)))
            i, j = gallop(a, b)
            assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()


def test_prices_are_exact_for_large_counts():
    count = np.array([0, 1, 10**9, 3 * 10**12, 10**15 - 1])
    for whole in (1 + 10**15, 7 * 10**15 + 3):
        assert prices(count, whole).tolist() == [1 + 10**9 * (c + 1) // whole for c in count.tolist()]


def test_a_task_without_kept_terms_gives_no_row():
    import pyarrow as pa

    bare = pa.table({"lang": ["x"], "source": ["s"], "term": ["t"], "count": [1], "docs": [1], "bucket": pa.array([0], pa.int32())})
    assert sorted_arrays((pa.scalar("x"), pa.scalar(0)), bare).num_rows == 0
