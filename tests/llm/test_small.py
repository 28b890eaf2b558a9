"""The operators on small fixtures against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from loglathe.llm import bpe, components, html, mixing, neardup, neighbours, packing, quality, repeats, toxicity, winnow
from loglathe.llm.words import shingle_sets, words

VOCABULARY = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnopq"]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in text.split())


def near_rows():
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = sentence(rng, 60 + 10 * g)
        rows += [base, base, *(edited(rng, base, s) for s in (0.01, 0.02, 0.03, 0.05, 0.08))]
    chain = sentence(rng, 120)
    for _ in range(25):  # each like the one before, the ends unlike
        rows.append(chain)
        chain = edited(rng, chain, 0.02)
    shared = sentence(rng, 30)
    rows += [f"{sentence(rng, 90)} {shared}" for _ in range(30)]
    rows += [None, "", "  \n", "one two", "One  TWO", "x" * 5000, sentence(rng, 4000)]
    return list(enumerate(rows))


def near_truth(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets[i] = grams
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((top(a), top(b)))
            parent[q] = p
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_near_duplicates(docs):
    rows = near_rows()
    rule = neardup.NearDup(block=8, pivot_rows=4)
    got = {r.id: (r.n_shingles, r.component) for r in neardup.near_duplicates(docs(*rows), rule).collect()}
    assert got == near_truth(rows)


def test_near_duplicates_exchange_small_batches(docs, spark, monkeypatch):
    """Each Python step of the job gets few rows at a time; the session's setting is as before."""
    name, seen, staged = "spark.sql.execution.arrow.maxRecordsPerBatch", [], neardup.stage
    monkeypatch.setattr(neardup, "stage", lambda *a: seen.append(int(spark.conf.get(name))) or staged(*a))
    rng, before = random.Random(12), spark.conf.get(name)
    rows = [(i, sentence(rng, 12)) for i in range(40)]
    rows += [(i + 40, t) for i, t in rows]
    found = neardup.near_duplicates(docs(*rows), neardup.NearDup(batch_rows=7))
    assert seen and set(seen) == {7} and spark.conf.get(name) == before
    assert {r.id: r.component for r in found.collect()} == {i: i % 40 for i in range(80)}
    assert neardup.NearDup().batch_rows <= 1024


def test_near_duplicates_odd_rows(docs, spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, None)]
    got = sorted((str(r.id), r.n_shingles, str(r.component)) for r in neardup.near_duplicates(docs(*rows)).collect())
    assert got == [("3", 2, "3"), ("3", 2, "3"), ("5", 0, "5"), ("None", 2, "None")]
    assert neardup.near_duplicates(docs(*rows).limit(0)).count() == 0


def test_every_pair_below_the_distance_shares_a_key():
    rule, rng = neardup.NearDup(), np.random.default_rng(1)
    most = rule.chunks * (rule.errors + 1) - 1
    for _ in range(200):
        equal = np.ones(rule.size, bool)
        equal[rng.choice(rule.size, most, replace=False)] = False
        assert equal[rule.kept()].all(1).any()
        assert rule.first_key(equal[None])[0] == np.flatnonzero(equal[rule.kept()].all(1))[0]


def test_shingles_of_columns_with_nulls():
    found = [s for _, _, f in words(pa.array([None, "a b c d e f", "", "A b"]), 4) for s in shingle_sets(f, 5)]
    assert [len(s) for s in found] == [0, 2, 0, 1]


@pytest.fixture(scope="module")
def ranks():
    rng = random.Random(2)
    table = {bytes([b]): b for b in range(256)}
    pool = [bytes([b]) for b in b"abcd "]
    while len(table) < 330:
        new = rng.choice(pool) + rng.choice(pool)
        if new not in table and len(new) < 9:
            table[new] = len(table)
            pool.append(new)
    return table


@pytest.mark.parametrize("text", ["", "a", "abcd" * 40, "a" * 700, "ab cd  dcba\n" * 30, "é日 x" * 9])
def test_bpe_like_plain_merging(ranks, text):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"\S+|\s+"
    own, other = bpe.ByteBpe(ranks, pattern), tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    ids = np.frombuffer(b"".join(own.encode(text)), "<u4")
    assert ids.tolist() == other.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_bpe_random_texts(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    own, other = bpe.ByteBpe(ranks, r"\S+|\s+"), tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("abcd ") for _ in range(rng.choice([3, 40, 400])))
        assert np.frombuffer(b"".join(own.encode(text)), "<u4").tolist() == other.encode_ordinary(text)


def brute_winnow(text, rule):
    """Positions by the definition, from the grams' own hashes."""
    gram = min(rule.gram, len(text))
    h = [int(winnow.winnow(text[i : i + gram], rule).hashes[0]) for i in range(len(text) - gram + 1)]
    w = min(rule.window, len(h))
    return sorted({max(i for i in range(a, a + w) if h[i] == min(h[a : a + w])) for a in range(len(h) - w + 1)})


@pytest.mark.parametrize("text", ["", "x", "short", "ab" * 60, "the quick brown fox jumps over the lazy dog, again and again; " * 3])
def test_winnowing(text):
    rule = winnow.Winnow(gram=8, window=6)
    found = winnow.winnow(text, rule)
    assert found.positions.tolist() == (brute_winnow(text, rule) if text else [])
    again = winnow.Fingerprint.of_text(found.text())
    assert again.hashes.tolist() == found.hashes.tolist() and again.positions.tolist() == found.positions.tolist()


def test_winnowing_guarantee():
    rule, rng = winnow.Winnow(), random.Random(5)
    for _ in range(30):
        shared = sentence(rng, 40)[: rule.guarantee()]
        a, b = (winnow.winnow(sentence(rng, 20) + shared + sentence(rng, 20), rule) for _ in "ab")
        assert set(a.hashes.tolist()) & set(b.hashes.tolist())


@pytest.mark.parametrize("rows", [[], [(1, "abc")], [(None, "x"), (None, None)], [(i, "text %d " % i * (i % 7)) for i in range(60)] + [(5, "twice"), (None, "n"), (8, None)]])
def test_edited_texts(docs, rows):
    frame = docs(*rows) if rows else docs((1, "a")).limit(0)
    got = winnow.edited_fingerprints(frame).collect()
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        changed = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        marks = [winnow.winnow(x) for x in (t, changed, after)]
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), marks[0].text(), marks[1].text(), marks[0].likeness(marks[1]), marks[0].likeness(marks[2])))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_packing_uses_every_piece_once():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 500, 20_000):
        lengths = np.clip(rng.lognormal(3.5, 1, n).astype(int), 1, 256)
        counts = np.bincount(lengths, minlength=257)
        patterns = packing.solve(counts)
        assert all(sum(p) <= 256 for p, _ in patterns)
        used = np.zeros(257, int)
        for p, times in patterns:
            for x in p:
                used[x] += times
        assert (used == counts).all()
        assert sum(t for _, t in patterns) <= -(-lengths.sum() // 256) * 1.02 + 1


def test_exact_complements():
    counts = np.zeros(101, int)
    counts[[60, 25, 10, 5, 99]] = [2, 1, 1, 1, 1]
    assert packing.complement(counts, 40, {}) == (25, 10, 5)
    assert packing.complement(counts, 35, {}) == (25, 10)
    assert packing.complement(counts, 41, {}) is None


def test_cut_pieces():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(20, 10) == [(0, 10), (10, 10)] and packing.cut(23, 10) == [(0, 3), (3, 10), (13, 10)]


def test_suffixes_find_every_repeat(docs):
    rng, fresh = random.Random(6), itertools.count()
    own = lambda n: " ".join(f"own{next(fresh)}" for _ in range(n))
    passage, other = sentence(rng, 60), sentence(rng, 50)
    rows = [(i, f"{own(30)} {p} {own(25)}") for i, p in enumerate([passage] * 5 + [other] * 3 + [" ".join(other.split()[:40])])]
    rows += [(20, None), (21, ""), (22, "again " * 400), (23, rows[0][1]), (23, rows[0][1])]
    rule = repeats.Repeats()
    first, texts, seen = {}, {}, {}
    for i, t in rows:
        w = (t or "").split()
        texts[i], seen[i] = w, [False] * len(w)
        for k in range(len(w) - rule.length + 1):
            first.setdefault(tuple(w[k : k + rule.length]), (i, k))
    for i, w in texts.items():
        for k in range(len(w) - rule.length + 1):
            a, b = first[tuple(w[k : k + rule.length])]
            if (a, b) != (i, k) and (a != i or k - b >= rule.length):
                seen[i][k : k + rule.length] = [True] * rule.length
    got = {i: [False] * len(w) for i, w in texts.items()}
    for r in repeats.repeated_spans(docs(*rows), rule).collect():
        assert texts[r.id][r.start : r.end] == texts[r.source_id][r.source_start : r.source_start + r.end - r.start]
        got[r.id][r.start : r.end] = [True] * (r.end - r.start)
    assert got == seen


def test_cutting_words():
    assert repeats.cut("a b  c\nd é", [(1, 3)]) == "a \nd é" and repeats.cut("a b", [(0, 2)]) == "" and repeats.cut("", []) == ""


def test_repeats_in_an_empty_table(docs):
    empty = docs((1, "a")).limit(0)
    assert repeats.without_spans(empty, repeats.repeated_spans(empty)).count() == 0


def test_neighbours_against_all(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(900, 16))
    vectors[300:330] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [1.0, None] + [0.0] * 14), (1200, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    rule = neighbours.Collide(block=200, queries=7)
    found = {}
    from pyspark.sql import functions as F

    for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0, 5, rule).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 900, 50):
        cosine = unit @ unit[q]
        cosine[q] = -9
        best = set(np.lexsort((np.arange(900), -cosine.round(12)))[:5].tolist())
        rows = sorted(found.pop(q))
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        assert all(abs(s - cosine[v]) < 1e-12 for _, v, s in rows)
        hits += len(best & {v for _, v, _ in rows})
        total += 5
    assert not found and hits / total >= 0.9


@pytest.mark.parametrize("dims", [3, 64, 100, 384])
def test_equal_vectors_go_by_id(spark, dims):
    """200 equal vectors over several blocks: the five smallest other ids, with one and the same score."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(dims)
    same = rng.normal(size=dims)
    vectors = rng.normal(size=(300, dims))
    vectors[50:250] = same * np.exp2(rng.integers(-3, 3, 200))[:, None]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0, 5, neighbours.Collide(block=64)).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (50, 100, 150, 200):
        got = sorted(found[q])
        assert [v for _, v, _ in got] == [i for i in range(50, 57) if i != q][:5]
        assert len({s for *_, s in got}) == 1


def test_huge_and_tiny_vectors(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1e200, 2e200]), (1, [1e-200, 2e-200]), (2, [3e-320, 6e-320]), (3, [1.7e308, -1.7e308]), (4, [2.0, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in neighbours.nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [g[1] for g in got[:2]] == [1, 4] or [g[1] for g in got[:3]] == [1, 2, 4]
    assert all(abs(s - 1) < 1e-3 for _, _, s in got[:3]) and got[3][1] == 3 and abs(got[3][2] + 1 / np.sqrt(10)) < 1e-12


def test_neighbours_of_few(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0).collect()]
    assert got == [(0, 1, 1, 0.0)]
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


TEXT = "This is the text of the page and it is long enough to be told from what is around it by the words that are in it, one by one."


def test_html_blocks():
    page = f"""<html><head><title>No</title><style>p{{}}</style><script>var a = "</p><p>{TEXT}";</script></head><body>
    <nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice"><p>{TEXT}</p></div>
    <article><h1>Head</h1><p>{TEXT} A&amp;B&nbsp;&copy;<br>Next <b>bold</b>er</p><p>Short.<!-- {TEXT} --><p>Also
    short<div class="ad">{TEXT}</div><form><p>{TEXT}</p></form></article>
    <section id=comments><p>{TEXT}</p></section><aside>{TEXT}</aside><footer>{TEXT}</footer></body>"""
    assert html.main_text(page) == f"Head\n{TEXT} A&B ©Next bolder\nShort.\nAlso short".replace("©Next", "© Next")


@pytest.mark.parametrize("page, text", [("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<article><p>x", "x"), ("<!-- x", ""), ("<script>x", ""), ("<p>a<b", "a")])
def test_html_odd_pages(page, text):
    assert html.main_text(page) == text


LONG = f"{TEXT} {TEXT}"


@pytest.mark.parametrize(
    "names",
    ['class="content has-sidebar"', 'class="post no-comments"', 'id="search-engine-history"', 'class="post-2 tag-ads comment-count"'],
)
def test_names_do_not_decide_on_most_of_a_page(names):
    page = f"<body><div class='ad'>{TEXT}</div><div {names}><h1>T</h1><p>{LONG}<p>{LONG}</div><div class=comments><p>{LONG}</div>"
    assert html.main_text(page) == f"T\n{LONG}\n{LONG}"


def test_elements_end_where_they_should():
    page = f'<article><p>{LONG} <span class="ad"><span>A</span> BUY NOW</span> {LONG}</article>'
    assert html.main_text(page) == f"{LONG}\n{LONG}"
    assert html.main_text(f'<p title="x>{LONG}<p>{LONG}') == f"{LONG}\n{LONG}"
    assert html.main_text(f"<p><b>{LONG}<p><i>{LONG}</b></p>") == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("page", ["<div>" * 10**5 + "</section>" * 10**5, "<section><article>" + "<div>" * 10**5 + "</section></b>" * 10**5])
def test_deep_pages_take_linear_time(page):
    import time

    start = time.process_time()
    assert html.main_text(page + LONG) == LONG
    assert time.process_time() - start < 20


def test_the_two_passes_decide_without_telling_names():
    """Only ``div`` without names: what is text is told by length, links, frequent words and neighbours."""
    menu = "".join(f"<div><a href=/{k}>Entry number {k} of the menu</a></div>" for k in range(6))
    page = f"<div>Site of things</div>{menu}<div>{LONG}</div><div>Short note.</div><div>{LONG}</div><div>Call 555 0100 now</div>{menu}<div>Imprint</div>"
    made = html.judge(html.blocks(page))
    assert [b.text for b in made if b.label == "good"][:3] == [LONG, "Short note.", LONG]
    assert all(b.label == "bad" for b in made if "menu" in b.text) and made[0].label == made[-1].label == "bad"
    odd = "xq zrt " * 30  # long, but without a frequent word
    assert html.main_text(f"<div>{odd}</div><div>{LONG}</div>") == LONG


def judged(rows, rules=html.Rules()):
    """The two passes told once more, block by block, for blocks outside articles and without headings."""
    first = []
    for text, linked, apart in rows:
        words_ = text.lower().split()
        share = sum(w.strip(".,;:!?\"'()") in html._STOP for w in words_) / len(words_)
        if apart or linked / len(text) > rules.links:
            first.append("bad")
        elif len(text) < rules.short:
            first.append("short")
        elif share >= rules.frequent:
            first.append("good" if len(text) >= rules.long else "near")
        else:
            first.append("bad" if len(text) < rules.long or share < rules.frequent / 4 else "near")
    final = []
    for i, own in enumerate(first):
        if own in ("good", "bad"):
            final.append(own)
            continue
        before = next(((i - j, first[j]) for j in range(i - 1, -1, -1) if first[j] in ("good", "bad")), None)
        after = next(((j - i, first[j]) for j in range(i + 1, len(first)) if first[j] in ("good", "bad")), None)
        if not {"good", "bad"} & set(first):
            final.append("good")
            continue
        before, after = before or (i + 1, "bad"), after or (len(first) - i, "bad")
        if before[1] == after[1]:
            final.append(before[1])
        else:
            final.append("good" if own == "near" else before[1] if before[0] <= after[0] else after[1])
    return final


def test_judging_equals_a_plain_walk():
    rng = random.Random(12)
    frequent = "the of and to in is that for".split()
    for _ in range(200):
        rows = []
        for _ in range(rng.randint(1, 12)):
            share = rng.choice([0.0, 0.08, 0.3])
            text = " ".join(rng.choice(frequent) if rng.random() < share else "xqz" * rng.randint(1, 3) for _ in range(rng.randint(1, 40)))
            rows.append((text, rng.choice([0, 0, len(text)]), rng.random() < 0.1))
        made = [html.Block(t, n, apart, (), 0, False) for t, n, apart in rows]
        assert [b.label for b in html.judge(made)] == judged(rows), rows


def test_html_clashing_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "x", 5, "<p>a")], "page_id long, text string, n_chars int, html string")
    (row,) = html.extract(frame).collect()
    assert (row.page_id, row.text, row.n_chars) == (1, "a", 1) and html.extract(frame.limit(0)).count() == 0


def test_html_table(spark):
    frame = spark.createDataFrame([(1, "u", None), (2, None, "<p>a")], "page_id long, url string, html string")
    assert sorted(map(str, html.extract(frame).collect())) == sorted(["Row(page_id=1, url='u', text='', n_chars=0)", "Row(page_id=2, url=None, text='a', n_chars=1)"])


def labelled(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        bad = rng.random() < 0.3
        t = sentence(rng, rng.randint(5, 60)).split()
        if bad:
            for _ in range(rng.randint(1, 3)):
                t.insert(rng.randrange(len(t)), rng.choice(["rotten", "vile", "viler"]))
        texts.append(" ".join(t))
        labels.append(int(bad))
    return texts, np.array(labels)


def test_toxicity_learns_words():
    model = toxicity.train(*labelled(500, 1), toxicity.Shape(buckets=1 << 12, steps=300))
    texts, labels = labelled(200, 2)
    logits = np.concatenate([model.logits(toxicity.features(w, model.shape), w.bounds) + model.shift[toxicity.languages(w)] for _, _, w in words(pa.array(texts))])
    assert ((logits >= np.log(0.7 / 0.3)) == labels).mean() > 0.95


def test_toxicity_scores(docs):
    model = toxicity.train(["a"], np.array([0]))
    rows = toxicity.scored(docs((1, None), (2, ""), (3, "x " * 9000)), model).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 0.5 for r in rows)
    assert toxicity.scored(docs((1, "a")).limit(0), model).count() == 0


def test_languages():
    texts = ["the end of the day", "der Tag und die Nacht", "los dos y el mar", "le jour et les nuits", ""]
    found = [toxicity._NAMES[k] for _, _, w in words(pa.array(texts)) for k in toxicity.languages(w)]
    assert found == ["en", "de", "es", "fr", "de"]


def test_quality_shrinks_sparse_sites(spark):
    from pyspark.sql import functions as F

    rows = [("big", "p", 2.0)] * 300 + [("bad", "p", -3.0)] * 300 + [("bad", "q", 3.0)] + [("new", "p", 0.0)]
    known = quality.sites(spark.createDataFrame(rows, "_host string, _path string, _evidence double"), 0.0)
    table = {(r._host, r._path): r for r in known.table.collect()}
    assert table["big", "p"].host_rate > 0.8 and table["bad", "p"].host_rate < 0.2
    assert abs(table["new", "p"].host_rate - known.rate) < 0.2
    assert table["bad", "q"].host_rate == table["bad", "p"].host_rate and table["bad", "q"].n == 1
    assert known.strength >= 1 and F is not None


def test_quality_odd_rows(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    frame = docs((1, "the end of it"), (2, "@@@ $$$"), (3, None), (None, ""), (1, "the end of it"))
    rows = quality.assessed(frame, labels, F.col("source"), F.lit(None).cast("string")).collect()
    assert len(rows) == 5 and all(0 <= r.quality <= 1 for r in rows)
    assert quality.assessed(frame.limit(0), labels, F.col("source"), F.col("lang")).count() == 0
    assert all(r.good for r in quality.assessed(frame, labels.limit(0), F.col("source"), F.col("lang")).collect())


def some_mixer(rule, seed=1):
    rng = np.random.default_rng(seed)
    n = len(mixing.CONTEXTS) * rule.slots
    table = (rng.integers(-3000, 3000, n).astype(np.int16) << 3) | rng.integers(0, 8, n).astype(np.int16)
    mixer = mixing.averaged(table, rule, [])
    mixer.weights = rng.normal(0.2, 0.1, mixer.weights.shape).astype(np.float32)
    mixer.cells = rng.uniform(0.1, 0.9, mixer.cells.shape)
    return mixer


def test_bits_of_all_tokens_sum_to_one():
    rule = mixing.Mixing(slots=1 << 12)
    mixer = some_mixer(rule)
    # the first byte's 256 values share out everything
    total = 0.0
    for b in range(256):
        p, one = 1.0, mixing.Bits([bytes([b]) if b != 32 else b""], np.array([2]), rule)
        for k, (_, slots, bit) in enumerate(one.steps()):
            if k == 8:
                break
            x, place, gate = mixer.inputs(slots)
            q = float(mixer.refined(mixer.odds(x, place), gate)[0])
            p *= q if bit[0] else 1 - q
        total += p
    assert abs(total - 1) < 1e-9


def test_mixing_equals_a_plain_loop():
    import math

    rule, tokens_ = mixing.Mixing(slots=1 << 10), [b"ab", b"", "é".encode(), b"x" * 100]
    mixer, k, levels = some_mixer(rule), len(mixing.CONTEXTS), mixing.LEVELS
    state = np.array([0, 4, 2, 1])
    truth = np.zeros(len(tokens_))
    for who, slots, bits in mixing.Bits(tokens_, state, rule).steps():
        for t, own, bit in zip(who, slots.T, bits):
            found = [int(mixer.packed[s]) for s in own]
            met = [f & 7 for f in found]
            best = max((j for j in range(k) if met[j]), default=0 if not any(met) else None)
            best = best if any(met) else k - 1
            gate = best * levels + met[best]
            odds = sum((f >> 3) / 350 * float(mixer.weights[(gate * k + j) * levels + met[j]]) for j, f in enumerate(found))
            odds = min(max(odds, -15.9), 15.9)
            p = (1 / (1 + math.exp(-odds)) + mixer.cells[gate][int((odds + 16) * 2)]) / 2
            p = min(max(p, 2**-22), 1 - 2**-22)
            truth[t] += math.log10(p if bit else 1 - p)
    assert np.allclose(mixer.log10(tokens_, state), truth, rtol=1e-4)


def test_shared_beginnings_are_coded_once():
    rule, rng = mixing.Mixing(slots=1 << 12), random.Random(8)
    tokens_ = [rng.choice(VOCABULARY).encode() for _ in range(500)] + [b"", b"x" * 48, b"x" * 100, b"x" * 47 + b"\x00"]
    state, mixer, seen = np.array([rng.randrange(3) for _ in tokens_]), some_mixer(rule), []
    truth = np.zeros(len(tokens_))
    for who, slots, bit in mixing.Bits(tokens_, state, rule).steps():
        x, place, gate = mixer.inputs(slots)
        p = mixer.refined(mixer.odds(x, place), gate)
        truth += np.bincount(who, np.log10(np.where(bit, p, 1 - p)), len(truth))
    inputs = mixer.inputs
    mixer.inputs = lambda slots: seen.append(slots.shape[1]) or inputs(slots)
    assert np.allclose(mixer.log10(tokens_, state), truth, rtol=1e-12, atol=0)
    different = {(s, a > 0, (w + b" ")[a : i + 1]) for w, s in zip(tokens_, state.tolist()) for a in (0, 48, 96) for i in range(a, min(len(w) + 1, a + 48))}
    assert sum(seen) <= 8 * len(different) < 8 * sum(len(w) + 1 for w in tokens_) / 2


@pytest.mark.parametrize("task_tokens, fan", [(1 << 18, 32), (9, 2)])
def test_tables_are_sums_over_all_tokens_of_either_fold(spark, monkeypatch, task_tokens, fan):
    rng = random.Random(6)
    rule = mixing.Mixing(slots=1 << 14, task_tokens=task_tokens)
    monkeypatch.setattr(mixing, "_FAN", fan)
    rows = [(rng.choice(range(5)), rng.choice(VOCABULARY).encode(), rng.randint(0, 9), rng.choice([0, 3, 2**33])) for _ in range(60)]
    counts = spark.createDataFrame([(0, *r) for r in rows], "hash long, state byte, word binary, counted long, learnt long").repartition(7)
    found = mixing.predictors(counts, len(rows), rule)
    for use, table in zip((lambda r: r[2], lambda r: r[2] + r[3]), found):
        n = np.zeros((len(mixing.CONTEXTS) * rule.slots, 2))
        for r in rows:
            for _, slots, bit in mixing.Bits([r[1]], np.array([r[0]]), rule).steps():
                n[slots[:, 0], bit[0]] += use(r)
        assert (table == mixing.packed(n)).all()


def test_learning_follows_the_decisions():
    """The log loss falls, on the tokens learnt from and on others of the kind."""
    rng = random.Random(2)
    rule = mixing.Mixing(slots=1 << 14, batch=64)
    words_ = [rng.choice(VOCABULARY).encode() for _ in range(900)]
    n = np.zeros((len(mixing.CONTEXTS) * rule.slots, 2))
    for w in words_[:300]:
        for _, slots, bit in mixing.Bits([w], np.array([0]), rule).steps():
            n[slots[:, 0], bit[0]] += 1
    learner, state = mixing.Learner(mixing.packed(n), rule, 1.0), np.zeros(300, np.int8)
    before = learner.mixer.log10(words_[600:], state).sum()
    for _ in range(5):
        learner.forget()
        learner.follow(words_[300:600], state, np.ones(300))
    after = mixing.averaged(learner.mixer.packed, rule, [(1.0, learner.mixer.weights, learner.met, learner.ones)])
    assert after.log10(words_[600:], state).sum() > before + 15


def test_held_out_texts_are_scored_better_than_by_the_base(spark):
    from pathlib import Path

    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test data")
    rows = mixing.scores(spark.read.parquet(str(path))).where("held_out")
    from pyspark.sql import functions as F

    score, base = rows.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > base


def test_scores_of_texts(docs):
    import math
    import zlib
    from collections import Counter

    rng = random.Random(7)
    rows = [(i, sentence(rng, rng.randint(0, 40))) for i in range(80)] + [(100, None), (101, ""), (102, "z" * 500), (103, "x " * 3000)]
    got = {r.id: r for r in mixing.scores(docs(*rows), mixing.Mixing(slots=1 << 13, frequent=16, lessons=1 << 16)).collect()}
    count, tokens = Counter(), {}
    for i, t in rows:
        tokens[i] = [*(t or "").encode().lower().split(), None]
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(tokens[i])
    n, v = sum(count.values()), len(count)
    for i, w in tokens.items():
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = got[i]
        assert math.isclose(base, r.base_score) and (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.score < 0 and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)


def test_words_before_count(docs):
    """Texts of the same words: the order that others have is likelier, and so is a text that repeats itself."""
    import zlib

    rng = random.Random(9)
    phrase = VOCABULARY[:12]
    rows = [(i, " ".join(phrase) + " " + sentence(rng, 20)) for i in range(200)]
    new = [next(i for i in range(k, k + 1000) if zlib.crc32(str(i).encode()) % 5 == 1) for k in (1000, 3000, 5000, 7000)]
    texts = [phrase, phrase[::-1], VOCABULARY[12:18] * 4, VOCABULARY[12:36]]
    rows += [(i, " ".join(t)) for i, t in zip(new, texts)]
    found = mixing.scores(docs(*rows), mixing.Mixing(slots=1 << 13, lessons=1 << 16))
    got = {r.id: r for r in found.collect()}
    same, turned, again, once = (got[i] for i in new)
    assert all(got[i].held_out for i in new) and abs(same.base_score - turned.base_score) < 1e-9
    assert same.score > turned.score + 5 and again.score > once.score + 5
    few = mixing.scores(docs(*rows), mixing.Mixing(slots=1 << 13, lessons=1 << 16, frequent=16))
    assert all(r.n_known == got[r.id].n_known and abs(r.base_score - got[r.id].base_score) < 1e-9 for r in few.collect())


def test_tokens_in_their_text_share_out_one():
    """By a plain loop over the tokens, whose shares of every next token also sum to one."""
    import math

    rng = random.Random(11)
    names = np.sort(np.array([rng.getrandbits(64) for _ in range(6)], np.uint64))
    bits = dict(zip(names.tolist(), (0.3, 0.25, 0.2, 0.15, 0.06, 0.04)))
    counts, tables = ({}, {}), []
    learnt = np.array([rng.choice(names.tolist()) for _ in range(80)], np.uint64)
    for k, (context, name) in enumerate(mixing.followed(learnt, np.zeros(80, np.int64))):
        for c, f, w in zip(context.tolist(), name.tolist(), learnt.tolist()):
            counts[k].setdefault(c, {}).setdefault(w, [0, f])[0] += 1
        flat = [(v[1], c, v[0]) for c, own in counts[k].items() for v in own.values()]
        f, c, n = (np.array(x, np.uint64) for x in zip(*flat))
        tables.append(mixing.Followers.of(f, c, n.astype(np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)))

    def share(given, state, trust):
        earned, had, n = state
        odds = given / (1 - given) * ((earned + trust) / (had + trust)) / ((n - earned + trust) / (n - had + trust))
        return odds / (1 + odds)

    def plain(row):
        out, states, two = [], [[0.0, 0.0, 0] for _ in range(3)], [int(mixing._END)] * 2
        for t, w in enumerate(row):
            one = np.array([row[t - 1] if t else mixing._END], np.uint64)
            pair = mixing._after(np.array([row[t - 2] if t > 1 else mixing._END], np.uint64), one)[0] if t else mixing._END
            own = row[:t]
            given = [t / (t + len(set(own))) if t else 0.0]
            mine = [lambda x: own.count(x) / max(t, 1)]
            for k, c in enumerate((int(one[0]), int(pair))):
                seen = counts[k].get(c, {})
                total = sum(v[0] for v in seen.values())
                given.append(total / (total + len(seen)) if seen else 0.0)
                mine.append(lambda x, seen=seen, total=total: seen[x][0] / total if x in seen else 0.0)
            shares = [share(g, s, 8.0) if g else 0.0 for g, s in zip(given, states)]

            def chain(x):
                p = [bits[x]]
                for a, m in zip(shares, mine):
                    p.append(a * m(x) + (1 - a) * p[-1])
                return p

            assert math.isclose(sum(chain(x)[-1] for x in bits), 1)
            p = chain(w)
            out.append(math.log10(p[-1]))
            for k in range(3):
                both = given[k] * mine[k](w) + (1 - given[k]) * p[k]
                states[k][0] += given[k] * mine[k](w) / both
                states[k][1] += given[k]
                states[k][2] += given[k] > 0
        return out

    rows = [[rng.choice(names.tolist()) for _ in range(n)] for n in (1, 30, 7)]
    hashes = np.array([w for r in rows for w in r], np.uint64)
    row = np.repeat(np.arange(3), [len(r) for r in rows])
    log10 = np.log10([bits[w] for w in hashes.tolist()])
    got, more = mixing.mixed(log10, np.ones(len(row), bool), hashes, row, tables, 8.0)
    assert not more.any() and np.allclose(got, [x for r in rows for x in plain(r)], rtol=1e-9)
    # without their bits, tokens that nothing knows keep what the others leave
    fresh = np.array([5], np.uint64)
    got, more = mixing.mixed(np.zeros(1), np.zeros(1, bool), fresh, np.zeros(1, np.int64), tables, 8.0)
    given = tables[0].trusted(np.array([mixing._END]))[0], tables[1].trusted(np.array([mixing._END]))[0]
    assert more.all() and math.isclose(got[0], sum(math.log10(1 - g) for g in given))


def test_scores_of_an_empty_table(docs):
    assert mixing.scores(docs((1, "a")).limit(0), mixing.Mixing(slots=1 << 13)).count() == 0


def test_a_batch_is_tallied_at_once(monkeypatch):
    """Of the sums over weights' or cells' places only that of the gradient is made at every step."""
    rule = mixing.Mixing(slots=1 << 10)
    learner = mixing.Learner(np.zeros(len(mixing.CONTEXTS) * rule.slots, np.int16), rule, 1.0)
    calls, real = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda *a: calls.append(len(a[0])) or real(*a))
    learner.follow([b"ab", b"abc", b""], np.zeros(3, np.int8), np.array([1.0, 2.0, 3.0]))
    assert len(calls) == 4 * 8 + 2
    assert learner.seen == 8 * (3 + 4 + 1) and learner.met.sum() == 8 * (3 + 2 * 4 + 3)


def test_mixing_steps_equal_a_plain_optimiser():
    rule, rng = mixing.Mixing(slots=1 << 10), np.random.default_rng(3)
    table = rng.integers(-500, 500, len(mixing.CONTEXTS) * rule.slots).astype(np.int16) * np.int16(8)
    table += rng.integers(0, 8, len(table)).astype(np.int16)
    tokens_, state, n = [b"ab", b"q" * 60, b"", b"abc"], np.array([0, 2, 1, 0], np.int8), np.array([1.0, 4.0, 2.0, 1.0])
    learner = mixing.Learner(table, rule, 2.0)
    plain = mixing.Mixer(table, mixing._start(rule), np.zeros(0), rule)
    first = second = np.zeros(len(plain.weights))
    met, ones = np.zeros_like(learner.met), np.zeros_like(learner.ones)
    for step, (who, slots, bit) in enumerate(mixing.Bits(tokens_, state, rule).steps(), 1):
        x, place, gate = plain.inputs(slots)
        for d in range(len(bit)):  # the most specific predictor that has met its context, and how often
            known = [(j, table[s] & 7) for j, s in enumerate(slots[:, d]) if table[s] & 7]
            j, level = known[-1] if known else (len(mixing.CONTEXTS) - 1, 0)
            assert gate[d] == j * mixing.LEVELS + level
        odds, weight = plain.odds(x, place), n[who] / 2.0
        for cell, w, b in zip(gate * 64 + ((odds + 16) * 2).astype(int), weight, bit):
            met[cell] += w
            ones[cell] += w * b
        grad = np.zeros(len(plain.weights))
        np.add.at(grad, place, (1 / (1 + np.exp(-odds)) - bit) * weight / len(bit) * x)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        plain.weights = (plain.weights - rule.rate / (1 + step / 2000) * move).astype(np.float32)
    learner.follow(tokens_, state, n)
    assert np.allclose(learner.met, met) and np.allclose(learner.ones, ones)
    assert np.abs(learner.mixer.weights - plain.weights).max() < 1e-3


def test_components_stop_at_stars(spark, monkeypatch):
    rng, made = random.Random(5), []
    real = components.stage
    monkeypatch.setattr(components, "stage", lambda *a: made.append(a) or real(*a))
    stars = [(10 * c + k, 10 * c) for c in range(4) for k in range(1, 5)]
    found = components.components(spark.createDataFrame(stars, "a long, b long"), "a", "b")
    assert sorted(map(tuple, found.collect())) == sorted([(a, b) for a, b in stars] + [(10 * c, 10 * c) for c in range(4)])
    assert len(made) == 1  # nothing but the links themselves
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(7, None), (5, 5)]
    least = {i: i for link in links if None not in link and link[0] != link[1] for i in link}
    for _ in range(40):
        for a, b in links:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    found = components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert len(found) == len(least) and dict(map(tuple, found)) == least
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_a_round_of_components_reads_its_links_four_times(spark, monkeypatch):
    plans, real = [], components.stage
    read = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    monkeypatch.setattr(components, "stage", lambda df, *a: plans.append(read(df)) or real(df, *a))
    links = [(i, i + 1) for i in range(9)] + [(20 + i, 20 + j) for i in range(5) for j in range(i)] + [(3, 3), (1, 0), (None, 2)]
    found = components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, found)) == [(i, 0) for i in range(10)] + [(20 + i, 20) for i in range(5)]
    assert len(plans) > 1 and max(plans) <= 4  # the links themselves, then rounds


def test_names_of_tokens_without_a_step_for_each():
    texts = pa.array(["Ab  cd ab", None, "", "é" * 40 + " x", "cd"])
    ((_, _, found),) = words(texts)
    hashes, _, row = mixing.tokens(found)
    want = [b"ab", b"cd", b"ab", b"", b"", b"", ("é" * 40).encode(), b"x", b"", b"cd", b""]
    for one in (np.arange(len(want)), np.array([9, 0, 3, 7]), np.array([3, 10]), np.zeros(0, np.int64)):
        assert mixing._named(found, hashes, row, one).to_pylist() == [want[i] for i in one]
    key = np.array([5, 9, 5, 9, 9, 7], np.uint64) << np.uint64(60)
    found = mixing._met([key[:3], key[3:]], [key[:3] + np.uint64(1), key[3:] + np.uint64(1)], 2).to_pydict()
    names = [(int(k) + 1).to_bytes(8, "little") for k in np.array(found["hash"], np.int64).view(np.uint64)]
    assert found["word"] == names and sorted(found["n"]) == [2, 3] and set(found["state"]) == {-2}
