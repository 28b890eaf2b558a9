"""Language identification: features against a plain count, the learner against its formula, accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglathe.llm import langid
from loglathe.llm.langid import Regression, Shape, document_frequencies, fitted_temperature, gram_counts, languages, softmax, weighted
from loglathe.llm.sampling import remainder

SYLLABLES = {"xx": ["ba", "lo", "mi", "ta"], "yy": ["schr", "ung", "keit", "ä"], "zz": ["ción", "ñe", "que", "lla"]}


def text(lang, rng, n=25):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture
def corpus(spark):
    rng = random.Random(11)
    rows = [(i, text(lang, rng), lang) for i in range(240) for lang in [("xx", "yy", "zz", "xx")[i % 4]]]
    rows += [(500, None, "xx"), (501, "", "yy"), (502, "12 34 -- !", "zz"), (503, text("yy", rng), None), (None, text("zz", rng), "xx"),
             (7, text("xx", rng), "xx"), (7, text("xx", rng), "xx"), (504, text("zz", rng, 9000), "zz"), (505, "²½", "xx")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_counts_are_those_of_all_grams_in_pieces_or_not(monkeypatch):
    shape = Shape(bits=30)  # few collisions, so that counts can be compared as multisets
    sample = "Ça va? İ 12 naïve_test — été\n\tABC abc 日本"
    plain = f" {langid._OTHER.sub(' ', sample.lower()).strip()} "
    truth = Counter(plain[i : i + n] for n in range(1, 5) for i in range(len(plain) - n + 1))
    whole = gram_counts(sample, shape)
    assert sorted(whole[1].tolist()) == sorted(truth.values())
    for size in (1, 3, 8):
        monkeypatch.setattr(langid, "_PIECE", size)
        cut = gram_counts(sample, shape)
        assert cut[0].tolist() == whole[0].tolist() and cut[1].tolist() == whole[1].tolist()


def test_weights_have_length_one_and_follow_the_definition():
    shape = Shape(bits=10)
    idf = np.linspace(1, 3, 1 << 10)
    grams, x = weighted("some words and some more", idf, shape)
    counts = gram_counts("some words and some more", shape)[1]
    raw = [(1 + math.log(c)) * idf[g] for g, c in zip(grams, counts)]
    assert np.allclose(x, np.array(raw) / math.sqrt(sum(v * v for v in raw)))


def test_learner_keeps_the_minimiser_of_its_sum():
    """After each step the weights minimise g.w + sum of sigma/2 (w - w_s)^2 + penalties, coordinate by coordinate."""
    shape = Shape(bits=3, l1=0.05, l2=0.3, alpha=0.7, beta=1.0)
    rng = np.random.default_rng(2)
    state = Regression(3, 8, shape)
    slope, pull, centre = np.zeros((8, 3)), np.zeros((8, 3)), np.zeros((8, 3))
    squares = np.zeros((8, 3))
    for _ in range(40):
        at, label = np.sort(rng.choice(8, 4, replace=False)), int(rng.integers(3))
        x = rng.normal(size=4)
        w = state.weights(slice(None)).copy()
        error = softmax(x @ w[at]) - np.eye(3)[label]
        g = np.zeros((8, 3))
        g[at] = x[:, None] * error
        sigma = (np.sqrt(squares + g**2) - np.sqrt(squares)) / shape.alpha
        squares += g**2
        slope, pull, centre = slope + g, pull + sigma, centre + sigma * w
        state.learn(at, x, label)
        b, a = slope - centre, pull + shape.beta / shape.alpha + shape.l2
        expected = np.where(np.abs(b) <= shape.l1, 0, -(b - np.sign(b) * shape.l1) / a)
        assert np.allclose(state.weights(slice(None)), expected)


def test_penalty_leaves_weights_at_zero():
    rng, idf = random.Random(3), np.ones(1 << 18)
    rows = [(lang, text(lang, rng)) for _ in range(40) for lang in SYLLABLES]
    sizes = [len(langid.fit(rows, idf, Shape(l1=l1)).grams) for l1 in (0.0, 0.003, 0.1)]
    assert sizes[0] > sizes[1] > sizes[2] > 0


def test_temperature_has_the_least_smoothed_loss():
    rng = np.random.default_rng(4)
    outputs = rng.normal(size=(400, 3)) * 6
    labels = np.array([rng.choice(3, p=p) for p in softmax(outputs / 4)])
    assert 3 < fitted_temperature(outputs, labels) < 5.3
    sure = np.eye(3)[labels] * 5
    assert softmax(sure / fitted_temperature(sure, labels)).max() < 1  # never certain
    assert fitted_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1


def test_document_frequencies_cover_all_rows(spark, corpus):
    texts = frame(spark, corpus).where("text is not null").select("text").repartition(7)
    docs, n = document_frequencies(texts)
    truth = np.zeros(1 << 18, int)
    for _, t, _ in corpus:
        if t is not None:
            truth[gram_counts(t)[0]] += 1
    assert n == sum(t is not None for _, t, _ in corpus) and (docs == truth).all()


def test_accuracy_and_odd_rows(spark, corpus):
    docs = frame(spark, corpus).withColumns({c: F.lit("x") for c in ("place", "n", "rank", "score")})
    rows = languages(docs, remainder("doc_id", 4) == 2).collect()
    assert len(rows) == len(corpus) and {r.lang_pred for r in rows} == {"xx", "yy", "zz", "und"}
    by_id = {r.id: r for r in rows}
    truth = {i: lang for i, _, lang in corpus}
    held = [r for r in rows if r.held_out and r.id < 240]
    assert len(held) > 30 and sum(r.lang_pred == truth[r.id] for r in held) >= 0.97 * len(held)
    for i in (500, 501, 502):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[503].lang_pred == "yy" and by_id[504].lang_pred == "zz" and by_id[None].lang_pred == "zz"
    assert all(0 <= r.score <= 1 for r in rows) and by_id[None].held_out is False


def test_held_out_languages_are_never_read(spark, corpus):
    mark = remainder("doc_id", 4) == 2
    docs = frame(spark, corpus)
    spoiled = docs.withColumn("lang", F.when(F.coalesce(mark, F.lit(False)), "??").otherwise(F.col("lang")))
    key = lambda r: (str(r.id), r.held_out, r.lang_pred, r.score)
    assert sorted(map(key, languages(docs, mark).collect())) == sorted(map(key, languages(spoiled, mark).collect()))


def test_nothing_to_learn_and_empty_table(spark):
    bare = frame(spark, [(1, "some text", None), (2, None, "en")])
    assert {(r.id, r.lang_pred, r.score) for r in languages(bare, F.lit(False)).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert languages(frame(spark, []), F.lit(False)).count() == 0
    one = frame(spark, [(i, "only one language", "en") for i in range(8)])
    assert {(r.lang_pred, r.score) for r in languages(one, F.lit(False)).collect()} == {("en", 1.0)}
