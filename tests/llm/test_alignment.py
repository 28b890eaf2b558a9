"""Alignment of two public tokenizers against a walk over all token ends, and the merge path."""

import hashlib
from collections import Counter
from dataclasses import replace

import numpy as np
import public_tokenizers
import pytest

from loglathe.llm import alignment
from loglathe.llm.alignment import Vocabularies, alignments, common_ends, crossings, links, units_of

FILES = Vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
FAST = replace(FILES, a_ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), a_pattern=public_tokenizers.PATTERN)
TEXTS = [
    "The quick brown fox, isn't it?", " leading and  double   spaces ", "tabs\tand\n\n new lines \r\n", "日本語 と emoji 🙂🙂",
    "<|endoftext|> is <s> plain </s> text <0x41>", "▁a piece mark", "", None, " ", "   ", "\n", "x" * 700, "don't  \n 're 123456 7",
    "ﬁne é  nbsp　wide \x1c sep", "The quick brown fox, isn't it?", "a  b \u0000c", "ünïcödé Straße naïve",
    " ".join(f"word{i % 37}" for i in range(900)), "supercalifragilistic" * 30,
]


def brute_force(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_coder = Tokenizer.from_file(FILES.a_path)
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=FILES.b_path)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    docs, corpus = [], Counter()
    for i, text in rows:
        a = a_coder.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_coder.encode(text) if text else []
        a_bytes = [bytes(byte[c] for c in a_coder.id_to_token(x)) for x in a]
        b_bytes = [
            bytes([int(b_coder.id_to_piece(x)[3:5], 16)]) if b_coder.is_byte(x)
            else b_coder.id_to_piece(x).replace("▁", " ").encode() for x in b
        ]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            docs.append((i, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
        common = sorted(set(ends[0]) & set(ends[1]))
        group = [[int(np.searchsorted(common, e)) for e in side] for side in ends]
        own = [([x for x, g in zip(a, group[0]) if g == k], [x for x, g in zip(b, group[1]) if g == k]) for k in range(len(common))]
        digest = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in own)
        docs.append((i, len(a), len(b), own, hashlib.sha256(digest.encode()).hexdigest()))
        corpus.update({(x, y) for p, q in own for x in p for y in q})
    best = {}
    for (x, _), n in corpus.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, n_a, n_b, own, sha in docs:
        every = [(x, y) for p, q in own for x in p for y in q]
        out.append((i, n_a, n_b, len(own), len(every), sum(corpus[e] == best[e[0]] for e in every), sum(corpus[e] for e in every), sha))
    return sorted(out, key=str)


def found(frame):
    columns = ("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


@pytest.mark.parametrize("files, block_bytes", [(FILES, 300), (FAST, 1), (FAST, 300), (FAST, 1 << 23)])
def test_equals_brute_force_in_blocks_of_any_size(spark, docs, files, block_bytes):
    rows = [*enumerate(TEXTS), (3, "again 3"), (3, "again 3"), (None, "no id")]
    assert found(alignments(docs(*rows).repartition(3), files, block_bytes=block_bytes)) == brute_force(rows)


def test_memo_keeps_what_it_returns():
    coder = alignment.coders(FAST)
    memo = alignment.Memo(coder, size=5)
    rng = np.random.default_rng(1)
    for _ in range(30):
        units = [f"unit{k}" for k in rng.choice(40, 17, replace=False)]
        assert memo.look_up(units) == alignment.aligned(units, coder)
        assert len(memo.young) <= 5


def test_numbers_are_written_in_decimal():
    numbers, after = np.array([0, 7, 10, 907, 50256]), np.frombuffer(b",|;,\0", np.uint8)
    data, ends = alignment.written(numbers, after)
    assert data.tobytes() == b"0,7|10;907,50256" and ends.tolist() == [2, 4, 7, 11, 16]


def test_slices_pieces_and_large_groups_change_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(alignment, "_SLICE_CHARS", 20)
    rows = list(enumerate(TEXTS))
    assert [u for t in TEXTS if t for part in units_of(t) for u in part] != []
    for t in filter(None, TEXTS):
        assert " " + t == "".join(" " + u for part in units_of(t) for u in part)
    assert found(alignments(docs(*rows), FILES)) == brute_force(rows)


def test_empty_table_and_clashing_columns(spark, docs):
    assert alignments(docs().limit(0), FILES).count() == 0
    from pyspark.sql import functions as F

    rows = [(1, "one text"), (2, "two texts")]
    wide = docs(*rows).withColumns({c: F.lit("x") for c in ("id", "block", "code", "count", "n_a", "units", "owner", "place")})
    assert found(alignments(wide, FILES)) == brute_force(rows)


def test_pieces_of_any_size_find_all_common_ends():
    rng = np.random.default_rng(8)
    for _ in range(200):
        last = 300
        a, b = (np.append(np.unique(rng.integers(0, last, rng.integers(0, 90))), last) for _ in range(2))
        truth = np.intersect1d(a, b)
        for piece in (1, 2, 3, 7, 64, 1 << 15):
            i, j = common_ends(a, b, piece)
            assert a[i].tolist() == b[j].tolist() == truth.tolist()


def test_crossings_follow_the_merge():
    a, b = np.array([2, 4, 4 + 3, 9]), np.array([1, 4, 8, 9, 12])
    merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    expected = [sum(side == 0 for _, side in merged[:d]) for d in range(len(merged) + 1)]
    assert crossings(a, b, np.arange(len(merged) + 1)).tolist() == expected


def test_large_groups_are_multiplied_by_distinct_ids(monkeypatch):
    a, b = np.array([5, 5, 6, 5]), np.array([1, 2, 2])
    one = np.array([0]), np.array([0]), np.array([4]), np.array([3])
    truth = Counter({(5, 1): 3, (5, 2): 6, (6, 1): 1, (6, 2): 2})
    for large in (100, 2):
        monkeypatch.setattr(alignment, "_LARGE", large)
        seen = Counter()
        for g, code, n in zip(*links(a, b, *one)):
            assert g == 0
            seen[int(code) >> 32, int(code) & 0xFFFFFFFF] += int(n)
        assert seen == truth
