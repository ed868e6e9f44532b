"""Elias-Fano sequences, the trie, and text scores against plain counting."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from shiftlens.llm import ngram_trie
from shiftlens.llm.elias_fano import EliasFano, Trie, quantise

U64 = np.uint64


@pytest.mark.parametrize("n, top", [(0, 9), (1, 5), (1, 2**64 - 1), (999, 999), (3000, 2**63), (5000, 2**40)])
def test_sequence_is_exact(n, top):
    draw = np.random.default_rng(n)
    values = np.sort(draw.integers(0, top, n, dtype=U64, endpoint=True))
    sequence = EliasFano.of(EliasFano.build(values).parts())
    assert (sequence.access(np.arange(n)) == values).all()
    if n:
        target = np.concatenate([draw.integers(0, top, 500, dtype=U64, endpoint=True), values[:200]])
        start = draw.integers(0, n, len(target))
        stop = np.minimum(n, start + draw.integers(0, n + 1, len(target)))
        want = [a + np.searchsorted(values[a:b], t) for t, a, b in zip(target, start, stop, strict=True)]
        assert (sequence.successor(target, start, stop) == want).all()


def test_trie_of_three_levels_maps_from_a_file(tmp_path):
    draw = np.random.default_rng(3)
    grams = sorted({tuple(draw.integers(0, 12, 3).tolist()) for _ in range(400)})
    first = sorted({g[:1] for g in grams})
    second = sorted({g[:2] for g in grams})
    keys = [np.array([g[-1] for g in level], U64) for level in (first, second, grams)]
    pointers = [
        np.array([sum(c[:d] < g for c in below) for g in [*level, (99,)]])
        for d, (level, below) in enumerate(((first, second), (second, grams)), 1)
    ]
    logs = [-draw.random(len(k)) for k in keys]
    (tmp_path / "trie").write_bytes(Trie.build(keys, pointers, logs).dump())
    trie = Trie.open(np.memmap(tmp_path / "trie", np.uint8, "r"))
    for gram in [*grams[::7], (0, 99, 0), (50, 1, 1)]:
        start, stop = np.array([0]), np.array([len(first)])
        for depth, word in enumerate(gram):
            node = trie.find(depth, np.array([word], U64), start, stop)
            known = gram[: depth + 1] in (set(first), set(second), set(grams))[depth]
            assert (node[0] >= 0) == known
            if not known:
                break
            at = (first, second, grams)[depth].index(gram[: depth + 1])
            assert node[0] == at and abs(trie.log10(depth, node)[0] - logs[depth][at]) < 0.01
            if depth < 2:
                start, stop = trie.children(depth, node)


def test_quantising_keeps_frequent_values():
    logs = np.concatenate([np.full(5000, -2.5), np.linspace(-9, -1, 4000)])
    codes, book = quantise(logs)
    width = 8 / 128  # of the bins that the values without a code of their own share
    assert np.abs(book[codes] - logs).max() <= width and book[codes[0]] == np.float32(-2.5)


def expected(rows, mu):
    """Score texts by counting."""
    held = lambda k: zlib.crc32(str("" if k is None else k).encode()) % 5 == 1
    split = [(k, (t or "").encode().lower().split() + [None]) for k, t in rows]
    one, two, after = Counter(), Counter(), Counter()
    for k, words in split:
        if not held(k):
            for v, w in zip([b"", *words], words, strict=False):
                one[w] += 1
                two[v, w] += 1
                after[v] += 1
    total, distinct = sum(one.values()), len(one)
    out = []
    for k, words in split:
        base = score = 0.0
        for v, w in zip([b"", *words], words, strict=False):
            p = (one[w] + 0.5) / (total + 0.5 * (distinct + 1))
            base += math.log10(p)
            score += math.log10((two[v, w] + mu * p) / (after[v] + mu))
        out.append((k, held(k), len(words), sum(one[w] > 0 for w in words), total, base, score))
    return out


@pytest.mark.parametrize("shard_bytes", [16 << 20, 1 << 13])
def test_scores_match_counting(spark, awkward, folder, monkeypatch, shard_bytes):
    monkeypatch.setattr(ngram_trie, "SHARD_BYTES", shard_bytes)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(awkward.select("doc_id", "text"))
    want = expected([tuple(r) for r in docs.collect()], ngram_trie.MU)
    got = [tuple(r) for r in ngram_trie.score_texts(docs).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, *r[2:4], round(r[5], 4))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-4)
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_nothing_to_learn_from(spark, empty):
    assert ngram_trie.score_texts(empty).count() == 0
    key = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    row = ngram_trie.score_texts(spark.createDataFrame([(key, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0)
    assert row.base_score == 0 and abs(row.score) < 1e-9
