"""Near duplicates and repeated strings against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from shiftlens.llm import coordinate_join, graph, suffix_dedup
from shiftlens.session import checkpoint_folder

SCHEMA = "doc_id long, text string"
RNG_PARTS = np.random.default_rng(9)


def linked_groups(rows, percent=85):
    """Group (key, text) rows by comparing all pairs of shingle sets."""
    sets = {}
    for k, text in rows:
        words = (text or "").encode().lower().split()
        n = min(5, len(words))
        sets[k] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    root = {k: k for k in sets}
    find = lambda k: k if root[k] == k else find(root[k])
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k), find(k) == k) for k in keys}


@pytest.fixture(scope="module")
def families():
    """Texts in families: copies, chains of small edits, edits too large to link, a shared passage."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    passage, rows = [word() for _ in range(60)], []

    def add(words):
        rows.append((len(rows) * 3 + 1, " ".join(words)))

    for size in (40, 90, 200):
        base = [word() for _ in range(size)]
        for _ in range(12):
            add(base)
            edited = list(base)
            for _ in range(draw.choice((1, 1, 2, 4))):
                edited[draw.randrange(size)] = word()
            add(edited)
            base = edited if draw.random() < 0.5 else base
    for _ in range(30):
        add([word() for _ in range(50)] + passage)
    draw.shuffle(rows)
    return rows


def test_groups_match_all_pairs(spark, families):
    got = coordinate_join.near_duplicates(spark.createDataFrame(families, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == linked_groups(families)


@pytest.mark.parametrize("percent", [100, 85, 80, 70, 50, 10])
def test_matches_follow_the_similarity(percent):
    least = coordinate_join.least_matches(percent)
    assert coordinate_join.missed(percent, least) < coordinate_join.MISSED
    assert least == 112 or coordinate_join.missed(percent, least + 1) >= coordinate_join.MISSED
    assert percent != 85 or least == 77


def test_no_matches_are_few_enough_for_a_tiny_similarity():
    for percent in (9, 0, 101):
        with pytest.raises(ValueError, match="percent"):
            coordinate_join.least_matches(percent)


def pairs_at(percent, n, words=900):
    """Pairs of texts that share about so much of their shingles: one text ends differently."""
    draw, rows = random.Random(percent), []
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(7))
    for k in range(n):
        base = [word() for _ in range(words)]
        other = math.floor((words - 4) * (100 - percent) / (100 + percent))  # of all shingles, on each side
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: words - other] + [word() for _ in range(other)]))]
    return rows


def test_pairs_at_a_low_threshold_are_found(spark):
    rows = pairs_at(70, 40)
    got = coordinate_join.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=70).collect()
    want = linked_groups(rows, 70)
    assert sum(not kept for _, _, kept in want.values()) == 40
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want


def test_stage_links_at_80_percent_and_op2_at_85(spark):
    docs = spark.createDataFrame(pairs_at(82, 20), SCHEMA)
    assert coordinate_join.near_duplicates(docs).filter("kept").count() == 40
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 40, 2))


def test_groups_of_awkward_rows(awkward, empty):
    got = coordinate_join.near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    by_key = {r.doc_id: r for r in got}
    assert by_key[0].n_shingles == by_key[1].n_shingles == by_key[2].n_shingles == 0
    assert by_key[0].kept and by_key[3].n_shingles == by_key[5].n_shingles == 1
    assert by_key[7].component_id == by_key[8].component_id == by_key[9].component_id == 7
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert coordinate_join.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_rare_prefixes_lose_no_link(spark, percent):
    """Sets over a common base with few or many shingles of their own, against all pairs."""
    draw = random.Random(percent)
    base = list(range(100))
    sets = {}
    for i in range(60):
        own = draw.choice((0, 3, 8, 15, 40))
        shared = draw.sample(range(200, 230), draw.randrange(12))
        sets[i] = draw.sample(base, 100 - draw.randrange(8)) + shared + [1000 * (i + 1) + k for k in range(own)]
    rows = [(i, bytearray(np.array(sorted(s), np.int64).tobytes())) for i, s in sets.items()]
    table = spark.createDataFrame(rows, "id long, shingles binary")
    kept = coordinate_join.rare_prefixes(table, table, percent).collect()
    found, most = {r.id: set(r.rare) for r in kept}, {r.id: r.common for r in kept}
    linked = 0
    for a in sets:
        for b in range(a):
            common = len(set(sets[a]) & set(sets[b]))
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                linked += 1
                assert found[a] & found[b] and common <= min(most[a], most[b])
    assert linked > 20 and len(found) < len(sets)  # those with many shingles of their own are left out


def test_near_copies_that_are_not_linked_meet_in_few_pairs(spark):
    """Copies of one base that lack different shingles: no link is lost, and few other pairs come out."""
    draw = random.Random(7)
    base = [draw.randrange(1 << 60) for _ in range(100)]
    sets = {i: set(draw.sample(base, 80)) for i in range(60)}
    for i in range(0, 10, 2):  # linked: a copy that lacks two more
        sets[100 + i] = sets[i] - set(draw.sample(sorted(sets[i]), 2))
    sets[200] = sets[0] - set(draw.sample(sorted(sets[0]), 3))  # of the same component as 0
    rows = [(i, bytearray(np.array(sorted(s), np.int64).tobytes())) for i, s in sets.items()]
    table = spark.createDataFrame(rows, "id long, shingles binary")
    roots = {i: 0 if i == 200 else i for i in sets}
    lists = [(t, i, roots[i], len(s)) for i, s in sets.items() for t in (3, 9)]
    known = spark.createDataFrame(lists, "token long, id long, root long, n_shingles long")
    got = [tuple(r) for r in coordinate_join.cross_pairs(known, table, 85).collect()]
    linked = {
        (a, b) for a in sets for b in sets if a < b and roots[a] != roots[b]
        and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    }
    assert len(linked) >= 5 and linked <= set(got) and len(got) == len(set(got)) and (0, 200) not in got
    assert len(got) < len(sets) * (len(sets) - 1) / 2 / 3


def test_intermediate_tables_are_deleted(spark, awkward):
    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    before = set(folder.glob("shiftlens-*"))
    suffix_dedup.remove_repeats(awkward, words=51).count()
    left = set(folder.glob("shiftlens-*")) - before
    assert len(left) == 2  # the spans of bytes and those of words


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, x) for x in range(1001, 1300)]
    loose = [(5000, 5000)]
    found = graph.components(spark.createDataFrame(chain + star + loose, "a long, b long"))
    roots = dict(tuple(r) for r in found.select("node", "root").collect())
    assert {roots[x] for x in range(201)} == {0} and {roots[x] for x in range(1000, 1300)} == {1000}


def removed(rows, window):
    """Remove repeated windows by a table of all of them."""
    texts = [(k, (t or "").encode()) for k, t in rows]
    seen: dict[bytes, int] = {}
    for _, t in texts:
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]] = seen.get(t[i : i + window], 0) + 1
    out = []
    for k, t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                mark[i : i + window] = b"\1" * window
        left = bytes(b for b, m in zip(t, mark, strict=True) if not m)
        spans = sum(1 for i, m in enumerate(mark) if m and (not i or not mark[i - 1]))
        out.append((k, len(t), sum(mark), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", ["50000", "2"])
def test_repeats_match_a_table_of_windows(spark, families, awkward, hot):
    draw = random.Random(2)
    noise = lambda n: "".join(draw.choice("abcdé \n") for _ in range(n))
    shared, inner = noise(900), noise(300)
    rows = [(i, noise(200) + shared[draw.randrange(300) :] + noise(150)) for i in range(12)]
    rows += [(50 + i, inner + noise(9) + inner + shared[: 190 + i]) for i in range(12)]
    rows += [(100, "ab" * 600), (101, "a" * 450), (102, noise(100) + "ab" * 300), (103, shared), (103, shared)]
    rows += [tuple(r) for r in awkward.filter("length(text) < 6000 OR text IS NULL").select("doc_id", "text").collect()]
    spark.conf.set("spark.shiftlens.hotSegments", hot)
    try:
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), window=200).collect()
    finally:
        spark.conf.unset("spark.shiftlens.hotSegments")
    assert sorted((tuple(r) for r in got), key=repr) == removed(rows, 200)


def test_cut_texts_keep_all_columns(awkward, empty):
    out = suffix_dedup.cut_repeats(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    by_key = {r.doc_id: r for r in out.collect()}
    assert by_key[0].text == "" and by_key[7].text == "" and by_key[7].n_chars == 0 and by_key[7].uid == "extra"
    assert by_key[40].text
    assert suffix_dedup.cut_repeats(empty).count() == 0


def repeated_words(rows, n):
    """Return, per row, the words outside all runs of n words that a table of them holds twice."""
    texts = [(k, (t or "").encode().split()) for k, t in rows]
    seen: dict[tuple, int] = {}
    for _, w in texts:
        for i in range(len(w) - n + 1):
            seen[tuple(w[i : i + n])] = seen.get(tuple(w[i : i + n]), 0) + 1
    out = []
    for k, w in texts:
        hit = {i + j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(n)}
        out.append((k, b" ".join(x for i, x in enumerate(w) if i not in hit).decode()))
    return sorted(out)


@pytest.mark.parametrize("hot", ["50000", "2"])
def test_stage_cuts_passages_of_over_50_words(spark, hot):
    draw = random.Random(8)
    prose = lambda n: [draw.choice("abcdefghij") + draw.choice(["", "e", "ou", "il"]) for _ in range(n)]
    passages, rows = {n: prose(n) for n in (30, 50, 51, 52, 55, 60)}, []
    for passage in passages.values():
        assert len(" ".join(passage)) < 400
        for _ in range(4):
            at, text = draw.randrange(40), prose(80)
            rows.append((len(rows), " ".join(text[:at] + passage + text[at:])))
    rows.append((len(rows), " ".join(passages[55][:30] + passages[60])))
    rows.append((len(rows), "\n".join(passages[52])))  # other white space
    rows += [(len(rows), " ".join(prose(2000))), (-1, ""), (-2, " ".join(passages[50] + prose(9)))]
    spark.conf.set("spark.shiftlens.hotSegments", hot)
    try:
        out = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    finally:
        spark.conf.unset("spark.shiftlens.hotSegments")
    got = sorted((r.doc_id, " ".join(r.text.split())) for r in out)
    assert got == repeated_words(rows, 51)
    told = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), words=51).collect()
    for r, (_, text) in zip(sorted(told, key=lambda r: r.doc_id), got, strict=True):
        lost = len(" ".join((dict(rows)[r.doc_id] or "").split())) - len(text)
        assert (r.n_passages > 0) == (lost > 0) and abs(r.passage_bytes - lost) <= r.n_passages
    left = dict(got)
    assert all(" ".join(passages[n]) not in t for t in left.values() for n in (51, 52, 55, 60))
    assert " ".join(passages[50]) in left[4] and " ".join(passages[30]) in left[0]


def test_suffix_order_is_that_of_bytes(monkeypatch):
    draw = np.random.default_rng(1)
    table = draw.integers(97, 99, (400, 70)).astype(np.uint8)
    table[100:300, :50] = table[0, :50]  # long common prefixes
    table[310:330] = table[0]
    group = draw.integers(0, 3, 400)
    for limit in (2000, 20):
        monkeypatch.setattr(suffix_dedup, "TRIE_GROUP", limit)
        order = suffix_dedup.deep_shallow_order(table, group)
        keys = [(group[i], table[i].tobytes()) for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(400))
    rows = [t.tobytes() for t in table[:50]] + [table[0].tobytes()]
    assert [rows[i] for i in suffix_dedup.blind_trie_order(rows)] == sorted(rows)


def test_anchors_of_parted_windows_are_those_of_the_whole():
    texts = [bytes(RNG_PARTS.integers(97, 101, n, dtype=np.uint8)) for n in (900, 0, 300, 2500, 420)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    def windows(found):
        rows = zip(*(found[k].tolist() for k in ("text", "hash", "at", "low", "high")), strict=True)
        return sorted((t, a - ahead, a, h) for t, h, a, low, high in rows for ahead in range(low, high + 1))

    whole = windows(suffix_dedup.anchors(data, at, 400))
    assert len(whole) == sum(max(0, len(t) - 399) for t in texts)
    for together in (1, 7, 500, 10_000):
        assert windows(suffix_dedup.anchors(data, at, 400, together=together)) == whole


def test_anchors_of_a_long_text_take_bounded_memory():
    data = RNG_PARTS.integers(97, 123, 8 << 20, dtype=np.uint8)
    tracemalloc.start()
    found = suffix_dedup.anchors(data, np.array([0, len(data)]), 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found["high"] - found["low"] + 1).sum() == len(data) - 399
    assert peak < 400 << 20
