"""Search, mixing, packing and the pipeline."""

from __future__ import annotations

import zlib
from collections import defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftlens.llm import mtree, queries, retrieval_packing, source_mixing
from tests.check_oracles import compare, connect


def best(rows, every, k):
    table = {i: np.floor(np.array(v) * 64) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    width = max(len(v) for v in table.values())
    table = {i: np.pad(v, (0, width - len(v))) for i, v in table.items()}
    out = []
    for q in sorted(i for i in table if i % every == 0):
        scored = sorted((-int(table[q] @ v), i) for i, v in table.items() if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize("sizes", [(16_384, 1024, 20_000), (40, 5, 20_000), (40, 5, 0)])
def test_search_matches_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("SHARD_ROWS", "QUERY_BLOCK", "MOST_ROUTED"), sizes, strict=True):
        monkeypatch.setattr(mtree, name, value)
    monkeypatch.setattr(mtree, "LEAF", 8)
    monkeypatch.setattr(mtree, "FANOUT", 3)
    draw = np.random.default_rng(0)
    center = draw.normal(0, 1, (4, 6))
    rows = [(i, (center[i % 4] + draw.normal(0, 0.1, 6)).tolist()) for i in range(250)]
    rows += [(1000 + i, [0.5] * 6) for i in range(80)]  # equal vectors
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")]), (2060, [1.0, float("inf")]), (2080, [3.0]), (2100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS id")
    want = best(rows, 20, 20)
    got = [tuple(r) for r in mtree.top_products(df.unionByName(df.limit(3))).collect()]
    assert sorted(got) == want


def test_search_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert mtree.top_products(spark.createDataFrame([], schema)).count() == 0
    assert mtree.top_products(spark.createDataFrame([(20, [1.0])], schema)).count() == 0
    two = mtree.top_products(spark.createDataFrame([(20, [1.0]), (21, [-0.5]), (None, [9.0])], schema)).collect()
    assert [tuple(r) for r in two] == [(20, 1, 21, -2048)]
    with pytest.raises(ValueError):
        mtree.top_products(spark.createDataFrame([(20, [1e30]), (1, [1.0])], schema))


def test_mixing_awkward_rows_matches_sql(spark, awkward, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(source_mixing, "DOCS_TOGETHER", 2)
    monkeypatch.setattr(source_mixing, "SLOTS_TOGETHER", 8)
    docs = awkward.select("doc_id", "text", "source")
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(source_mixing.SQL).fetchall()
    got = source_mixing.mix_sources(awkward).docs.collect()
    key = lambda r: repr(tuple(r))
    # The block size decides nothing but which words are in a slot together.
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert source_mixing.mix_sources(empty).docs.count() == 0


def test_schedule_is_even_and_complete(spark, folder):
    mix = source_mixing.mix_sources(spark.read.parquet(f"{folder}/documents.parquet"), block=32)
    slots = sorted(tuple(r) for r in mix.slots.collect())
    targets = {r.src: r.target for r in mix.sources.collect()}
    words = defaultdict(int)
    for _, src, _, _, start, stop in slots:
        words[src] += stop - start
    assert dict(words) == {s: int(t) for s, t in targets.items() if int(t)}
    whole, seen = sum(targets.values()), defaultdict(int)
    for n, (_, src, *_) in enumerate(slots[: len(slots) // 2], 1):
        seen[src] += 1
        assert abs(seen[src] - n * targets[src] / whole) < 8
    taken = mix.docs.collect()
    assert all(0 <= r.taken <= 2 * r.size for r in taken)


def test_schedule_of_over_two_to_the_23_slots(spark):
    slots, few = (1 << 23) + 5, 2000
    rows = [(0, slots - few, slots - few, 0, slots - few), (1, few, few, 0, few)]
    plan = spark.createDataFrame(rows, "src long, blocks long, first long, again long, slots long")
    found = source_mixing._schedule(spark, plan, slots, 2, 1)
    counts = found.groupBy("src").agg(F.count("*"), F.sum("stop") - F.sum("start"), F.max("block")).collect()
    assert sorted(map(tuple, counts)) == [(0, slots - few, slots - few, slots - few - 1), (1, few, few, few - 1)]


def check_packing(rows, got, path=None):
    """Check pieces against whole encodings; return how many tokens lie in windows of one text kind."""
    encode = retrieval_packing.encoder(path).tokenizer.encode
    ids = lambda t: np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    want = sorted(((r.doc_id is None, r.doc_id or 0, len(ids(r.text)), ids(r.text).tobytes()) for r in rows))
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # never padded
    by_key = defaultdict(list)
    for none, key, _, body in want:
        by_key[None if none else key].append(np.frombuffer(body, "<u4"))
    assert set(by_key) == set(pieces)
    for key, bodies in by_key.items():
        assert sum(len(b) for b in bodies) == sum(p.length for p in pieces[key])
        for p in pieces[key]:
            assert any(len(b) == p.doc_tokens and zlib.crc32(b[p.start : p.start + p.length]) == p.ids_crc32 for b in bodies)
        if len(bodies) == 1:
            at = 0
            for p in sorted(pieces[key], key=lambda p: p.start):
                assert p.start == at
                at += p.length


@pytest.mark.parametrize("shard_bytes", [8 << 20, 1 << 15])
def test_packing_keeps_every_token(spark, folder, awkward, empty, monkeypatch, shard_bytes):
    monkeypatch.setattr(retrieval_packing, "SHARD_BYTES", shard_bytes)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    docs = docs.filter("doc_id > 100").unionByName(awkward.select("doc_id", "text"))
    odd = spark.createDataFrame([(9001, "a<|endoftext|> b\u2028c\x1c d\u00a0e"), (9002, "<|endoftext|>")], "doc_id long, text string")
    docs = docs.unionByName(odd)
    got = [tuple(r) for r in retrieval_packing.pack_documents(docs).collect()]
    check_packing(docs.collect(), retrieval_packing.pack_documents(docs.repartition(3)).collect())
    assert sorted(got, key=repr) == sorted((tuple(r) for r in retrieval_packing.pack_documents(docs.repartition(5)).collect()), key=repr)
    assert retrieval_packing.pack_documents(empty).count() == 0


def test_texts_are_told_by_their_bytes(monkeypatch):
    """Texts go to the same encoder as by the pattern, and most are told without it."""
    encode = retrieval_packing.encoder(None)
    odd = ["", "<|", "a<|b", "\x00", "a\x1c", "\xa0", "\xa1", "\u023f", "\u0240", "\u024f", "\u0250", "\u00e9<|",
           "\u2028", "\u65e5\u672c", "\x7f", "\x80", "\u00ab a", " ~\t\n\r", "\u00e9\u00ff\u0100"]
    assert [encode.is_unusual(t) for t in odd] == [encode.unusual.search(t) is not None for t in odd]
    monkeypatch.setattr(encode, "unusual", None)
    assert not encode.is_unusual("Plain text, caf\u00e9 and stra\u00dfe.\n") and encode.is_unusual("a <|endoftext|>")


def test_neighbours_are_lexically_close():
    draw = np.random.default_rng(2)
    topics = [draw.integers(100 * t, 100 * t + 60, (12, 300)).astype(np.uint32) for t in range(1, 6)]
    docs = [topics[i % 5][i // 5] for i in range(60)]
    seen = np.zeros(1000)
    for d in docs:
        seen[np.unique(d)] += 1
    windows = retrieval_packing.pack_shard(docs, np.log1p((60 - seen + 0.5) / (seen + 0.5)), 300.0)
    full = [w for w in windows if sum(b - a for _, a, b in w) == 2048]
    mixed = sum(len({doc % 5 for doc, _, _ in w}) > 2 for w in full)
    assert full and mixed == 0


def test_neighbours_are_found_by_whole_documents(spark):
    """Long documents tell their topic in the windows that are cut off, and share their ends."""
    draw = np.random.default_rng(3)
    words = lambda t, n: " ".join(f"{'bcdfg'[t]}{'aeiou'[w]}{'lmnrs'[w % 3]}{w}" for w in draw.integers(0, 5, n))
    rows = [(t, words(t, 400) + " the same end" * 1500) for t in range(5)]
    rows += [(10 + 5 * i + t, words(t, 100) + " the same end") for i in range(30) for t in range(5)]
    got = retrieval_packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    ends = [s for s in sequences.values() if any(r.doc_id < 10 for r in s) and len(s) > 1]
    assert {r.doc_id for s in ends for r in s if r.doc_id < 10} == set(range(5))
    assert all(len({r.doc_id % 5 for r in s}) <= 2 for s in ends)


def test_pipeline_stages_keep_their_promises(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    check_packing(docs.collect(), corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect())
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


def test_pipeline_takes_awkward_rows(spark, awkward, empty, folder):
    for docs in (awkward, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns
            out.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, folder, name):
    problem, rows = compare(spark, connect(folder), name, queries.QUERIES[name], queries.ORACLES[name], folder)
    assert problem is None and rows > 0
