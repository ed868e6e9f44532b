"""Operators that judge rows by themselves: URLs, repetition, toxicity, quality."""

from __future__ import annotations

import fnmatch
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shiftlens.llm import quality_bayes, repetition, toxicity_cnn, url_automaton


def test_automaton_matches_globs():
    draw = random.Random(4)
    globs = ["".join(draw.choice("ab.*?") for _ in range(draw.randint(0, 25))) for _ in range(60)]
    texts = ["".join(draw.choice("ab.c") for _ in range(draw.randint(0, 30))) for _ in range(400)] + ["a" * 300]
    hits = url_automaton.Automaton([g.encode() for g in globs]).matches([t.encode() for t in texts])
    for i, text in enumerate(texts):
        assert hits[i].tolist() == [fnmatch.fnmatchcase(text, g) for g in globs], text


def test_urls(spark, empty):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "example.com/en/": ("", "", None, "allow"),
        "http://EXAMPLE.com/en/x?q=/fr/": ("example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "x://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "http://a.net/es/1#t": ("a.net", "/es/1", "net/es/", "block"), "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "http://a.net/de/": ("a.net", "/de/", None, "allow"), "http://a.net": ("a.net", "", None, "allow"),
        "http://casino-win.org/": ("casino-win.org", "/", None, "block"),
        "http://casino.com/": ("casino.com", "/", "com/", "allow"), "http://a.org/casino": ("a.org", "/casino", None, "allow"),
        "http://x.org/y.com/en/": ("x.org", "/y.com/en/", None, "allow"), "http://com": ("com", "", None, "allow"),
        "http://a.b?c=http://net/es/": ("a.b", "", None, "allow"), "http://É.com/é": ("É.com", "/é", "com/", "allow"),
        "http://" + "a" * 5000 + ".com/": ("a" * 5000 + ".com", "/", "com/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(cases)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_automaton.filter_urls(pages).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert url_automaton.filter_urls(pages.limit(0)).count() == 0


def coverage(text, n):
    """Return (words, characters) inside n-grams found twice or more."""
    words = (text or "").encode().split()
    grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    inside = {i + j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(n)}
    return len(inside), sum(len(words[i].decode()) for i in inside)


@pytest.mark.parametrize("constant_hash", [False, True])
def test_repetition_matches_counting(spark, awkward, folder, monkeypatch, constant_hash):
    if constant_hash:  # all windows share a hash: words alone must decide
        plain = repetition.repeated_starts
        monkeypatch.setattr(repetition, "repeated_starts", lambda w, d, s, n, h: plain(w, d, s, n, h * np.uint64(0)))
        table = repetition.measure(_arrow([r.text for r in awkward.filter("length(text) < 2000").collect()]))
        texts = [r.text for r in awkward.filter("length(text) < 2000").collect()]
        assert table["n_repeat_words"].tolist() == [coverage(t, 8)[0] for t in texts]
        return
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    got = repetition.repetition_coverage(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    for r, (_, text) in zip(got, rows, strict=True):
        text = text or ""
        words = text.encode().split()
        lines = [x for x in text.encode().split(b"\n") if x.split()]
        assert (r.n_words, r.word_chars) == (len(words), sum(len(w.decode()) for w in words))
        assert r.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == coverage(text, 8)[0]
        assert list(r.ngram_chars) == [coverage(text, n)[1] for n in (5, 6, 7, 8, 9, 10)]
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words))
        assert r.kept == (not r.base_failed and r.worst is None)


def _arrow(texts):
    import pyarrow as pa

    return pa.array(texts, pa.string())


def test_repetition_edges(awkward, empty):
    got = {r.doc_id: r for r in repetition.repetition_coverage(awkward).collect()}
    assert got[0].base_failed and not got[0].kept and got[0].n_words == 0
    assert got[12].base_failed and got[12].dup_line_chars > 0 and got[10].kept
    assert repetition.repetition_coverage(empty).count() == 0


def test_toxicity_on_held_out_rows(spark, awkward, empty):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity_cnn.toxicity(spark, docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    held = [r for r in got.collect() if r.held_out]
    clean = [r.predicted for r in held if not r.toxic]
    english = [r.predicted for r in held if r.toxic and r.lang == "en"]
    assert len(clean) > 50 and sum(clean) <= 0.03 * len(clean)
    assert len(english) > 5 and sum(english) >= 0.9 * len(english)
    model = toxicity_cnn.fit_model(docs, labels)
    again = toxicity_cnn.Cnn.load(model.dump())
    scored = toxicity_cnn.score_toxicity(awkward, again)
    assert scored.columns == [*awkward.columns, "tox_score", "tox_rejected"] and scored.count() == awkward.count()
    assert all(0 <= r.tox_score <= 1 for r in scored.collect())
    scores = {(r.text or "").strip(): r.tox_score for r in scored.collect() if not (r.text or "").strip()}
    assert len(scores) == 1
    assert toxicity_cnn.score_toxicity(empty, model).count() == 0


def test_toxicity_without_labels(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(7, None), (None, 1), (8, 1), (8, 0)], "doc_id long, toxic int")
    for labels in (none, odd):
        got = toxicity_cnn.toxicity(spark, awkward, labels).collect()
        assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)


def test_bounded_labels_decide_as_all_do(spark, monkeypatch):
    """Scores are moved to the true rate of toxic rows; thresholds must be of the same scale."""
    groups = {"qwertyu": (6000, 0.02), "zxcvbnm": (1500, 0.2), "plokmij": (50, 0.9)}
    drawn = [w for w, (n, _) in groups.items() for _ in range(n)]
    toxic = [int(k < n * share) for n, share in groups.values() for k in range(n)]
    docs = spark.createDataFrame([(i, w, "en") for i, w in enumerate(drawn)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    asked = spark.createDataFrame([(k, w, "en") for k, w in enumerate(groups)], docs.schema)
    for most_toxic, most_clean in ((3000, 9000), (3000, 700), (150, 700)):
        monkeypatch.setattr(toxicity_cnn, "MOST_TOXIC", most_toxic)
        monkeypatch.setattr(toxicity_cnn, "MOST_CLEAN", most_clean)
        scored = toxicity_cnn.score_toxicity(asked, toxicity_cnn.fit_model(docs, labels))
        # Of all rows, the best F1 takes the second group, a fifth of which is toxic.
        assert {r.doc_id: r.tox_rejected for r in scored.collect()} == {0: False, 1: True, 2: True}


def test_every_labelled_row_is_fitted_on(spark, frame_of_words, monkeypatch):
    """A word that only rows beyond one task's bound hold is learnt, and any partitioning fits alike."""
    docs, labels = frame_of_words
    monkeypatch.setattr(toxicity_cnn, "MOST_TOXIC", 60)
    monkeypatch.setattr(toxicity_cnn, "MOST_CLEAN", 60)
    model = toxicity_cnn.fit_model(docs, labels)
    asked = spark.createDataFrame([(i, f"plain talk {i:02d}word", "en") for i in range(100)], docs.schema)
    scores = [r.tox_score for r in toxicity_cnn.score_toxicity(asked, model).collect()]
    plain = spark.createDataFrame([(0, "plain talk here", "en")], docs.schema)
    base = toxicity_cnn.score_toxicity(plain, model).first().tox_score
    assert sum(s > 2 * base for s in scores) >= 95
    again = toxicity_cnn.fit_model(docs.repartition(5), labels.repartition(3))
    assert np.allclose(again.flat(), model.flat()) and again.thresholds == model.thresholds
    assert np.allclose([again.slope, again.offset], [model.slope, model.offset])


def test_each_of_many_tasks_makes_all_passes(spark, frame_of_words, monkeypatch):
    """The weights are the mean of what every task's rows give in as many passes as one task makes."""
    monkeypatch.setattr(toxicity_cnn, "MOST_TOXIC", 1000)
    docs, labels = frame_of_words
    model = toxicity_cnn.fit_model(docs, labels)
    rows = docs.join(labels, "doc_id").filter(toxicity_cnn.remainder("doc_id", 4) != 2)
    known = rows.agg(F.sum("toxic"), F.count("*")).first()
    tasks = -(-known[0] // 1000)
    assert tasks > 2
    rows = rows.withColumn("task", F.pmod(F.xxhash64("doc_id"), F.lit(tasks))).orderBy("doc_id").collect()
    rows = [r for r in rows if xxhash.xxh32_intdigest(str(r.doc_id).encode()) % 4]
    codes = toxicity_cnn.WordCodes()
    prior = toxicity_cnn.prior_of(*known)

    def part(some):
        words, flat = toxicity_cnn.numbered([codes(r.text.encode().split()) for r in some])
        return words, flat, np.array([r.toxic for r in some], np.float32)

    def start():
        model = toxicity_cnn.blank(prior, np.random.default_rng(4))
        return toxicity_cnn.started(model, prior, *toxicity_cnn.bucket_counts(*part(rows)))

    want = []
    for task in range(tasks):
        mine, some = start(), [r for r in rows if r.task == task]
        draw = np.random.default_rng((4, task))
        toxicity_cnn.descend(mine, *part(some), np.arange(len(some)), draw, toxicity_cnn.EPOCHS)
        want.append(mine.flat())
    assert np.allclose(model.flat(), np.mean(want, axis=0), atol=1e-5)


@pytest.fixture
def frame_of_words(spark):
    """Each of 100 words marks 40 toxic texts, and is in no clean one."""
    rows = [(i, f"plain talk {i % 100:02d}word" if i < 4000 else f"plain talk {i % 100:02d}nice", "en") for i in range(8000)]
    labels = [(i, int(i < 4000)) for i in range(8000)]
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_gradients_match_differences():
    draw = np.random.default_rng(1)
    codes = draw.integers(0, 1 << 63, 30, dtype=np.uint64)
    words = [draw.integers(0, 30, n) for n in (5, 1, 0, 9)]
    labels = np.array([1, 0, 1, 0], np.float32)
    shape = (toxicity_cnn.FILTERS * len(toxicity_cnn.WIDTHS),)
    model = toxicity_cnn.Cnn(
        draw.normal(0, 1, (toxicity_cnn.BUCKETS, toxicity_cnn.SIZE)),
        [draw.normal(0, 0.3, (k, toxicity_cnn.SIZE, toxicity_cnn.FILTERS)) for k in toxicity_cnn.WIDTHS],
        draw.normal(0, 0.1, shape), draw.normal(0, 0.5, shape), 0.1,
    )

    def loss():
        z = model.logits(words, codes)
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    grads, touched = toxicity_cnn._gradients(model, words, codes, labels)
    bucket = codes.view(np.uint16)[8]
    places = [(model.out, grads[5], 3), (model.bias, grads[4], 2), (model.filters[1], grads[2], (1, 2, 3)),
              (model.filters[2], grads[3], (2, 0, 1))]
    places.append((model.table, {(bucket, 2): grads[0][np.searchsorted(touched, bucket), 2]}, (bucket, 2)))
    for array, grad, at in places:
        array[at] += 1e-4
        up = loss()
        array[at] -= 2e-4
        down = loss()
        array[at] += 1e-4
        assert grad[at] == pytest.approx((up - down) / 2e-4, abs=2e-3)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = quality_bayes.site_quality(docs, labels).join(labels, "doc_id").filter("crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2")
    right = Counter((r.quality, r.kept) for r in got.collect())
    assert right[1, True] >= 0.98 * (right[1, True] + right[1, False])
    assert right[0, False] >= 0.9 * (right[0, False] + right[0, True])


def test_sites_shrink_towards_the_whole(spark):
    rows = [(i, "ab cd " * 3, "a", "big") for i in range(300)] + [(1000, "ab cd " * 3, "a", "small")]
    rows += [(2000 + i, "# # # # " * 5, "b", "bad") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], int(r[3] == "big")) for r in rows if r[3] != "small"], "doc_id long, quality int")
    by_site = {r.doc_id: r for r in quality_bayes.site_quality(docs, labels).collect()}
    whole = sum(r.doc_score for r in by_site.values()) / len(by_site)
    assert by_site[0].host_posterior > 0.9 > by_site[1000].host_posterior > 0.1 > by_site[2000].host_posterior
    assert abs(by_site[1000].host_posterior - whole) < 0.01  # nothing else is known of its site
    assert by_site[0].kept and not by_site[2000].kept


def test_quality_edges(spark, awkward, empty):
    labels = spark.createDataFrame([(7, 1), (13, 0), (8, None), (None, 1)], "doc_id long, quality int")
    got = quality_bayes.site_quality(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 < r.score < 1 for r in got)
    assert quality_bayes.site_quality(empty, labels).count() == 0
    assert quality_bayes.site_quality(awkward, labels.limit(0)).count() == awkward.count()
