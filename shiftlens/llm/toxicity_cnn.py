"""Toxicity by a convolutional text classifier, trained and run in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first 4, 5 and 6 bytes, so
inflected forms share what they begin with. Filters of widths 1, 2 and 3 slide over the words,
the largest activation of each filter in the whole text is kept (max pooling), and a logistic
layer reads them. Scores are calibrated on labelled rows that the fit did not see, and each
language gets its own threshold there. All labelled rows count: what one task does not fit, many
fit from the same start on a part each, in as many passes as one would make, and their weights are
averaged.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.llm.texts import CACHED_WORDS, chunks, remainder, texts_of
from shiftlens.session import discard, materialize

BUCKETS, SIZE = 1 << 16, 8
WIDTHS, FILTERS = (1, 2, 3), 8
PREFIXES = (4, 5, 6)
#: The most labelled rows of each class that one task fits on; more are dealt to more tasks.
MOST_TOXIC, MOST_CLEAN = 3000, 9000
#: Models that one task adds up.
MODELS_AT_ONCE = 16
#: Passes over the rows of the fit, whatever number of tasks they are dealt to.
EPOCHS, BATCH, RATE = 6, 64, 0.05
#: Rows that the prior counts for in the log-odds that embeddings start from.
PRIOR_ROWS = 10.0
#: Labelled rows of a class below which a language keeps the common threshold.
LANGUAGE_ROWS = 20
THRESHOLD = 0.3
#: Thresholds that a language may get.
GRID = np.round(np.arange(0.1, 0.61, 0.05), 2)
PUNCTUATION = b".,;:!?\"'()[]{}|#*$%&<>/\\-_"


class WordCodes:
    """Four 16-bit bucket numbers of each word, packed to 64 bits, in a bounded table."""

    def __init__(self) -> None:
        self.table: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        table = self.table
        if len(table) > CACHED_WORDS:
            table.clear()
        for word in set(words).difference(table):
            core = word.strip(PUNCTUATION) or word
            code = xxhash.xxh32_intdigest(core) & 0xFFFF
            for k, n in enumerate(PREFIXES, 1):
                code |= (xxhash.xxh32_intdigest(core[:n], n) & 0xFFFF) << (16 * k)
            table[word] = code
        return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


@dataclass
class Cnn:
    """Weights: embeddings, filters (one table per width), output layer, calibration."""

    table: np.ndarray
    filters: list[np.ndarray]  # per width k: k x SIZE x FILTERS
    bias: np.ndarray
    out: np.ndarray
    shift: float
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def dump(self) -> bytes:
        file = io.BytesIO()
        numbers = np.array([self.shift, self.slope, self.offset])
        named = {f"filter{k}": f for k, f in zip(WIDTHS, self.filters, strict=True)}
        np.savez(file, table=self.table, bias=self.bias, out=self.out, numbers=numbers,
                 names=np.array(list(self.thresholds), dtype=str),
                 limits=np.array(list(self.thresholds.values()), float), **named)
        return file.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Cnn:
        with np.load(io.BytesIO(data)) as x:
            limits = dict(zip(x["names"].tolist(), x["limits"].tolist(), strict=True))
            return cls(x["table"], [x[f"filter{k}"] for k in WIDTHS], x["bias"], x["out"],
                       *x["numbers"].tolist(), limits)

    def weights(self) -> list[np.ndarray]:
        return [self.table, *self.filters, self.bias, self.out]

    def flat(self) -> np.ndarray:
        """Return all weights as one row of doubles, the shift last."""
        return np.concatenate([*[w.ravel() for w in self.weights()], [self.shift]]).astype(float)

    def filled(self, flat: np.ndarray) -> Cnn:
        """Take the weights from such a row."""
        at = 0
        for w in self.weights():
            w[...] = flat[at : at + w.size].reshape(w.shape)
            at += w.size
        self.shift = float(flat[at])
        return self

    def activations(self, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Return what each filter makes of the window that begins at each place."""
        columns = []
        for k, weights in zip(WIDTHS, self.filters, strict=True):
            by_word = [vectors @ w for w in weights]
            total = by_word[0][index]
            for j in range(1, k):
                total[: len(index) - j] += by_word[j][index[j:]]
            columns.append(total)
        return np.concatenate(columns, axis=1)

    def logits(self, words: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
        """Return the uncalibrated logit of texts given as indices into ``codes``."""
        index, start, size = padded(words, len(codes))
        vectors = np.vstack([self.vectors(codes), np.zeros((1, SIZE), np.float32)])
        edges = np.column_stack([start, start + size]).ravel()
        pooled = np.maximum.reduceat(self.activations(vectors, index), edges[:-1], axis=0)[::2]
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        return self.table[codes.view(np.uint16).reshape(-1, 4)].sum(axis=1)

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -30, 30)))


def padded(words: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lay texts end to end with blanks between; an empty text is one blank."""
    size = np.array([max(1, len(w)) for w in words])
    gap = max(WIDTHS)
    start = np.concatenate([[0], np.cumsum(size + gap)[:-1]])
    index = np.full(int((size + gap).sum()), pad, np.int64)
    for at, w in zip(start, words, strict=True):
        index[at : at + len(w)] = w
    return index, start, size


def indexed(texts: list[bytes], codes: WordCodes) -> tuple[list[np.ndarray], np.ndarray]:
    """Return each text as indices into the codes of the distinct words of all."""
    ids: dict[bytes, int] = {}
    words = []
    for text in texts:
        split = text.lower().split()
        words.append(np.fromiter((ids.setdefault(w, len(ids)) for w in split), np.int64, len(split)))
    return words, codes(list(ids))


def numbered(codes: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Return each text as indices into the distinct codes of all, which come in order."""
    flat = np.unique(np.concatenate([*codes, np.zeros(0, np.uint64)]))
    return [np.searchsorted(flat, c) for c in codes], flat


def prior_of(toxic: float, rows: int) -> float:
    return (toxic + 0.5) / (rows + 1.0)


def blank(prior: float, draw: np.random.Generator) -> Cnn:
    """Return a model of drawn weights whose score is the prior."""
    table = draw.normal(0, 0.05, (BUCKETS, SIZE)).astype(np.float32)
    filters = [draw.normal(0, 0.2, (k, SIZE, FILTERS)).astype(np.float32) for k in WIDTHS]
    out = draw.normal(0, 0.05, FILTERS * len(WIDTHS)).astype(np.float32)
    return Cnn(table, filters, np.zeros_like(out), out, float(np.log(prior / (1 - prior))))


def bucket_counts(words: list[np.ndarray], flat: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count the texts, and the toxic ones, that each bucket occurs in."""
    seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    pieces = flat.view(np.uint16).reshape(-1, 4)
    for w, label in zip(words, labels, strict=True):
        b = np.unique(pieces[np.unique(w)])
        seen[b] += 1
        toxic[b] += label
    return seen, toxic


def started(model: Cnn, prior: float, seen: np.ndarray, toxic: np.ndarray) -> Cnn:
    """Start the first coordinate as the shrunken log-odds of a bucket's documents."""
    share = (toxic + PRIOR_ROWS * prior) / (seen + PRIOR_ROWS)
    model.table[:, 0] = (np.log(share / (1 - share)) - model.shift) / 4
    for weights in model.filters:
        weights[:, 0, 0] = 1.0
    model.out[::FILTERS] = 1.0
    return Cnn(model.table, model.filters, np.full(len(model.out), -0.3, np.float32), model.out, -3.0)


def descend(
    model: Cnn, words: list[np.ndarray], flat: np.ndarray, labels: np.ndarray, rows: np.ndarray,
    draw: np.random.Generator, epochs: int,
) -> None:
    """Fit the weights to the given rows by passes of adaptive gradient steps."""
    params = [model.table, *model.filters, model.bias, model.out, np.array([model.shift], np.float32)]
    history = [np.full_like(p, 0.1) for p in params]
    for _ in range(epochs):
        draw.shuffle(rows)
        for at in range(0, len(rows), BATCH):
            some = rows[at : at + BATCH]
            grads, touched = _gradients(model, [words[r] for r in some], flat, labels[some])
            for k, (p, h, g) in enumerate(zip(params, history, grads, strict=True)):
                where = touched if k == 0 else slice(None)
                h[where] += g * g
                p[where] -= RATE * g / np.sqrt(h[where])
            model.shift = float(params[-1][0])


def all_logits(model: Cnn, words: list[np.ndarray], flat: np.ndarray) -> np.ndarray:
    return np.concatenate([model.logits(words[i : i + 64], flat) for i in range(0, len(words), 64)])


def train(codes: list[np.ndarray], labels: np.ndarray, langs: list, fit: np.ndarray) -> Cnn:
    """Fit on the rows of ``fit`` and calibrate on the others (on all, if those lack a class)."""
    draw = np.random.default_rng(4)
    words, flat = numbered(codes)
    prior = prior_of(labels.sum(), len(labels))
    model = blank(prior, draw)
    rows = np.flatnonzero(fit)
    if not len(rows) or labels[rows].min() == labels[rows].max():
        model.out *= 0
        return model
    model = started(model, prior, *bucket_counts([words[r] for r in rows], flat, labels[rows]))
    descend(model, words, flat, labels, rows, draw, EPOCHS)
    held = np.flatnonzero(~fit)
    if not len(held) or labels[held].min() == labels[held].max():
        held = np.arange(len(labels))
    logits = all_logits(model, words, flat)
    model.slope, model.offset = platt(logits[held], labels[held])
    scores = model.calibrated(logits)
    model.thresholds = language_thresholds(scores[held], labels[held], [langs[i] for i in held])
    return model


def _gradients(model: Cnn, words: list[np.ndarray], codes: np.ndarray, labels: np.ndarray):
    """Return the gradients of the logistic loss, the embeddings' for the touched rows only."""
    used, inverse = np.unique(np.concatenate([*words, np.zeros(0, np.int64)]), return_inverse=True)
    cuts = np.cumsum([len(w) for w in words])[:-1]
    index, start, size = padded(np.split(inverse, cuts), len(used))
    vectors = np.vstack([model.vectors(codes[used]), np.zeros((1, SIZE), np.float32)])
    acts = model.activations(vectors, index)
    best = np.array([acts[a : a + n].argmax(axis=0) + a for a, n in zip(start, size, strict=True)])
    pooled = np.maximum(np.take_along_axis(acts, best, axis=0) + model.bias, 0)
    logit = pooled @ model.out + model.shift
    error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels).astype(np.float32) / len(labels)
    down = error[:, None] * model.out * (pooled > 0)
    pieces = np.vstack([codes[used].view(np.uint16).reshape(-1, 4), np.zeros((1, 4), np.uint16)])
    filter_grads, where, what = [], [], []
    for c, weights in enumerate(model.filters):
        some = slice(c * FILTERS, (c + 1) * FILTERS)
        grad = np.zeros_like(weights)
        for j in range(len(weights)):
            token = index[best[:, some] + j]
            grad[j] = np.einsum("bfs,bf->sf", vectors[token], down[:, some])
            real = token < len(used)
            where.append(pieces[token[real]])
            what.append((down[:, some, None] * weights[j].T[None])[real])
        filter_grads.append(grad)
    buckets, values = np.concatenate(where), np.concatenate(what)
    touched, at = np.unique(buckets.ravel(), return_inverse=True)
    table_grad = np.zeros((len(touched), SIZE), np.float32)
    np.add.at(table_grad, at, np.repeat(values, 4, axis=0))
    return [table_grad, *filter_grads, down.sum(axis=0), error @ pooled, error.sum(keepdims=True)], touched


def platt_goal(toxic: float, clean: float) -> tuple[float, float]:
    """Return the smoothed targets of toxic and clean rows."""
    return (toxic + 1) / (toxic + 2), 1 / (clean + 2)


def platt_steps(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[float, float]:
    """Fit slope and offset of a logistic curve by Newton steps.

    ``sums`` gives, for a slope and an offset, the gradient and the curvature summed over the rows.
    """
    w = np.array([1.0, 0.0])
    for _ in range(50):
        slope, curve = sums(w)
        step = np.linalg.solve(curve + 1e-3 * np.eye(2), slope + 1e-3 * (w - [1.0, 0.0]))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def platt(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Fit a logistic curve to the labels of a few rows, with smoothed targets."""
    high, low = platt_goal(labels.sum(), len(labels) - labels.sum())
    goal = np.where(labels > 0, high, low)
    x = np.column_stack([logits, np.ones(len(logits))])

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return x.T @ (p - goal), (x * (p * (1 - p))[:, None]).T @ x

    return platt_steps(sums)


def best_threshold(hits: Sequence[float], taken: Sequence[float], toxic: float) -> float:
    """Return the threshold of the best F1, of equally good ones the nearest to the common one."""
    f1 = [2 * h / max(1, t + toxic) for h, t in zip(hits, taken, strict=True)]
    best = GRID[np.array(f1) >= max(f1) - 1e-12]
    return float(best[np.abs(best - THRESHOLD).argmin()])


def language_thresholds(scores: np.ndarray, labels: np.ndarray, langs: list) -> dict[str, float]:
    """Return, per language with enough rows of both classes, the threshold of the best F1."""
    found = {}
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.array([x == lang for x in langs])
        y, s = labels[mine], scores[mine]
        if min(y.sum(), len(y) - y.sum()) < LANGUAGE_ROWS:
            continue
        hits = [((s >= t) & (y > 0)).sum() for t in GRID]
        found[lang] = best_threshold(hits, [(s >= t).sum() for t in GRID], (y > 0).sum())
    return found


def fit_spread(coded: DataFrame, workers: int) -> Cnn:
    """Fit on all coded rows in ``workers`` tasks, as ``train`` does in one.

    All start from the same weights, whose log-odds count every row of the fit; each makes all
    ``EPOCHS`` passes over the rows dealt to it by hash of the id, and the weights are averaged.
    Curve and thresholds come from sums over all rows held back.
    """
    spark = coded.sparkSession
    table = materialize(coded.withColumn("worker", F.pmod(F.xxhash64("id"), F.lit(workers))))
    bad = F.col("toxic") > 0
    count = {(r[0], r[1]): r[2] for r in table.groupBy("fit", bad).agg(F.count("*")).collect()}
    rows, toxic = sum(count.values()), sum(n for (_, t), n in count.items() if t)
    prior = prior_of(toxic, rows)
    model = blank(prior, np.random.default_rng(4))
    if not (count.get((True, True)) and count.get((True, False))):
        model.out *= 0
        return model

    def read(batch: pa.RecordBatch | pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        words, flat = numbered([np.frombuffer(c, np.uint64) for c in batch["codes"]])
        return words, flat, (np.array(batch["toxic"], float) > 0).astype(np.float32)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            some = bucket_counts(*read(batch.to_pandas()))
            seen, toxic = seen + some[0], toxic + some[1]
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, seen[used], toxic[used])], names=["b", "n", "t"])

    seen, bucket_toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    tallies = table.filter("fit").select("codes", "toxic").mapInArrow(tally, "b long, n double, t double")
    for b, n, t in tallies.groupBy("b").agg(F.sum("n"), F.sum("t")).collect():  # one row per bucket
        seen[b], bucket_toxic[b] = n, t
    start = spark.sparkContext.broadcast(started(model, prior, seen, bucket_toxic).dump())

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "codes"])
        mine, worker = Cnn.load(start.value), int(frame["worker"].iloc[0])
        descend(mine, *read(frame), np.arange(len(frame)), np.random.default_rng((4, worker)), EPOCHS)
        return pd.DataFrame({"worker": [worker], "n": [1], "weights": [mine.flat().tobytes()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("worker")
        total = sum(np.frombuffer(x) for x in frame["weights"])
        return pd.DataFrame({"worker": frame["worker"].iloc[:1], "n": [frame["n"].sum()], "weights": [total.tobytes()]})

    schema, left = "worker long, n long, weights binary", workers
    sums = table.filter("fit").groupBy("worker").applyInPandas(learn, schema)
    while left > 1:
        left = -(-left // MODELS_AT_ONCE)
        sums = sums.withColumn("worker", F.floor(F.col("worker") / MODELS_AT_ONCE)).groupBy("worker").applyInPandas(add, schema)
    _, n, weights = sums.first()
    model = Cnn.load(start.value).filled(np.frombuffer(weights) / n)

    held = (False, True) in count and (False, False) in count
    fitted = spark.sparkContext.broadcast(model.dump())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn = Cnn.load(fitted.value)
        for batch in batches:
            words, flat, _ = read(batch.to_pandas())
            logits = all_logits(cnn, words, flat).astype(float) if words else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("toxic"), pa.array(logits)], names=["lang", "toxic", "logit"]
            )

    chosen = table.filter("NOT fit") if held else table
    kind = table.schema["toxic"].dataType.simpleString()
    logits = materialize(
        chosen.select("lang", "toxic", "codes").mapInArrow(score, f"lang string, toxic {kind}, logit double")
    )
    keys = [(False, x) if held else (y, x) for x in (True, False) for y in ((False,) if held else (False, True))]
    high, low = platt_goal(*(sum(count.get(k, 0) for k in set(keys) if k[1] is x) for x in (True, False)))

    def curve(w: np.ndarray) -> Column:
        at = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("logit") * float(w[0]) + float(w[1])))
        return 1 / (1 + F.exp(-at))

    def newton(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, x = curve(w), F.col("logit")
        off, bend = p - F.when(bad, high).otherwise(low), p * (1 - p)
        a, b, c, d, e = logits.agg(*map(F.sum, (off * x, off, bend * x * x, bend * x, bend))).first()
        return np.array([a, b]), np.array([[c, d], [d, e]])

    model.slope, model.offset = platt_steps(newton)
    judged = logits.select("lang", bad.alias("bad"), curve(np.array([model.slope, model.offset])).alias("s"))
    by_lang = judged.filter("lang IS NOT NULL").groupBy("lang").agg(
        F.count_if("bad").alias("toxic"), F.count_if(~F.col("bad")).alias("clean"),
        F.array(*[F.count_if(F.col("bad") & (F.col("s") >= float(t))) for t in GRID]).alias("hits"),
        F.array(*[F.count_if(F.col("s") >= float(t)) for t in GRID]).alias("taken"),
    )
    enough = by_lang.filter(F.least("toxic", "clean") >= LANGUAGE_ROWS).orderBy("lang")
    model.thresholds = {r.lang: best_threshold(r.hits, r.taken, r.toxic) for r in enough.collect()}
    discard(table, logits)
    return model


def fit_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Cnn:
    """Train on all labelled rows but those whose crc32 of the key modulo 4 is 2.

    Three quarters of them fit the weights and a quarter calibrates. Keys labelled twice count as
    toxic if either row is; null labels and keys are left out. The model, of fixed size, is trained
    in one task on up to ``MOST_TOXIC`` and ``MOST_CLEAN`` rows, and beyond that in as many as
    these go into all.
    """
    known = (
        labels.select(F.col(key).alias("id"), "toxic").dropna().groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .filter(remainder("id", 4) != 2)
    )
    total = known.agg(F.sum((F.col("toxic") > 0).cast("long")), F.count("*")).first()
    toxic, clean = int(total[0] or 0), int(total[1]) - int(total[0] or 0)
    workers = max(1, -(-toxic // MOST_TOXIC), -(-clean // MOST_CLEAN))
    langs = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), langs.alias("lang"))
    # For one task, MOST_TOXIC + MOST_CLEAN labels at most. More are merged whatever their size.
    sample = rows.filter(remainder("id", 4) != 2).join(known.hint("broadcast" if workers == 1 else "merge"), "id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in chunks(batches):
            coded = [codes(t.lower().split()).tobytes() for t in texts_of(batch.column("text"))]
            fit = [xxhash.xxh32_intdigest(str(i).encode()) % 4 != 0 for i in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "toxic", "lang")), pa.array(coded, pa.binary()), pa.array(fit, pa.bool_())],
                names=["id", "toxic", "lang", "codes", "fit"],
            )

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "codes"])
        codes = [np.frombuffer(c, np.uint64) for c in frame["codes"]]
        y = (frame["toxic"].to_numpy() > 0).astype(np.float32)
        model = train(codes, y, [None if pd.isna(x) else x for x in frame["lang"]], frame["fit"].to_numpy(bool))
        return pd.DataFrame({"model": [model.dump()]})

    id_type = docs.schema[key].dataType.simpleString()
    toxic_type = labels.schema["toxic"].dataType.simpleString()
    coded = sample.select("id", "text", "lang", "toxic").mapInArrow(
        encode, f"id {id_type}, toxic {toxic_type}, lang string, codes binary, fit boolean"
    )
    if workers > 1:
        return fit_spread(coded, workers)
    found = coded.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(learn, "model binary").collect()
    if found:
        return Cnn.load(bytes(found[0]["model"]))
    return train([], np.zeros(0, np.float32), [], np.zeros(0, bool))


def score_toxicity(docs: DataFrame, model: Cnn, text: str = "text") -> DataFrame:
    """Add ``tox_score`` and ``tox_rejected`` to every row of ``docs``, keeping all its columns.

    The score is of the whole text alone; a null or empty text has the score of no words. The
    language only picks the threshold (0.3 where it has none) that rejects. Columns of these
    names that the table already has are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.dump())
    docs = docs.drop("tox_score", "tox_rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn, codes = Cnn.load(shared.value), WordCodes()
        for batch in chunks(batches, text):
            words, distinct = indexed(texts_of(batch.column(text)), codes)
            score = cnn.calibrated(cnn.logits(words, distinct).astype(np.float64))
            langs = batch.column("lang").to_pylist() if "lang" in batch.schema.names else [None] * len(score)
            limit = np.array([cnn.thresholds.get(x, THRESHOLD) for x in langs])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array(score >= limit)],
                names=[*batch.schema.names, "tox_score", "tox_rejected"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, tox_score double, tox_rejected boolean")


def toxicity(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Return key, held_out, score, predicted (score >= 0.3) and rejected for every document.

    Null keys are scored and count as not held out unless the crc32 of an empty text says so;
    repeated rows are scored alike; without usable labels all scores are the prior of the few
    that there are.
    """
    columns = [F.col(key), F.col(text)] + [F.col(c) for c in ("lang",) if c in docs.columns]
    scored = score_toxicity(docs.select(*columns), fit_model(docs, labels, key, text), text)
    return scored.select(
        key, (remainder(key, 4) == 2).alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("tox_rejected").alias("rejected"),
    )
