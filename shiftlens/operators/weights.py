"""Bootstraps that draw weights inside the row: no draw table, no copies of rows.

A cluster's weight in a replicate is a Poisson(1) variable from a hash of (seed, cluster,
replicate), so any task that meets a row of the cluster draws the same weights without asking.
Rank metrics of all replicates are then computed side by side, as vectors over the replicates:
narrow score counts are dealt to buckets of consecutive scores; a bucket's task walks down its
scores once and returns vectors of partial sums; the buckets of a group are put together last.
Scores that very many clusters share are first summed to one vector each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.ids import hash_order
from shiftlens.operators.ranking import bucket_of, split_points
from shiftlens.session import is_small, materialize, setting

# Cumulative probabilities of a Poisson variable with mean one.
POISSON_STEPS = (
    0.36787944117144233,
    0.7357588823428847,
    0.9196986029286058,
    0.9810118431238462,
    0.9963401531726563,
    0.9994058151824183,
    0.999916758850712,
    0.9999897508033253,
    0.999998874797402,
    0.9999998885745217,
)
#: Rows whose weights a task holds at once.
BLOCK = 512

_U64 = np.uint64


def weight_base(seed: int | str | Column, group: str) -> Column:
    """Return the 60-bit hash of (seed, group) that its weights are drawn from."""
    return F.conv(F.substring(hash_order(seed, group), 1, 15), 16, 10).cast("long")


def poisson_weights(base: np.ndarray, samples: int) -> np.ndarray:
    """Return the weights of groups, given by their ``weight_base``, in all replicates.

    The uniform number behind a weight is the upper 53 bits of ``base + replicate * golden`` after
    two rounds of multiplying and folding.
    """
    x = base.astype(_U64)[:, None] + np.arange(samples, dtype=_U64) * _U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    uniform = ((x ^ (x >> _U64(31))) >> _U64(11)) * 2.0**-53
    out = np.zeros(uniform.shape, np.int64)
    for step in POISSON_STEPS:
        more = uniform > step
        if not more.any():
            break
        out += more
    return out


def weights_sql(groups: str, group: str, samples: int, seed: str) -> str:
    """Return SQL for (group, replicate, w) of the groups of a table, as ``poisson_weights``."""
    wrap = "% 18446744073709551616::UHUGEINT)::UBIGINT"

    def fold(x: str, bits: int, factor: str | None) -> str:
        mixed = f"xor({x}, {x} >> {bits})"
        return f"(({mixed})::UHUGEINT * {factor}::UHUGEINT {wrap}" if factor else mixed

    steps = " + ".join(f"(u > {s!r}::DOUBLE)::BIGINT" for s in POISSON_STEPS)
    return f"""SELECT {group}, replicate, {steps} AS w FROM (
  SELECT {group}, replicate, ({fold("c", 31, None)} >> 11)::DOUBLE / 9007199254740992.0::DOUBLE AS u FROM (
  SELECT {group}, replicate, {fold("b", 27, "10723151780598845931")} AS c FROM (
  SELECT {group}, replicate, {fold("a", 30, "13787848793156543929")} AS b FROM (
  SELECT {group}, r.r AS replicate, ((('0x' || substr(sha256('{seed}|' || {group}), 1, 15))::UHUGEINT
    + r.r::UHUGEINT * 11400714819323198485::UHUGEINT) {wrap} AS a
  FROM (SELECT DISTINCT {group} FROM {groups}), range({samples}) r(r)))))"""


def weighted_sums(
    clusters: DataFrame, by: Sequence[str], group: str, sums: Sequence[str], *, samples: int, seed: int | Column
) -> DataFrame:
    """Add up whole-number columns of clusters in every replicate: one row per group and replicate."""
    by = list(by)
    rows = clusters.select(*by, weight_base(seed, group).alias("_base"), *[F.col(c).cast("long").alias(c) for c in sums])
    vector = ", ".join(f"{c} array<long>" for c in sums)
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{keys}, {vector}" if by else vector

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names = list(zip(*[batch.column(c).to_pylist() for c in by], strict=True)) if by else [()] * batch.num_rows
            number = {k: i for i, k in enumerate(dict.fromkeys(names))}
            at = np.array([number[k] for k in names], np.int64)
            values = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in sums])
            base = batch.column("_base").to_numpy(zero_copy_only=False)
            for start in range(0, len(base), BLOCK):
                part = slice(start, start + BLOCK)
                weights = poisson_weights(base[part], samples)
                for k, i in number.items():
                    mine = at[part] == i
                    if mine.any():
                        added = values[:, part][:, mine] @ weights[mine]
                        held[k] = held[k] + added if k in held else added
        if held:
            columns = [pa.array([k[i] for k in held], batch.schema.field(c).type) for i, c in enumerate(by)]
            columns += [pa.array([v[i].tolist() for v in held.values()], pa.list_(pa.int64())) for i in range(len(sums))]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, *sums])

    vectors = rows.mapInArrow(partial, schema)
    zipped = F.arrays_zip(F.sequence(F.lit(0), F.lit(samples - 1)).alias("replicate"), *sums)
    long = vectors.select(*by, F.inline(zipped))
    return long.groupBy(*by, "replicate").agg(*[F.sum(c).alias(c) for c in sums])


# ---- rank metrics ------------------------------------------------------------------------

#: Kinds of rows that a bucket's task gets: counts of one cluster, vectors of a score that many
#: clusters share, and the vectors of what lies above the bucket.
_NARROW, _SUMMED, _BEFORE = 0, 1, 2


def _vector(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int64)


def _blocks(table: pa.Table, samples: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield the vectors of positives and negatives of each score, from the highest down."""
    score = table["score"].to_numpy()
    order = np.argsort(-score, kind="stable")
    score = score[order]
    base, pos, neg, kind = (table[c].to_numpy()[order] for c in ("base", "pos", "neg", "kind"))
    blobs = [table[c].to_pylist() for c in ("pos_sums", "neg_sums")] if (kind == _SUMMED).any() else None
    carried = None
    for start in range(0, len(score), BLOCK):
        part = slice(start, start + BLOCK)
        weights = poisson_weights(base[part], samples)
        sums = [x[part, None] * weights for x in (pos, neg)]
        for i in np.flatnonzero(kind[part] == _SUMMED):
            for side in (0, 1):
                sums[side][i] = _vector(blobs[side][order[start + i]])
        first = np.flatnonzero(np.concatenate([[True], np.diff(score[part]) != 0]))
        p, n = (np.add.reduceat(x, first, axis=0) for x in sums)
        for i, at in enumerate(first):
            here = (score[start + at], p[i], n[i])
            if carried and carried[0] == here[0]:
                carried = (here[0], carried[1] + here[1], carried[2] + here[2])
                continue
            if carried:
                yield carried[1:]
            carried = here
    if carried:
        yield carried[1:]


#: Vectors over the replicates that a bucket returns.
STATE = ("area", "steps", "best", "open", "crossed", "first_pos", "first_neg", "last_pos", "last_neg",
         "head", "head_open", "seen")


def walk(
    scores: Iterator[tuple[np.ndarray, np.ndarray]], before: np.ndarray, whole: np.ndarray, recall: float
) -> dict[str, np.ndarray]:
    """Walk down the scores of one bucket for all replicates at once.

    ``before`` and ``whole`` hold positives and negatives above the bucket and in all. A point at
    which equal steps meet is no corner, so the operating point is where the run of equal steps
    that first reaches the recall ends: ``best`` is its number of negatives, and it stays ``open``
    while the bucket's last step may go on in the next one. ``head`` is where the run that begins
    the bucket ends.
    """
    tp, fp = before.copy()
    positives = np.maximum(whole[0], 1)
    size = len(tp)
    exact = 2.0 * float(whole[0].max()) * float(whole[1].max()) < 2.0**62
    area = np.zeros(size, np.int64 if exact else np.float64)
    steps, best, head = np.zeros(size), np.zeros(size, np.int64), np.zeros(size, np.int64)
    first, last = np.full((2, size), -1), np.full((2, size), -1)
    open_, head_open = np.zeros(size, bool), np.zeros(size, bool)
    crossed = (before[0] > 0) & (before[0] / positives >= recall)
    new_here = np.zeros(size, bool)
    for p, n in scores:
        present = (p + n) > 0
        tp, fp = tp + p, fp + n
        area += (n if exact else n.astype(float)) * (2 * tp - p)
        steps += p * (tp / np.maximum(tp + fp, 1))
        same = present & (p == last[0]) & (n == last[1])
        best[open_ & same] = fp[open_ & same]
        open_ &= same | ~present
        reached = present & ~crossed & (tp / positives >= recall)
        best[reached] = fp[reached]
        open_[reached] = ((tp != p) | (fp != n))[reached]
        crossed |= reached
        new_here |= reached
        begins = present & (first[0] < 0)
        goes_on = begins | (head_open & same)
        head[goes_on] = fp[goes_on]
        head_open = np.where(begins, True, head_open & (same | ~present))
        first[:, begins] = np.stack([p, n])[:, begins]
        last[:, present] = np.stack([p, n])[:, present]
    return dict(zip(STATE, (area.astype(float), steps, best, open_, new_here, *first, *last, head, head_open,
                            first[0] >= 0), strict=True))


def join_buckets(buckets: list[dict[str, np.ndarray]], recall: float) -> dict[str, np.ndarray]:
    """Put the buckets of one group together, from the highest scores down."""
    area, steps = sum(b["area"] for b in buckets), sum(b["steps"] for b in buckets)
    best = np.zeros_like(buckets[0]["best"])
    open_ = np.zeros(len(best), bool)
    step = np.full((2, len(best)), -1)
    for b in buckets:
        seen = b["seen"].astype(bool)
        same = seen & (step[0] == b["first_pos"]) & (step[1] == b["first_neg"])
        goes_on = open_ & same
        best[goes_on] = b["head"][goes_on]
        open_ = np.where(seen, goes_on & b["head_open"].astype(bool), open_)
        crossed = b["crossed"].astype(bool)
        best[crossed] = b["best"][crossed]
        open_ = np.where(crossed, b["open"].astype(bool), open_)
        step[:, seen] = np.stack([b["last_pos"], b["last_neg"]])[:, seen]
    return {"area": area, "steps": steps, "best": best if recall > 0 else np.zeros_like(best)}


def _hot_sums(counts: DataFrame, by: list[str], samples: int) -> DataFrame:
    """Sum the scores that very many clusters share to one vector each, combined within tasks."""
    types = {f.name: f.dataType.simpleString() for f in counts.schema}
    keys = [*by, "score"]
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keys], "pos_sums binary, neg_sums binary"])
    base = counts.select(*keys, "base", "pos", "neg")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names = list(zip(*[batch.column(c).to_pylist() for c in keys], strict=True))
            pos, neg, seeds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "neg", "base"))
            for start in range(0, len(names), BLOCK):
                weights = poisson_weights(seeds[start : start + BLOCK], samples)
                where: dict[tuple, list[int]] = {}
                for i, k in enumerate(names[start : start + BLOCK]):
                    where.setdefault(k, []).append(i)
                for k, rows in where.items():
                    at = np.array(rows) + start
                    added = np.stack([pos[at] @ weights[rows], neg[at] @ weights[rows]])
                    held[k] = held[k] + added if k in held else added
        if held:
            arrays = [pa.array([k[i] for k in held], batch.schema.field(c).type) for i, c in enumerate(keys)]
            arrays += [pa.array([v[side].tobytes() for v in held.values()], pa.binary()) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "pos_sums", "neg_sums"])

    def add(table: pa.Table) -> pa.Table:
        sums = [sum(_vector(b) for b in table[c].to_pylist()).tobytes() for c in ("pos_sums", "neg_sums")]
        out = {c: table[c][:1] for c in keys}
        return pa.table(out | {c: pa.array([s], pa.binary()) for c, s in zip(("pos_sums", "neg_sums"), sums, strict=True)})

    return base.mapInArrow(partial, schema).groupBy(*keys).applyInArrow(add, schema)


def weighted_metrics(
    counts: DataFrame, by: Sequence[str], *, group: str, samples: int, seed: int, recall: float = 0.5
) -> DataFrame:
    """Evaluate every replicate: by, replicate, available, auroc, auprc, false_positive_rate.

    ``counts`` holds one row per cluster and distinct score (``pos``, ``neg``) and should be
    materialized. A replicate with one class only has no metrics.
    """
    by = list(by)
    points = split_points(counts, "score")
    rows = counts.select(
        *by, F.col("score").cast("double").alias("score"), weight_base(seed, group).alias("base"),
        F.col("pos").cast("long").alias("pos"), F.col("neg").cast("long").alias("neg"),
    )
    blank = {"base": F.lit(0).cast("long"), "pos": F.lit(0).cast("long"), "neg": F.lit(0).cast("long"),
             "pos_sums": F.lit(None).cast("binary"), "neg_sums": F.lit(None).cast("binary")}

    def full(df: DataFrame, kind: int, *more: str) -> DataFrame:
        cells = [F.col(c) if c in df.columns else v.alias(c) for c, v in blank.items()]
        return df.select(*by, "score", *cells, F.lit(kind).alias("kind"), *more)

    parts = [full(rows, _NARROW)]
    if not is_small(counts):
        hot = rows.groupBy(*by, "score").agg(F.count("*").alias("_n")).filter(F.col("_n") >= setting(counts, "hotRows"))
        hot = materialize(hot.drop("_n"))  # few by construction: at most all rows / hotRows
        if not hot.isEmpty():
            same = F.lit(True)
            for c in [*by, "score"]:
                same = same & rows[c].eqNullSafe(hot[c])
            parts = [full(rows.join(F.broadcast(hot), same, "left_anti"), _NARROW)]
            parts.append(full(_hot_sums(rows.join(F.broadcast(hot), same, "left_semi"), by, samples), _SUMMED))
    spread = parts[0]
    for part in parts[1:]:
        spread = spread.unionByName(part)
    spread = spread.withColumn("bucket", F.lit(len(points)) - bucket_of(F.col("score"), points))
    if points:
        spread = materialize(spread)
    types = {f.name: f.dataType.simpleString() for f in spread.schema}
    keys = "".join(f"`{c}` {types[c]}, " for c in by)

    def key_of(table: pa.Table) -> dict:
        return {c: table[c][:1] for c in by}

    if points:

        def add(table: pa.Table) -> pa.Table:
            total = np.zeros((2, samples), np.int64)
            for p, n in _blocks(table, samples):
                total += np.stack([p, n])
            return pa.table(key_of(table) | {"bucket": table["bucket"][:1], "pos_sums": pa.array([total[0].tobytes()], pa.binary()),
                                             "neg_sums": pa.array([total[1].tobytes()], pa.binary())})

        def run(table: pa.Table) -> pa.Table:
            order = np.argsort(table["bucket"].to_numpy())
            vectors = [np.array([_vector(table[c][int(i)].as_py()) for i in order]) for c in ("pos_sums", "neg_sums")]
            # What lies above a bucket, then the whole.
            out = [[(np.cumsum(v, axis=0) - v)[i].tobytes() + v.sum(axis=0).tobytes() for i in range(len(order))] for v in vectors]
            return pa.table({c: pa.array([table[c][0].as_py()] * len(order), table[c].type) for c in by} | {
                "bucket": table["bucket"].take(pa.array(order)), "pos_sums": pa.array(out[0], pa.binary()),
                "neg_sums": pa.array(out[1], pa.binary())})

        sums = f"{keys}bucket int, pos_sums binary, neg_sums binary"
        totals = spread.groupBy(*by, "bucket").applyInArrow(add, sums)
        before = totals.groupBy(*(by or [F.lit(0)])).applyInArrow(run, sums)
        above = full(before.withColumn("score", F.lit(0.0)), _BEFORE, "bucket")
        spread = spread.unionByName(above)

    def metrics(table: pa.Table) -> pa.Table:
        heads = table["kind"].to_numpy() == _BEFORE
        rows = table.filter(pa.array(~heads))
        if heads.any():
            at = int(np.flatnonzero(heads)[0])
            both = [_vector(table[c][at].as_py()).reshape(2, samples) for c in ("pos_sums", "neg_sums")]
            before, whole = (np.stack([b[k] for b in both]) for k in (0, 1))
        else:  # the only bucket: its own sums are the whole
            before, whole = np.zeros((2, samples), np.int64), np.zeros((2, samples), np.int64)
            for p, n in _blocks(rows, samples):
                whole += np.stack([p, n])
        state = walk(_blocks(rows, samples), before, whole, recall) | {"positives": whole[0], "negatives": whole[1]}
        blobs = {k: pa.array([v.astype(np.float64).tobytes() if v.dtype.kind == "f" else v.astype(np.int64).tobytes()],
                             pa.binary()) for k, v in state.items()}
        return pa.table(key_of(table) | {"bucket": table["bucket"][:1]} | blobs)

    def whole_group(table: pa.Table) -> pa.Table:
        order = np.argsort(table["bucket"].to_numpy())
        read = lambda c, i: np.frombuffer(table[c][int(i)].as_py(), float if c in ("area", "steps") else np.int64)
        out = join_buckets([{c: read(c, i) for c in STATE} for i in order], recall)
        p, n = read("positives", 0), read("negatives", 0)
        both = (p > 0) & (n > 0)
        values = {"auroc": out["area"] / np.where(both, 2.0 * p * n, 1), "auprc": out["steps"] / np.maximum(p, 1),
                  "false_positive_rate": out["best"] / np.maximum(n, 1)}
        return pa.table({c: pa.array([table[c][0].as_py()] * samples, table[c].type) for c in by} | {
            "replicate": np.arange(samples, dtype=np.int32), "available": both,
            **{k: pa.array(v, pa.float64(), mask=~both) for k, v in values.items()}})

    blobs = ", ".join(f"{c} binary" for c in (*STATE, "positives", "negatives"))
    done = spread.groupBy(*by, "bucket").applyInArrow(metrics, f"{keys}bucket int, {blobs}")
    result = f"{keys}replicate int, available boolean, auroc double, auprc double, false_positive_rate double"
    return done.groupBy(*(by or [F.lit(0)])).applyInArrow(whole_group, result)
