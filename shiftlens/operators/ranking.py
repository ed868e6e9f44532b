"""Ranks, running sums, quantiles and balanced quotas that never sort one group in one task.

A plain ``row_number`` over a stratum puts the whole stratum into one task. Here every ordered
group is cut into buckets of consecutive keys; bucket totals give each bucket its offset and only
rows of one bucket are sorted together. Hash keys are uniform, so their leading hex digits are
the bucket. Other keys use split points measured once and then written into the plan as literals,
which keeps bucket membership the same when a lost executor forces a recomputation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.functions.ids import hash_order
from shiftlens.session import is_small, setting

MAX_BUCKETS = 1024
SAMPLE_KEYS = 8192


def split_points(df: DataFrame, key: str, *, max_buckets: int = MAX_BUCKETS) -> list:
    """Measure ``df`` and return the key values that cut it into even buckets.

    Empty when the data fit one bucket. Numbers use a quantile sketch; other types use the
    keys with the smallest hashes, a uniform sample of at most ``SAMPLE_KEYS`` values.
    """
    if is_small(df):
        return []
    numeric = isinstance(df.schema[key].dataType, T.NumericType)
    aggregates = [F.count("*").alias("n")]
    if numeric:
        cuts = [F.lit(i / max_buckets) for i in range(1, max_buckets)]
        aggregates.append(F.percentile_approx(key, F.array(*cuts), F.lit(10_000)).alias("q"))
    row = df.agg(*aggregates).first()
    buckets = min(max_buckets, -(-row["n"] // setting(df, "rowsPerBucket")))
    if buckets <= 1:
        return []
    if numeric:
        points = [row["q"][i * max_buckets // buckets - 1] for i in range(1, buckets)]
    else:
        order = F.xxhash64(key)
        sample = df.select(key, order.alias("_o")).distinct().orderBy("_o").limit(SAMPLE_KEYS)
        keys = sorted(r[0] for r in sample.collect() if r[0] is not None)
        points = [keys[i * len(keys) // buckets] for i in range(1, buckets)] if keys else []
    return sorted(set(points))


def bucket_of(key: Column, points: Sequence) -> Column:
    """Return the number of split points at or below ``key`` by a balanced comparison tree."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < F.lit(points[middle]), tree(low, middle)).otherwise(
            tree(middle + 1, high)
        )

    return tree(0, len(points))


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    sums: dict[str, str],
    *,
    descending: bool = False,
    points: Sequence | None = None,
    following: Sequence[str] = (),
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums of columns in key order within each group.

    ``df`` must hold one row per (group, key). ``sums`` maps new names to input columns.
    Columns named in ``following`` also get ``next_<name>``, the value of the next row in order;
    ``totals`` maps new names to columns summed over the whole group.
    ``points`` may pass known split points; by default they are measured.
    """
    points = split_points(df, key) if points is None else points
    by, totals = list(by), totals or {}
    order = F.col(key).desc() if descending else F.col(key).asc()
    if not points:
        window = Window.partitionBy(*by).orderBy(order)
        total = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*by)
        return df.select(
            "*",
            *[F.sum(c).over(total).alias(n) for n, c in sums.items()],
            *[F.lead(c).over(window).alias(f"next_{c}") for c in following],
            *[F.sum(c).over(whole).alias(n) for n, c in totals.items()],
        )
    bucket = bucket_of(F.col(key), points)
    rows = df.withColumn("_bucket", F.lit(len(points)) - bucket if descending else bucket)
    first = F.max_by if descending else F.min_by
    buckets = rows.groupBy(*by, "_bucket").agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in {**sums, **totals}.items()],
        *[first(c, key).alias(f"_f_{c}") for c in following],
    )
    across = Window.partitionBy(*by).orderBy("_bucket")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        *by,
        "_bucket",
        *[F.sum(f"_t_{n}").over(Window.partitionBy(*by)).alias(f"_w_{n}") for n in totals],
        *[
            F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums
        ],
        *[F.lead(f"_f_{c}").over(across).alias(f"_n_{c}") for c in following],
    )
    within = Window.partitionBy(*by, "_bucket").orderBy(order)
    total = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(offsets, [*by, "_bucket"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.sum(c).over(total)).alias(n) for n, c in sums.items()],
        *[
            F.coalesce(F.lead(c).over(within), F.col(f"_n_{c}")).alias(f"next_{c}")
            for c in following
        ],
        *[F.col(f"_w_{n}").alias(n) for n in totals],
    )


def _bucketed_rank(
    df: DataFrame, by: list[str], bucket: Column, order: Sequence[Column], rank: str
) -> DataFrame:
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    before = (
        Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *by, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy(*by, "_bucket").orderBy(*order)
    joined = rows.join(offsets, [*by, "_bucket"])
    return joined.select(
        *df.columns, (F.col("_offset") + F.row_number().over(within)).cast("long").alias(rank)
    )


def rank_by_hash(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    seed: int | str,
    *,
    rank: str = "rn",
    digits: int | None = None,
) -> DataFrame:
    """Rank rows 1..n within each group by the hash of (seed, key).

    The leading ``digits`` hex digits are the bucket, so one group spreads over 16**digits tasks;
    by default there are enough of them for ``rowsPerBucket``, and a plan too small to be worth
    it is sorted directly.
    """
    staged = df.withColumn("_h", hash_order(seed, key))
    if digits == 0 or (digits is None and is_small(df)):
        window = Window.partitionBy(*by).orderBy("_h", key)
        return staged.withColumn(rank, F.row_number().over(window).cast("long")).drop("_h")
    if digits is None:
        rows, digits = staged.count(), 1
        while rows > setting(df, "rowsPerBucket") << (4 * digits):
            digits += 1
    ranked = _bucketed_rank(
        staged, list(by), F.substring("_h", 1, digits), [F.col("_h"), F.col(key)], rank
    )
    return ranked.drop("_h")


def rank_by_key(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    *,
    rank: str = "rn",
    points: Sequence | None = None,
) -> DataFrame:
    """Rank rows 1..n within each group by a unique key."""
    points = split_points(df, key) if points is None else points
    if not points:
        window = Window.partitionBy(*by).orderBy(key)
        return df.withColumn(rank, F.row_number().over(window).cast("long"))
    return _bucketed_rank(df, list(by), bucket_of(F.col(key), points), [F.col(key)], rank)


def first_k(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, *, salt: Column, rank: str
) -> DataFrame:
    """Keep the first ``k`` rows of each group and number them.

    Groups are cut by ``salt`` first, so each task keeps ``k`` rows before a group meets.
    """
    salted = df.withColumn("_salt", salt)
    near = Window.partitionBy(*by, "_salt").orderBy(*order)
    kept = salted.withColumn(rank, F.row_number().over(near)).filter(F.col(rank) <= k)
    final = Window.partitionBy(*by).orderBy(*order)
    return (
        kept.drop(rank, "_salt")
        .withColumn(rank, F.row_number().over(final))
        .filter(F.col(rank) <= k)
    )


def round_robin_quota(
    sizes: DataFrame, outer: Sequence[str], strata: Sequence[str], n: int | Column
) -> DataFrame:
    """Return how many rows each stratum gives to a round-robin sample of ``n`` rows.

    ``sizes`` has one row per stratum with a ``size`` column. Full rounds are found in closed
    form from the sorted sizes; the strata that still have rows then give one more in order.
    ``total`` is the number of rows the group could give.
    """
    n = n if isinstance(n, Column) else F.lit(n)
    group = Window.partitionBy(*outer)
    ordered = group.orderBy("size", *strata)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wanted = sizes.withColumn("_n", n.cast("long"))
    smaller = wanted.select(
        "*",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_smaller"),
        F.count("*").over(after).alias("_open"),
    )
    rounds = F.least(F.col("size"), F.expr("(_n - _smaller) div _open"))
    full = smaller.withColumn("_full", F.greatest(F.max(rounds).over(group), F.lit(0)))
    taken = full.withColumn("_base", F.least("size", "_full")).withColumn(
        "_more", (F.col("size") > F.col("_full")).cast("long")
    )
    nth = F.sum("_more").over(
        group.orderBy(*strata).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    spare = F.col("_n") - F.sum("_base").over(group)
    return taken.select(
        *outer,
        *strata,
        "size",
        F.sum("size").over(group).alias("total"),
        (F.col("_base") + F.when((F.col("_more") == 1) & (nth <= spare), 1).otherwise(0)).alias(
            "quota"
        ),
    )


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    *,
    points: Sequence | None = None,
    weight: str | None = None,
    interpolate: bool = True,
) -> DataFrame:
    """Return exact quantiles of each group, from value counts.

    They are linearly interpolated, or else the value at the place rounded down. ``weight``
    names a column saying how many rows each input row stands for.
    """
    by = list(by)
    rows = F.sum(weight) if weight else F.count("*")
    counts = df.groupBy(*by, value).agg(rows.alias("_c"))
    joined = running_sums(counts, by, value, {"_hi": "_c"}, points=points, totals={"_n": "_c"})
    picks = []
    for name, p in probabilities.items():
        place = F.lit(p) * (F.col("_n") - 1)
        for edge, index in (("l", F.floor(place)), ("u", F.ceil(place))):
            inside = (F.col("_hi") > index) & (F.col("_hi") - F.col("_c") <= index)
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{edge}_{name}"))
    found = joined.groupBy(*by, "_n").agg(*picks)
    results = []
    for name, p in probabilities.items():
        place = F.lit(p) * (F.col("_n") - 1)
        low, high = F.col(f"_l_{name}"), F.col(f"_u_{name}")
        between = low + (high - low) * (place - F.floor(place))
        results.append((between if interpolate else low).alias(name))
    return found.select(*by, F.col("_n").alias("n"), *results)

