"""Exact top-k inner products by best-first search of M-trees.

Inner products become distances by one more coordinate: with x' = (x, sqrt(M - |x|^2)) and
q' = (q, 0), |x' - q'|^2 = |q|^2 + M - 2 q.x, so the nearest are the largest products. Rows are
dealt to shards by their nearest pivot; a shard is an M-tree in pages. An entry keeps its routing
vector, covering radius and distance to its page's own routing vector; the triangle inequality on
these rules out pages, and entries of a page before their product is computed. A query first
searches the shard nearest to it; the k-th score found there rules out whole shards.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.session import materialize

SCALE = 64.0
#: Rows of a shard, entries of a leaf page and of an inner page, queries searched in one task.
SHARD_ROWS, LEAF, FANOUT, QUERY_BLOCK = 16_384, 256, 16, 1024
#: Most pivots that shards form around, and most shards that queries are routed over one by one.
MOST_PIVOTS, MOST_ROUTED = 256, 20_000
#: Distances are trusted to this share of their size.
SLACK = 1e-9


class MTree:
    """An M-tree over integer vectors, in flat arrays; page 0 is the root."""

    FIELDS = ("vectors", "ids", "radius", "parent", "child", "start", "leaf")

    def __init__(self, top: float, **arrays: np.ndarray) -> None:
        self.top = top
        for name in self.FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, top: float) -> MTree:
        """Load all rows at once; ``top`` is the largest squared length of any vector."""
        norms = np.einsum("ij,ij->i", vectors, vectors)
        extra = np.sqrt(np.maximum(top - norms, 0))
        draw = np.random.default_rng(len(ids))
        pages: list[list] = []  # entries of a page: (row, radius, distance to parent, child)

        def apart(rows: np.ndarray, row: int) -> np.ndarray:
            square = norms[rows] + norms[row] - 2 * (vectors[rows] @ vectors[row])
            return np.sqrt(np.maximum(square, 0) + (extra[rows] - extra[row]) ** 2)

        def page(rows: np.ndarray, center: int) -> int:
            number = len(pages)
            pages.append([])
            if len(rows) <= LEAF:
                away = apart(rows, center)
                pages[number] = [True, rows, np.zeros(len(rows)), away, np.full(len(rows), -1)]
                return number
            many = min(FANOUT, -(-len(rows) // LEAF))
            pivots = draw.choice(rows, many, replace=False)
            near = np.argmin(np.column_stack([apart(rows, p) for p in pivots]), axis=1)
            if np.bincount(near, minlength=many).max() > 0.9 * len(rows):
                near = np.arange(len(rows)) * many // len(rows)  # alike: cut evenly
            entries = []
            for j in range(many):
                mine = rows[near == j]
                if len(mine):
                    pivot = int(pivots[j])
                    entries.append((pivot, apart(mine, pivot).max(), page(mine, pivot)))
            own, radius, child = (np.array(x) for x in zip(*entries, strict=True))
            pages[number] = [False, own, radius, apart(own, center), child]
            return number

        if len(ids):
            page(np.arange(len(ids)), 0)
        join = lambda i, kind: np.concatenate([*(p[i] for p in pages), np.zeros(0)]).astype(kind)
        rows = join(1, np.int64)
        return cls(
            top, vectors=vectors[rows], ids=ids[rows], radius=join(2, float), parent=join(3, float),
            child=join(4, np.int64), leaf=np.array([p[0] for p in pages], bool),
            start=np.cumsum([0, *(len(p[1]) for p in pages)]),
        )

    def dump(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, top=np.array(self.top), **{n: getattr(self, n) for n in self.FIELDS})
        return file.getvalue()

    @classmethod
    def load(cls, data: bytes) -> MTree:
        with np.load(io.BytesIO(data)) as x:
            return cls(float(x["top"]), **{n: x[n] for n in cls.FIELDS})

    def search(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf):
        """Return ids and scores of the k best but ``own``; ``floor``: scores below are of no use."""
        length = float(query @ query)
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        reach = lambda score: np.sqrt(max(length + self.top - 2 * score, 0.0)) * (1 + SLACK) + SLACK
        limit = np.inf if floor == -np.inf else reach(floor)
        heap: list[tuple] = [(0.0, 0, -1.0)] if len(self.leaf) else []
        while heap and heap[0][0] <= limit:
            _, number, center = heapq.heappop(heap)
            some = slice(self.start[number], self.start[number + 1])
            radius = self.radius[some]
            use = np.arange(some.start, some.stop)
            if center >= 0 and limit < np.inf:  # stored distances first
                use = use[np.abs(center - self.parent[some]) - radius <= limit]
            products = self.vectors[use] @ query
            if not self.leaf[number]:
                away = np.sqrt(np.maximum(length + self.top - 2 * products, 0))
                least = np.maximum(away - self.radius[use], 0)
                for i in np.flatnonzero(least <= limit):
                    heapq.heappush(heap, (float(least[i]), int(self.child[use[i]]), float(away[i])))
                continue
            good = (products >= floor) & (self.ids[use] != own)
            ids = np.concatenate([ids, self.ids[use[good]]])
            scores = np.concatenate([scores, products[good]])
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) == k:
                floor = max(floor, float(scores.min()))
                limit = reach(floor)
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def quantised(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """Return (id, dims, vector) of the usable rows: floor(64 x) as doubles, in bytes.

    Left out: null ids and vectors, and vectors with a null or non-finite component. Rows of one
    id count once (the smallest vector, if they differ).
    """
    x = F.col("x").cast("array<double>")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    source = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [np.floor(np.asarray(v, float) * SCALE) + 0.0 for v in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(v) for v in whole], pa.int32()),
                 pa.array([v.tobytes() for v in whole], pa.binary())],
                names=["id", "dims", "vector"],
            )

    good = source.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & finite)
    packed = good.select("id", x.alias("x")).mapInArrow(pack, "id long, dims int, vector binary")
    return packed.groupBy("id").agg(F.min(F.struct("vector", "dims")).alias("v")).select("id", "v.*")


def stacked(values, dims: int) -> np.ndarray:
    """Stack packed vectors, shorter ones filled up with zeros."""
    out = np.zeros((len(values), dims))
    for i, v in enumerate(values):
        x = np.frombuffer(v)
        out[i, : len(x)] = x
    return out


def top_products(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", every: int = 20, k: int = 20
) -> DataFrame:
    """Return query_id, rank, vec_id, score: the k largest inner products of each query.

    Queries are the ids divisible by ``every``, searched against all other ids; equal scores go
    to the smaller id; with fewer candidates all are returned. See ``quantised`` for rows that
    take no part. Vectors of different length are compared as if filled up with zeros. An empty
    table gives no rows. Equal vectors, however many, are cut evenly over shards and pages.
    Products are exact while they stay below 2**53; larger ones raise an error.
    """
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors, key, column))
    asked = f"id % {every} = 0"

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            square = [float((np.frombuffer(v) ** 2).sum()) for v in batch.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(square, pa.float64())], names=["square"])

    n, dims, queries = rows.agg(
        F.count("*"), F.max("dims"), F.sum(F.expr(f"cast({asked} AS long)"))
    ).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], result)
    top = rows.select("vector").mapInArrow(lengths, "square double").agg(F.max("square")).first()[0]
    if top >= 2.0**53:
        raise ValueError("inner products beyond 2**53 are not exact")
    n_pivots = min(MOST_PIVOTS, -(-n // SHARD_ROWS))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()  # MOST_PIVOTS at most
    pivots = stacked([r["vector"] for r in chosen], dims)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lift = lambda v: np.column_stack([v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))])
        center = lift(pivots)
        for batch in batches:
            table = lift(stacked(batch.column("vector").to_pylist(), dims))
            away = (center * center).sum(axis=1) - 2 * table @ center.T
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vector"), pa.array(away.argmin(axis=1))],
                names=["id", "vector", "pivot"],
            )

    placed = materialize(rows.select("id", "vector").mapInArrow(near, "id long, vector binary, pivot long"))
    cuts = placed.groupBy("pivot").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("cuts"))
    cut = F.pmod(F.xxhash64("id"), F.col("cuts"))
    dealt = placed.join(F.broadcast(cuts), "pivot")  # MOST_PIVOTS rows at most

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        tree = MTree.build(stacked(frame["vector"], dims), frame["id"].to_numpy(), top)
        center = tree.vectors[0]
        square = (tree.vectors**2).sum(axis=1)
        lift = np.sqrt(np.maximum(top - square, 0))
        away = np.sqrt(((tree.vectors - center) ** 2).sum(axis=1) + (lift - lift[0]) ** 2)
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "center": [center.tobytes()],
                             "radius": [away.max() * (1 + SLACK)], "tree": [tree.dump()]})

    trees = materialize(
        dealt.withColumn("shard", F.col("pivot") * (1 << 32) + cut).select("shard", "id", "vector")
        .groupBy("shard").applyInPandas(grow, "shard long, center binary, radius double, tree binary")
    )
    routes = trees.select("shard", "center", "radius").limit(MOST_ROUTED + 1).collect()
    shards = np.array([r["shard"] for r in routes], np.int64)
    centers = stacked([r["center"] for r in routes], dims)
    radii = np.array([r["radius"] for r in routes])
    routed = len(routes) <= MOST_ROUTED

    def least(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Return the least distance of each query to each shard, and its squared length."""
        q = stacked(batch.column("vector").to_pylist(), dims)
        square = (q * q).sum(axis=1)[:, None] + top - 2 * q @ centers.T
        return np.maximum(np.sqrt(np.maximum(square, 0)) - radii, 0), (q * q).sum(axis=1)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = shards[least(batch)[0].argmin(axis=1)]
            floor = pa.array(np.full(batch.num_rows, -np.inf))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), floor], names=names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor = batch.column("floor").to_numpy()
            away, length = least(batch)
            limit = np.sqrt(np.maximum(length + top - 2 * floor, 0)) * (1 + SLACK) + SLACK
            limit[floor == -np.inf] = np.inf
            open_ = (away <= limit[:, None]) & (shards[None] != batch.column("home").to_numpy()[:, None])
            row, shard = np.nonzero(open_)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [taken.column("id"), taken.column("vector"), pa.array(shards[shard]), taken.column("floor")],
                names=names,
            )

    names = ["id", "vector", "shard", "floor"]
    kinds = "id long, vector binary, shard long, floor double"
    blocks = max(1, -(-int(queries) // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    ask = rows.filter(asked).select("id", "vector")

    def look(asked_: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asked_) and len(forest):
            tree = MTree.load(forest["tree"].iloc[0])
            table = stacked(asked_["vector"], dims)
            for i, own, floor in zip(range(len(table)), asked_["id"], asked_["floor"], strict=True):
                ids, scores = tree.search(table[i], own, k, floor)
                out += [(own, v, int(s)) for v, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def searched(wanted: DataFrame) -> DataFrame:
        spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
        left = wanted.select("*", block).groupBy("shard", "block")
        right = trees.select("shard", "tree", spread).groupBy("shard", "block")
        return left.cogroup(right).applyInPandas(look, "query_id long, vec_id long, score long")

    if routed:
        first = materialize(searched(ask.mapInArrow(home, kinds).repartition(blocks * n_pivots)))
        floors = first.groupBy("query_id").agg(
            F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor")
        )
        wanted = (
            ask.mapInArrow(home, kinds).select("id", "vector", F.col("shard").alias("home"))
            .join(floors.withColumnRenamed("query_id", "id"), "id", "left")
            .withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
            .mapInArrow(others, kinds)
        )
        found = first.unionByName(searched(wanted))
    else:  # too many shards to route over: every query visits all, pivot by pivot
        listed = trees.groupBy(F.floor(F.col("shard") / (1 << 32)).alias("pivot")).agg(
            F.collect_list("shard").alias("shards")
        )
        turns = F.explode(F.sequence(F.lit(0), F.lit(n_pivots - 1))).alias("pivot")
        every_shard = ask.select("id", "vector", turns).join(F.broadcast(listed), "pivot")
        found = searched(
            every_shard.select("id", "vector", F.explode("shards").alias("shard"))
            .withColumn("floor", F.lit(float("-inf")))
        )
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    return (
        found.groupBy("query_id").agg(best.alias("best"))
        .select("query_id", F.posexplode("best"))
        .select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", (-F.col("col.s")).alias("score"))
    )


SQL = r"""
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(q.e, c.e)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
