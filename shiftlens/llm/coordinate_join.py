"""MinHash near-duplicates by an inverted join over signature coordinates.

Documents are posted under the (coordinate, value) pairs of their signatures. A pair of documents
over the threshold agrees in at least ``least_matches`` of ``COORDINATES`` places, so it shares one
of each side's rarest pairs (the prefix); values of passages that many documents hold are skipped,
for they come last. Candidates that agree often enough are confirmed on their whole sets.

Components need a spanning set of the links, not all of them: first every document meets one
document of its posting lists, the one whose coordinates most others share, and after that only
documents of different components meet, each pair once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.graph import components
from shiftlens.llm.texts import U64, WordHashes, chunks, mix, texts_of
from shiftlens.session import discard, materialize

WIDTH = 5
COORDINATES = 112
#: The chance, at most, that a pair at the threshold has fewer matches than are asked for.
MISSED = 1e-5
#: Rounds in which every document meets one other, before all that is left meets.
STAR_ROUNDS = 2
#: Blocks that shingles are dealt to, whose counts bound what two sets have in common.
BLOCKS = 16
#: A list of ids up to this long is broadcast (16 bytes each).
BROADCAST_IDS = 1_000_000

_draw = np.random.default_rng(20240229)
FACTORS = _draw.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * U64(2) + U64(1)
SHIFTS = _draw.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def missed(percent: int, matches: int) -> float:
    """Return the chance that a pair of this similarity agrees in fewer coordinates than that."""
    p = percent / 100
    return sum(math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k) for k in range(matches))


def least_matches(percent: int) -> int:
    """Return the most coordinates that may be asked for: 77 at 85 percent, 70 at 80.

    At a similarity below 0.1 even one is too many for ``MISSED``, which is an error.
    """
    if not 0 < percent <= 100 or missed(percent, 1) >= MISSED:
        raise ValueError(f"percent must be from 10 to 100, not {percent}")
    return max(m for m in range(1, COORDINATES + 1) if missed(percent, m) < MISSED)


def shingle_sets(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Return the sorted distinct shingle hashes of all texts, and where each text's begin."""
    sets, sizes = [], []
    for text in texts:
        words = hashes(text.lower().split())
        n = min(WIDTH, len(words))
        rolled = np.full(max(len(words) - WIDTH + 1, 1 if n else 0), U64(n))
        for j in range(n):
            rolled = rolled * U64(0x9E3779B97F4A7C15) + mix(words[j : j + len(rolled)])
        sets.append(np.unique(mix(rolled)))
        sizes.append(len(sets[-1]))
    return np.concatenate([*sets, np.zeros(0, U64)]), np.concatenate([[0], np.cumsum(sizes)])


def sketch(column: pa.Array, hashes: WordHashes) -> dict[str, pa.Array]:
    """Return n_shingles, two identities of the set, and the signature of every text."""
    flat, at = shingle_sets(texts_of(column), hashes)
    sizes = np.diff(at)
    full = np.flatnonzero(sizes)
    ids = np.zeros((2, len(sizes)), U64)
    marks = np.zeros((len(sizes), COORDINATES), np.uint32)
    if len(full):
        begin = at[:-1][full]
        for k, salt in enumerate((U64(0x1F83D9ABFB41BD6B), U64(0x5BE0CD19137E2179))):
            ids[k, full] = np.add.reduceat(mix(flat ^ salt), begin)
        for k in range(COORDINATES):
            values = ((flat * FACTORS[k] + SHIFTS[k]) >> U64(32)).astype(np.uint32)
            marks[full, k] = np.minimum.reduceat(values, begin)
    return {
        "n_shingles": pa.array(sizes.astype(np.int64)),
        "set_a": pa.array(ids[0].view(np.int64)),
        "set_b": pa.array(ids[1].view(np.int64)),
        "signature": pa.array([row.tobytes() for row in marks], pa.binary()),
    }


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sketch every row: (id, n_shingles, set_a, set_b, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches, "text"):
            found = sketch(batch.column("text"), hashes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *found.values()], names=["id", *found]
            )

    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "id long, n_shingles long, set_a long, set_b long, signature binary"
    return source.mapInArrow(run, schema)


def whole_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """Return (id, shingles) of the wanted (id, set_a): the texts are read once more."""
    few = wanted.count() <= BROADCAST_IDS
    ids = wanted.select(F.col("id"), "set_a")
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    source = source.join(F.broadcast(ids) if few else ids, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in chunks(batches, "text"):
            flat, at = shingle_sets(texts_of(batch.column("text")), hashes)
            mixed = np.concatenate([np.zeros(1, U64), np.cumsum(mix(flat ^ U64(0x1F83D9ABFB41BD6B)), dtype=U64)])
            right = (mixed[at[1:]] - mixed[at[:-1]]).view(np.int64) == batch.column("set_a").to_numpy()
            rows = np.flatnonzero(right)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)),
                 pa.array([flat[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())],
                names=["id", "shingles"],
            )

    return source.select("id", "set_a", "text").mapInArrow(run, "id long, shingles binary").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Keep the pairs (a, b) that agree in enough coordinates and overlap enough as whole sets."""
    least = least_matches(percent)

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32) for c in ("x", "y"))
            same = (x == y).reshape(-1, COORDINATES).sum(axis=1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(same))

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, U64), np.frombuffer(y, U64)])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    def sided(table: DataFrame, column: str) -> DataFrame:
        left = table.select(F.col("id").alias("a"), F.col(column).alias("x"))
        right = table.select(F.col("id").alias("b"), F.col(column).alias("y"))
        return pairs_now.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    pairs_now = pairs.select("a", "b")
    pairs_now = materialize(sided(reps, "signature").mapInArrow(agree, "a long, b long"))
    return sided(sets, "shingles").mapInArrow(overlap, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85
) -> DataFrame:
    """Group documents whose shingle sets overlap by ``percent`` of their union or more.

    Returns, per row of ``docs``: key, n_shingles, component_id (smallest key reachable over
    links) and kept (key = component_id). Texts of under five words have one shingle, the whole
    sequence; a null text or one without words has none and is linked with nothing. Equal sets
    are one document to the search. A row without a key is linked with nothing: component_id is
    null and it is kept. Repeated rows get the same answer each. Lists of any length are joined
    in full: nothing is capped, and Spark splits long ones (adaptive skew join).
    """
    rows = materialize(sketches(docs, key, text))
    same_set = ["set_a", "set_b", "n_shingles"]
    reps = materialize(
        rows.filter("n_shingles > 0 AND id IS NOT NULL")
        .groupBy(*same_set)
        .agg(F.min(F.struct("id", "signature")).alias("rep"))
        .select("rep.*", *same_set)
    )
    postings = materialize(prefix_postings(reps, percent))
    active = materialize(postings.select("id").distinct().join(reps, "id")
                         .select("id", "set_a", "n_shingles", "signature"))
    sets = materialize(whole_sets(docs, key, text, active))

    links, labels = None, None
    for turn in range(STAR_ROUNDS + 1):
        known = postings.withColumn("root", F.col("id"))
        if labels is not None:
            known = postings.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn(
                "root", F.coalesce("root", "id")
            )
            mixed = known.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
            known = known.join(mixed.filter("lo <> hi").select("token"), "token")
        known = materialize(known)
        if known.isEmpty():
            break
        pairs = star_pairs(known, turn) if turn < STAR_ROUNDS else cross_pairs(known, sets, percent)
        new = materialize(confirmed(materialize(pairs), active, sets, percent))
        links = new if links is None else materialize(links.unionByName(new))
        labels = components(links)
    if labels is None:
        labels = components(postings.select(F.col("id").alias("a"), F.col("id").alias("b")))
    groups = (
        reps.join(labels.withColumnRenamed("node", "id"), "id", "left")
        .select(*same_set, F.coalesce("root", "id").alias("component_id"))
    )
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component_id", "id"))
    return (
        rows.drop("signature").join(groups, same_set, "left")
        .select(F.col("id").alias(key), "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    )


def prefix_postings(reps: DataFrame, percent: int) -> DataFrame:
    """Return (token, id, n_shingles, shared): each document under the rarest of its shared tokens.

    ``shared`` is how much the document has in common with others: the logarithms of the
    frequencies of its tokens, summed up.

    Tokens of one document only meet nothing and are left out. Of m shared tokens, ordered from
    rare to frequent alike for all, the first m - least + 1 are posted (``least_matches``): two
    documents with that many tokens in common meet in one of them.
    """
    least = least_matches(percent)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32)
            coded = marks.reshape(-1, COORDINATES).astype(np.int64) * 128 + np.arange(COORDINATES)
            ids = np.repeat(batch.column("id").to_numpy(), COORDINATES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(coded.ravel()), pa.array(ids)], names=["token", "id"]
            )

    posted = reps.select("id", "signature").mapInArrow(tokens, "token long, id long")
    shared = posted.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    ranked = F.array_sort(F.collect_list(F.struct("n", "token")))
    return (
        posted.join(shared, "token")
        .groupBy("id")
        .agg(ranked.alias("tokens"))
        .filter(F.size("tokens") >= least)
        .withColumn("shared", F.aggregate("tokens", F.lit(0.0), lambda total, x: total + F.log(x["n"])))
        .withColumn("post", F.explode(F.slice("tokens", 1, F.size("tokens") - (least - 1))))
        .join(reps.select("id", "n_shingles"), "id")
        .select("post.token", "id", "n_shingles", "shared")
    )


def star_pairs(known: DataFrame, turn: int) -> DataFrame:
    """Pair every document with one of its lists' leaders: the one that most lists name.

    A list is led by its most shared document, in later turns by any one (the least hash).
    """
    order = -F.round("shared", 6) if turn == 0 else F.xxhash64("id", F.lit(turn))
    lead = known.groupBy("token").agg(
        F.min_by(F.struct("id", "root"), F.struct(order, "id")).alias("lead")
    )
    return (
        known.join(lead, "token").filter("lead.root <> root")
        .groupBy("id", F.col("lead.id").alias("other")).agg(F.count("*").alias("votes"))
        .groupBy("id").agg(F.max(F.struct("votes", -F.col("other"))).alias("best"))
        .select(F.least("id", -F.col("best.col2")).alias("a"), F.greatest("id", -F.col("best.col2")).alias("b"))
        .distinct()
    )


def rare_prefixes(ids: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Return (id, rare, common, blocks): what each document could share with one linked to it.

    Of n shingles, linked sets share ``least`` = ceil(percent * n / 100) or more, so one of the
    n - least + 1 rarest (ordered alike for all) is shared. Those that no document of another ``root``
    has (of another id, if ``ids`` tells no roots) cannot be; a document with too few others is
    linked with none of them and left out. ``common`` counts the others, ``blocks`` by hash.
    """
    root = F.col("root" if "root" in ids.columns else "id").alias("root")

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
            often = [len(x) for x in shingles]
            values = np.concatenate([*shingles, np.zeros(0, np.int64)])
            owners = [pa.array(np.repeat(batch.column(c).to_numpy(), often)) for c in ("id", "root")]
            yield pa.RecordBatch.from_arrays([*owners, pa.array(values)], names=["id", "root", "shingle"])

    owned = sets.join(ids.select("id", root).distinct(), "id").select("id", "root", "shingles")
    mine = materialize(owned.mapInArrow(flat, "id long, root long, shingle long"))
    counts = (
        mine.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        .filter("lo <> hi").select("shingle", "n")
    )
    sizes = mine.groupBy("id").agg(F.count("*").alias("size"))
    block = F.pmod("shingle", F.lit(BLOCKS))
    shared = mine.join(counts, "shingle").groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("shared"),
        F.array(*[F.count_if(block == k) for k in range(BLOCKS)]).alias("blocks"),
    )
    # The shingles that cannot be shared come first in the order.
    alone = F.col("size") - F.size("shared")
    room = F.col("size") - F.expr(f"({percent} * size + 99) div 100") + 1 - alone
    rare = F.slice("shared", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))
    kept = materialize(
        shared.join(sizes, "id").filter(room > 0).select(
            "id", F.transform(rare, lambda x: x["shingle"]).alias("rare"), F.size("shared").alias("common"), "blocks"
        )
    )
    discard(mine)
    return kept


def cross_pairs(known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pair the documents of a list that are in different components, close in size and rare alike.

    Two sets share no more of a block of shingles than either has in common with other components
    there; pairs that this keeps from a link are left out. A pair that meets in several lists is kept
    at the first of them and skipped in the others.
    """
    lists = known.groupBy("id").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    known = known.join(lists, "id").join(rare_prefixes(known, sets, percent), "id")
    columns = ("id", "root", "n_shingles", "tokens", "rare", "common")
    left, right = (
        known.select(
            "token", *[F.col(c).alias(f"{c}_{side}") for c in columns],
            *[F.col("blocks")[k].alias(f"block{k}_{side}") for k in range(BLOCKS)],
        )
        for side in ("a", "b")
    )
    first = F.array_min(F.array_intersect("tokens_a", "tokens_b")) == left["token"]

    def close(most: str) -> Column:
        return F.expr(f"100 * ({most}) >= {percent} * (n_shingles_a + n_shingles_b - ({most}))")

    # Two sets share no more than either has in common with any other, in all and in each block.
    whole = close("least(common_a, common_b)")
    parts = close(" + ".join(f"least(block{k}_a, block{k}_b)" for k in range(BLOCKS)))
    apart = (F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b"))
    rare = F.arrays_overlap("rare_a", "rare_b")
    return left.join(right, (left["token"] == right["token"]) & apart & whole & parts & rare & first).select(
        F.col("id_a").alias("a"), F.col("id_b").alias("b")
    )


#: Links and components in SQL, over all documents.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
reps AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
flat AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM reps),
shared AS (
  SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common
  FROM flat a JOIN flat b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (n + m - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (
  SELECT rep, rep FROM reps UNION SELECT edges.b, reach.seen FROM reach JOIN edges ON reach.node = edges.a),
roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id,
  doc_id = coalesce(root, doc_id) AS kept
FROM sets LEFT JOIN reps ON list_sort(sets.s) = reps.s LEFT JOIN roots ON reps.rep = roots.node
"""
