"""Mixing sources to target weights by a low-discrepancy source schedule.

Slot i of the mix gets the golden-ratio point frac(i / phi), mapped through the cumulative weights
of the sources. The k-th slot of a source takes the k-th of its blocks: its documents, shuffled
by a hash and laid end to end, cut to blocks of equally many words. Every step is a DataFrame
operation; ranks and running sums are taken in bounded pieces, so a source may hold any share of
the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block.
BLOCK = 256
#: Slots that one task ranks together, and documents whose sizes one task sums up.
SLOTS_TOGETHER, DOCS_TOGETHER = 1 << 16, 20_000
#: The golden ratio's inverse in units of 2**-40, made odd, so that points do not repeat.
GOLDEN, UNIT = 679_568_432_531, 1 << 40


def golden_point(slot: Column) -> Column:
    """Return frac(slot / phi) as a multiple of 2**-40, in integers that cannot overflow."""
    high, low = F.floor(slot / (1 << 20)) % (1 << 20), slot % (1 << 20)
    return ((high * GOLDEN % UNIT) * (1 << 20) % UNIT + low * GOLDEN) % UNIT


def source_targets(sized: DataFrame, weights: tuple, share: float, cap: float) -> DataFrame:
    """Return a row per source: src (rank by code point, null last), source, source_size, target.

    Sources weigh ``weights`` in turn and share ``share`` of all words. A target stops at ``cap``
    times its source's size; what lies above is shared anew by weight. Sources sorted by
    cap/weight fill up one after another, so running sums give where this ends.
    """
    everything = Window.orderBy(F.col("source").isNull(), "source")
    ratio = Window.orderBy("ratio", "src")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("src", F.row_number().over(everything) - 1)
        .withColumn("weight", F.element_at(turn, F.col("src") % len(weights) + 1))
        .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("left", F.lit(float(share)) * F.sum("source_size").over(whole)
                    - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(after))
        .withColumn("full", F.col("level") >= F.col("ratio"))
        .withColumn("final", F.min_by(F.when(~F.col("full"), F.col("level")),
                                      F.when(~F.col("full"), F.struct("ratio", "src"))).over(whole))
        .withColumn("target", F.when(F.col("full"), F.col("most"))
                    .otherwise(F.col("final") * F.col("weight")))
    )
    return sources.select("src", "source", "source_size", "target")


@dataclass
class Mix:
    """``docs``: what the mix takes of each row; ``slots``: the schedule; ``sources``: targets."""

    docs: DataFrame
    slots: DataFrame
    sources: DataFrame


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    block: int = BLOCK,
    seed: str = "mix",
) -> Mix:
    """Mix all documents so that each source's words come to its target (see ``Mix``).

    ``docs``: key, size (words of the text; null text: 0), source, source_size, target, taken: one
    row per row of ``docs``. ``slots``: slot, src, pass, block, start, stop (words of the source's
    stream), in slot order the mixed corpus. Words are taken exactly up to the target, cut to
    whole words; no document is taken more than ``cap`` times, ``cap`` being 2 at most. A
    document without words takes part with 0. Null sources are one source. Null keys and repeated
    rows are documents of their own; among equal hashes key and size decide, and rows equal in
    these are alike. An empty table gives empty tables. The order is a hash of seed and key, so
    reruns agree.
    """
    if not 0 < cap <= 2:
        raise ValueError("cap must be above 0 and at most 2: blocks are passed over twice at most")
    spark = docs.sparkSession
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    sized = materialize(
        docs.select(
            F.col(key).alias("doc_key"), F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            order.alias("shuffled"),
        )
    )
    sources = materialize(source_targets(sized, weights, share, cap))
    quota = F.floor("target")
    blocks = F.ceil(F.col("source_size") / block)
    plan = (
        sources.withColumn("blocks", blocks)
        .withColumn("first", F.least(quota, F.col("source_size")))
        .withColumn("again", quota - F.col("first"))
        .withColumn("slots", F.when(F.col("again") > 0, F.col("blocks") + F.ceil(F.col("again") / block))
                    .otherwise(F.ceil(F.col("first") / block)))
    )
    totals = plan.agg(F.sum("slots"), F.count("*")).first()
    n_slots, n_sources = int(totals[0] or 0), int(totals[1])
    slots = _schedule(spark, plan, n_slots, n_sources, block)

    n_rows = sized.count()
    digits = 0
    while n_rows > DOCS_TOGETHER << (4 * digits):
        digits += 1
    known = sized.join(sources, sized.source.eqNullSafe(sources.source)).drop(sources.source)
    placed = _laid_out(known.withColumn("part", F.substring("shuffled", 1, digits)))
    piece = F.explode(F.sequence(F.floor(F.col("start") / block),
                                 F.floor((F.col("start") + F.col("size") - 1) / block)))
    row = ["doc_key", "source", "src", "size", "source_size", "target", "start"]
    overlap = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("to"))
                         - F.greatest("start", "from"))
    taken = (
        placed.filter("size > 0")
        .withColumn("block", piece)
        .join(slots.select("src", "block", F.col("start").alias("from"), F.col("stop").alias("to")),
              ["src", "block"], "left")
        .groupBy(*row)
        .agg(F.sum(F.when(F.col("from").isNull(), 0).otherwise(overlap)).alias("taken"))
    )
    empty = known.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_key", "size", "source", "source_size", "target", "taken"]
    both = taken.select(*columns).unionByName(empty.select(*columns))
    return Mix(both.withColumnRenamed("doc_key", key), slots, sources)


def _laid_out(known: DataFrame) -> DataFrame:
    """Add ``start``: where a document begins in its source's shuffled stream of words."""
    within = Window.partitionBy("src", "part").orderBy("shuffled", "doc_key", "size")
    parts = Window.partitionBy("src").orderBy("part")
    before = (
        known.groupBy("src", "part")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.sum("words").over(parts) - F.col("words"))
        .drop("words")
    )
    summed = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return (
        known.withColumn("inner", summed)
        .join(before, ["src", "part"])
        .withColumn("start", F.col("before") + F.col("inner"))
    )


def _schedule(spark, plan: DataFrame, n_slots: int, n_sources: int, block: int) -> DataFrame:
    """Deal the slots to sources by their golden-ratio points and rank them per source."""
    buckets = 1
    while buckets < 4 * n_sources:
        buckets *= 2
    width = UNIT // buckets
    upto = F.sum("slots").over(Window.orderBy("src"))
    # In doubles, where scaling by a power of two is exact: as integers, 2**23 slots would overflow.
    scaled = upto.cast("double") * float(UNIT)
    edges = plan.filter("slots > 0").withColumn("high", F.floor(scaled / F.lit(max(n_slots, 1))))
    edges = edges.withColumn("low", F.lag("high", 1, 0).over(Window.orderBy("src")))
    near = edges.select(
        "src", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))
        .alias("bucket"),
    )
    dealt = (
        spark.range(0, n_slots, 1, max(1, n_slots // 500_000)).withColumnRenamed("id", "slot")
        .withColumn("point", golden_point(F.col("slot")))
        .withColumn("bucket", F.floor(F.col("point") / width))
        .join(near, "bucket")
        .filter("point >= low AND point < high")
        .select("slot", "src", F.floor(F.col("slot") / SLOTS_TOGETHER).alias("part"))
    )
    counts = dealt.groupBy("src", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn(
        "before", F.sum("n").over(Window.partitionBy("src").orderBy("part")) - F.col("n")
    )
    inner = F.row_number().over(Window.partitionBy("src", "part").orderBy("slot")) - 1
    ranked = (
        dealt.withColumn("inner", inner)
        .join(before.drop("n"), ["src", "part"])
        .select("slot", "src", (F.col("before") + F.col("inner")).alias("rank"))
    )
    # The schedule misses a source's count by a few slots: those come at its end.
    got = counts.groupBy("src").agg(F.sum("n").alias("got"))
    late = (
        plan.join(got, "src", "left")
        .withColumn("got", F.coalesce("got", F.lit(0)))
        .filter("slots > got")
        .withColumn("rank", F.explode(F.sequence("got", F.col("slots") - 1)))
        .select((F.lit(n_slots) + (F.col("rank") - F.col("got")) * n_sources + F.col("src"))
                .alias("slot"), "src", "rank")
    )
    stop = F.when(F.col("pass") == 0, F.col("first")).otherwise(F.col("again"))
    return (
        ranked.unionByName(late)
        .join(plan.select("src", "blocks", "first", "again", "slots"), "src")
        .filter("rank < slots")
        .withColumn("pass", F.floor(F.col("rank") / F.col("blocks")))
        .withColumn("block", F.col("rank") % F.col("blocks"))
        .withColumn("start", F.col("block") * block)
        .withColumn("stop", F.least(F.col("start") + block, stop))
        .select("slot", "src", "pass", "block", "start", "stop")
    )


#: What the mix takes, in SQL: the schedule fills each source's stream up to its target.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS shuffled FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source IS NULL, source) - 1 AS src FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(src % 3 + 1)::INT] AS weight,
    2.0::DOUBLE * source_size AS most FROM sources),
leveled AS (
  SELECT *, most / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, src
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, src
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT *, CASE WHEN level >= ratio THEN most ELSE weight * (SELECT arg_min(level, (ratio, src))
    FROM leveled WHERE level < ratio) END AS target FROM leveled),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, s.source, floor(t.target)::BIGINT AS quota,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY shuffled, s.doc_id, s.size
      ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source, source_size, target,
  (greatest(0, least(start + size, least(quota, source_size)) - start)
   + greatest(0, least(start + size, quota - least(quota, source_size)) - start))::BIGINT AS taken
FROM placed
"""
