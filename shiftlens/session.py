"""Session settings, reliable checkpoints and size checks shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits that decide between the direct and the spread form of an operator; a session may
# override each as spark.shiftlens.<name>.
LIMITS = {
    # A plan estimated below this size is sorted in one task.
    "smallPlanBytes": 64 << 20,
    # Ordered groups are cut into buckets of about this many rows.
    "rowsPerBucket": 1_000_000,
    # Keys with at least this many fact rows are joined without moving their facts together.
    "hotRows": 2_000_000,
    # Files up to this size are hashed in tasks, which hold them in memory.
    "bytesPerFile": 128 << 20,
}


def build_session(app: str = "shiftlens", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with adaptive execution, UTC time and Arrow switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """Return the shared folder of ``spark.checkpoint.dir``.

    A temporary folder is used only where the session names none and runs on one machine;
    executors of a cluster would each write to a disk of their own, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shiftlens-checkpoint-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write a reduced table to the shared folder and read it back.

    Used where one reduced table feeds several branches: the facts are then scanned once, a
    lost executor costs a read instead of the whole lineage, and later joins see true sizes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/shiftlens-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more.

    What was made from them must have been written itself.
    """
    for table in tables:
        path = getattr(table, "written_path", None)
        if path is not None:
            context = table.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame) -> DataFrame:
    """Materialize a reduced table unless its plan is small enough to run twice."""
    return df if is_small(df) else materialize(df)


def estimated_bytes(df: DataFrame) -> int:
    """Return Catalyst's size estimate of a plan."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_limit(spark: SparkSession) -> int:
    """Return the session's broadcast threshold in bytes."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = text.removesuffix("b")
    return int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)


def setting(df: DataFrame, name: str) -> int:
    """Return one of the ``spark.shiftlens.*`` limits of the session."""
    return int(df.sparkSession.conf.get(f"spark.shiftlens.{name}", str(LIMITS[name])))


def is_small(df: DataFrame) -> bool:
    """Check a plan's estimated size against what one task sorts easily."""
    return estimated_bytes(df) <= setting(df, "smallPlanBytes")


def fits_broadcast(df: DataFrame) -> bool:
    """Check a plan's estimated size against the session's broadcast threshold."""
    return estimated_bytes(df) <= broadcast_limit(df.sparkSession)


def in_parts(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Deal a table of ``rows`` rows by its keys so that a task gets about ``rowsPerBucket`` of them.

    Shuffles are sized by bytes, and narrow rows of ids are compressed so well that a task may get many
    millions; a table of few rows is left as it is. Rows of one key stay together.
    """
    parts = -(-rows // setting(df, "rowsPerBucket"))
    return df.repartition(parts, *keys) if parts > 1 else df


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Make a small constant table that Catalyst can fold, without a Python worker."""
    names = [part.strip().split(" ", 1) for part in schema.split(",")]
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, names, strict=True)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
