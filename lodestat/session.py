"""Session defaults. A session made by the caller always wins; nothing here
overrides settings of a cluster that already has one running."""

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "lodestat", cores: int | None = None) -> SparkSession:
    """Active session if there is one, else a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("LODESTAT_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_LOCAL = {}


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A folder every executor can reach, below ``spark.checkpoint.dir``.

    The setting is read from the session, or else from the context's checkpoint
    folder. Only where both are unset and one machine does all the work (a local
    master, as in tests), a temporary folder stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = of_context.get() if of_context.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL.get(app) or tempfile.mkdtemp(prefix="lodestat-")
        _LOCAL[app] = base
    return f"{base.rstrip('/')}/{purpose}-{os.urandom(6).hex()}"


def stage(df, purpose: str):
    """A table written to the shared folder and read back. A result that several
    branches read is thus computed once, and its lineage ends at files that
    survive the loss of an executor."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_alone(df, purpose: str):
    """``stage``, and what was exchanged for the table is dropped. Spark removes the files of an exchange when the driver's JVM collects the
    plan that made it, which a driver with memory to spare does late; until then every exchange of a long query stays on disk."""
    out = stage(df, purpose)
    df.sparkSession.sparkContext._jvm.java.lang.System.gc()
    return out


#: Bytes of input in a part of ``dealt``.
PART_BYTES = 16 << 20


#: Above this an estimate says that the size is not known (rows of no file).
KNOWN_BYTES = 1 << 50


def input_bytes(df) -> int:
    """The optimizer's estimate of a table's size; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < KNOWN_BYTES else 0


def dealt(df, *keys, like=None):
    """Rows of equal keys in one part, of about ``PART_BYTES`` of input each. For aggregates that Spark can only sort for, such as the best
    row by several columns, where keys have few rows: combined before the exchange, every input split is sorted whole, which spills as
    splits grow, and nearly as many rows go on. ``like`` is a table of about that size, for rows of which the optimizer knows none (a join's
    is a product)."""
    spark, size = df.sparkSession, input_bytes(df if like is None else like)
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // PART_BYTES, 10_000)), *keys)


_STAGED = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build):
    """``stage`` once per application and input folder: reports over the same
    (immutable) inputs share their intermediate tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        _STAGED[key] = stage(build(), name)
    return _STAGED[key]


def forget_staged() -> None:
    _STAGED.clear()
