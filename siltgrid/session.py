"""Session, shared folder and table helpers used by every operator."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "siltgrid", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the session's Python workers, wherever they run and were started; once per application."""
    context = spark.sparkContext
    if getattr(context, "_siltgrid_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="siltgrid-code-")) / "siltgrid.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, Path("siltgrid") / f.relative_to(package))
    context.addPyFile(str(archive))
    context._siltgrid_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only where the session names none and runs on this machine alone (tests, local runs) is a temporary folder made and set; on a cluster
    that is an error, as what an executor writes to its own disk no other can read.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        there = checkpoint.get() if checkpoint.isDefined() else None
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("siltgrid needs a folder that all executors share: set spark.checkpoint.dir")
        there = "file://" + tempfile.mkdtemp(prefix="siltgrid-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def _scratch(spark: SparkSession) -> str:
    """The application's own folder in the shared one; removed when the program ends, if Spark still runs then."""
    context = spark.sparkContext
    if not getattr(context, "_siltgrid_scratch", None):
        context._siltgrid_scratch = f"{shared_folder(spark)}/siltgrid/{context.applicationId}"
        atexit.register(lambda: discard(spark) if context._jsc is not None else None)
    return context._siltgrid_scratch


def discard(spark: SparkSession) -> None:
    """Remove every table this application has stored; results that were not written elsewhere can't be read afterwards."""
    context = spark.sparkContext
    there = getattr(context, "_siltgrid_scratch", None)
    if there:
        path = context._jvm.org.apache.hadoop.fs.Path(there)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df once to the shared folder and return the written table.

    It cuts the lineage as a checkpoint does, survives the loss of executors, and is read with
    column pruning and pushed filters.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], columns: list[str], at: str = "loaded_at") -> DataFrame:
    """For each key the row with the latest `at`; a null `at` is older than any.

    Rows that tie on `at` are taken to be equal in `columns`, as the input's contract says. Copies of
    one key are combined before the shuffle, so a key with a third of all rows costs one row per task.
    """
    order = F.coalesce(F.col(at), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    return df.groupBy(*keys).agg(*(F.max_by(F.col(c), order).alias(c) for c in columns))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df partitioned by keys into as many partitions as the session shuffles to, however few bytes there are.

    For grouped kernels that cost far more than their rows weigh: adaptive coalescing would put small inputs into one task.
    The grouping that follows needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
