"""SparkSession construction and small session-level helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job in this package assumes.  Shuffle partitions are a
# starting point only: AQE coalesces small partitions and splits skewed ones.
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# A finished query's shuffle files go at once, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ROUND_ROWS, ROUNDS = 1 << 22, 4     # rows that a round of a written table has at least, rounds at most

_shipped: dict[str, str] = {}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              driver_memory: str = "16g", app_name: str = "pertscope") -> SparkSession:
    """Return the active session or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("PERTSCOPE_MASTER", "local[8]"))
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", driver_memory)
    for key, value in _BASE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only set one when it is unset.

    On a cluster the setting names a shared folder and is left alone.  A
    private scratch folder is created only for local runs (tests, benches).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="pertscope-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the workers, once per application, so that
    tasks import it wherever the driver was started."""
    context = spark.sparkContext
    if _shipped.get("application") == context.applicationId:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(package)
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-modules-"), f"{name}-modules.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    out.write(path, os.path.join(name, os.path.relpath(path, package)))
    context.addPyFile(archive)
    _shipped["application"] = context.applicationId


def materialize(df, name: str = "table"):
    """Write ``df`` once as Parquet under the checkpoint folder and read it back.

    This cuts lineage like ``checkpoint()`` but runs a single job (a reliable
    RDD checkpoint of an unpersisted plan computes it twice) and stores the
    table columnar and compressed in the shared folder.  The shuffles of the
    write are of no further use: Spark removes their files when it ends.
    """
    return materialize_rounds(df.sparkSession, lambda i: df, 1, name)


def by_shuffle(df: DataFrame) -> DataFrame:
    """A table that grows with the data, for a join by shuffle.

    Spark compares the size of compressed files with its broadcast threshold:
    a million short rows are 4 MB there and 100 MB in the driver's memory.
    """
    return df.hint("merge")


def rounds_of(n_rows: int) -> int:
    """In how many rounds a table made from so many rows is written."""
    return min(ROUNDS, max(1, n_rows // ROUND_ROWS))


def in_round(key: str | Column, i: int, rounds: int) -> Column:
    """Whether a row belongs to round ``i``: rows of one key share a round."""
    return F.pmod(F.xxhash64(key), F.lit(rounds)) == i if rounds > 1 else F.lit(True)


def materialize_rounds(spark: SparkSession, make: Callable[[int], DataFrame], rounds: int, name: str = "table"):
    """Write ``make(0)``, ``make(1)`` and so on into one table and read it back.

    Each round makes all rows of its own keys, and its shuffles are gone before
    the next round's are made, so that only one round's lie on the disk.
    """
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        for i in range(rounds):
            make(i).write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more."""
    for table in tables:
        folder = next((os.path.dirname(file) for file in table.inputFiles()), None)
        if folder:
            jvm = table.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
