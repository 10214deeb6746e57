"""Session helpers: building a session, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if the estimate of its size in memory is below this.
BROADCAST_LIMIT_BYTES = 128 * 1024 * 1024
#: The optimizer takes the size of a scanned file for the size of its rows; in memory, rows take about so many times as much.
INFLATION = 4


#: Whether each column expression looks up the line of Python that made it; plans of many expressions are built some times faster without.
QUIET = "spark.python.sql.dataFrameDebugging.enabled"


def build_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g", app: str = "paneflow") -> SparkSession:
    """A local session with the settings that the engine expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(QUIET, "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (tests, local runs) gets a folder of its own; a session on a cluster
    raises, as a folder of one machine would lose data with that machine.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="paneflow-ckpt-"))
    return named or sc.getCheckpointDir()


class Storage:
    """Small files on the file system that holds ``root``, whatever Hadoop file system that is."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self.root = spark._jvm, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside the old file, then rename over it, so that a reader sees the old text or the new one."""
        beside = self._path(f"{name}.next")
        stream = self._fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        option = self._jvm.org.apache.hadoop.fs.Options.Rename
        array = self._jvm.java.lang.reflect.Array.newInstance(option.OVERWRITE.getClass(), 1)
        self._jvm.java.lang.reflect.Array.set(array, 0, option.OVERWRITE)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self._conf).rename(beside, self._path(name), array)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so that losing an executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that were cut and that nothing refers to any more.

    It does so when the driver collects its garbage, which with a large heap may be long after; until then every
    executor's disk holds them.
    """
    gc.collect()
    spark._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="paneflow-ship-"), "paneflow.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("paneflow", os.path.relpath(full, root)))
    sc.addPyFile(at)
    _SHIPPED.add(sc.applicationId)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``: of a scan the size of its files; without statistics, beyond any limit."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    try:
        return int(stats.sizeInBytes())
    except ValueError:  # a product over many joins, of thousands of digits
        return 1 << 62


def small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size in memory is below ``limit``, else unchanged (AQE then picks a shuffled join)."""
    return F.broadcast(df) if estimated_bytes(df) * INFLATION <= limit else df


#: Rows of a cut side of a join up to which it is broadcast.
SMALL_ROWS = 100_000


def small_rows(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df``, whose lineage is cut, with a broadcast hint if it has ``limit`` rows at most: a checkpoint has no statistics but is cheap to count."""
    return F.broadcast(df) if df.count() <= limit else df


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once for each row.

    The optimizer may inline a costly expression wherever it is used; a one-element explode keeps it from doing so.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def default_parallelism(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame, min_partitions: int | None = None, *keys: str) -> DataFrame:
    """Spread rows over all cores before CPU-heavy work, whatever files they came in; hot keys do not matter as rows go round robin."""
    ship_package(df.sparkSession)
    n = min_partitions or max(default_parallelism(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, *keys) if keys else df.repartition(n)


def data_root() -> str:
    return os.environ.get("PANEFLOW_DATA", "/root/testdata")
