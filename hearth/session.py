"""Session helpers: a tuned local/cluster session and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "hearth") -> SparkSession:
    """Return a session configured for this library.

    Local runs (``master="local[N]"``) get N shuffle partitions. On a cluster
    ``master`` stays unset (spark-submit decides) and the cluster's own
    ``spark.sql.shuffle.partitions`` is kept: AQE then coalesces small
    partitions and splits skewed ones at run time by bytes
    (``advisoryPartitionSizeInBytes``, from the cluster's configuration), so
    the setting can be generous (see ``conf/spark-defaults.cluster.conf``).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    local = bool(master) and master.startswith("local")
    if shuffle_partitions is None and local:
        inner = master[len("local["):-1] if master.startswith("local[") else "1"
        shuffle_partitions = os.cpu_count() or 8 if inner in ("*", "") else int(inner)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if local:
        # small local data: coalesce shuffles to the advisory size instead of many 1 MB partitions
        builder = (builder.config("spark.driver.memory", os.environ.get("HEARTH_DRIVER_MEMORY", "16g"))
                   .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
                   .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Where it is unset a local session gets a folder under
    the system temp dir; on a cluster that is an error, since executors would
    write to their own disks.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        current = sc.getCheckpointDir()
        if current:
            return current
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="hearth-ckpt-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        sc.setCheckpointDir(root)
        return sc.getCheckpointDir() or root
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def drop_scratch(spark: SparkSession) -> None:
    """Remove every table that this library has written to the shared folder in this
    application; results still to be read from them must be written first."""
    jvm = spark.sparkContext._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_WRITTEN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    root = checkpoint_root(spark).rstrip("/")
    _WRITTEN.append(f"{root}/hearth-{name}-{uuid.uuid4().hex[:12]}")
    return _WRITTEN[-1]


def written(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back (as ``schema``, if given, of the same
    stored types): the lineage ends at the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_method_lock = threading.Lock()


@contextmanager
def compiled_methods(spark: SparkSession):
    """Queries run inside split the code of wide projections into small methods. By default it is one method
    of up to 64 KB, and the JVM interprets, never compiles, methods of more than 8,000 bytes (a
    hundred expressions a row then take some 50 microseconds). The setting is put back."""
    with _method_lock:
        before = spark.conf.get(_METHOD_LIMIT)
        spark.conf.set(_METHOD_LIMIT, "8000")
        try:
            yield
        finally:
            spark.conf.set(_METHOD_LIMIT, before)


#: Job sets that run side by side for each core of the cluster, and at most.
SETS_PER_CORE, MAX_CONCURRENT = 1, 64


def parallel_map(fn, items, parallel: bool = True, max_concurrent: int | None = None):
    """Run independent sets of jobs (such as fits) concurrently from driver threads, results in order. Each is its
    own set of Spark jobs, in a scheduler pool of its own, so that where the cluster schedules
    fairly (``spark.scheduler.mode``) a short fit doesn't wait for a long one's tasks."""
    items = list(items)
    if not parallel or len(items) < 2:
        return [fn(x) for x in items]
    sc = SparkSession.active().sparkContext
    most = max_concurrent or min(MAX_CONCURRENT, max(4, SETS_PER_CORE * sc.defaultParallelism))
    pool = sc.getLocalProperty("spark.scheduler.pool") or "set"

    def run(at: int):
        sc.setLocalProperty("spark.scheduler.pool", f"{pool}-{at}")
        try:
            return fn(items[at])
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=min(len(items), most)) as ex:
        return list(ex.map(inheritable_thread_target(SparkSession.active())(run), range(len(items))))
