"""Session helpers: building, tuning, shipping the package, shared scratch space."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # A page may be megabytes of HTML, so Arrow batches are bounded by bytes too.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def build_session(app: str = "pagerisk", cores: int | str = "*") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return attach(builder.getOrCreate())


def attach(spark: SparkSession) -> SparkSession:
    """Set runtime options and make this package importable on every executor, once a session."""
    if getattr(spark, "_pagerisk_attached", False):
        return spark
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    sc = spark.sparkContext
    if not any(name.endswith("pagerisk_pkg.zip") for name in sc.listFiles):
        sc.addPyFile(_package_zip())
    spark._pagerisk_attached = True
    return spark


def _package_zip() -> str:
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="pagerisk-pkg-"), "pagerisk_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as bundle:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.relpath(path, os.path.dirname(package)))
    return target


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, which goes when the
    process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="pagerisk-shared-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/pagerisk/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, in the part of this application."""
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; call when it is done.

    Results that have not been written elsewhere cannot be read any more.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(shuffled: DataFrame, each: int = 16, per_core: int = 2) -> DataFrame:
    """Hand the result of a shuffle to fewer tasks, before it is written.

    A task takes up to ``each`` neighbouring partitions, one after the other; ``per_core`` tasks
    a core stay at least. Every task that writes makes a file of its own, with a
    checksum, and Hadoop's local file system starts a process for each of its access rights. What
    adaptive execution merged or split by size is not split again nor dealt anew.
    """
    spark = shuffled.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return shuffled.coalesce(max(per_core * spark.sparkContext.defaultParallelism, -(-parts // each)))


def spread(scan: DataFrame, tasks: int = 1) -> DataFrame:
    """Give CPU-heavy per-row work on a *file scan* at least ``tasks`` tasks and one per core.

    A scan that has as many splits already is returned unchanged.
    """
    tasks = max(tasks, scan.sparkSession.sparkContext.defaultParallelism)
    if scan.rdd.getNumPartitions() >= tasks:
        return scan
    return scan.repartition(tasks)
