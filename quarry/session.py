"""Spark session helpers.

Cluster jobs get their session from the platform; everything here only
fills in settings that are *unset*, so a cluster's own values (shuffle
partitions, checkpoint folder, broadcast threshold) always win.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings a job relies on. AQE re-plans joins from measured shuffle sizes
# (runtime broadcast only below the threshold, skew-join splitting of hot
# keys, partition coalescing), so no join in this package hard-codes a
# strategy for data whose size is not bounded by a parameter.
JOB_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches handed to the vector kernels; bounds Python memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "quarry", driver_memory: str = "16g") -> SparkSession:
    """Session for tests and the bench on one machine (UI off, loopback)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in JOB_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.
    Only a session on one machine (tests, bench) may leave it unset: it then
    gets a folder of its own.  A cluster without one is an error, since other
    executors cannot see a machine-local folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="quarry-ckpt-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate
    tables (index, caches, run tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/quarry/{name}"


def materialize(df, name: str, at: str | None = None, packed: bool = False):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: the lineage is cut (a lost executor re-reads files), and later
    plans get file statistics, column pruning and filter pushdown -- which
    an RDD checkpoint does not give. ``at`` names another folder; ``packed``
    tables take less disk for some more CPU (zstd)."""
    import uuid
    path = at or scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    out = df.write.mode("overwrite")
    (out.option("compression", "zstd") if packed else out).parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df):
    """Before a CPU-heavy stage (tokenising, numpy scoring) over a written table
    of few files: as many partitions as cores, where the table is smaller than
    one split a core. A large table is left as it is. Only for tables that are
    read directly; nothing runs to decide."""
    spark = df.sparkSession
    par = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= par:
        return df
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    total = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(par) if total < split * par else df
