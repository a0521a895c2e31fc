"""Spark session helpers: a local builder for tests/bench and checkpoint handling.

On a cluster the session comes from the platform; ``spark.checkpoint.dir`` must
name a shared (distributed) folder there.  Only when it is unset *and* the
master is local do we create a scratch folder of our own.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "spanfold") -> SparkSession:
    """Session for tests and the bench: local mode, AQE on, UI off."""
    scratch = tempfile.mkdtemp(prefix="spanfold-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPANFOLD_DRIVER_MEMORY", "16g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.local.dir", os.path.join(scratch, "local"))
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, configuring it from ``spark.checkpoint.dir``.

    Cluster runs must set ``spark.checkpoint.dir`` to a shared folder.  A local
    master without that setting (tests, the driver's checks) gets a fresh
    folder under the system temp directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) that every executor can reach")
        configured = tempfile.mkdtemp(prefix="spanfold-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written once as compressed Parquet in the shared checkpoint folder, and read back.

    Cuts the lineage and survives executor loss; one job, and no copy on the
    executors.  The table stays until :func:`discard` or the folder's clean-up.
    """
    path = scratch_path(df.sparkSession, "table")
    write_table(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``df`` written as Parquet; the files shuffled for it are deleted once it is written, not at some collection of garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder, once nothing reads it any more."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the tables that :func:`checkpoint` wrote, once nothing reads them any more."""
    for t in tables:
        path = getattr(t, "_written_at", None)
        if path:
            delete_path(t.sparkSession, path)
            t._written_at = None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    import uuid
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame) -> DataFrame:
    """Use every core on small inputs: round-robin only when the input has
    fewer partitions than the default parallelism.

    A large input (many files / splits) is left alone, so no shuffle of the
    raw data is added where the scan is already parallel.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def scale_conf(input_bytes: float, executors: int, cores_per_executor: int = 4,
               executor_memory_gb: float = 16.0) -> dict[str, str]:
    """Session settings sized for a given input (the work is CPU-heavy per byte).

    * splits of 64 MB give cleaning/tagging tasks of a few seconds each;
    * shuffle partitions target ~256 MB each after the document repartition
      (at least 2 waves of tasks);
    * each task's share of executor memory must hold one partition's
      per-document arrays several times over, which the bounds above keep;
    * AQE coalesces only where the plan allows it (document repartitions use
      an explicit count) and splits skewed join partitions;
    * automatic broadcasts stay small: the large lookups here broadcast only
      after their own row-count check.
    """
    slots = max(1, executors * cores_per_executor)
    shuffle = int(max(2 * slots, -(-input_bytes // (256 * 1024 ** 2))))
    per_task_mb = executor_memory_gb * 1024 / cores_per_executor
    split_mb = 64 if per_task_mb >= 1024 else 32
    return {
        "spark.sql.files.maxPartitionBytes": f"{split_mb}m",
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.default.parallelism": str(2 * slots),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
