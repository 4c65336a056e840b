"""Session helpers: a tuned local session for tests/bench, and the
checkpoint directory rule (use the cluster's ``spark.checkpoint.dir``;
only when it is unset *and* Spark runs in local mode do we pick a scratch
folder of our own)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "qforge", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus) * 2
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(parts))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("QFORGE_DRIVER_MEM", "16g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting it if needed.

    On a cluster the shared folder must come from ``spark.checkpoint.dir``;
    a machine-local folder is only acceptable in local mode (tests, bench).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="qforge-ckpt-", dir="/tmp")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder on the cluster")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a
    machine-local temp folder on a cluster)."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/qforge-{name}-{uuid.uuid4().hex[:12]}"


def scale_conf(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings sized to the data: scan splits and shuffle partitions of
    about ``target_partition_bytes`` (so a task's partition fits executor
    memory with room for sort/aggregation buffers), never fewer shuffle
    partitions than 2x the cores, AQE coalescing and skew splitting on.

    Scan splits are not made smaller than the Parquet row groups: a split
    without a row-group midpoint is an empty task, and a file of one row
    group would look well split while one task does all the work.

    For 100 TB on 1000 executors x 8 cores: 400k shuffle partitions of 256 MB
    before AQE coalescing; a skewed partition above 4x the median (and above
    1 GB) is split by AQE."""
    parts = max(2 * cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def input_bytes(paths) -> int:
    """Total size of the input files (driver-side listing, no data read)."""
    import glob
    total = 0
    for p in paths:
        for f in glob.glob(p) if any(ch in p for ch in "*?[") else [p]:
            if os.path.isdir(f):
                for root, _, files in os.walk(f):
                    total += sum(os.path.getsize(os.path.join(root, x)) for x in files)
            elif os.path.exists(f):
                total += os.path.getsize(f)
    return total
