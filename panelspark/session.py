"""Session helpers: configuration, shared checkpoint folder, size-checked broadcast.

Scale rules kept here so every operator follows them:

* Lineage is cut with ``DataFrame.checkpoint`` into the folder the cluster
  names in ``spark.checkpoint.dir`` (reliable storage, survives executor
  loss).  A folder of our own is set only when the session has none, which
  is the case in tests and local runs.
* A join side is broadcast only when its size is proven small: either the
  plan guarantees a row bound (a global aggregate has one row) or the
  optimizer's size estimate is under the threshold.  Everything else is
  left to AQE, which re-plans with measured shuffle sizes and splits skewed
  partitions.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings we rely on.  All of them are Spark defaults in 4.x
# except the skew factors, which we tighten so a key holding a third of the
# rows is always split.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

BROADCAST_MAX_BYTES = 32 * 1024 * 1024


def get_session(master: str | None = None, app: str = "panelspark",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (builder.config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_sql_defaults(spark)
    return spark


def apply_sql_defaults(spark: SparkSession) -> None:
    for k, v in SQL_DEFAULTS.items():
        spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a local one only when the session has none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        # only a local session may fall back to a folder of this machine
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="panelspark-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut lineage by writing a table into the shared checkpoint folder and reading it back.

    Equivalent in safety to a reliable ``DataFrame.checkpoint`` (never
    ``localCheckpoint``): the files live in shared storage and survive
    executor loss.  Parquet keeps the data columnar and the plan is computed
    once (an RDD checkpoint serialises rows and may recompute the plan).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the scratch table behind ``df`` (as ``cut_lineage`` gave it), once nothing reads it any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        if "/scratch/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of ended plans: it does so when the driver's heap is collected, which may be late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer size estimate of a plan, or None when unavailable."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(str(stats.sizeInBytes()))
    except Exception:  # pragma: no cover - estimate is best effort
        return None


def max_rows(df: DataFrame) -> int | None:
    """Row bound Catalyst can prove for a plan (e.g. 1 for a global aggregate)."""
    try:
        bound = df._jdf.queryExecution().optimizedPlan().maxRows()
        return int(bound.get()) if bound.isDefined() else None
    except Exception:  # pragma: no cover
        return None


def sized_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES,
                    max_row_bound: int = 100_000) -> DataFrame:
    """Hint a broadcast only when the side is provably small.

    Proof is either a plan row bound (global aggregate, literal table,
    ``limit``) or an optimizer size estimate below ``max_bytes``.  Otherwise
    the frame is returned unhinted and AQE decides from measured sizes,
    falling back to a shuffle join with skew splitting.
    """
    rows = max_rows(df)
    if rows is not None and rows <= max_row_bound:
        return F.broadcast(df)
    size = estimated_bytes(df)
    if size is not None and size <= max_bytes:
        return F.broadcast(df)
    return df
