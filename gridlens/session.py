"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every gridlens job wants; all can be overridden by the caller or
# by spark-defaults on a cluster.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # per-key top-k (row_number <= k) gets a partial limit before the shuffle for k up to this
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
}


def get_spark(master: str | None = None, app_name: str = "gridlens",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = DEFAULT_CONF | REQUIRED_CONF
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the folder is configured by its host (setting or
    ``setCheckpointDir``) and is only read here; without one this raises.  A
    temporary folder is set only for a session in one local process, as in tests.
    """
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not current:
        master = context.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = fallback or os.environ.get("GRIDLENS_TEST_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="gridlens-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", current)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/gridlens-tables/{name}-{uuid.uuid4().hex[:12]}"


def saved(df, name: str):
    """``df`` as a table of its own in the shared folder, read back: for models and tables that a plan uses many times."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Settings results depend on (time zone of NTZ -> instant casts) or plans rely on.
REQUIRED_CONF = {
    # as JSON.parse does: of equal keys the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
    # ids and windows of streams live on disk, with changelogs in the checkpoint, not on the heap
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.optimizer.windowGroupLimitThreshold": "5000",
}


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply the settings gridlens relies on to a session created elsewhere."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def spread_for_python(df, *keys):
    """Hash-partition ``df`` on ``keys`` into 2 x default parallelism (or shuffle) partitions.

    For CPU-heavy ``applyInPandas`` groups on small inputs: AQE would coalesce
    the tiny shuffle into a few partitions and run the model fits serially;
    an explicit partition count is kept, and the following ``groupBy`` on the
    same keys reuses this partitioning (no second shuffle).
    """
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)
