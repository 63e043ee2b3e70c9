"""SparkSession construction and cluster-facing settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  Shuffle partitions are sized by the caller:
# local tests use the core count, a cluster run uses ~2-3x total executor cores
# and AQE coalesces the small ones at runtime.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Catalyst only broadcasts a join side whose estimated size is below this
    # bound; anything larger falls back to a shuffled join.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "clickwise", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's settings applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    let_workers_import(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    """The one setting that results depend on; all others stay the caller's."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def let_workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it (a folder that
    executors see too; otherwise it comes with ``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name a folder that all executors share; a
    scratch folder is picked only in local mode (tests), where there is one machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="clickwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


# Input bytes per shuffle partition; map-side combining leaves a fraction of
# them to shuffle.  The upper bound keeps the map status of a huge job in the
# driver's memory (20,000 reducers for 100 TB are 5 GB of input each, before combining).
BYTES_PER_SHUFFLE_PARTITION = 256 * 1024 * 1024
MAX_SHUFFLE_PARTITIONS = 20_000
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"


def input_bytes(spark: SparkSession, paths) -> int:
    """Total size of the files under ``paths`` (any Hadoop filesystem)."""
    from clickwise.sources import fs
    return sum(fs.size_bytes(spark, p) for p in ([paths] if isinstance(paths, str) else paths))


def shuffle_partitions_for(n_bytes: int, cores: int) -> int:
    return max(cores, min(MAX_SHUFFLE_PARTITIONS, -(-n_bytes // BYTES_PER_SHUFFLE_PARTITION)))


def size_shuffle_partitions(spark: SparkSession, paths, override: bool = False) -> int:
    """Set ``spark.sql.shuffle.partitions`` from the input size, at least the core
    count.  A value the user set, 200 included, is kept unless ``override``."""
    if not override and spark._jsparkSession.sessionState().conf().contains(SHUFFLE_PARTITIONS):
        return int(spark.conf.get(SHUFFLE_PARTITIONS))
    n = shuffle_partitions_for(input_bytes(spark, paths), spark.sparkContext.defaultParallelism)
    spark.conf.set(SHUFFLE_PARTITIONS, str(n))
    return n
