"""Session helpers: a local session for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours wants, cluster or local.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ledgerloom", extra: dict | None = None) -> SparkSession:
    """A local[N] session for tests and the bench (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(BASE_CONF)
    conf.update({
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    })
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` must be set (a shared file system
    folder); we never invent a machine-local one there. Only a local-mode
    session without the setting (tests, bench) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    path = tempfile.mkdtemp(prefix="ledgerloom-ckpt-", dir=os.environ.get("LEDGERLOOM_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def default_parallelism(spark: SparkSession) -> int:
    """Width of explicit range and hash shuffles: the session's
    ``spark.sql.shuffle.partitions``, which a caller sizes for its data
    (0.5 to 1 GB after the shuffle a partition). No plan is executed to guess it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


_HELD: list[DataFrame] = []
_KEPT: list[tuple[SparkSession, str]] = []
_OLD: list[tuple[SparkSession, str]] = []


def hold(df: DataFrame) -> DataFrame:
    """Persist a frame that several branches of one plan must read alike. It
    is released by the next ``release_held`` (each registered query begins
    with one); a plan built on it keeps working afterwards, unpersisted."""
    _HELD.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _HELD[-1]


def release_held() -> None:
    while _HELD:
        _HELD.pop().unpersist()
    while _OLD:
        drop_written(*_OLD.pop())
    _OLD.extend(_KEPT)  # one query later: the last query's result may be read yet
    _KEPT.clear()


def written(df: DataFrame, label: str, kept: bool = False) -> tuple[str, DataFrame]:
    """``df`` as a Parquet table in the shared checkpoint folder: (its path, the
    table read back). It cuts the lineage and survives executors. Whoever asked
    for it calls ``drop_written``; with ``kept`` it is deleted by the second
    ``release_held`` from now."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/ledgerloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if kept:
        _KEPT.append((spark, path))
    return path, spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def kept_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted by the second ``release_held`` from now."""
    path = f"{ensure_checkpoint_dir(spark)}/ledgerloom-{label}-{uuid.uuid4().hex}"
    _KEPT.append((spark, path))
    return path
