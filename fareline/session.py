"""Session set-up for tests and benchmarks, and the shared work folder of a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# application -> work folders handed out
_HANDED_OUT: dict[str, list[str]] = {}


def local_session(cores: int = 8, app: str = "fareline") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="fareline-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared checkpoint folder of this session."""
    folder = f"{_shared_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _HANDED_OUT.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to a work folder and read it back under its own schema.

    Later joins then see its true size, adaptive execution can cut the other side, and
    several results can share it.
    """
    folder = work_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: The bytes of a shuffle that one task is to read.
SHUFFLE_BYTES = 8 << 20
_START, _TARGET = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
# application -> the settings made here
_FITTED: dict[str, dict[str, int]] = {}


def fit_shuffles(spark: SparkSession, files: list[str]) -> None:
    """Let shuffles over these files start with partitions that grow in number, not in size.

    Adaptive execution puts small ones together. Small inputs keep what the session has, and
    a setting of the session's own stays as it is.
    """
    paths = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    held = [(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p) for p in paths]
    n = 2 * sum(fs.getContentSummary(p).getLength() for fs, p in held if fs.exists(p)) // SHUFFLE_BYTES
    if n <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return
    made = _FITTED.setdefault(spark.sparkContext.applicationId, {})
    for key, value in ((_START, n), (_TARGET, SHUFFLE_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or (now == str(made.get(key)) and int(now) < value):
            spark.conf.set(key, str(value))
            made[key] = value


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def list_folder(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, none where it does not exist."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def clear_work(spark: SparkSession) -> None:
    """Delete the work folders of this application; frames that read them are of no use then."""
    for folder in _HANDED_OUT.pop(spark.sparkContext.applicationId, []):
        delete_folder(spark, folder)


def finish(spark: SparkSession) -> None:
    """Delete the work folders and the reliable checkpoints of the application and stop it."""
    clear_work(spark)
    checkpoints = spark.sparkContext.getCheckpointDir()  # a folder of this application's own
    if checkpoints:
        delete_folder(spark, checkpoints)
    spark.stop()


def enable_checkpoints(spark: SparkSession) -> None:
    """Make sure ``DataFrame.checkpoint`` has a reliable folder to write to."""
    _shared_root(spark)
