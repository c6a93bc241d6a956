"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
# Rows that one task sorts or groups, whatever the session's shuffle setting.
TASK_ROWS = 1_000_000

# Only where the cluster names no folder and Spark runs in one process (tests).
_local_dirs: dict[str, str] = {}


def local_session(cores: str = "*", app: str = "gleaner") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="/tmp/spark-")
    return _local_dirs[app]


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/gleaner/{spark.sparkContext.applicationId}"


def drop_stored(spark: SparkSession) -> None:
    """Delete every intermediate table this application wrote; frames that read them end with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and freezes values such as partition
    ids that would change if the frame were computed twice. The copy is columnar, so each
    reader loads only the columns it uses.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_counted(df: DataFrame, name: str = "step") -> tuple[DataFrame, int]:
    """`stored`, with the number of rows observed while they were written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for work that costs far more than a row's transport.

    Only a scan with fewer partitions than cores is shuffled, which a large table never is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def sized(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Lay `rows` rows by key over as many tasks as keep each within `TASK_ROWS`; few rows are left to the session."""
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df
