"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes shuffles, switches joins at run time and splits skewed join partitions.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators expect to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "medallion") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="medallion-"))
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_roots: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own: a machine-local folder on a
    cluster would be lost with its machine and invisible to the other executors.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if context.applicationId not in _own_roots:
            _own_roots[context.applicationId] = tempfile.mkdtemp(prefix="medallion-")
        root = _own_roots[context.applicationId]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared root for one write."""
    return f"{checkpoint_root(spark).rstrip('/')}/medallion/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared root and read it back: no later use, and no lost executor, runs it again."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class WorkTables:
    """Written work tables of one call, to be deleted when its result no longer reads them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = work_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int = 0) -> None:
        """Delete all tables but the ``keep`` last ones."""
        gone, self.paths = self.paths[:len(self.paths) - keep], self.paths[len(self.paths) - keep:]
        for path in gone:
            target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread_small(df: DataFrame) -> DataFrame:
    """Spread an input that has fewer partitions than there are cores, before costly expressions.

    A small Parquet file is often one row group and so one task.  Inputs with a task for each core are left
    alone: no shuffle of the data.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stream_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session for one stateful stream, with shuffle partitions of its own.

    A stream keeps the number it began with for the life of its checkpoint, and adaptive execution does not
    change it; ``partitions`` is what its state will need, by default the session's setting.  Other queries
    keep theirs.
    """
    own = spark.newSession()
    wanted = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return prepare(own)
