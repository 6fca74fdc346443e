"""Stage tables, JSON reports and intermediate tables on shared storage."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_spread(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Read a table that row-wise work on long texts follows.

    A table in fewer splits than there are slots is small, and would leave
    slots idle; only then is it spread by ``key``. A large table is read as is.
    """
    df = spark.read.parquet(path)
    slots = spark.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace the Parquet table at ``path``."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: tuple[str, ...]) -> None:
    """Write the partitions that ``df`` has rows of; all others at ``path`` stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """One JSON object, from a one-row report."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def _scratch_root(spark: SparkSession) -> str:
    """Folder of this session's intermediate tables, below ``spark.checkpoint.dir``.

    Executors of a cluster do not see each other's disks, so without that
    setting only a local master may go on, in a folder of its own.
    """
    root = spark.conf.get("spark.threadloom.scratch", None)
    if not root:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="threadloom-")
        root = f"{shared.rstrip('/')}/threadloom-{uuid.uuid4().hex}"
        spark.conf.set("spark.threadloom.scratch", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path for an intermediate table."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete the session's intermediate tables; for the end of a job."""
    root = spark.conf.get("spark.threadloom.scratch", None)
    if root:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        spark.conf.unset("spark.threadloom.scratch")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a file read and not a rerun, and
    gives the planner true sizes for what follows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """The same, with aggregates taken while the rows are written.

    They belong to the tasks that write the files, and a task counts once
    however often it is tried.
    """
    observed = Observation(f"{name}-{uuid.uuid4().hex}")
    stored = materialize(df.observe(observed, *(column.alias(key) for key, column in counts.items())), name)
    return stored, {key: int(value or 0) for key, value in observed.get.items()}
