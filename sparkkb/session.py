"""Session settings, tables and scratch space shared by all executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application: the local folder made where spark.checkpoint.dir is unset, and the catalog tables written.
_folders: dict[str, str] = {}
_tables: dict[str, list[str]] = {}


def get_spark(app: str = "sparkkb", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with the settings every operator expects: UTC, adaptive execution, Arrow. Master and sizes are those of spark-submit, if it started us, else local."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a local temporary one of our own only where it is unset and the master is local."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or _folders.get(context.applicationId)
    if not path:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _folders[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="sparkkb-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{_scratch(spark)}/{what}-{uuid.uuid4().hex}"


def _scratch(spark: SparkSession) -> str:
    if spark.sparkContext.applicationId not in _tables:
        _tables[spark.sparkContext.applicationId] = []
        atexit.register(_at_exit, spark)
    return f"{shared_dir(spark)}/sparkkb-{spark.sparkContext.applicationId}"


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone by now
        release(spark)


def release(spark: SparkSession) -> None:
    """Drop the intermediate tables of this application and their files; called when Python ends. Results that read them are no longer valid."""
    if spark.sparkContext._jsc is None:  # stopped
        return
    scratch = _scratch(spark)
    for name in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folders.pop(spark.sparkContext.applicationId, scratch))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, what: str, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage is cut, and it survives the loss of executors."""
    path = scratch_path(df.sparkSession, what)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, what: str, key: str, *partition_by: str, buckets: int | None = None) -> DataFrame:
    """As materialize(), hash-partitioned by key on disk: a later grouping or join by it needs no shuffle. As many buckets as shuffle partitions, unless given."""
    spark = df.sparkSession
    name = f"sparkkb_{what}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", scratch_path(spark, what)).format("parquet")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    _tables[spark.sparkContext.applicationId].append(name)
    return spark.table(name)
