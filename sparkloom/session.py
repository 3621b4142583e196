"""Session helpers: shared working folders and shipping the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from spark.checkpoint.dir.

    Only where the setting is absent, in a local session, a temporary folder of the driver is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/sparkloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_clean(df: DataFrame, label: str) -> DataFrame:
    """Like written(); the shuffles of `df` are deleted as soon as it is written, not when the driver next collects garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return written(df, label)
    finally:
        conf.set(name, before)


def bucketed(df: DataFrame, label: str, key: str, codec: str = "snappy") -> DataFrame:
    """Like written(), in as many buckets of `key` as a shuffle has partitions: what meets the rows by that key is shuffled, they themselves are not.

    A task writes a file for each bucket that it has rows of, so few rows should be large ones. The table is known to the
    catalog only until the frame is made.
    """
    spark = df.sparkSession
    table = f"spark_catalog.default.sparkloom_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", codec).option("path", new_path(spark, label)).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores: for work that is costly for each row, where few bytes of a file, and so one task, hold very many rows."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a working folder through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a frame that written() returned, once nothing reads it any more."""
    for path in {os.path.dirname(x) for x in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers of every executor."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(), "sparkloom_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for top, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
