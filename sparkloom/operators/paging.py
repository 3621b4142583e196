"""A list kept in order as files, so that any page of it is read from the one or two files that hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import search

#: Rows of a file, a power of two.
ROWS = 1 << 20


def title_order(catalog: DataFrame) -> DataFrame:
    """The catalog with the keys that titles are listed by, each worked out once."""
    return catalog.withColumns({"__title": T.numeric_order(F.col("title")), "__artist": T.numeric_order(F.col("artist"))})


def write_ordered(rows: DataFrame, path: str, order: list[str], rows_per_file: int = ROWS) -> None:
    """Rows with their `place`, from 0, in a folder for each `rows_per_file` of them.

    The folder of a place follows from the place, so no list of folders has to be kept or read. Places come from counts
    of range partitions, so no task sorts or counts all rows. Columns that begin with __ are left out.
    """
    placed = search.numbered_rows(rows, [F.col(c) for c in order])
    kept = placed.select(*[c for c in placed.columns if not c.startswith("__")], F.floor(F.col("place") / rows_per_file).alias("file"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept.repartitionByRange(n, "file").sortWithinPartitions("file", "place").write.mode("errorifexists").partitionBy("file").parquet(f"{path}/rows")
    total = kept.agg(F.count("*").alias("total"), F.lit(rows_per_file).cast("long").alias("rows_per_file"))
    total.write.mode("errorifexists").json(f"{path}/about")


def about(spark: SparkSession, path: str) -> tuple[int, int]:
    """(number of rows, rows of a file)"""
    row = spark.read.schema("total long, rows_per_file long").json(f"{path}/about").first()
    return row.total, row.rows_per_file


def read_page(spark: SparkSession, path: str, number: int, size: int = search.PAGE) -> DataFrame:
    """Page `number`, from 1: opens only the folders that its places lie in, and sorts only its own rows."""
    total, per_file = about(spark, path)
    first, last = (number - 1) * size, min(number * size, total) - 1
    folders = [f"{path}/rows/file={i}" for i in range(max(first, 0) // per_file, max(last, 0) // per_file + 1)] if 0 <= first <= last else []
    if not folders:  # none, or a page that isn't there
        return spark.read.parquet(f"{path}/rows").drop("file").limit(0) if total else spark.createDataFrame([], "place long")
    return spark.read.option("basePath", f"{path}/rows").parquet(*folders).where(F.col("place").between(first, last)).orderBy("place").drop("file")


def spread(catalog: DataFrame, order: list[str], k: int, path: str) -> DataFrame:
    """k rows at equal distances in order, first and last included, out of a list that was written in order."""
    spark = catalog.sparkSession
    if k < 2:
        raise ValueError("a sample has two rows at least")
    write_ordered(catalog, path, order)
    total, _ = about(spark, path)
    if total < k:
        raise ValueError(f"{total} rows are fewer than {k}")
    wanted = spark.range(k).select(F.col("id").cast("int").alias("sample_no"), F.floor(F.col("id") * (total - 1) / (k - 1) + 0.5).alias("place"))
    return spark.read.parquet(f"{path}/rows").drop("file").join(F.broadcast(wanted), "place")
