"""What the operators share on the DataFrame side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import ship

#: Rows of an Arrow batch between the JVM and Python; with texts of some KB a batch has a few MB.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions, for calls that need it said."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def add_columns(df: DataFrame, make, ddl: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Rows of `df` (columns `keep`, all by default) with the columns of `ddl` that `make` works out from the texts.

    make(texts: pyarrow string array, or a struct array if `text` is a struct) gives one array per column of `ddl`.
    A column of the input that has the name of a new one gives way to it.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(ddl)
    kept = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    source = F.col(text) if isinstance(df.schema[text].dataType, StructType) else F.col(text).cast("string")
    slim = df.select(*[F.col(f"`{c}`") for c in kept], source.alias("__text"))
    schema = StructType([slim.schema[c] for c in kept] + new.fields)
    wanted = list(schema.names)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            n = b.num_columns - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *make(b.column(n))], names=wanted)

    return slim.mapInArrow(run, schema)
