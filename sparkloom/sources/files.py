"""JSON documents as tables: strict and lenient reading, atomic snapshots, a durable keyed state."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.sources import commits


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents, one row each; anything malformed fails when it is read, and the error names the file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same, with no rows for what is missing or malformed."""
    try:
        rows = spark.read.schema(StructType.fromDDL(schema).add("_bad", "string")).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    # Spark wants such a filter to look at the data's own columns as well
    return rows.where(F.to_json(F.struct(*rows.columns)).isNotNull() & F.col("_bad").isNull()).drop("_bad")


def catalog_scan(spark: SparkSession, path: str) -> DataFrame:
    """(song_ord, id, title, artist, source_url, variants) of catalogs kept as one array of songs in a document."""
    song = "id: string, title: string, artist: string, source_url: string, variants: array<struct<number: string, version_type: string, supports_x1: boolean>>"
    return read_json(spark, path, f"songs array<struct<{song}>>").select(F.posexplode("songs").alias("song_ord", "s")).select("song_ord", "s.*")


def write_snapshot(rows: DataFrame, path: str, order: list | None = None) -> None:
    """JSON lines in order, seen whole or not at all: in a folder of their own, to which one rename of a manifest leads."""
    commits.replace_with(rows.orderBy(*order) if order else rows, path)


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the last snapshot that was written whole; none if there is none."""
    return commits.read_whole(spark, path, schema)


def index_snapshot(index: DataFrame, path: str, offset: int, limit: int) -> None:
    """The chosen slice of an index (url, ordinal), each row with the number of all entries."""
    total = index.agg(F.count("*").alias("total_entries"))
    chosen = index.orderBy("ordinal").offset(offset).limit(limit)  # the slice that was asked for
    write_snapshot(chosen.join(F.broadcast(total), F.lit(True)), path, ["ordinal"])


def load_index(spark: SparkSession, path: str, version: int, url_pattern: str, new_only: bool = False) -> tuple[str, DataFrame]:
    """(source id, entries (url, last_modified)) of a candidate index kept as one document; ValueError if it can't be used.

    It must be of this version and have entries; addresses must fit the pattern and not repeat. new_only leaves out those
    that are known. The source id names the file and the choice, so that states of different choices are kept apart.
    """
    entry = "url: string, last_modified: string, known: boolean"
    held = read_json(spark, path, f"version int, entries array<struct<{entry}>>")
    head = held.select("version", F.col("entries").isNotNull().alias("has")).first()
    if head is None or head.version != version or not head.has:
        raise ValueError(f"{path} is no candidate index of version {version}")
    rows = held.select(F.explode("entries").alias("e")).select("e.*")
    rows = rows.where(~F.coalesce("known", F.lit(False))) if new_only else rows
    bad = rows.agg(F.count_if(~F.coalesce(F.col("url").rlike(url_pattern), F.lit(False))).alias("bad")).first().bad
    twice = rows.groupBy("url").count().where("count > 1").isEmpty()
    if bad or not twice:
        raise ValueError(f"{path} has addresses that don't fit or repeat")
    return f"local-index:{path}{'#new-only' if new_only else ''}", rows.select("url", "last_modified")


def load_state(spark: SparkSession, path: str, schema: str, source_id: str, version: int, key: str = "url") -> DataFrame:
    """Rows of a checkpoint of this version and source; a missing, foreign or older one is an empty state."""
    return commits.read(spark, path, key, schema, {"source_id": source_id, "version": version})


def save_state(new: DataFrame, path: str, source_id: str, version: int, key: str = "url", order: str | None = None) -> int:
    """Puts rows on top of the checkpoint, those of a key that it has in their place; one of another source or version is replaced."""
    return commits.commit(new, path, key, order, about={"source_id": source_id, "version": version})
