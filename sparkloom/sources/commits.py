"""A keyed state, or a snapshot, that is committed as a whole: data in folders of their own, named by numbered manifests.

A commit writes its rows under data/ in a new folder, then a manifest beside its place, and last renames that to the next
number, which the file system does for one writer only. Until then readers see the state before, from then on the new
one; a crash after any step leaves one of the two, and at most files that no manifest names, which vacuum() deletes. A
writer that finds its number taken reads the newer manifest and puts its own rows on top of it.

A manifest lists the folders that make up the state, oldest first: of each key the row of the last folder counts, and
inside a folder there is one row per key. compact() writes them as one. It also tells the last batch of each stream that
has been committed, so that a batch that is delivered again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sparkloom.session import drop_path

TRIES = 20


class Manifest(NamedTuple):
    version: int
    folders: list[str]
    applied: dict[str, int]
    schema: str
    about: dict


NOTHING = Manifest(0, [], {}, "", {})


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the manifests there are."""
    fs, folder = _fs(spark, root), _path(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def latest(spark: SparkSession, root: str) -> Manifest:
    found = versions(spark, root)
    if not found:
        return NOTHING
    text = spark.read.text(f"{root}/manifests/{found[-1]:020d}.json", wholetext=True).first()[0]
    return Manifest(**json.loads(text))


def _publish(spark: SparkSession, root: str, manifest: Manifest) -> bool:
    """Gives the manifest its number, if no one else has: the one step that changes what readers see."""
    fs = _fs(spark, root)
    beside = f"{root}/manifests/.{uuid.uuid4().hex}.tmp"
    out = fs.create(_path(spark, beside), False)
    out.write(bytearray(json.dumps(manifest._asdict()).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(_path(spark, beside), _path(spark, f"{root}/manifests/{manifest.version:020d}.json"), none)
    except Py4JJavaError as e:
        fs.delete(_path(spark, beside), False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    return True


def one_per_key(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    """Of the rows of a key the one that comes last in `order`; without an order, keys must not repeat."""
    if order is None:
        return rows
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(F.col(order), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))
    return rows.groupBy(F.col(key).alias("__key")).agg(last.alias("r")).select("r.*")


def commit(rows: DataFrame, root: str, key: str, order: str | None = None, stream: str | None = None, batch: int | None = None, replace: bool = False, about: dict | None = None) -> int:
    """Puts the rows on top of the state (replace: in its place) and returns its version.

    stream, batch: a batch of a stream whose number isn't above the last committed one changes nothing. about: what
    readers are to ask of the state (source and format, say); a state that says otherwise is replaced.
    """
    spark = rows.sparkSession
    if stream is not None and batch <= latest(spark, root).applied.get(stream, -1):
        return latest(spark, root).version
    folder = f"data/{uuid.uuid4().hex}"
    one_per_key(rows, key, order).write.parquet(f"{root}/{folder}")
    for _ in range(TRIES):
        was = latest(spark, root)
        if stream is not None and batch <= was.applied.get(stream, -1):
            return was.version
        fresh = replace or (about is not None and about != was.about)
        applied = {**({} if fresh else was.applied), **({} if stream is None else {stream: batch})}
        made = Manifest(was.version + 1, [folder] if fresh else [*was.folders, folder], applied, rows.schema.json(), was.about if about is None else about)
        if _publish(spark, root, made):
            return made.version
    raise OSError(f"{root} has been changed by others {TRIES} times over")


def read(spark: SparkSession, root: str, key: str, schema: str, about: dict | None = None) -> DataFrame:
    """The state as its last manifest says; no rows of `schema` if there is none, or if it is about something else."""
    return _read(spark, root, latest(spark, root), key, schema, about)


def _read(spark: SparkSession, root: str, manifest: Manifest, key: str, schema: str | None, about: dict | None = None) -> DataFrame:
    if not manifest.folders or (about is not None and about != manifest.about):
        return spark.createDataFrame([], schema)
    wanted = StructType.fromJson(json.loads(manifest.schema)) if schema is None else StructType.fromDDL(schema)
    parts = [spark.read.schema(wanted).parquet(f"{root}/{x}").withColumn("__place", F.lit(i)) for i, x in enumerate(manifest.folders)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if len(parts) == 1:
        return rows.drop("__place")
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in wanted.names]), "__place")
    return rows.groupBy(F.col(key).alias("__key")).agg(last.alias("r")).select("r.*")


def compact(spark: SparkSession, root: str, key: str) -> int:
    """Writes the state as one folder; rows that others have put on top meanwhile stay on top."""
    was = latest(spark, root)
    if len(was.folders) < 2:
        return was.version
    folder = f"data/{uuid.uuid4().hex}"
    _read(spark, root, was, key, None).write.parquet(f"{root}/{folder}")
    for _ in range(TRIES):
        now = latest(spark, root)
        if now.folders[: len(was.folders)] != was.folders:
            return now.version  # replaced or merged by another writer: this merge is of no use
        made = now._replace(version=now.version + 1, folders=[folder, *now.folders[len(was.folders) :]])
        if _publish(spark, root, made):
            return made.version
    raise OSError(f"{root} has been changed by others {TRIES} times over")


def replace_with(rows: DataFrame, root: str) -> int:
    """A snapshot as JSON lines, in the order of the rows, in place of the one before."""
    spark = rows.sparkSession
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.json(f"{root}/{folder}")
    for _ in range(TRIES):
        made = Manifest(latest(spark, root).version + 1, [folder], {}, rows.schema.json(), {"format": "json"})
        if _publish(spark, root, made):
            return made.version
    raise OSError(f"{root} has been changed by others {TRIES} times over")


def read_whole(spark: SparkSession, root: str, schema: str) -> DataFrame:
    now = latest(spark, root)
    return spark.read.schema(schema).json(f"{root}/{now.folders[0]}") if now.folders else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, root: str) -> int:
    """Deletes folders that the last manifest doesn't name and older manifests; only while no one else writes or reads the state."""
    fs, now = _fs(spark, root), latest(spark, root)
    gone = 0
    for at in fs.listStatus(_path(spark, f"{root}/data")) if fs.exists(_path(spark, f"{root}/data")) else []:
        if f"data/{at.getPath().getName()}" not in now.folders:
            drop_path(spark, at.getPath().toString())
            gone += 1
    for v in versions(spark, root)[:-1]:
        drop_path(spark, f"{root}/manifests/{v:020d}.json")
    return gone


def commit_stream(rows: DataFrame, root: str, key: str, order: str, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps the state up to date with a stream: each micro-batch is one commit, whatever it is delivered twice.

    A key's row is replaced only by one that comes later in `order`, so that files may arrive in any order.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = one_per_key(batch, key, order)
        was = read(spark, root, key, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema))
        # only keys of this batch are looked up; what is stored and later stays
        older = was.select(F.col(key).alias("__key"), F.col(order).alias("__order"))
        newer = fresh.join(older, F.col(key).eqNullSafe(F.col("__key")), "left").where(F.col("__order").isNull() | (F.col(order) > F.col("__order"))).drop("__key", "__order")
        commit(newer, root, key, stream=name, batch=number)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
