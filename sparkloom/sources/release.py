"""The files that a release is made from: the audited catalog, the generated songs and the review of their sources.

Each is a folder of snapshots, which are seen whole or not at all; numbers that a release is judged by are worked out
from what the files hold, and the generated songs are known by a digest of their bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import gates, search
from sparkloom.operators.merge import Snapshot
from sparkloom.sources import commits, files

FORMAT = 1
COUNTS = ["n_index", "n_success", "n_no_x1", "n_unavailable", "n_error", "n_pending", "n_processed", "n_conflicts", "merged_songs", "merged_variants"]
SUMMARY = f"catalog_version int, ready boolean, percent double, {', '.join(f'{c} long' for c in COUNTS)}"
PAGES = "url string, place string"
CONFLICTS = "kind string, key string, message string"
VARIANTS = "song_ord long, var_ord long, url string, song_id string, title string, artist string, number string, variant_id string, meta string, supports boolean"
STATS = "songs_version int, success long, no_x1 long, unavailable long, error long"
REVIEW = "review_version int, passed boolean, size long, input_path string, input_sha256 string"
SAMPLES = "url string, matched boolean, differences array<string>"


def write_catalog(snapshot: Snapshot, path: str) -> None:
    """Summary, pages by state, conflicts, and the merged songs by address, each with its variants by number."""
    songs, variants = snapshot.merged.songs, snapshot.merged.variants
    placed = search.numbered_rows(songs.select("url", "song_id", "title", "artist"), ["url", "song_id"]).withColumnRenamed("place", "song_ord")
    own = variants.select("url", "number", "variant_id", "meta", F.lit(True).alias("supports"))
    var_ord = F.when(F.col("number").isNotNull(), F.xxhash64("number", "variant_id"))
    rows = placed.join(own, "url", "left").withColumn("var_ord", F.coalesce(var_ord, F.lit(-1).cast("long")))
    files.write_snapshot(snapshot.summary.select(F.lit(FORMAT).alias("catalog_version"), "ready", "percent", *COUNTS), f"{path}/summary")
    files.write_snapshot(snapshot.pages.select("url", "place"), f"{path}/pages")
    files.write_snapshot(snapshot.conflicts, f"{path}/conflicts")
    files.write_snapshot(rows.select(*[x.split()[0] for x in VARIANTS.split(", ")]), f"{path}/songs", ["song_ord", "number"])


def write_songs(checkpoint: DataFrame, songs: DataFrame, path: str, url_pattern: str | None = None) -> None:
    """The variants of the songs of good pages, and how many pages the checkpoint (url, status) has of each status.

    With a pattern for addresses the songs are checked first; ValueError with the first error, and nothing is written.
    """
    if url_pattern is not None:
        wrong = gates.song_errors(songs.withColumn("supports", F.lit(True)), url_pattern).orderBy("song_ord", "var_ord", "place").first()
        if wrong is not None:
            raise ValueError(f"{wrong.rule}: {wrong.message}")
    count = lambda s: F.count_if(F.col("status") == s).alias(s.replace("-", "_"))
    files.write_snapshot(checkpoint.agg(*[count(s) for s in ("success", "no-x1", "unavailable", "error")]).select(F.lit(FORMAT).alias("songs_version"), "*"), f"{path}/stats")
    files.write_snapshot(songs, f"{path}/songs", ["url"])


def write_review(samples: DataFrame, songs_path: str, path: str) -> None:
    """Samples (url, matched, differences) of a review, how many there are, whether all matched, and what was reviewed."""
    spark = samples.sparkSession
    about = samples.agg(F.count("*").alias("size"), F.coalesce(F.every(F.col("matched") & (F.size("differences") == 0)), F.lit(False)).alias("passed"))
    told = {"review_version": F.lit(FORMAT), "input_path": F.lit(songs_path), "input_sha256": F.lit(digest(spark, f"{songs_path}/songs"))}
    files.write_snapshot(about.withColumns(told), f"{path}/review")
    files.write_snapshot(samples, f"{path}/samples")


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the SHA-256 of each file of the snapshot, in order of their parts; of no file, that of the empty text."""
    now = commits.latest(spark, path)
    if not now.folders:
        return gates.fingerprint_in_blocks(spark.createDataFrame([], "k long, sha string"), "k").first()[0]
    # bytes are read by tasks, a file at a time; part numbers order the files
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/{now.folders[0]}")
    part = F.regexp_extract("path", r"part-([0-9]+)-", 1).cast("long")
    return gates.fingerprint_in_blocks(parts.select(part.alias("k"), F.sha2("content", 256).alias("sha")), "k").first()[0]


def promotion_metrics(spark: SparkSession, catalog: str, songs: str, review: str, allow_partial: bool, url_pattern: str) -> DataFrame:
    """The one row that gates.release() judges, all of it from the files of the three folders."""
    pages = files.read_snapshot(spark, f"{catalog}/pages", PAGES)
    variants = files.read_snapshot(spark, f"{catalog}/songs", VARIANTS)
    generated = files.read_snapshot(spark, f"{songs}/songs", "url string").distinct()
    place = lambda p, name: F.count_if(F.col("place") == p).alias(name)
    success = pages.where("place = 'success'").select("url")
    reviewed = files.read_snapshot(spark, f"{review}/review", REVIEW)
    # frames of one row each, side by side
    rows = [
        files.read_snapshot(spark, f"{catalog}/summary", SUMMARY),
        pages.agg(place("error", "listed_error"), place("outside-index", "listed_outside"), place("pending", "listed_pending")),
        files.read_snapshot(spark, f"{catalog}/conflicts", CONFLICTS).agg(F.count("*").alias("listed_conflicts")),
        variants.agg(F.count_distinct("song_ord").alias("listed_songs"), F.count("number").alias("listed_variants")),
        gates.song_errors(variants, url_pattern).agg(F.count("*").alias("song_errors")),
        files.read_snapshot(spark, f"{songs}/stats", STATS).select("songs_version", *[F.col(c).alias(f"stats_{c}") for c in ("success", "no_x1", "unavailable", "error")]),
        generated.agg(F.count("*").alias("generated_songs")),
        gates.multiset_equal(generated, success).select(F.col("n_unmatched").alias("unmatched_addresses")),
        reviewed.select("review_version", F.col("passed").alias("review_passed"), F.col("size").alias("review_size"), F.col("input_path").alias("review_path"), F.col("input_sha256").alias("review_sha256")),
        gates.sample_metrics(files.read_snapshot(spark, f"{review}/samples", SAMPLES), generated),
    ]
    one = reduce(lambda a, b: a.join(F.broadcast(b), F.lit(True)), rows)
    return one.withColumns({"allow_partial": F.lit(allow_partial), "songs_path": F.lit(songs), "songs_sha256": F.lit(digest(spark, f"{songs}/songs"))})


def promote(spark: SparkSession, catalog: str, songs: str, review: str, out: str, allow_partial: bool, url_pattern: str) -> None:
    """Writes what a release keeps of the catalog; ValueError with the first gate that fails, and nothing is written."""
    metrics = promotion_metrics(spark, catalog, songs, review, allow_partial, url_pattern)
    kept = gates.production_catalog(metrics, files.read_snapshot(spark, f"{catalog}/songs", VARIANTS))
    files.write_snapshot(kept, out, ["song_ord", "number"])
