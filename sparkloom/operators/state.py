"""Checkpoints: reuse, status routing, pages outside the index, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 12
STATUSES = ("success", "no-x1", "unavailable", "error")


def reusable(index: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """The index with `reuse`: a stored result that is no error and whose date is the index's (both missing counts as equal)."""
    was = checkpoint.select("url", F.col("status").alias("__s"), F.col("last_modified").alias("__m"))
    ok = F.col("__s").isNotNull() & (F.col("__s") != "error") & F.col("last_modified").eqNullSafe(F.col("__m"))
    return index.join(was, "url", "left").withColumn("reuse", F.coalesce(ok, F.lit(False))).drop("__s", "__m")


def outside_index(checkpoint: DataFrame, index: DataFrame) -> DataFrame:
    return checkpoint.join(index.select("url"), "url", "left_anti")


def status_summary(index: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """One row: a count for each status (zeros too), pending pages, completion in percent (100 for an empty index)."""
    both = index.select("url").join(checkpoint.select("url", "status"), "url", "left")
    counts = [F.count_if(F.col("status") == s).alias("n_" + s.replace("-", "_")) for s in STATUSES]
    one = both.agg(F.count("*").alias("n_index"), *counts, F.count_if(F.col("status").isNull()).alias("n_pending"))
    done = sum((F.col("n_" + s.replace("-", "_")) for s in STATUSES[1:]), F.col("n_success"))
    return one.withColumn("percent", F.when(F.col("n_index") == 0, F.lit(100.0)).otherwise(F.floor(done / F.col("n_index") * 10000 + 0.5) / 100))


def upserted(state: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """State with the rows of `new` in place of those with the same key."""
    return state.join(new.select(key), key, "left_anti").unionByName(new)


def outcome(variants, http_status):
    """Status of a fetched page from its number of supported variants (null: not parsed) and HTTP status."""
    return F.when(variants > 0, "success").when(variants == 0, "no-x1").when(http_status == 404, "unavailable").otherwise("error")


def status_lists(index: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(status, url, ordinal, place): pages of each status, pending ones too, with their place, from 1, in order of the index.

    Pages are placed in blocks of neighbouring ordinals, after the counts of the blocks before, so that no status is one
    task's; ordinals are whole numbers and don't repeat.
    """
    status = F.coalesce("status", F.lit("pending")).alias("status")
    rows = index.join(checkpoint.select("url", "status"), "url", "left").select(status, "url", "ordinal", F.shiftright(F.col("ordinal").cast("long"), BLOCK_BITS).alias("__block"))
    inside = rows.withColumn("__at", F.row_number().over(Window.partitionBy("status", "__block").orderBy("ordinal")))
    sizes = rows.groupBy("status", "__block").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy("status").orderBy("__block")) - F.col("__n")).drop("__n")
    return inside.join(before, ["status", "__block"]).select("status", "url", "ordinal", (F.col("__before") + F.col("__at")).alias("place"))


def aborted(fetched: DataFrame) -> DataFrame:
    """Pages of each source up to the first that was refused (403 or 429), that one without; all that follows is left for another run."""
    stop = fetched.where(F.col("http_status").isin(403, 429)).groupBy("source").agg(F.min("ordinal").alias("__stop"))
    return fetched.join(stop, "source", "left").where(F.col("__stop").isNull() | (F.col("ordinal") < F.col("__stop"))).drop("__stop")


def new_only(entries: DataFrame, strict: bool) -> DataFrame:
    """Entries that aren't known. `strict` drops those without a flag (the audit), otherwise they count as new (the crawl)."""
    flag = F.col("known")
    return entries.where(flag.eqNullSafe(F.lit(False)) if strict else ~F.coalesce(flag, F.lit(False)))


def normalized_index(site: DataFrame, local: DataFrame, new: bool) -> DataFrame:
    """(url, last_modified, layout) of an index in either layout; only the local one (with `known`) can be cut to new entries."""
    if new and not site.isEmpty():
        raise ValueError("a site's index has no flags to choose new entries by")
    kept = new_only(local, strict=True) if new else local
    one = site.select("url", "last_modified", F.lit("site").alias("layout"))
    return one.unionByName(kept.select("url", F.lit(None).cast("string").alias("last_modified"), F.lit("local").alias("layout")))


def source_reuse(sources: DataFrame, saved: DataFrame) -> DataFrame:
    """Sources with `reuse`: a saved result that is no error and of the very same descriptor (all columns but id)."""
    described = F.to_json(F.struct(*[c for c in sorted(sources.columns) if c != "id"]), {"ignoreNullFields": "false"})
    was = saved.select("id", F.col("status").alias("__s"), F.col("descriptor").alias("__d"))
    ok = (F.col("__s") != "error") & (F.col("__d") == described)
    return sources.join(was, "id", "left").withColumn("reuse", F.coalesce(ok, F.lit(False))).drop("__s", "__d")


def candidate_checks(entries: DataFrame, url_pattern: str) -> DataFrame:
    """One row: entries, addresses that don't fit, repeated addresses, and whether the declared total is the number of entries."""
    counts = entries.groupBy("url").agg(F.count("*").alias("n"), F.max("declared").alias("declared"))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_entries"), F.count_if(~F.coalesce(F.col("url").rlike(url_pattern), F.lit(False))).alias("n_bad"), F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.coalesce(F.max("declared") == F.sum("n"), F.lit(False)).alias("total_fits"),
    )


def generated_songs(checkpoint: DataFrame) -> DataFrame:
    """All songs of good pages, by address."""
    return checkpoint.where("status = 'success' and song is not null").select("url", "song").orderBy("url")
