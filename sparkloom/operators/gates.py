"""Validation, comparison and release gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import trimmed

BLOCK_BITS = 12


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def rule_errors(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_errors) of all row rules, zeros included, in one pass."""
    one = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in rules]), F.array(*[F.col(k) for k in rules]))).alias("rule", "n_errors"))


def song_errors(variants: DataFrame, url_pattern: str) -> DataFrame:
    """(song_ord, var_ord, rule, message) of songs given as variant rows, in row order: eight rules.

    A blank title or artist, an address that doesn't fit, a repeated id or address (of songs; var_ord is -1), a number
    that isn't digits, an unsupported variant, a repeated variant id or number. The first row of a key is no repeat:
    it is found by a minimum per key, so that a key of many rows is no task's sort.
    """
    songs = variants.groupBy("song_ord").agg(*[F.first(c).alias(c) for c in ("url", "song_id", "title", "artist")]).withColumn("var_ord", F.lit(-1).cast("long"))
    own = variants.where("number is not null")
    blank = F.length(trimmed(F.coalesce("title", F.lit("")))) * F.length(trimmed(F.coalesce("artist", F.lit("")))) == 0
    rules = [
        (songs.where(blank), "blank", "url"),
        (songs.where(~F.coalesce(F.col("url").rlike(url_pattern), F.lit(False))), "address", "url"),
        (_repeats(songs, "song_id"), "song-id", "song_id"),
        (_repeats(songs, "url"), "repeated-address", "url"),
        (own.where(~F.col("number").rlike(r"^[0-9]+\z")), "number", "number"),
        (own.where(~F.coalesce("supports", F.lit(False))), "unsupported", "variant_id"),
        (_repeats(own, "variant_id"), "variant-id", "variant_id"),
        (_repeats(own, "number"), "repeated-number", "number"),
    ]
    out = None
    for place, (rows, rule, key) in enumerate(rules):
        part = rows.select("song_ord", "var_ord", F.lit(place).alias("place"), F.lit(rule).alias("rule"), F.col(key).alias("message"))
        out = part if out is None else out.unionByName(part)
    return out


def _repeats(rows: DataFrame, key: str) -> DataFrame:
    order = F.struct("song_ord", "var_ord")
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    return rows.join(first, key).where(order > F.col("__first")).drop("__first", "__n")


#: What a release needs of the one row that sources.release.promotion_metrics() gives: in this order, the first that fails is reported.
RELEASE = [
    ("catalog format", "catalog_version = 1"),
    ("songs format", "songs_version = 1"),
    ("review format", "review_version = 1"),
    ("crawl incomplete", "ready or allow_partial"),
    ("error pages", "n_error = 0"),
    ("conflicts", "n_conflicts = 0"),
    ("error list", "listed_error = 0"),
    ("conflict list", "listed_conflicts = 0"),
    ("pages outside the index", "listed_outside = 0"),
    ("processed pages", "n_success + n_no_x1 + n_unavailable + n_error = n_processed"),
    ("indexed pages", "n_success + n_no_x1 + n_unavailable + n_error + n_pending = n_index"),
    ("pending list", "listed_pending = n_pending"),
    ("merged songs", "listed_songs = merged_songs"),
    ("merged variants", "listed_variants = merged_variants"),
    ("song errors", "song_errors = 0"),
    ("success count", "stats_success = n_success"),
    ("no-x1 count", "stats_no_x1 = n_no_x1"),
    ("unavailable count", "stats_unavailable = n_unavailable"),
    ("error count", "stats_error = n_error"),
    ("generated songs", "generated_songs = n_success"),
    ("generated addresses", "unmatched_addresses = 0"),
    ("review failed", "review_passed"),
    ("review too small", "review_size >= 20"),
    ("review size", "listed_samples = review_size"),
    ("review samples", "bad_samples = 0"),
    ("repeated samples", "distinct_samples = review_size"),
    ("reviewed file", "review_path = songs_path"),
    ("reviewed content", "review_sha256 = songs_sha256"),
]


def sample_metrics(samples: DataFrame, generated: DataFrame) -> DataFrame:
    """One row over review samples (url, matched, differences): their number, distinct pages, and those that fail or aren't among the generated songs (url)."""
    known = generated.select("url").distinct().withColumn("__in", F.lit(True))
    ok = F.coalesce(F.col("matched") & (F.size("differences") == 0) & F.col("__in"), F.lit(False))
    return samples.join(known, "url", "left").agg(F.count("*").alias("listed_samples"), F.count_distinct("url").alias("distinct_samples"), F.count_if(~ok).alias("bad_samples"))


def release(metrics: DataFrame) -> DataFrame:
    """The row of metrics with the first of the RELEASE assertions that fails (null is a failure), and whether it may be released."""
    return first_failure(metrics, [(name, F.expr(rule)) for name, rule in RELEASE])


def production_catalog(metrics: DataFrame, variants: DataFrame) -> DataFrame:
    """What a release keeps: songs and variants with the lineage and nine counts of the audit; raises if a gate fails."""
    row = release(metrics).first()
    if not row.released:
        raise ValueError(row.first_failure)
    kept = ["songs_sha256", "n_index", "n_processed", "n_pending", "percent", "n_success", "n_no_x1", "n_unavailable", "merged_songs", "merged_variants"]
    return variants.withColumns({**{c: F.lit(row[c]) for c in kept}, "partial": F.lit(not row.ready)})


def multiset_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both hold the same rows as often."""
    c = a.columns
    n = a.select(*c, F.lit(1).alias("__d")).unionByName(b.select(*c, F.lit(-1).alias("__d"))).groupBy(*c).agg(F.sum("__d").alias("d"))
    return n.agg(F.coalesce(F.sum(F.abs("d")), F.lit(0)).alias("n_unmatched")).withColumn("equal", F.col("n_unmatched") == 0)


def differences(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """`differences`: the fields whose stored_ and live_ values are not the same (null is a value)."""
    diff = F.array_compact(F.array(*[F.when(~F.col(f"stored_{f}").eqNullSafe(F.col(f"live_{f}")), F.lit(f)) for f in fields]))
    return pairs.withColumn("differences", diff).withColumn("matched", F.size("differences") == 0)


VARIANT_FIELDS = ["number", "label", "version_type", "supports_x1"]


def _by_number(variants: Column) -> Column:
    """Variants in order of number and then of their other fields, without what isn't compared."""
    bare = F.transform(F.coalesce(variants, F.array()), lambda v: F.struct(*[v[f].alias(f) for f in VARIANT_FIELDS]))
    return F.array_sort(bare)


def song_differences(pairs: DataFrame) -> DataFrame:
    """Pairs of a stored and a live song with `differences`, `matched`, and the numbers of variants `added`, `lost` and `changed`.

    Pairs have stored_ and live_ title, artist and variants (number, label, version_type, supports_x1). Null is a value;
    null variants count as none. Order does not matter, repeats do. A number on both sides is changed if its variants
    aren't the same ones; one that is on one side only is added or lost.
    """
    was, now = _by_number(F.col("stored_variants")), _by_number(F.col("live_variants"))
    pairs = pairs.withColumns({"__was": was, "__now": now})
    numbers = lambda c: F.array_distinct(F.transform(c, lambda v: v["number"]))
    of = lambda c, n: F.filter(c, lambda v: v["number"].eqNullSafe(n))
    both = F.array_intersect(numbers("__was"), numbers("__now"))
    changed = F.filter(both, lambda n: ~of("__was", n).eqNullSafe(of("__now", n)))
    field = lambda f: F.when(~F.col(f"stored_{f}").eqNullSafe(F.col(f"live_{f}")), F.lit(f))
    told = pairs.withColumns({"added": F.array_except(numbers("__now"), numbers("__was")), "lost": F.array_except(numbers("__was"), numbers("__now")), "changed": changed})
    one = F.array_compact(F.array(field("title"), field("artist"), F.when(~F.col("__was").eqNullSafe(F.col("__now")), F.lit("variants"))))
    return told.withColumn("differences", one).withColumn("matched", F.size("differences") == 0).drop("__was", "__now")


def first_failure(metrics: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """One row of metrics with the first gate that does not hold, or null."""
    found = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in gates], F.lit(None).cast("string"))
    return metrics.withColumn("first_failure", found).withColumn("released", found.isNull())


def require(metrics: DataFrame, gates: list[tuple[str, Column]]) -> None:
    """Raise ValueError with the first gate that does not hold."""
    row = first_failure(metrics, gates).select("first_failure").first()
    if row[0]:
        raise ValueError(row[0])


def fingerprint_in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """One row: SHA-256 over the digests of blocks of blocks of rows in order of a whole-number key, equal keys by digest.

    A block holds the rows of 2**BLOCK_BITS neighbouring keys, so that only keys that repeat make it larger; nulls have
    their own block, come first and differ from empty text. No rows have the digest of the empty text.
    """
    cells = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in rows.columns]
    level = rows.select(F.col(key).cast("long").alias("k"), F.sha2(F.concat_ws("|", *cells), 256).alias("d"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("k").isNotNull().alias("has"), "k", "d"))), lambda x: x["d"]), "\n"), 256)
    for _ in range(64 // BLOCK_BITS):
        level = level.groupBy(F.shiftright("k", BLOCK_BITS).alias("b")).agg(joined.alias("d")).select(F.col("b").alias("k"), "d")
    return level.agg(joined.alias("sha256"))


def fingerprint(rows: DataFrame, order: list[str]) -> DataFrame:
    """SHA-256 over rows' digests in order: of chunks by the order's high part first would change it, so rows must be few (a manifest)."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
    listed = F.array_sort(F.collect_list(F.struct(*order, line.alias("__line"))))
    return rows.agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["__line"]), "\n"), 256).alias("sha256"))
