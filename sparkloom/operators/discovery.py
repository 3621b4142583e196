"""Candidate discovery: grouping by page with provenance, section counts, artists' page plans."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZE = 20


def candidate_index(found: DataFrame, production: DataFrame) -> DataFrame:
    """(url, known, sources): one entry per source, the last one found (by ordinal), and whether the page is in production."""
    last = found.groupBy("url", "source").agg(F.max_by("sections", "ordinal").alias("sections"))
    grouped = last.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("source", "sections"))).alias("sources"))
    keys = production.select("url").distinct().withColumn("known", F.lit(True))
    return grouped.join(keys, "url", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def section_counts(found: DataFrame, sections: DataFrame) -> DataFrame:
    """Distinct pages of each section, zero for sections without any."""
    counts = found.groupBy("section").agg(F.count_distinct("url").alias("n"))
    return sections.join(counts, "section", "left").select("section", F.coalesce("n", F.lit(0)).alias("n_pages"))


def page_plan(seeds: DataFrame) -> DataFrame:
    """(artist_id, page, first, last) of every page that an artist's declared total asks for."""
    pages = seeds.where("declared_total > 0").withColumn("page", F.explode(F.sequence(F.lit(1), F.ceil(F.col("declared_total") / PAGE_SIZE).cast("int"))))
    return pages.select("artist_id", "page", ((F.col("page") - 1) * PAGE_SIZE + 1).alias("first"), F.least(F.col("page") * PAGE_SIZE, "declared_total").alias("last"))


def pending(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """Planned pages that are not stored, or stored as an error."""
    state = stored.select("artist_id", "page", "status")
    return plan.join(state, ["artist_id", "page"], "left").where(F.col("status").isNull() | (F.col("status") == "error")).drop("status")


def artist_rollup(plan: DataFrame, stored: DataFrame) -> DataFrame:
    """Status counts of each artist's planned pages, zeros included."""
    both = plan.join(stored.select("artist_id", "page", "status"), ["artist_id", "page"], "left")
    counts = {s: F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("success", "unavailable", "error")}
    return both.groupBy("artist_id").agg(F.count("*").alias("planned"), *counts.values(), F.count_if(F.col("status").isNull()).alias("n_pending"))


def top_per_source(ranked: DataFrame, source: str, order: list, n: int) -> DataFrame:
    """The first n rows of each source. Parts of a source are cut to n first, so that no source is sorted whole."""
    salt = F.pmod(F.xxhash64(*ranked.columns), F.lit(32))
    cut = ranked.withColumn("__salt", salt).withColumn("__at", F.row_number().over(Window.partitionBy(source, "__salt").orderBy(*order))).where(F.col("__at") <= n)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("rank") <= n).drop("__salt", "__at")


def artist_seeds(sources: DataFrame, host: str) -> DataFrame:
    """(artist_id, artist_name, declared_total, planned_pages) of the first pages of artists that were read well and aren't excluded.

    sources: (id, parser, status, excluded, url, artist_name, total). `complete` is whether the source says all that is needed,
    `once` whether no other source has the artist.
    """
    use = (F.col("parser") == "artist-catalog") & (F.col("status") == "success") & ~F.coalesce("excluded", F.lit(False)) & F.col("id").endswith("-page-1")
    artist = F.nullif(F.regexp_extract("url", rf"^https://{host}/artist/([0-9]+)", 1), F.lit(""))
    rows = sources.where(use).select("id", artist.alias("artist_id"), "artist_name", F.col("total").cast("long").alias("declared_total"))
    rows = rows.withColumn("complete", F.col("artist_id").isNotNull() & (F.coalesce(F.length("artist_name"), F.lit(0)) > 0) & F.coalesce(F.col("declared_total") >= 1, F.lit(False)))
    counts = rows.groupBy("artist_id").agg(F.count("*").alias("__n"))
    rows = rows.join(counts, rows.artist_id.eqNullSafe(counts.artist_id)).drop(counts.artist_id)
    return rows.select("id", "artist_id", "artist_name", "declared_total", F.ceil(F.col("declared_total") / PAGE_SIZE).alias("planned_pages"), "complete", (F.col("__n") == 1).alias("once"))


def reconciled(seeds: DataFrame, saved: DataFrame) -> DataFrame:
    """Seeds with their saved state: a total that was changed since is kept if name and id agree; others start anew; artists without seed vanish."""
    was = saved.select("artist_id", F.col("artist_name").alias("__name"), F.col("declared_total").alias("__total"))
    same = F.coalesce(F.col("__name") == F.col("artist_name"), F.lit(False))
    both = seeds.join(was, "artist_id", "left").withColumn("kept", same)
    return both.withColumn("declared_total", F.when(same, F.col("__total")).otherwise(F.col("declared_total"))).drop("__name", "__total")


def reset_totals(artists: DataFrame, pages: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(artists, pages) after fetched pages have shown other totals: those artists lose all pages and get new plans; totals under 1 are refused."""
    new = totals.where("declared_total >= 1").select("artist_id", F.col("declared_total").alias("__new"))
    both = artists.join(new, "artist_id", "left").withColumn("reset", F.coalesce(F.col("__new") != F.col("declared_total"), F.lit(False)))
    both = both.withColumn("declared_total", F.coalesce("__new", "declared_total")).drop("__new")
    both = both.withColumn("planned_pages", F.ceil(F.col("declared_total") / PAGE_SIZE))
    return both, pages.join(both.where("reset").select("artist_id"), "artist_id", "left_anti")


def imported_pages(old: DataFrame, artists: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of an earlier run that may stand for missing ones: good, of a wanted artist with the same total, not stored yet, and none of that artist fetched anew."""
    wanted = artists.select("artist_id", F.col("declared_total").alias("__total"), "planned_pages")
    fit = old.where("status = 'success'").join(wanted, "artist_id").where((F.col("declared_total") == F.col("__total")) & F.col("page").between(1, F.col("planned_pages"))).drop("__total", "planned_pages")
    fresh = pages.where("imported_from is null").select("artist_id").distinct()
    return fit.join(pages.select("artist_id", "page"), ["artist_id", "page"], "left_anti").join(fresh, "artist_id", "left_anti")


def artist_state(artists: DataFrame, pages: DataFrame, urls: DataFrame) -> DataFrame:
    """Each artist with its page counts, distinct candidates, and whether all pages are good but the candidates don't add up to the total."""
    inside = pages.join(artists.select("artist_id", "planned_pages"), "artist_id").where(F.col("page").between(1, F.col("planned_pages")))
    counts = inside.groupBy("artist_id").agg(F.count("*").alias("n_stored"), *[F.count_if(F.col("status") == x).alias(f"n_{x}") for x in ("success", "unavailable", "error")])
    found = inside.where("status = 'success'").select("artist_id", "page").join(urls, ["artist_id", "page"]).groupBy("artist_id").agg(F.count_distinct("url").alias("n_urls"))
    both = artists.join(counts, "artist_id", "left").join(found, "artist_id", "left").na.fill(0, ["n_stored", "n_success", "n_unavailable", "n_error", "n_urls"])
    both = both.withColumn("n_pending", F.col("planned_pages") - F.col("n_stored")).drop("n_stored")
    return both.withColumn("inconsistent", (F.col("n_unavailable") == 0) & (F.col("n_error") == 0) & (F.col("n_pending") == 0) & (F.col("n_urls") != F.col("declared_total")))


def without_drift(state: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages without the imported ones of inconsistent artists, which are to be fetched anew."""
    drift = state.where("inconsistent").select("artist_id").withColumn("__drift", F.lit(True))
    return pages.join(drift, "artist_id", "left").where(F.col("__drift").isNull() | F.col("imported_from").isNull()).drop("__drift")


def page_faults(pages: DataFrame, seeds: DataFrame) -> DataFrame:
    """Fetched pages (artist_id, page, total, first, last, n_urls, n_distinct) with the first thing wrong with them, or null."""
    plan = seeds.select("artist_id", "declared_total")
    first = (F.col("page") - 1) * PAGE_SIZE + 1
    last = F.least(F.col("page") * PAGE_SIZE, F.col("declared_total"))
    fault = (
        F.when(F.col("total") != F.col("declared_total"), "total changed")
        .when((F.col("first") != first) | (F.col("last") != last), "range")
        .when(F.col("n_urls") != last - first + 1, "number of links")
        .when(F.col("n_distinct") != F.col("n_urls"), "repeated links")
    )
    return pages.join(plan, "artist_id").withColumn("fault", fault).drop("declared_total")


def artist_entries(pages: DataFrame, urls: DataFrame, production: DataFrame) -> DataFrame:
    """(url, known, artist_id, page, rank): all places of each candidate on good pages; rank goes on from page to page."""
    good = pages.where("status = 'success'").select("artist_id", "page")
    known = production.select("url").distinct().withColumn("known", F.lit(True))
    rows = urls.join(good, ["artist_id", "page"]).join(known, "url", "left")
    return rows.select("url", F.coalesce("known", F.lit(False)).alias("known"), "artist_id", "page", ((F.col("page") - 1) * PAGE_SIZE + 1 + F.col("pos")).alias("rank"))


def artist_index(state: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: the summary of a full-artist discovery, and whether it is ready: nothing pending, no errors, none inconsistent."""
    sums = state.agg(
        F.count("*").alias("n_artists"), F.sum("declared_total").alias("declared"), F.sum("planned_pages").alias("planned"), F.sum("n_success").alias("n_success"), F.sum("n_unavailable").alias("n_unavailable"),
        F.sum("n_error").alias("n_error"), F.sum("n_pending").alias("n_pending"), F.count_if("inconsistent").alias("n_inconsistent"), F.sum("n_urls").alias("n_references"),
    )
    pages = entries.groupBy("url").agg(F.max("known").alias("known")).agg(F.count("*").alias("n_pages"), F.count_if("known").alias("n_known"))
    one = sums.join(F.broadcast(pages), F.lit(True)).withColumn("n_new", F.col("n_pages") - F.col("n_known"))
    return one.withColumn("ready", (F.col("n_pending") == 0) & (F.col("n_error") == 0) & (F.col("n_inconsistent") == 0))


def without_excluded(found: DataFrame, artists: DataFrame, excluded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates of artists that no exclusion list names, all artists with `excluded`): excluded artists stay listed, without candidates."""
    names = excluded.select("artist_name").distinct().withColumn("excluded", F.lit(True))
    marked = artists.join(names, "artist_name", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    return found.join(marked.where("excluded").select("artist_id"), "artist_id", "left_anti"), marked


def ranked_artists(pages: DataFrame, prefix: str, pattern: str) -> DataFrame:
    """Distinct artist addresses of good ranking pages whose id begins with the prefix."""
    return pages.where((F.col("status") == "success") & F.col("id").startswith(prefix) & F.col("url").rlike(pattern)).select("url").distinct()


def year_lists(found: DataFrame) -> DataFrame:
    """(url, years): the years of each page, in order of year; at most as many as there are years."""
    return found.groupBy("url").agg(F.array_sort(F.collect_set("year")).alias("years"))


def discovery_summary(sources: DataFrame, found: DataFrame, production: DataFrame) -> DataFrame:
    """One row: sources by status, references, distinct pages, pages in production and new ones."""
    known = production.select("url").distinct().withColumn("known", F.lit(1))
    pages = found.groupBy("url").agg(F.count("*").alias("refs")).join(known, "url", "left")
    one = pages.agg(F.coalesce(F.sum("refs"), F.lit(0)).alias("n_references"), F.count("*").alias("n_pages"), F.count("known").alias("n_known")).withColumn("n_new", F.col("n_pages") - F.col("n_known"))
    counts = sources.agg(F.count("*").alias("n_sources"), *[F.count_if(F.col("status") == x).alias(f"sources_{x}") for x in ("success", "unavailable", "error")])
    return counts.join(F.broadcast(one), F.lit(True))


class Output(NamedTuple):
    """What a discovery gives out: one row of counts, its sources, and a row for each candidate and source."""

    summary: DataFrame
    sources: DataFrame
    entries: DataFrame


NO_LINKS = "songs declared, none linked"


def discovery_output(sources: DataFrame, candidates: DataFrame, production: DataFrame, sections: list[str]) -> Output:
    """Ranked or expanded candidates with all that was asked of their sources.

    sources: (id, url, parser, status, excluded, total, limit); candidates: (source, url, section, rank, year, ordinal).
    Of a source's links the first `limit` count (null: all), and of a link that a source has several times the last one.
    Sources that a category excludes stay listed, without candidates; a good catalog page that declares songs but links
    none is at fault. The years of a link are a row each, under the rank of its last one. Entries come as rows (url, known,
    source, section, rank, years), so that no page's sources are gathered; order them by url and source where they are written.
    """
    known = production.select("url").distinct().withColumn("known", F.lit(True))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("ordinal"))
    limits = sources.where("limit is not null").select(F.col("id").alias("source"), "limit")
    # only sources with a limit are numbered, and a page of links is small
    numbered = candidates.join(limits, "source").withColumn("__at", rank).where(F.col("__at") <= F.col("limit")).drop("__at", "limit")
    cut = candidates.join(limits.select("source"), "source", "left_anti").unionByName(numbered)
    counts = cut.groupBy("source").agg(F.count_distinct("url").alias("n_candidates"))
    listed = sources.join(counts.withColumnRenamed("source", "id"), "id", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    fault = F.when((F.col("status") == "success") & (F.coalesce("total", F.lit(0)) > 0) & (F.col("n_candidates") == 0), NO_LINKS)
    listed = listed.withColumn("fault", fault)
    used = cut.join(sources.where(~F.coalesce("excluded", F.lit(False))).select(F.col("id").alias("source")), "source", "left_semi")
    last = used.groupBy("url", "source").agg(F.max_by(F.struct("section", "rank"), F.struct("ordinal", "section", "rank")).alias("r"), F.array_sort(F.collect_set("year")).alias("years"))
    entries = last.join(known, "url", "left").select("url", F.coalesce("known", F.lit(False)).alias("known"), "source", "r.section", "r.rank", "years")
    pages = entries.groupBy("url").agg(F.max("known").alias("known"), *[F.max(F.coalesce(F.col("section") == x, F.lit(False))).alias(x) for x in sections])
    counted = pages.agg(F.count("*").alias("n_pages"), F.count_if("known").alias("n_known"), F.count_if(~F.col("known")).alias("n_new"), *[F.count_if(x).alias(f"n_{x}") for x in sections])
    good = F.col("status") == "success"
    asked = listed.agg(F.count("*").alias("n_sources"), F.count_if(good).alias("n_success"), F.count_if(~good).alias("n_unavailable"), F.count_if("excluded").alias("n_excluded"), F.count("fault").alias("n_faults"))
    return Output(asked.join(F.broadcast(counted), F.lit(True)), listed, entries)


def artist_sources(artists: DataFrame, url: str, limit: int) -> DataFrame:
    """(id, artist_id, page, url, limit) of the list pages of artists (artist_id, total) that hold their first `limit` songs; the first page always.

    url: the address with {artist} and {page}.
    """
    pages = F.least(F.ceil(F.lit(limit) / PAGE_SIZE), F.greatest(F.lit(1), F.ceil(F.coalesce("total", F.lit(0)) / PAGE_SIZE))).cast("int")
    rows = artists.select("artist_id", F.explode(F.sequence(F.lit(1), pages)).alias("page"))
    address = F.replace(F.replace(F.lit(url), F.lit("{artist}"), F.col("artist_id").cast("string")), F.lit("{page}"), F.col("page").cast("string"))
    own = F.least(F.lit(PAGE_SIZE), limit - (F.col("page") - 1) * PAGE_SIZE)
    return rows.select(F.concat(F.lit("artist-"), "artist_id", F.lit("-page-"), "page").alias("id"), "artist_id", "page", address.alias("url"), own.alias("limit"))


def seed_sources(fixed: list[tuple[str, str]], yearly: list[tuple[str, str, int, int]], spark) -> DataFrame:
    """(id, url, year): constant sources, and one for each year of (id, url with {year}, first, last); few rows."""
    rows = [(i, u, None) for i, u in fixed] + [(f"{i}-{y}", u.format(year=y), y) for i, u, a, z in yearly for y in range(a, z + 1)]
    return spark.createDataFrame(rows, "id string, url string, year int")
