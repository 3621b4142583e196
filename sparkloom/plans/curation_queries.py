"""Registered queries: merge, snapshots, gates, state and discovery, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import discovery, gates, merge, search, state
from sparkloom.plans.catalog_queries import registered
from sparkloom.session import new_path
from sparkloom.sources import release

# Songs drawn from parts in blocks of eight: a base song (in production for each third block), then one of each outcome.
_BLOCKS = """WITH g AS (SELECT p_partkey AS k, CAST(p_partkey // 8 AS VARCHAR) AS b, p_partkey % 8 AS i, (p_partkey // 8) % 3 = 0 AS old FROM part) """


def _blocks(table) -> tuple[DataFrame, DataFrame]:
    key = F.col("p_partkey")
    block, i = F.floor(key / 8), key % 8
    b, k = block.cast("string"), key.cast("string")
    base = lambda p: F.concat(F.lit(p), b)
    own = lambda p: F.concat(F.lit(p), k)
    rows = table("part").select(
        key.alias("song_ord"), F.lit(0).cast("long").alias("var_ord"),
        F.when(i == 3, own("z")).when(i == 4, own("w")).otherwise(base("u")).alias("url"),
        F.when((i == 0) | (i == 3), base("i")).otherwise(own("x")).alias("song_id"),
        F.when(i == 2, F.lit("other")).otherwise(base("t")).alias("title"), base("a").alias("artist"),
        F.when(i.isin(0, 4, 5, 6), base("n")).otherwise(own("m")).alias("number"),
        F.when(i.isin(0, 7), base("v")).otherwise(own("y")).alias("variant_id"),
        F.when(i == 5, F.lit("changed")).otherwise(F.lit("plain")).alias("meta"), ((i == 0) & (block % 3 == 0)).alias("old"),
    )
    return rows.where("old").drop("old"), rows.where("not old").drop("old")


@registered(_BLOCKS + "SELECT 'u' || b AS url, 'n' || b AS number, 'v' || b AS variant_id, NOT old AS added FROM g WHERE i = 0 UNION ALL SELECT 'u' || b, 'm' || k, 'y' || k, true FROM g WHERE i = 1")
def merge_catalog(table):
    return merge.merge_catalog(*_blocks(table)).variants.select("url", "number", "variant_id", "added")


@registered(_BLOCKS + "SELECT 'u' || b AS url, 'i' || b AS song_id, 't' || b AS title, NOT old AS added FROM g WHERE i = 0")
def merge_songs(table):
    return merge.merge_catalog(*_blocks(table)).songs.select("url", "song_id", "title", "added")


@registered(_BLOCKS + """SELECT CASE i WHEN 2 THEN 'song-metadata' WHEN 3 THEN 'song-id' WHEN 4 THEN 'song-number' WHEN 5 THEN 'variant-metadata' ELSE 'variant-id' END AS kind, CASE i WHEN 2 THEN 'u' WHEN 3 THEN 'i' WHEN 7 THEN 'v' ELSE 'n' END || b AS key,
CASE i WHEN 3 THEN 'z' || k WHEN 4 THEN 'w' || k ELSE 'u' || b END AS url, 'u' || b AS other_url FROM g WHERE i IN (2, 3, 4, 5, 7)""")
def merge_conflicts(table):
    return merge.merge_catalog(*_blocks(table)).conflicts.select("kind", "key", "url", "other_url")


@registered(_BLOCKS + """SELECT count(*) FILTER (i = 0 AND old) AS production_songs, count(*) FILTER (i = 0 AND old) AS production_variants, count(*) FILTER (NOT (i = 0 AND old)) AS generated_songs, count(*) FILTER (NOT (i = 0 AND old)) AS generated_variants, count(*) FILTER (i = 0 AND NOT old) AS new_songs,
count(*) FILTER (i IN (1, 2, 5, 6, 7)) AS overlapping_songs, count(*) FILTER (i = 1 OR (i = 0 AND NOT old)) AS added_variants, count(*) FILTER (i = 0) AS merged_songs, count(*) FILTER (i IN (0, 1)) AS merged_variants FROM g""")
def merge_stats(table):
    return merge.merge_catalog(*_blocks(table)).stats


def _crawl(table) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Index, checkpoint, the checkpoint's songs, production: parts as pages, with states by size; suppliers lie outside."""
    url, size = F.concat(F.lit("p"), "p_partkey"), F.col("p_size") % 10
    part = table("part")
    index = part.select(url.alias("url"), F.col("p_partkey").alias("ordinal"))
    status = F.when((size == 0) & (F.col("p_partkey") % 7 == 0), "odd").when(size <= 5, "success").when(size == 6, "no-x1").when(size == 7, "unavailable").otherwise("error")
    found = part.where(size < 9).select(url.alias("url"), status.alias("status"), F.when(size <= 3, url).when(size == 5, F.concat(url, F.lit("x"))).alias("song_url"))
    outside = table("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("url"), F.lit("no-x1").alias("status"), F.lit(None).cast("string").alias("song_url"))
    song = [F.col("p_partkey").alias("song_ord"), F.lit(0).cast("long").alias("var_ord"), url.alias("url"), F.concat(F.lit("i"), "p_partkey").alias("song_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist")]
    variant = lambda p: [F.concat(F.lit(p), "p_partkey").alias("number"), F.concat(F.lit(p + "v"), "p_partkey").alias("variant_id"), F.lit("m").alias("meta")]
    songs = part.select(url.alias("page"), *song, *variant("n"))
    production = part.where((size == 1) & (F.col("p_partkey") % 2 == 0)).select(*song, *variant("q"))
    return index, found.unionByName(outside), songs, production


@registered("""WITH g AS (SELECT p_partkey AS k, p_size % 10 AS z, p_size % 10 = 0 AND p_partkey % 7 = 0 AS odd FROM part), o AS (SELECT count(*) AS n FROM supplier),
c AS (SELECT count(*) AS n_index, count(*) FILTER (z <= 5 AND NOT odd) AS n_success, count(*) FILTER (z = 6) AS n_no_x1, count(*) FILTER (z = 7) AS n_unavailable, count(*) FILTER (z = 8) AS n_error, count(*) FILTER (z = 9) AS n_pending, (SELECT n FROM o) AS n_outside_index, count(*) FILTER (odd OR z IN (4, 5)) + (SELECT n FROM o) AS n_conflicts,
count(*) FILTER (z <= 3 AND NOT odd AND NOT (z = 1 AND k % 2 = 0)) AS new_songs, count(*) FILTER (z = 1 AND k % 2 = 0) AS overlapping_songs, count(*) FILTER (z <= 3 AND NOT odd) AS added_variants FROM g)
SELECT n_index, n_success, n_no_x1, n_unavailable, n_error, n_pending, n_outside_index, n_conflicts, new_songs, overlapping_songs, added_variants, n_success + n_no_x1 + n_unavailable + n_error AS n_processed, floor((n_success + n_no_x1 + n_unavailable + n_error) / n_index * 10000 + 0.5) / 100 AS percent, n_pending = 0 AND n_error = 0 AND n_conflicts = 0 AS ready FROM c""")
def catalog_snapshot(table):
    return merge.catalog_snapshot(*_crawl(table)).summary.select("n_index", "n_success", "n_no_x1", "n_unavailable", "n_error", "n_pending", "n_outside_index", "n_conflicts", "new_songs", "overlapping_songs", "added_variants", "n_processed", "percent", "ready")


@registered("""SELECT 'p' || p_partkey AS key, CASE WHEN p_size % 10 = 4 THEN 'success without song' WHEN p_size % 10 = 5 THEN 'song of another page' ELSE 'unknown status' END AS message FROM part WHERE p_size % 10 IN (4, 5) OR (p_size % 10 = 0 AND p_partkey % 7 = 0) UNION ALL SELECT 's' || s_suppkey, 'outside the index' FROM supplier""")
def snapshot_conflicts(table):
    return merge.catalog_snapshot(*_crawl(table)).conflicts.where("kind = 'checkpoint'").select("key", "message")


@registered("""WITH ck AS (SELECT doc_id AS url, CASE WHEN quality = 1 THEN 'success' WHEN toxic = 1 THEN 'error' ELSE 'no-x1' END AS status FROM labels) SELECT coalesce(status, 'pending') AS status, doc_id AS url FROM documents LEFT JOIN ck ON url = doc_id""")
def status_lists(table):
    kind = F.when(F.col("quality") == 1, "success").when(F.col("toxic") == 1, "error").otherwise("no-x1")
    index = table("documents").select(F.col("doc_id").alias("url"), F.col("doc_id").alias("ordinal"))
    return state.status_lists(index, table("labels").select(F.col("doc_id").alias("url"), kind.alias("status"))).select("status", "url")


@registered("""WITH ck AS (SELECT doc_id AS url, CASE WHEN quality = 1 THEN 'success' WHEN toxic = 1 THEN 'error' ELSE 'no-x1' END AS status FROM labels) SELECT coalesce(status, 'pending') AS status, doc_id AS url, row_number() OVER (PARTITION BY coalesce(status, 'pending') ORDER BY doc_id) AS place FROM documents LEFT JOIN ck ON url = doc_id""")
def status_places(table):
    kind = F.when(F.col("quality") == 1, "success").when(F.col("toxic") == 1, "error").otherwise("no-x1")
    index = table("documents").select(F.col("doc_id").alias("url"), F.col("doc_id").alias("ordinal"))
    return state.status_lists(index, table("labels").select(F.col("doc_id").alias("url"), kind.alias("status"))).select("status", "url", "place")


@registered("""WITH s AS (SELECT user_id, min(event_id) AS stop FROM events WHERE event_id % 31 IN (3, 9) GROUP BY 1) SELECT event_id, user_id AS source FROM events LEFT JOIN s USING (user_id) WHERE stop IS NULL OR event_id < stop""")
def abort_on_refusal(table):
    status = F.when(F.col("event_id") % 31 == 3, 403).when(F.col("event_id") % 31 == 9, 429).otherwise(200)
    fetched = table("events").select("event_id", F.col("user_id").alias("source"), F.col("event_id").alias("ordinal"), status.alias("http_status"))
    return state.aborted(fetched).select("event_id", "source")


def _flagged(table) -> DataFrame:
    return table("orders").select(F.col("o_orderkey").alias("url"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("known"))


@registered("SELECT o_orderkey AS url FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false)")
def new_only_crawl(table):
    return state.new_only(_flagged(table), strict=False).select("url")


@registered("SELECT o_orderkey AS url FROM orders WHERE o_orderstatus = 'O'")
def new_only_audit(table):
    return state.new_only(_flagged(table), strict=True).select("url")


@registered("SELECT CAST(p_partkey AS VARCHAR) AS url, p_type AS last_modified, 'site' AS layout FROM part UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, 'local' FROM orders")
def index_layouts(table):
    site = table("part").select(F.col("p_partkey").cast("string").alias("url"), F.col("p_type").alias("last_modified"))
    return state.normalized_index(site, _flagged(table).withColumn("url", F.col("url").cast("string")), new=False)


@registered("SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 4 <> 0 AS reuse FROM customer")
def source_reuse(table):
    key = F.col("c_custkey")
    sources = table("customer").select(key.cast("string").alias("id"), F.col("c_name").alias("url"), F.when(key % 3 > 0, F.col("c_mktsegment")).alias("parser"), key.alias("total"))
    said = lambda total: F.to_json(F.struct("parser", total.alias("total"), F.col("c_name").alias("url")), {"ignoreNullFields": "false"})
    saved = table("customer").where("c_custkey % 7 != 0").withColumn("parser", F.when(key % 3 > 0, F.col("c_mktsegment")))
    saved = saved.select(key.cast("string").alias("id"), F.when(key % 5 == 0, "error").otherwise("success").alias("status"), said(F.when(key % 4 == 0, key + 1).otherwise(key)).alias("descriptor"))
    return state.source_reuse(sources, saved).select("id", "reuse")


@registered("""WITH e AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE 'song/' || o_custkey END AS url FROM orders), u AS (SELECT url, count(*) AS n FROM e GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n_entries, count(*) FILTER (url = 'x') AS n_bad, count(*) FILTER (n > 1) AS n_repeated, true AS total_fits FROM u""")
def candidate_checks(table):
    orders = table("orders")
    total = orders.agg(F.count("*").alias("declared"))
    entries = orders.select(F.when(F.col("o_orderkey") % 10 == 0, "x").otherwise(F.concat(F.lit("song/"), "o_custkey")).alias("url")).join(F.broadcast(total), F.lit(True))
    return state.candidate_checks(entries, r"^song/[0-9]+\z")


@registered("SELECT doc_id AS url, lang AS song FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND lang IS NOT NULL")
def generated_songs(table):
    both = table("documents").join(table("labels"), "doc_id")
    return state.generated_songs(both.select(F.col("doc_id").alias("url"), F.when(F.col("quality") == 1, "success").otherwise("error").alias("status"), F.col("lang").alias("song")))


@registered("""WITH n AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 3 = 0) SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE lang END AS lang FROM documents""")
def state_upsert(table):
    d = table("documents").select(F.col("doc_id").alias("url"), "lang")
    return state.upserted(d, d.where("url % 3 = 0").withColumn("lang", F.upper("lang"))).withColumnRenamed("url", "doc_id")


def _output(table) -> discovery.Output:
    """Suppliers as sources of the parts in their lines."""
    key = F.col("s_suppkey")
    sources = table("supplier").select(key.alias("id"), F.col("s_name").alias("url"), F.lit("list").alias("parser"), F.when(key % 7 == 0, "unavailable").otherwise("success").alias("status"), (key % 11 == 0).alias("excluded"), F.lit(5).alias("total"), F.when(key % 3 == 0, key % 9).alias("limit"))
    line = table("lineitem").where("l_suppkey % 13 != 0")
    section = F.when(F.col("l_returnflag") == "R", "ranked").when(F.col("l_returnflag") == "A", "years").otherwise("other")
    found = line.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("url"), section.alias("section"), F.col("l_linenumber").alias("rank"), F.year("l_shipdate").alias("year"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").alias("ordinal"))
    return discovery.discovery_output(sources, found, table("part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("url")), ["ranked", "years"])


_OUTPUT = """WITH s AS (SELECT s_suppkey AS id, s_suppkey % 7 = 0 AS gone, s_suppkey % 11 = 0 AS excluded, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 9 END AS most FROM supplier),
l AS (SELECT l_suppkey AS source, l_partkey AS url, CASE l_returnflag WHEN 'R' THEN 'ranked' WHEN 'A' THEN 'years' ELSE 'other' END AS section, l_linenumber AS rank, year(l_shipdate) AS y, l_orderkey AS k, l_shipdate AS d FROM lineitem WHERE l_suppkey % 13 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, rank, url, d) AS at_ FROM l), c AS (SELECT n.*, excluded FROM n JOIN s ON id = source WHERE most IS NULL OR at_ <= most), u AS (SELECT * FROM c WHERE NOT excluded),
e AS (SELECT url, source, section, rank, row_number() OVER (PARTITION BY url, source ORDER BY k DESC, rank DESC, d DESC, section DESC) AS r FROM u), y AS (SELECT url, source, list_sort(list_distinct(list(y))) AS years FROM u GROUP BY 1, 2), p AS (SELECT p_partkey FROM part WHERE p_size % 2 = 0) """


@registered(_OUTPUT + "SELECT e.url, e.url IN (SELECT p_partkey FROM p) AS known, e.source, e.section, e.rank, array_to_string(years, ',') AS years FROM e JOIN y ON y.url = e.url AND y.source = e.source WHERE r = 1")
def discovery_entries(table):
    return _output(table).entries.withColumn("years", F.array_join(F.col("years").cast("array<string>"), ","))


@registered(_OUTPUT + """, g AS (SELECT url, url IN (SELECT p_partkey FROM p) AS known, bool_or(section = 'ranked') AS ranked, bool_or(section = 'years') AS years FROM e WHERE r = 1 GROUP BY url), f AS (SELECT id, count(c.source) AS n FROM s LEFT JOIN c ON c.source = id GROUP BY id)
SELECT (SELECT count(*) FROM s) AS n_sources, (SELECT count(*) FROM s WHERE NOT gone) AS n_success, (SELECT count(*) FROM s WHERE gone) AS n_unavailable, (SELECT count(*) FROM s WHERE excluded) AS n_excluded, (SELECT count(*) FROM s JOIN f USING (id) WHERE NOT gone AND n = 0) AS n_faults, count(*) AS n_pages, count(*) FILTER (known) AS n_known, count(*) FILTER (NOT known) AS n_new, count(*) FILTER (ranked) AS n_ranked, count(*) FILTER (years) AS n_years FROM g""")
def discovery_output(table):
    return _output(table).summary


@registered("""WITH a AS (SELECT o_custkey AS artist_id, count(*) * 7 AS total FROM orders GROUP BY 1), p AS (SELECT artist_id, unnest(range(1, 1 + CAST(least(3, ceil(total / 20.0)) AS BIGINT))) AS page FROM a) SELECT 'artist-' || artist_id || '-page-' || page AS id, CAST(page AS INT) AS page, 'https://h.example/artist/' || artist_id || '?page=' || page AS url, CASE WHEN page = 3 THEN 10 ELSE 20 END AS "limit" FROM p""")
def artist_sources(table):
    artists = table("orders").groupBy(F.col("o_custkey").alias("artist_id")).agg((F.count("*") * 7).alias("total"))
    return discovery.artist_sources(artists, "https://h.example/artist/{artist}?page={page}", 50).drop("artist_id")


# Artists from customers' orders; pages by order key, links from their lines.
_FULL = """WITH a AS (SELECT o_custkey AS artist_id, count(*) * 7 AS declared_total, CAST(ceil(count(*) * 7 / 20.0) AS BIGINT) AS planned_pages FROM orders GROUP BY 1),
p AS (SELECT o_custkey AS artist_id, o_orderkey % 3 + 1 AS page, CASE arg_max(o_orderstatus, o_orderkey) WHEN 'P' THEN 'unavailable' ELSE CASE WHEN max(o_orderkey) % 9 = 0 THEN 'error' ELSE 'success' END END AS status, CASE WHEN max(o_orderkey) % 2 = 0 THEN 'old' END AS imported_from FROM orders GROUP BY 1, 2),
u AS (SELECT o_custkey AS artist_id, o_orderkey % 3 + 1 AS page, l_partkey AS url, l_linenumber - 1 AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
i AS (SELECT p.* FROM p JOIN a USING (artist_id) WHERE page <= planned_pages),
c AS (SELECT artist_id, count(*) AS n, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'unavailable') AS n_unavailable, count(*) FILTER (status = 'error') AS n_error FROM i GROUP BY 1),
f AS (SELECT artist_id, count(DISTINCT url) AS n_urls FROM i JOIN u USING (artist_id, page) WHERE status = 'success' GROUP BY 1),
s AS (SELECT a.*, coalesce(n_success, 0) AS n_success, coalesce(n_unavailable, 0) AS n_unavailable, coalesce(n_error, 0) AS n_error, coalesce(n_urls, 0) AS n_urls, planned_pages - coalesce(n, 0) AS n_pending FROM a LEFT JOIN c USING (artist_id) LEFT JOIN f USING (artist_id)),
t AS (SELECT *, n_unavailable = 0 AND n_error = 0 AND n_pending = 0 AND n_urls <> declared_total AS inconsistent FROM s),
e AS (SELECT url, c_custkey IS NOT NULL AS known, artist_id, page, (page - 1) * 20 + 1 + pos AS rank FROM u JOIN p USING (artist_id, page) LEFT JOIN customer ON c_custkey = url AND c_acctbal > 0 WHERE status = 'success') """


def _full(table) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    orders = table("orders")
    total = F.count("*") * 7
    artists = orders.groupBy(F.col("o_custkey").alias("artist_id")).agg(total.alias("declared_total"), F.ceil(total / discovery.PAGE_SIZE).alias("planned_pages"))
    page = F.col("o_orderkey") % 3 + 1
    last = F.max("o_orderkey")
    status = F.when(F.max_by("o_orderstatus", "o_orderkey") == "P", "unavailable").when(last % 9 == 0, "error").otherwise("success")
    pages = orders.groupBy(F.col("o_custkey").alias("artist_id"), page.alias("page")).agg(status.alias("status"), F.when(last % 2 == 0, "old").alias("imported_from"))
    lines = table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    urls = lines.select(F.col("o_custkey").alias("artist_id"), page.alias("page"), F.col("l_partkey").alias("url"), (F.col("l_linenumber") - 1).alias("pos"))
    return artists, pages, urls, table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("url"))


@registered(_FULL + "SELECT artist_id, declared_total, planned_pages, n_success, n_unavailable, n_error, n_pending, n_urls, inconsistent FROM t")
def artist_state(table):
    artists, pages, urls, _ = _full(table)
    return discovery.artist_state(artists, pages, urls).select("artist_id", "declared_total", "planned_pages", "n_success", "n_unavailable", "n_error", "n_pending", "n_urls", "inconsistent")


@registered(_FULL + "SELECT url, known, artist_id, page, rank FROM e")
def artist_entries(table):
    _, pages, urls, production = _full(table)
    return discovery.artist_entries(pages, urls, production)


@registered(_FULL + """SELECT count(*) AS n_artists, CAST(sum(declared_total) AS BIGINT) AS declared, CAST(sum(planned_pages) AS BIGINT) AS planned, CAST(sum(n_pending) AS BIGINT) AS n_pending, count(*) FILTER (inconsistent) AS n_inconsistent, CAST(sum(n_urls) AS BIGINT) AS n_references,
(SELECT count(DISTINCT url) FROM e) AS n_pages, (SELECT count(DISTINCT url) FROM e WHERE NOT known) AS n_new, sum(n_pending) = 0 AND sum(n_error) = 0 AND count(*) FILTER (inconsistent) = 0 AS ready FROM t""")
def artist_index(table):
    artists, pages, urls, production = _full(table)
    found = discovery.artist_index(discovery.artist_state(artists, pages, urls), discovery.artist_entries(pages, urls, production))
    return found.select("n_artists", "declared", "planned", "n_pending", "n_inconsistent", "n_references", "n_pages", "n_new", "ready")


@registered(_FULL + "SELECT artist_id, page FROM p JOIN t USING (artist_id) WHERE NOT (inconsistent AND imported_from IS NOT NULL)")
def drift_invalidation(table):
    artists, pages, urls, _ = _full(table)
    return discovery.without_drift(discovery.artist_state(artists, pages, urls), pages).select("artist_id", "page")


@registered(_FULL + """SELECT artist_id, CASE WHEN artist_id % 4 = 0 THEN declared_total + artist_id % 3 ELSE declared_total END AS declared_total, CAST(ceil(CASE WHEN artist_id % 4 = 0 THEN declared_total + artist_id % 3 ELSE declared_total END / 20.0) AS BIGINT) AS planned_pages, artist_id % 4 = 0 AND artist_id % 3 <> 0 AS reset, CASE WHEN artist_id % 4 = 0 AND artist_id % 3 <> 0 THEN 0 ELSE (SELECT count(*) FROM p WHERE p.artist_id = a.artist_id) END AS n_pages FROM a""")
def reset_totals(table):
    artists, pages, _, _ = _full(table)
    totals = artists.where("artist_id % 4 = 0").select("artist_id", (F.col("declared_total") + F.col("artist_id") % 3).alias("declared_total"))
    changed, left = discovery.reset_totals(artists, pages, totals)
    counts = left.groupBy("artist_id").agg(F.count("*").alias("n_pages"))
    return changed.join(counts, "artist_id", "left").na.fill(0, ["n_pages"]).select("artist_id", "declared_total", "planned_pages", "reset", "n_pages")


@registered("SELECT c_custkey AS artist_id, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN c_custkey + 5 ELSE c_custkey END AS declared_total, c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AS kept FROM customer")
def reconcile_seeds(table):
    key = F.col("c_custkey")
    seeds = table("customer").select(key.alias("artist_id"), F.col("c_name").alias("artist_name"), key.alias("declared_total"))
    saved = seeds.where("artist_id % 2 = 0").select("artist_id", F.when(F.col("artist_id") % 3 == 0, "else").otherwise(F.col("artist_name")).alias("artist_name"), (F.col("artist_id") + 5).alias("declared_total"))
    gone = table("supplier").select((-1 - F.col("s_suppkey")).alias("artist_id"), F.col("s_name").alias("artist_name"), F.lit(1).cast("long").alias("declared_total"))
    return discovery.reconciled(seeds, saved.unionByName(gone)).select("artist_id", "declared_total", "kept")


@registered(_FULL + """, h AS (SELECT artist_id, unnest([1, 2, 3]) AS page, CASE WHEN artist_id % 5 = 0 THEN 'error' ELSE 'success' END AS status, declared_total + CASE WHEN artist_id % 3 = 0 THEN 1 ELSE 0 END AS declared_total FROM a)
SELECT artist_id, page FROM h JOIN a USING (artist_id) WHERE status = 'success' AND h.declared_total = a.declared_total AND page <= planned_pages AND NOT EXISTS (SELECT 1 FROM p WHERE p.artist_id = h.artist_id AND (p.page = h.page OR p.imported_from IS NULL))""")
def historical_pages(table):
    artists, pages, _, _ = _full(table)
    fault = F.when(F.col("artist_id") % 3 == 0, 1).otherwise(0)
    old = artists.select("artist_id", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("page"), F.when(F.col("artist_id") % 5 == 0, "error").otherwise("success").alias("status"), (F.col("declared_total") + fault).alias("declared_total"))
    return discovery.imported_pages(old, artists, pages).select("artist_id", F.col("page").cast("int").alias("page"))


@registered(_FULL + """, g AS (SELECT artist_id, page, declared_total, CAST((page - 1) * 20 + 1 AS BIGINT) AS x, CAST(least(page * 20, declared_total) AS BIGINT) AS y FROM i JOIN a USING (artist_id))
SELECT artist_id, page, CASE artist_id % 6 WHEN 1 THEN 'total changed' WHEN 2 THEN 'range' WHEN 3 THEN 'number of links' WHEN 4 THEN 'repeated links' END AS fault FROM g""")
def page_faults(table):
    artists, pages, _, _ = _full(table)
    rows = pages.join(artists, "artist_id").where("page <= planned_pages")
    kind, page = F.col("artist_id") % 6, F.col("page")
    first, last = (page - 1) * 20 + 1, F.least(page * 20, F.col("declared_total"))
    n = last - first + 1 + F.when(kind == 3, 1).otherwise(0)
    fetched = rows.select("artist_id", "page", (F.col("declared_total") + F.when(kind == 1, 1).otherwise(0)).alias("total"), (first + F.when(kind == 2, 1).otherwise(0)).alias("first"), last.alias("last"), n.alias("n_urls"), (n - F.when(kind == 4, 1).otherwise(0)).alias("n_distinct"))
    return discovery.page_faults(fetched, artists).select("artist_id", "page", "fault")


@registered("""WITH s AS (SELECT c_custkey AS k, 'a' || c_custkey || '-page-' || (1 + c_custkey % 2) AS id, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(c_custkey // 3 AS VARCHAR) END AS artist_id, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END AS artist_name, CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE c_custkey % 90 END AS total FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 2 = 0)
SELECT id, artist_id, total AS declared_total, CAST(ceil(total / 20.0) AS BIGINT) AS planned_pages, artist_id IS NOT NULL AND artist_name <> '' AND total >= 1 AS complete, count(*) OVER (PARTITION BY artist_id) = 1 AS once FROM s""")
def artist_seeds(table):
    key = F.col("c_custkey")
    sources = table("customer").select(
        F.concat(F.lit("a"), key, F.lit("-page-"), 1 + key % 2).alias("id"), F.when(key % 5 == 0, "annual").otherwise("artist-catalog").alias("parser"), F.when(key % 7 == 0, "error").otherwise("success").alias("status"), F.when(key % 11 == 0, True).alias("excluded"),
        F.when(key % 8 == 0, "https://h.example/x").otherwise(F.concat(F.lit("https://h.example/artist/"), F.floor(key / 3), F.lit("?a=1"))).alias("url"), F.when(key % 13 == 0, "").otherwise(F.col("c_name")).alias("artist_name"), F.when(key % 17 == 0, 0).otherwise(key % 90).alias("total"),
    )
    return discovery.artist_seeds(sources, "h.example").drop("artist_name")


@registered("""WITH x AS (SELECT DISTINCT c_mktsegment AS n FROM customer WHERE c_custkey % 97 = 0) SELECT o_orderkey, o_custkey AS artist_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_name NOT IN (SELECT c_name FROM customer WHERE c_custkey % 5 = 0)""")
def excluded_artists(table):
    customer = table("customer")
    found = table("orders").select("o_orderkey", F.col("o_custkey").alias("artist_id"))
    artists = customer.select(F.col("c_custkey").alias("artist_id"), F.col("c_name").alias("artist_name"))
    kept, _ = discovery.without_excluded(found, artists, artists.where("artist_id % 5 = 0"))
    return kept


@registered("SELECT DISTINCT 'https://h.example/artist/' || o_custkey AS url FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 = 1")
def ranked_artists(table):
    key = F.col("o_orderkey")
    pages = table("orders").select(F.concat(F.when(key % 3 == 1, "popular-").otherwise("other-"), key).alias("id"), F.when(F.col("o_orderstatus") == "O", "success").otherwise("error").alias("status"), F.concat(F.lit("https://h.example/artist/"), "o_custkey").alias("url"))
    return discovery.ranked_artists(pages, "popular-", r"^https://h\.example/artist/[0-9]+\z")


@registered("SELECT o_custkey AS url, array_to_string(list_sort(list(DISTINCT CAST(year(o_orderdate) AS INT))), ',') AS years FROM orders GROUP BY 1")
def year_lists(table):
    found = table("orders").select(F.col("o_custkey").alias("url"), F.year("o_orderdate").alias("year"))
    return discovery.year_lists(found).select("url", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


@registered("""SELECT (SELECT count(*) FROM orders) AS n_sources, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS sources_success, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS sources_unavailable, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS sources_error, (SELECT count(*) FROM lineitem) AS n_references, count(*) AS n_pages, count(*) FILTER (l_partkey IN (SELECT c_custkey FROM customer)) AS n_known, count(*) FILTER (l_partkey NOT IN (SELECT c_custkey FROM customer)) AS n_new FROM (SELECT DISTINCT l_partkey FROM lineitem)""")
def discovery_summary(table):
    kind = F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "P", "unavailable").otherwise("error")
    return discovery.discovery_summary(table("orders").select(kind.alias("status")), table("lineitem").select(F.col("l_partkey").alias("url")), table("customer").select(F.col("c_custkey").alias("url")))


@registered("""WITH y AS (SELECT CAST(unnest(range(1992, 1999)) AS INT) AS year), s AS (SELECT 'year-' || year AS id, year FROM y UNION ALL SELECT 'all', NULL) SELECT id, count(o_orderkey) AS n FROM s LEFT JOIN orders ON s.year IS NULL OR s.year = year(o_orderdate) GROUP BY id""")
def source_table(table):
    orders = table("orders").select(F.year("o_orderdate").alias("y"))
    seeds = discovery.seed_sources([("all", "https://h.example/all")], [("year", "https://h.example/{year}", 1992, 1998)], orders.sparkSession)
    per = orders.groupBy("y").agg(F.count("*").alias("m"))  # few years
    hit = F.col("year").isNull() | (F.col("year") == F.col("y"))
    return seeds.join(F.broadcast(per), hit, "left").groupBy("id").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))


def _faulty(table) -> DataFrame:
    key = F.col("p_partkey")
    k = key.cast("string")
    return table("part").select(
        key.alias("song_ord"), F.lit(0).cast("long").alias("var_ord"), F.when(key % 9 == 0, "song/x").otherwise(F.concat(F.lit("song/"), F.when(key % 10 == 0, key - 1).otherwise(key))).alias("url"),
        F.when(key % 8 == 0, (key - 1).cast("string")).otherwise(k).alias("song_id"), F.when(key % 7 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.col("p_brand").alias("artist"),
        F.when(key % 6 == 0, F.concat(F.lit("n"), k)).when(key % 5 == 0, (key - 1).cast("string")).otherwise(k).alias("number"), F.when(key % 4 == 0, (key - 1).cast("string")).otherwise(k).alias("variant_id"), F.lit("m").alias("meta"), (key % 11 != 0).alias("supports"),
    )


@registered("""WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 THEN 'song/x' ELSE 'song/' || CASE WHEN p_partkey % 10 = 0 THEN p_partkey - 1 ELSE p_partkey END END AS url, CAST(CASE WHEN p_partkey % 8 = 0 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR) AS id, p_partkey % 7 = 0 AS blank,
CASE WHEN p_partkey % 6 = 0 THEN 'n' || p_partkey WHEN p_partkey % 5 = 0 THEN CAST(p_partkey - 1 AS VARCHAR) ELSE CAST(p_partkey AS VARCHAR) END AS number, CAST(CASE WHEN p_partkey % 4 = 0 THEN p_partkey - 1 ELSE p_partkey END AS VARCHAR) AS vid FROM part),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS a, row_number() OVER (PARTITION BY url ORDER BY k) AS b, row_number() OVER (PARTITION BY vid ORDER BY k) AS c, row_number() OVER (PARTITION BY number ORDER BY k) AS d FROM r)
SELECT k AS song_ord, 'blank' AS rule, url AS message FROM w WHERE blank UNION ALL SELECT k, 'address', url FROM w WHERE url = 'song/x' UNION ALL SELECT k, 'song-id', id FROM w WHERE a > 1 UNION ALL SELECT k, 'repeated-address', url FROM w WHERE b > 1
UNION ALL SELECT k, 'number', number FROM w WHERE k % 6 = 0 UNION ALL SELECT k, 'unsupported', vid FROM w WHERE k % 11 = 0 UNION ALL SELECT k, 'variant-id', vid FROM w WHERE c > 1 UNION ALL SELECT k, 'repeated-number', number FROM w WHERE d > 1""")
def song_errors(table):
    return gates.song_errors(_faulty(table), r"^song/[0-9]+\z").select("song_ord", "rule", "message")


_VARIANT = "struct<number: string, label: string, version_type: string, supports_x1: boolean>"

_METRICS = """SELECT 1 AS catalog_version, 1 AS songs_version, 1 AS review_version, false AS ready, true AS allow_partial, count(*) FILTER (p_size % 5 = 4) * 0 AS n_error, CAST(0 AS BIGINT) AS n_conflicts, CAST(0 AS BIGINT) AS listed_error, CAST(0 AS BIGINT) AS listed_conflicts, CAST(0 AS BIGINT) AS listed_outside,
count(*) FILTER (p_size % 5 < 2) AS n_success, count(*) FILTER (p_size % 5 = 2) AS n_no_x1, count(*) FILTER (p_size % 5 = 3) AS n_unavailable, count(*) FILTER (p_size % 5 < 4) AS n_processed, count(*) FILTER (p_size % 5 = 4) AS n_pending, count(*) AS n_index, count(*) FILTER (p_size % 5 = 4) AS listed_pending,
count(*) FILTER (p_size % 5 < 2) AS listed_songs, count(*) FILTER (p_size % 5 < 2) AS merged_songs, count(*) FILTER (p_size % 5 < 2) AS listed_variants, count(*) FILTER (p_size % 5 < 2) AS merged_variants, count(*) FILTER (p_size % 5 < 2 AND trim(p_name) = '') AS song_errors, count(*) FILTER (p_size % 5 < 2) AS stats_success, count(*) FILTER (p_size % 5 = 2) AS stats_no_x1, count(*) FILTER (p_size % 5 = 3) AS stats_unavailable, CAST(0 AS BIGINT) AS stats_error,
count(*) FILTER (p_size % 5 < 2) AS generated_songs, CAST(0 AS BIGINT) AS unmatched_addresses, true AS review_passed, count(*) FILTER (p_size = 10) AS review_size, count(*) FILTER (p_size = 10) AS listed_samples, count(*) FILTER (p_size = 10 AND p_partkey % 2 = 0) AS bad_samples, count(*) FILTER (p_size = 10) AS distinct_samples, 'a' AS review_path, 'a' AS songs_path, 'x' AS review_sha256, 'x' AS songs_sha256 FROM part"""
_FIRST = "CASE " + " ".join(f"WHEN NOT coalesce({rule}, false) THEN '{name}'" for name, rule in gates.RELEASE) + " END"


@registered(f"WITH m AS ({_METRICS}), f AS (SELECT *, {_FIRST} AS first_failure FROM m) SELECT n_success, n_pending, n_index, listed_samples, bad_samples, first_failure, first_failure IS NULL AS released FROM f")
def release_gates(table):
    part, kind = table("part"), F.col("p_size") % 5
    count = lambda ok, name: F.count_if(ok).alias(name)
    good = part.where(kind < 2).select(F.col("p_partkey").alias("url"))
    samples = part.where("p_size = 10").select(F.col("p_partkey").alias("url"), (F.col("p_partkey") % 2 == 1).alias("matched"), F.array().cast("array<string>").alias("differences"))
    none = ("n_error", "n_conflicts", "listed_error", "listed_conflicts", "listed_outside", "stats_error")
    counts = part.agg(
        *[count(kind < 2, c) for c in ("n_success", "listed_songs", "merged_songs", "listed_variants", "merged_variants", "stats_success", "generated_songs")], *[count(kind == 2, c) for c in ("n_no_x1", "stats_no_x1")], *[count(kind == 3, c) for c in ("n_unavailable", "stats_unavailable")],
        *[count(kind == 4, c) for c in ("n_pending", "listed_pending")], count(kind < 4, "n_processed"), F.count("*").alias("n_index"), count((kind < 2) & (F.trim("p_name") == ""), "song_errors"), count(F.col("p_size") == 10, "review_size"),
    ).withColumns({**{c: F.lit(0) for c in none}, **{c: F.lit(1) for c in ("catalog_version", "songs_version", "review_version")}, "ready": F.lit(False), "allow_partial": F.lit(True), "review_passed": F.lit(True), "review_path": F.lit("a"), "songs_path": F.lit("a"), "review_sha256": F.lit("x"), "songs_sha256": F.lit("x")})
    same = gates.multiset_equal(good, good).select(F.col("n_unmatched").alias("unmatched_addresses"))
    metrics = counts.join(F.broadcast(gates.sample_metrics(samples, good)), F.lit(True)).join(F.broadcast(same), F.lit(True))  # one row each
    return gates.release(metrics).select("n_success", "n_pending", "n_index", "listed_samples", "bad_samples", "first_failure", "released")


# A crawl of parts whose states follow their size, merged into the suppliers' songs, written as files, reviewed and judged.
@registered("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (p_size % 5 < 2) AS good, count(*) FILTER (p_size % 5 = 2) AS n_no_x1, count(*) FILTER (p_size % 5 = 3) AS n_unavailable, count(*) FILTER (p_size % 5 = 4) AS n_pending FROM part), s AS (SELECT count(*) AS more FROM supplier)
SELECT n AS n_index, good AS n_success, n_no_x1, n_unavailable, n - n_pending AS n_processed, n_pending, n_pending AS listed_pending, good + more AS merged_songs, good + more AS listed_songs, good + more AS listed_variants, good AS stats_success, good AS generated_songs,
CAST(0 AS BIGINT) AS song_errors, CAST(0 AS BIGINT) AS unmatched_addresses, CAST(0 AS BIGINT) AS listed_conflicts, CAST(20 AS BIGINT) AS review_size, CAST(20 AS BIGINT) AS distinct_samples, CAST(0 AS BIGINT) AS bad_samples, n_pending = 0 AS ready, true AS same_songs, CAST(NULL AS VARCHAR) AS first_failure, true AS released FROM c, s""")
def release_from_files(table):
    spark, kind, key = table("part").sparkSession, F.col("p_size") % 5, F.col("p_partkey")
    url = F.concat(F.lit("p"), "p_partkey")
    part = table("part")
    index = part.select(url.alias("url"), key.alias("ordinal"))
    status = F.when(kind < 2, "success").when(kind == 2, "no-x1").otherwise("unavailable")
    checkpoint = part.where(kind < 4).select(url.alias("url"), status.alias("status"), F.when(kind < 2, url).alias("song_url"))
    song = lambda p, k: [k.alias("song_ord"), F.lit(0).cast("long").alias("var_ord"), F.concat(F.lit(p), k).alias("url"), F.concat(F.lit(p + "i"), k).alias("song_id")]
    variant = lambda p, k: [k.cast("string").alias("number"), F.concat(F.lit(p + "v"), k).alias("variant_id"), F.lit("m").alias("meta")]
    songs = part.where(kind < 2).select(url.alias("page"), *song("p", key), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), *variant("p", key))
    ours = F.col("s_suppkey") + 1_000_000_000_000
    production = table("supplier").select(*song("s", ours), F.col("s_name").alias("title"), F.lit("a").alias("artist"), *variant("s", ours))
    path = new_path(spark, "release")
    release.write_catalog(merge.catalog_snapshot(index, checkpoint, songs, production), f"{path}/catalog")
    release.write_songs(checkpoint, songs.drop("page"), f"{path}/songs")
    samples = search.equidistant(songs.select("url", "song_ord"), [F.col("song_ord")], 20).select("url", F.lit(True).alias("matched"), F.array().cast("array<string>").alias("differences"))
    release.write_review(samples, f"{path}/songs", f"{path}/review")
    metrics = release.promotion_metrics(spark, f"{path}/catalog", f"{path}/songs", f"{path}/review", True, r"^[ps][0-9]+\z")
    shown = ["n_index", "n_success", "n_no_x1", "n_unavailable", "n_processed", "n_pending", "listed_pending", "merged_songs", "listed_songs", "listed_variants", "stats_success", "generated_songs", "song_errors", "unmatched_addresses", "listed_conflicts", "review_size", "distinct_samples", "bad_samples", "ready"]
    return gates.release(metrics).select(*shown, (F.col("review_sha256") == F.col("songs_sha256")).alias("same_songs"), "first_failure", "released")


@registered("""WITH g AS (SELECT l_orderkey AS id, CAST(l_linenumber AS VARCHAR) AS number, CAST(l_shipdate AS VARCHAR) AS label, l_returnflag AS kind, l_linestatus = 'O' AS ok, (l_orderkey + l_linenumber) % 7 AS z FROM lineitem), p AS (SELECT id, list_sort(list_distinct(list(number) FILTER (z = 0))) AS lost, list_sort(list_distinct(list('x' || number) FILTER (z = 1))) AS added, list_sort(list_distinct(list(number) FILTER (z IN (2, 3)))) AS changed, id % 3 = 0 AS retitled FROM g GROUP BY id)
SELECT id, concat_ws(',', CASE WHEN retitled THEN 'title' END, CASE WHEN id % 5 = 0 THEN 'artist' END, CASE WHEN len(coalesce(lost, [])) + len(coalesce(added, [])) + len(coalesce(changed, [])) > 0 THEN 'variants' END) AS differences, array_to_string(coalesce(lost, []), ',') AS lost, array_to_string(coalesce(added, []), ',') AS added, array_to_string(coalesce(changed, []), ',') AS changed FROM p""")
def review_variants(table):
    """Lines of orders as variants: in the live version some are lost, added, without label or without word on their support; their order never counts."""
    z = (F.col("l_orderkey") + F.col("l_linenumber")) % 7
    number = F.col("l_linenumber").cast("string")
    variant = lambda n, label, ok: F.struct(n.alias("number"), label.alias("label"), F.col("l_returnflag").alias("version_type"), ok.alias("supports_x1"))
    ok = F.col("l_linestatus") == "O"
    stored = variant(number, F.col("l_shipdate").cast("string"), ok)
    live = F.when(z == 0, F.array().cast(f"array<{_VARIANT}>")).when(z == 1, F.array(stored, variant(F.concat(F.lit("x"), number), F.col("l_shipdate").cast("string"), ok))).when(z == 2, F.array(variant(number, F.lit(None).cast("string"), ok))).when(z == 3, F.array(variant(number, F.col("l_shipdate").cast("string"), F.lit(None).cast("boolean")))).otherwise(F.array(stored))
    # an order has few lines
    pairs = table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(stored).alias("stored_variants"), F.flatten(F.reverse(F.collect_list(live))).alias("live_variants"))
    fields = {"stored_title": F.lit("t"), "live_title": F.when(F.col("id") % 3 != 0, "t"), "stored_artist": F.lit(None).cast("string"), "live_artist": F.when(F.col("id") % 5 == 0, "a")}
    found = gates.song_differences(pairs.withColumns(fields))
    return found.select("id", *[F.array_join(F.array_sort(c) if c != "differences" else F.col(c), ",").alias(c) for c in ("differences", "lost", "added", "changed")])
