"""Registered queries: whole searches with variants, song and ranking pages, files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import paging, search
from sparkloom.plans.catalog_queries import NORM, registered
from sparkloom.session import new_path, spread
from sparkloom.sources import commits, extract, files, songpages

# Variants by size: two kinds that are supported for even and for three-fold sizes, and one that never is.
_SONGS = f"""WITH g AS (SELECT p_partkey AS id, p_name AS title, p_brand AS artist, {NORM.format('p_name')} AS n, {NORM.format('p_brand')} AS a,
array_to_string(list_concat(CASE WHEN p_size % 3 = 0 THEN ['standard'] ELSE [] END, CASE WHEN p_size % 2 = 0 THEN ['anime-video'] ELSE [] END), ',') AS variants FROM part) """


def _songs(table, title=None, plain: bool = True) -> DataFrame:
    variant = lambda number, kind, ok: F.struct(F.lit(number).alias("number"), F.lit(kind).alias("version_type"), ok.alias("supports_x1"))
    size = F.col("p_size")
    variants = F.array(variant("1", "anime-video", size % 2 == 0), variant("2", "other", F.lit(False)), variant("3", "standard", size % 3 == 0))
    rows = table("part").select(F.col("p_partkey").alias("id"), (F.col("p_name") if title is None else title).alias("title"), F.col("p_brand").alias("artist"), F.col("p_partkey").alias("ordinal"), F.concat(F.lit("https://parts.example/"), "p_partkey").alias("source_url"), variants.alias("variants"), "p_size")
    return search.indexed(rows, plain=plain)


def _shown(found: DataFrame, *more: str) -> DataFrame:
    return found.select("id", "title", *more, F.array_join(F.transform("variants", lambda v: v["version_type"]), ",").alias("variants"))


@registered(_SONGS + "SELECT id, title, variants FROM g WHERE contains(n, 'widge') AND variants <> ''")
def search_songs(table):
    return _shown(search.search_songs(_songs(table), "WIDGE"))


@registered(_SONGS + "SELECT id, title, variants FROM g WHERE n = 'coldwidget' AND variants <> ''")
def search_songs_exact(table):
    return _shown(search.search_songs(_songs(table), "cold widget"))


@registered(_SONGS + "SELECT id, title, CASE WHEN a = 'brand' THEN 0 ELSE 1 END AS tier, variants FROM g WHERE contains(a, 'brand') AND variants <> ''")
def search_songs_by_artist(table):
    return _shown(search.search_songs_by_artist(_songs(table), "Brand"), "tier")


@registered(_SONGS + "SELECT id, title, variants FROM g WHERE variants <> ''")
def list_songs(table):
    return _shown(search.list_songs(_songs(table)))


@registered("""SELECT p_partkey AS id, p_name || ' ' || p_partkey % 120 AS title FROM part WHERE p_size % 3 = 0 OR p_size % 2 = 0 ORDER BY lower(p_name), p_partkey % 120, CAST(regexp_extract(p_brand, '[0-9]+') AS INT), 'https://parts.example/' || p_partkey LIMIT 10 OFFSET 20""")
def browse_page(table):
    title = F.concat("p_name", F.lit(" "), F.col("p_partkey") % 120)
    return search.browse(_songs(table, title), " ", 3).select("id", "title")


@registered(_SONGS + "SELECT id, title FROM g WHERE contains(n, 'widge') AND variants <> '' ORDER BY id LIMIT 10 OFFSET 10")
def browse_search_page(table):
    return search.browse(_songs(table), "widge", 2).select("id", "title")


# Titles with words in Japanese scripts, by size; their search forms are written out in the SQL.
_WORDS = ["ギター", "ｷﾞﾀｰ", "櫻の道", "東京１２３", "ヴァ々ー", "Ｓｏｎｇ"]
_KANA = """WITH g AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z]', '', 'g') || CASE p_size % 6 WHEN 0 THEN 'ぎたー' WHEN 1 THEN 'ぎたー' WHEN 2 THEN '桜の道' WHEN 3 THEN '東京' WHEN 4 THEN 'ゔぁ々ー' ELSE 'song' END AS norm FROM part) """


def _kana(table) -> DataFrame:
    words = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("p_size") % 6 + 1).cast("int"))
    return _songs(table, F.concat("p_name", F.lit(" "), words), plain=False)


@registered(_KANA + "SELECT id, norm FROM g")
def japanese_forms(table):
    return _kana(table).select("id", F.col("title_norm").alias("norm"))


@registered(_KANA + "SELECT id FROM g WHERE contains(replace(norm, 'ー', ''), 'ぎた')")
def japanese_search(table):
    return search.by_title(_kana(table), "ギタ～ー").select("id")


@registered(_KANA + "SELECT id FROM g WHERE contains(norm, '桜の道')")
def han_search(table):
    return search.by_title(_kana(table), "桜道").select("id")


@registered(_KANA + "SELECT id FROM g WHERE false")
def han_search_too_short(table):
    return search.by_title(_kana(table), "櫻").select("id")


@registered("""WITH t AS (SELECT CAST(ceil(count(*) / 10.0) AS INT) AS total FROM part), c AS (SELECT total, CAST(least(total, greatest(1, p_size)) AS INT) AS here, CAST(p_size AS INT) AS current FROM t, (SELECT DISTINCT p_size FROM part) s)
SELECT total, current, array_to_string(CASE WHEN total <= 7 THEN [CAST(x AS VARCHAR) for x in range(1, total + 1)] WHEN here <= 4 THEN ['1', '2', '3', '4', '5', 'end-gap', CAST(total AS VARCHAR)] WHEN here >= total - 3 THEN ['1', 'start-gap', CAST(total - 4 AS VARCHAR), CAST(total - 3 AS VARCHAR), CAST(total - 2 AS VARCHAR), CAST(total - 1 AS VARCHAR), CAST(total AS VARCHAR)]
ELSE ['1', 'start-gap', CAST(here - 1 AS VARCHAR), CAST(here AS VARCHAR), CAST(here + 1 AS VARCHAR), 'end-gap', CAST(total AS VARCHAR)] END, ',') AS strip FROM c""")
def marked_page_strip(table):
    parts = table("part")
    total = parts.agg(F.ceil(F.count("*") / 10).cast("int").alias("total"))
    pages = parts.select(F.col("p_size").cast("int").alias("current")).distinct().join(F.broadcast(total), F.lit(True))
    return search.marked_strip(pages).select("total", "current", F.array_join("strip", ",").alias("strip"))


@registered("""SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'catalog' WHEN p_size % 5 = 1 THEN 'invalid' WHEN p_size % 5 = 2 THEN 'too-short' WHEN p_size % 5 = 3 THEN 'none' ELSE 'results' END AS state FROM part""")
def empty_states(table):
    kind = F.col("p_size") % 5
    asked = F.when(kind == 0, " ").when(kind == 1, "?!").when(kind == 2, "a").otherwise(F.col("p_name"))
    return table("part").select(F.col("p_partkey").alias("id"), search.empty_state(asked, T.searchable_folded(asked), F.when(kind == 4, 3).otherwise(0)).alias("state"))


# Song pages made from parts: metadata in embedded JSON, in the title of a video page, or in heading and table, by size.
def _song_pages(table) -> DataFrame:
    kind, key = F.col("p_size") % 4, F.col("p_partkey")
    record = F.to_json(F.struct(F.lit("MusicRecording").alias("@type"), F.col("p_name").alias("name"), F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.col("p_type").alias("name"))).alias("byArtist")))
    graph = F.concat(F.lit('<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"@type":"Thing"},'), record, F.lit("]}</script>"))
    video = F.concat(F.lit("<title>[ミュージックビデオ観放題]"), "p_name", F.lit("／"), "p_brand", F.lit("-楽曲検索 | Site</title>"))
    table_ = F.concat(F.lit("<h1> "), T.xml_escaped(F.col("p_name")), F.lit(" </h1><table><tr><th>作詞</th><td>x</td></tr><tr><th> 歌手名 </th><td>"), "p_brand", F.lit("</td><td>y</td></tr></table>"))
    head = F.when(kind == 0, graph).when(kind == 1, video).when(kind == 2, table_).otherwise("<h1>only</h1>")
    card = lambda label, number, device: F.concat(F.lit("<div data-testid='card-information'><p>"), label, F.lit("</p><span>曲番号 : "), number, F.lit(f"</span> for {device}</div>"))
    cards = F.concat(card(F.col("p_name"), key, "Device X1"), card(F.lit("again"), key, "Device X1"), card(F.lit("ガイドボーカル版"), key + 1, "Device X1"), card(F.lit("old"), key + 2, "Device F1"))
    return spread(table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).select(F.concat(F.lit("https://h.example/song/"), F.when(kind == 2, key).otherwise(key)).alias("url"), F.concat(F.lit("<html><body>"), head, cards, F.lit("</body></html>")).alias("html"))


@registered("""WITH g AS (SELECT *, p_size % 4 AS k FROM part), v AS (SELECT *, 0 AS pos FROM g UNION ALL SELECT *, 1 FROM g)
SELECT CAST(p_partkey AS VARCHAR) AS page_id, CASE WHEN k < 3 THEN trim(p_name) ELSE 'only' END AS title, CASE k WHEN 0 THEN p_brand || '、' || p_type WHEN 3 THEN NULL ELSE p_brand END AS artist, CASE k WHEN 3 THEN 'no title or artist' END AS fault, CAST(p_partkey + pos AS VARCHAR) AS number, CASE WHEN pos = 1 THEN 'guide-vocal' WHEN k = 3 THEN 'other' ELSE 'standard' END AS version_type FROM v""")
def song_page_parser(table):
    found = songpages.song_pages(_song_pages(table), "Device X1", r"/song/([0-9]+)\z")
    return found.select("page_id", "title", "artist", "fault", F.explode("variants").alias("v")).select("page_id", "title", "artist", "fault", "v.number", "v.version_type")


_SITE = r"/song/\d+"


def _rankings(table) -> DataFrame:
    """A ranking page for each part: three headed sections, lists with ids, a catalog heading."""
    key = F.col("p_partkey")
    link = lambda n: F.concat(F.lit('<li><a href="/song/'), n, F.lit('?from=list">x</a></li>'))
    annual = F.concat(
        F.lit("<h2>General  ranking</h2><ul>"), link(key), link(key + 1), link(key), F.lit('<a href="/other/5">no</a></ul><p>'), link(key + 2), F.lit("</p><h2>Anime game ranking</h2><div><ul>"), link(key + 3), F.lit("</ul></div><h2>News</h2>"), link(key + 9)
    )
    lists = F.concat(F.lit('<div id="list01">'), link(key), F.lit('</div><div id="list02">'), link(key + 1), link(key), F.lit('</div><div id="list09">'), link(key + 5), F.lit("</div>"))
    catalog = F.concat(F.lit("<section><h2>9件 (1-9件目表示)</h2></section><section><h2> "), key, F.lit("件\n(1 - 2件目表示)</h2><ul>"), link(key + 1), link(key), link(key + 1), F.lit("</ul></section>"))
    empty = F.lit("<section><h2>5件(1-5件目表示)</h2></section>")
    kind = key % 4
    return spread(table("part").select("p_partkey")).select(key.cast("string").alias("id"), F.concat(F.lit("https://h.example/"), key).alias("url"), F.when(kind == 0, "annual").when(kind == 1, "lists").otherwise("artist-catalog").alias("parser"), F.when(kind == 0, annual).when(kind == 1, lists).when(kind == 2, catalog).otherwise(empty).alias("html"))


_SECTIONS = {"general": "^General ranking$", "anime": "Anime.*(?:game)? ranking"}


@registered("""WITH g AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 4 = 0), l AS (SELECT k, 'general' AS section, unnest([k, k + 1, k + 2]) AS n FROM g UNION ALL SELECT k, 'anime', k + 3 FROM g) SELECT 'https://h.example/' || k AS url, section, '/song/' || n AS link FROM l""")
def section_links(table):
    return songpages.with_section_links(_rankings(table), _SECTIONS, _SITE)


@registered("""WITH g AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 4 = 1) SELECT 'https://h.example/' || k AS url, id, CASE id WHEN 'list01' THEN '/song/' || k WHEN 'list02' THEN array_to_string(list_sort(['/song/' || k, '/song/' || (k + 1)]), ',') ELSE '' END AS links FROM g, (VALUES ('list01'), ('list02'), ('list03')) t(id)""")
def links_by_id(table):
    rows = _rankings(table).where("parser = 'lists'")
    return songpages.with_links_under(rows, ["list01", "list02", "list03"], _SITE).select("url", "id", F.array_join("links", ",").alias("links"))


@registered("""SELECT 'https://h.example/' || p_partkey AS url, CASE p_partkey % 4 WHEN 2 THEN p_partkey WHEN 3 THEN 5 ELSE 0 END AS total, CASE WHEN p_partkey % 4 >= 2 THEN 1 ELSE 0 END AS "first", CASE p_partkey % 4 WHEN 2 THEN 2 WHEN 3 THEN 5 ELSE 0 END AS "last", CASE WHEN p_partkey % 4 = 2 THEN '/song/' || (p_partkey + 1) || ',/song/' || p_partkey ELSE '' END AS links FROM part""")
def artist_catalog_page(table):
    return songpages.with_catalog_page(_rankings(table), _SITE).select("url", "total", "first", "last", F.array_join("links", ",").alias("links"))


@registered("""WITH g AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS id FROM part), l AS (SELECT id, 'general' AS section, unnest([k, k + 1, k + 2]) AS n FROM g WHERE k % 4 = 0 UNION ALL SELECT id, 'anime', k + 3 FROM g WHERE k % 4 = 0 UNION ALL SELECT id, 'list01', k FROM g WHERE k % 4 = 1 UNION ALL SELECT id, 'list02', unnest([k, k + 1]) FROM g WHERE k % 4 = 1 UNION ALL SELECT id, 'artist', unnest([k + 1, k]) FROM g WHERE k % 4 = 2)
SELECT id, section, '/song/' || n AS link, NULL AS fault FROM l UNION ALL SELECT id, 'artist', NULL, 'songs declared, none linked' FROM g WHERE k % 4 = 3""")
def source_dispatch(table):
    return songpages.dispatched(_rankings(table), _SECTIONS, _SITE, ["list01", "list02"])


@registered("""SELECT p_partkey AS id, array_to_string(list_sort(list_distinct([p_name, p_brand || '"', 'é'])), '|') AS names FROM part""")
def embedded_names(table):
    escaped = F.concat(F.lit('x{\\"artistName\\":\\"'), "p_name", F.lit('\\"}'))
    plain = F.concat(F.lit('{"artistName":""},{"artistName":"\\u00e9"},{"artistName":"'), "p_name", F.lit('"}'))
    quoted = F.concat(F.lit('{"artistName":"'), "p_brand", F.lit('\\u0022"}'))
    return table("part").select(F.col("p_partkey").alias("id"), F.array_join(songpages.embedded_names(F.concat(escaped, plain, quoted), "artistName"), "|").alias("names"))


@registered("""SELECT 'https://h.example/song/' || o_orderkey AS url, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus || '&<' END AS last_modified FROM orders WHERE o_orderkey % 5 > 0""")
def sitemap_scan(table):
    key = F.col("o_orderkey")
    loc = F.concat(F.lit("https://h.example/"), F.when(key % 5 == 0, "page/").otherwise("song/"), key)
    xml = F.concat(F.lit("<urlset><url><loc> "), loc, F.lit(" </loc><lastmod>"), T.xml_escaped(F.when(key % 3 > 0, F.concat("o_orderstatus", F.lit("&<"))).otherwise(" ")), F.lit("</lastmod></url></urlset>"))
    return extract.sitemap_entries(table("orders").select(xml.alias("xml")), r"^https://h\.example/song/[0-9]+\z").select("url", "last_modified")


@registered("""SELECT p_partkey AS id, CASE WHEN p_size % 6 = 5 THEN 'standard' ELSE ['official-video', 'anime-video', 'guide-vocal', 'guitar-guide', 'other'][p_size % 6 + 1] END AS version_type FROM part""")
def version_types(table):
    labels = ["本人映像 アニメカラオケ", "アニメカラオケ", "ガイドボーカル ギタナビ", "ギタナビ", "live"]
    label = F.element_at(F.array(*[F.lit(x) for x in labels], F.col("p_name")), (F.col("p_size") % 6 + 1).cast("int"))
    return table("part").select(F.col("p_partkey").alias("id"), extract.version_type(label, F.col("p_name")).alias("version_type"))


@registered("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN 'https://h.example/song/' || o_orderkey || ',' ELSE '' END || 'https://h.example/song/' || o_custkey AS links FROM orders WHERE o_orderkey <> o_custkey""")
def canonical_paths(table):
    key = F.col("o_orderkey")
    first = F.concat(F.when(key % 4 == 0, "/other/").otherwise("/song/"), key)
    paths = F.array(F.concat(first, F.lit("?a=1#b")), F.concat(first, F.lit("#c")), F.concat(F.lit("/song/"), "o_custkey"), F.lit(""))
    links = extract.absolute_paths(paths, "https://h.example", r"^/song/[0-9]+\z")
    return table("orders").where("o_orderkey != o_custkey").select(key.alias("id"), F.array_join(links, ",").alias("links"))


@registered("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 1000 WHEN 1 THEN NULL WHEN 2 THEN 0 ELSE 5000 END AS ms FROM orders""")
def retry_after(table):
    key = F.col("o_orderkey")
    header = F.when(key % 4 == 0, key.cast("string")).when(key % 4 == 1, "soon").when(key % 4 == 2, "Wed, 21 Oct 2015 07:28:00 GMT").otherwise(" 5 ")
    return table("orders").select(key.alias("id"), T.retry_after_ms(header).alias("ms"))


@registered("""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey AS BIGINT) * 1000 + 500 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE 250 END AS ms, CASE WHEN o_orderkey % 6 = 2 THEN epoch_ms(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 100 YEAR) END AS until_ms FROM orders""")
def retry_after_forms(table):
    """Fractions, negative numbers, dates past and a hundred years ahead; `until_ms` is the moment that a wait for a date ends at."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    printed = lambda d: F.concat(F.date_format(d, "EEE, dd MMM yyyy"), F.lit(" 00:00:00 GMT"))
    ahead = date + F.expr("interval '100' year")
    header = F.when(key % 6 == 0, F.concat(key.cast("string"), F.lit(".5"))).when(key % 6 == 1, F.concat(F.lit("-"), key.cast("string"))).when(key % 6 == 2, printed(date)).when(key % 6 == 3, " ").when(key % 6 == 4, "1 2").otherwise(".25")
    waits = T.retry_after_ms(F.when(key % 6 == 2, printed(ahead)))
    # the clock goes on between the parts of a plan, so the end of the wait is told to the second
    return table("orders").select(key.alias("id"), T.retry_after_ms(header).alias("ms"), (F.round((waits + F.unix_millis(F.now())) / 1000) * 1000).cast("long").alias("until_ms"))


@registered("SELECT o_orderkey AS url, o_orderkey AS ordinal, (SELECT count(*) FROM orders) AS total_entries FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 10")
def index_snapshot(table):
    index = table("orders").select(F.col("o_orderkey").alias("url"), F.col("o_orderkey").alias("ordinal"))
    spark = index.sparkSession
    path = new_path(spark, "snapshot")
    files.index_snapshot(index, path, 10, 25)
    return files.read_snapshot(spark, path, "url long, ordinal long, total_entries long")


@registered("SELECT doc_id AS url, lang AS status FROM documents WHERE doc_id % 2 = 0")
def checkpoint_files(table):
    docs = table("documents").select(F.col("doc_id").alias("url"), F.col("lang").alias("status"))
    spark = docs.sparkSession
    path = new_path(spark, "state")
    files.save_state(docs.where("url % 2 = 0"), f"{path}/a", "mine", 1)
    files.save_state(docs.where("url % 2 = 1"), f"{path}/b", "other", 1)
    schema = "url long, status string"
    mine, other, old, none = (files.load_state(spark, f"{path}/{x}", schema, "mine", v) for x, v in (("a", 1), ("b", 1), ("a", 2), ("c", 1)))
    return mine.unionByName(other).unionByName(old).unionByName(none)


@registered("SELECT user_id AS url, arg_max(event_type, event_id) AS status, max(event_id) AS ordinal FROM events GROUP BY user_id")
def streamed_state(table):
    """The events as a stream of files into a committed state; batches that are delivered again, and a merge, change nothing."""
    events = table("events").select(F.col("user_id").alias("url"), F.col("event_type").alias("status"), F.col("event_id").alias("ordinal"))
    spark = events.sparkSession
    path = new_path(spark, "stream")
    events.repartitionByRange(4, "ordinal").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    for again in ("a", "b"):  # the second run delivers every batch once more, under the numbers of the first
        commits.commit_stream(stream, f"{path}/state", "url", "ordinal", "events", f"{path}/checkpoint-{again}").awaitTermination()
    commits.compact(spark, f"{path}/state", "url")
    return commits.read(spark, f"{path}/state", "url", "url long, status string, ordinal long")


@registered("""SELECT o_orderkey AS url, CASE WHEN o_orderkey % 3 = 0 THEN 'success' WHEN o_orderstatus = 'F' THEN 'error' ELSE 'no-x1' END AS status FROM orders""")
def saved_state(table):
    """A checkpoint saved in increments, each on top of the one before; one of another version is not read."""
    orders = table("orders").select(F.col("o_orderkey").alias("url"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("no-x1").alias("status"))
    spark = orders.sparkSession
    path = new_path(spark, "state")
    files.save_state(orders.withColumn("status", F.lit("old")), path, "mine", 1)
    files.save_state(orders, path, "mine", 2)
    files.save_state(orders.where("url % 3 = 0").withColumn("status", F.lit("success")), path, "mine", 2)
    schema = "url long, status string"
    return files.load_state(spark, path, schema, "mine", 2).unionByName(files.load_state(spark, path, schema, "mine", 1))


@registered("""SELECT o_orderkey AS id, 'T' || o_custkey AS title, place FROM (SELECT *, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS place FROM orders) WHERE place BETWEEN 990 AND 999""")
def browse_far_page(table):
    """The hundredth page of a list in order of titles, out of the one file that holds it."""
    orders = table("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("T"), "o_custkey").alias("title"), F.concat(F.lit("A"), "o_orderkey").alias("artist"))
    path = new_path(orders.sparkSession, "ordered")
    paging.write_ordered(paging.title_order(orders), path, ["__title", "__artist", "id"], rows_per_file=1024)
    return paging.read_page(orders.sparkSession, path, 100).select("id", "title", "place")


@registered("""WITH g AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 > 0) SELECT 'https://h.example/song/' || k AS url, CASE WHEN k % 3 > 0 THEN s || '&<' END AS last_modified, row_number() OVER (ORDER BY k) - 1 AS ordinal FROM g""")
def sitemap_splits(table):
    """Sitemap files that are read in splits; entries of other addresses have no ordinal."""
    orders, key = table("orders"), F.col("o_orderkey")
    spark = orders.sparkSession
    path = new_path(spark, "sitemap")
    loc = F.concat(F.lit("<loc> https://h.example/"), F.when(key % 5 > 0, "song/").otherwise("other/"), key, F.lit(" </loc><loc>https://h.example/song/0</loc>"))
    date = F.when(key % 3 == 1, F.concat(F.lit("<lastmod>"), "o_orderstatus", F.lit("&amp;&lt;</lastmod>"))).when(key % 3 == 2, F.concat(F.lit("<lastmod><![CDATA["), "o_orderstatus", F.lit("&<]]></lastmod><lastmod>x</lastmod>"))).otherwise("<lastmod> </lastmod>")
    head = F.when(key % 100 == 1, '<?xml version="1.0"?>\n<urlset xmlns="x">').otherwise("")
    orders.repartitionByRange(3, key).sortWithinPartitions(key).select(F.concat(head, F.lit("<url>"), loc, date, F.lit("</url>"))).write.text(path)
    return extract.sitemap_files(spark, path, r"^https://h\.example/song/[0-9]+\z").select("url", "last_modified", "ordinal")


@registered("""SELECT p_partkey AS id, CASE WHEN p_size % 8 IN (5, 6) THEN NULL ELSE trim(p_name) END AS title, CASE WHEN p_size % 8 IN (0, 2) THEN p_brand || '、' || p_type WHEN p_size % 8 IN (1, 5, 7) THEN p_brand END AS artist FROM part WHERE p_size % 8 <> 3""")
def embedded_recordings(table):
    """Records of music in every shape: in a graph or alone, artists as array, object or text, numbers as names, scripts that are no JSON."""
    kind, s = F.col("p_size") % 8, F.struct
    named = lambda c: s(c.alias("name"))
    both = F.array(named(F.col("p_brand")), named(F.lit(" ")), named(F.col("p_type")))
    record = lambda name, artist: F.to_json(s(F.lit("MusicRecording").alias("@type"), name.alias("name"), *([] if artist is None else [artist.alias("byArtist")])))
    name = F.col("p_name")
    alone = F.when(kind.isin(0, 2), record(name, both)).when(kind.isin(1, 7), record(F.concat(F.lit(" "), name, F.lit(" ")), named(F.col("p_brand")))).when(kind == 4, record(name, F.col("p_brand"))).when(kind == 5, record(F.col("p_partkey"), named(F.col("p_brand")))).when(kind == 6, record(F.lit(None).cast("string"), None)).otherwise(F.lit('{"@type": "WebPage"}'))
    held = F.when(kind % 2 == 0, F.concat(F.lit('{"@graph": [{"@type": "WebPage"}, 5, '), alone, F.lit("]}"))).otherwise(alone)
    script = lambda x: F.concat(F.lit('<script type="application/ld+json">'), x, F.lit("</script>"))
    html = F.concat(F.lit("<html>"), script(F.lit("{no json")), script(F.lit("[1]")), script(held), F.lit("</html>"))
    # as a generator's row, so that the filter on it isn't moved down to where each page would be parsed once more, by the few tasks of the file
    found = F.explode_outer(F.array(extract.recordings(html))).alias("r")
    return spread(table("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).select(F.col("p_partkey").alias("id"), found).where("r is not null").select("id", "r.*")


@registered("""SELECT o_orderkey AS id, 'https://h.example/artist/' || o_custkey || '%20%26?page=' || o_orderkey AS url, CAST(o_orderkey AS VARCHAR) AS segment, CASE o_orderkey % 4 WHEN 0 THEN -CAST(o_orderkey AS BIGINT) WHEN 1 THEN o_orderkey WHEN 2 THEN NULL ELSE 9007199254740991 END AS number FROM orders""")
def address_parts(table):
    key, small = F.col("o_orderkey"), F.col("o_orderkey") % 4
    url = T.filled("https://h.example/artist/{artist}?page={page}", {"artist": F.concat("o_custkey", F.lit(" &")), "page": key})
    raw = F.when(small == 0, F.concat(F.lit("-"), key)).when(small == 1, F.concat(F.lit("+00"), key, F.lit(".00"))).when(small == 2, F.element_at(F.array(F.lit("9007199254740992"), F.lit("1.5"), F.lit("x1"), F.lit("")), (key % 3 + 1).cast("int"))).otherwise("9007199254740991")
    return table("orders").select(key.alias("id"), url.alias("url"), T.last_segment(F.concat(F.lit("/web/song/"), key)).alias("segment"), T.safe_integer(raw).alias("number"))
