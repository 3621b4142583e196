"""Registered queries: the catalog operators over the shared tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import discovery, gates, merge, search, state
from sparkloom.session import new_path, ship
from sparkloom.sources import extract

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Search forms of text in Latin letters: NFKC changes nothing there but composition.
NORM = "regexp_replace(lower(nfc_normalize({})), '[^\\p{{Latin}}]', '', 'g')"


def _catalog(table) -> DataFrame:
    """Parts as songs: name as title, brand as artist."""
    p = table("part")
    return search.indexed(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_partkey").alias("ordinal"), F.concat(F.lit("https://parts.example/"), "p_partkey").alias("source_url")), plain=True)


@registered(f"SELECT doc_id, {NORM.format('text')} AS norm FROM documents")
def normalize_text(table):
    return table("documents").select("doc_id", T.searchable(F.col("text")).alias("norm"))


@registered(f"""WITH h AS (SELECT p_partkey, p_name, {NORM.format('p_name')} AS n FROM part) SELECT p_partkey AS id, p_name AS title, 0 AS tier FROM h WHERE n = 'coldwidget'""")
def title_search_exact(table):
    return search.by_title(_catalog(table), "Cold Widget!").select("id", "title", "tier")


@registered(f"""WITH h AS (SELECT p_partkey, p_name, {NORM.format('p_name')} AS n FROM part), t AS (SELECT *, CASE WHEN n = 'widge' THEN 0 ELSE 1 END AS tier FROM h WHERE contains(n, 'widge'))
SELECT p_partkey AS id, p_name AS title, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""")
def title_search_partial(table):
    return search.by_title(_catalog(table), "WIDGE").select("id", "title", "tier")


@registered(f"""WITH h AS (SELECT p_partkey, p_brand, {NORM.format('p_brand')} AS n FROM part) SELECT p_partkey AS id, p_brand AS artist, CASE WHEN n = 'brand' THEN 0 ELSE 1 END AS tier FROM h WHERE contains(n, 'brand')""")
def artist_search_ranked(table):
    return search.by_artist(_catalog(table), "brand").select("id", "artist", "tier")


@registered("SELECT p_partkey AS id, p_name AS title FROM part ORDER BY p_name, p_brand, p_partkey LIMIT 10 OFFSET 20")
def catalog_page(table):
    rows = _catalog(table)
    return search.page(rows.orderBy("title", "artist", "id"), 3).select("id", "title")


@registered("""WITH t AS (SELECT CAST(ceil(count(*) / 10.0) AS INT) AS total FROM part), c AS (SELECT total, CAST(least(total, greatest(1, p_size)) AS INT) AS here, CAST(p_size AS INT) AS current FROM t, (SELECT DISTINCT p_size FROM part) s)
SELECT total, current, array_to_string(CASE WHEN total <= 7 THEN range(1, total + 1) WHEN here <= 4 THEN [1, 2, 3, 4, 5, 0, total] WHEN here >= total - 3 THEN [1, 0, total - 4, total - 3, total - 2, total - 1, total] ELSE [1, 0, here - 1, here, here + 1, 0, total] END, ',') AS strip FROM c""")
def page_strip(table):
    parts = table("part")
    total = parts.agg(F.ceil(F.count("*") / 10).cast("int").alias("total"))
    pages = parts.select(F.col("p_size").cast("int").alias("current")).distinct().join(F.broadcast(total), F.lit(True))
    return search.page_strip(pages).select("total", "current", F.array_join(F.col("strip").cast("array<string>"), ",").alias("strip"))


@registered("""WITH v AS (SELECT l_partkey AS id, l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 ELSE 6 END AS p FROM lineitem WHERE l_returnflag = 'N')
SELECT id, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY id ORDER BY p, l_orderkey, l_linenumber) AS INT) AS place FROM v""")
def variant_filter_rank(table):
    kinds = F.array(*[F.lit(k) for k in search.PRIORITY])
    line = table("lineitem").select(F.col("l_partkey").alias("id"), "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("supports_x1"), F.element_at(kinds, F.least(F.lit(6), "l_linenumber").cast("int")).alias("version_type"))
    return search.ranked_variants(line, "l_orderkey", ["l_linenumber"]).select("id", "l_orderkey", "l_linenumber", "place")


@registered("""WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="/[^"]*"'))) AS link FROM pages) SELECT page_id, link FROM l""")
def page_links(table):
    return table("pages").select("page_id", F.explode(extract.links(F.col("html"), 'href="/[^"]*"')).alias("link"))


@registered(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages""")
def page_title(table):
    return table("pages").select("page_id", extract.heading(F.col("html")).alias("title"))


@registered("""WITH g AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS bare FROM pages) SELECT bare AS url, count(*) AS n FROM g WHERE regexp_matches(bare, '^https?://[^/]+/[a-z]{2}/[0-9]+/?$') GROUP BY bare""")
def official_pages(table):
    bare = F.regexp_extract("url", r"^([^?#]*)", 1)
    return table("pages").where(bare.rlike(r"^https?://[^/]+/[a-z]{2}/[0-9]+/?\z")).groupBy(bare.alias("url")).agg(F.count("*").alias("n"))


def _found(table) -> DataFrame:
    return table("events").select(F.col("user_id").alias("url"), F.col("event_type").alias("source"), F.get_json_object("props", "$.k").alias("sections"), F.col("event_id").alias("ordinal"))


@registered("""WITH l AS (SELECT user_id AS url, event_type AS source, json_extract_string(props, '$.k') AS sections, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events)
SELECT url, EXISTS (SELECT 1 FROM customer WHERE c_custkey = url AND c_acctbal > 0) AS known, source, sections FROM l WHERE r = 1""")
def candidate_index(table):
    production = table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("url"))
    index = discovery.candidate_index(_found(table), production)
    return index.select("url", "known", F.explode("sources").alias("s")).select("url", "known", "s.source", "s.sections")


@registered("""WITH s AS (SELECT DISTINCT event_type AS section FROM events UNION SELECT 'share') SELECT section, count(DISTINCT user_id) AS n_pages FROM s LEFT JOIN events ON event_type = section GROUP BY section""")
def section_counts(table):
    found = _found(table).select("url", F.col("source").alias("section"))
    known = found.select("section").distinct()
    sections = known.unionByName(known.agg(F.lit("share").alias("section")))
    return discovery.section_counts(found, sections)


def _artists(table) -> tuple[DataFrame, DataFrame]:
    orders = table("orders")
    seeds = orders.groupBy(F.col("o_custkey").alias("artist_id")).agg((F.count("*") * 7).alias("declared_total"))
    page = (F.col("o_orderkey") % 5 + 1).cast("int")
    kind = F.when(F.col("o_orderstatus") == "O", "success").when(F.col("o_orderstatus") == "F", "unavailable").otherwise("error")
    stored = orders.groupBy(F.col("o_custkey").alias("artist_id"), page.alias("page")).agg(F.max_by(kind, "o_orderkey").alias("status"))
    return discovery.page_plan(seeds), stored


_ARTISTS = """WITH seeds AS (SELECT o_custkey AS artist_id, count(*) * 7 AS declared_total FROM orders GROUP BY 1),
plan AS (SELECT artist_id, CAST(unnest(range(1, CAST(ceil(declared_total / 20.0) AS BIGINT) + 1)) AS INT) AS page, declared_total FROM seeds),
stored AS (SELECT o_custkey AS artist_id, CAST(o_orderkey % 5 + 1 AS INT) AS page, CASE arg_max(o_orderstatus, o_orderkey) WHEN 'O' THEN 'success' WHEN 'F' THEN 'unavailable' ELSE 'error' END AS status FROM orders GROUP BY 1, 2) """


@registered(_ARTISTS + """SELECT artist_id, count(*) AS planned, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'unavailable') AS n_unavailable, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status IS NULL) AS n_pending FROM plan LEFT JOIN stored USING (artist_id, page) GROUP BY artist_id""")
def artist_page_rollup(table):
    return discovery.artist_rollup(*_artists(table))


@registered(_ARTISTS + """SELECT artist_id, page, CAST((page - 1) * 20 + 1 AS BIGINT) AS "first", CAST(least(page * 20, declared_total) AS BIGINT) AS "last" FROM plan LEFT JOIN stored USING (artist_id, page) WHERE status IS NULL OR status = 'error'""")
def pending_plan(table):
    out = discovery.pending(*_artists(table))
    return out.select("artist_id", "page", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@registered("""SELECT o_orderkey, o_custkey, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def top_n_per_source(table):
    rows = table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return discovery.top_per_source(rows, "o_custkey", [F.col("o_totalprice").desc(), "o_orderkey"], 3).select("o_orderkey", "o_custkey", "rank")


def _checkpoint(table) -> tuple[DataFrame, DataFrame]:
    index = table("documents").where("doc_id % 10 != 9").select(F.col("doc_id").alias("url"), F.col("lang").alias("last_modified"))
    kind = F.when(F.col("quality") == 1, "success").when(F.col("toxic") == 1, "error").otherwise("no-x1")
    found = table("labels").select(F.col("doc_id").alias("url"), kind.alias("status"), F.when(F.col("toxic") == 0, "en").alias("last_modified"))
    return index, found


_CHECK = """WITH ix AS (SELECT doc_id AS url, lang AS last_modified FROM documents WHERE doc_id % 10 <> 9), ck AS (SELECT doc_id AS url, CASE WHEN quality = 1 THEN 'success' WHEN toxic = 1 THEN 'error' ELSE 'no-x1' END AS status, CASE WHEN toxic = 0 THEN 'en' END AS last_modified FROM labels) """


@registered(_CHECK + """SELECT count(*) AS n_index, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'no-x1') AS n_no_x1, count(*) FILTER (status = 'unavailable') AS n_unavailable, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status IS NULL) AS n_pending,
floor(count(status) / count(*) * 10000 + 0.5) / 100 AS percent FROM ix LEFT JOIN ck USING (url)""")
def checkpoint_status(table):
    return state.status_summary(*_checkpoint(table))


@registered(_CHECK + "SELECT url, status FROM ck WHERE url NOT IN (SELECT url FROM ix)")
def outside_index(table):
    index, found = _checkpoint(table)
    return state.outside_index(found, index).select("url", "status")


@registered(_CHECK + "SELECT url, coalesce(status <> 'error' AND ix.last_modified IS NOT DISTINCT FROM ck.last_modified, false) AS reuse FROM ix LEFT JOIN ck USING (url)")
def reuse_predicate(table):
    return state.reusable(*_checkpoint(table)).select("url", "reuse")


def _whole_checkpoint(table) -> tuple[DataFrame, DataFrame]:
    """All documents as the index."""
    return table("documents").select(F.col("doc_id").alias("url"), F.col("lang").alias("last_modified")), _checkpoint(table)[1]


_WHOLE = _CHECK.replace(" WHERE doc_id % 10 <> 9", "")


@registered(_WHOLE + """SELECT count(*) AS n_index, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'no-x1') AS n_no_x1, count(*) FILTER (status = 'unavailable') AS n_unavailable, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status IS NULL) AS n_pending,
floor(count(status) / count(*) * 10000 + 0.5) / 100 AS percent FROM ix LEFT JOIN ck USING (url)""")
def checkpoint_status_all(table):
    return state.status_summary(*_whole_checkpoint(table))


@registered(_WHOLE + "SELECT url, coalesce(status <> 'error' AND ix.last_modified IS NOT DISTINCT FROM ck.last_modified, false) AS reuse FROM ix LEFT JOIN ck USING (url)")
def reuse_predicate_all(table):
    return state.reusable(*_whole_checkpoint(table)).select("url", "reuse")


@registered("SELECT o_orderkey AS url, o_orderstatus AS status FROM orders WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = o_orderkey)")
def outside_index_orders(table):
    found = table("orders").select(F.col("o_orderkey").alias("url"), F.col("o_orderstatus").alias("status"))
    return state.outside_index(found, _whole_checkpoint(table)[0]).select("url", "status")


@registered("""SELECT 'blank-title' AS rule, count(*) FILTER (trim(p_name) = '') AS n_errors FROM part UNION ALL SELECT 'bad-number', count(*) FILTER (NOT regexp_matches(p_brand, '^Brand#[0-9]+$')) FROM part UNION ALL SELECT 'price', count(*) FILTER (p_retailprice < 950) FROM part UNION ALL SELECT 'duplicate-name', count(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1)""")
def validate_rules(table):
    parts = table("part")
    rules = {"blank-title": T.trimmed(F.col("p_name")) != "", "bad-number": F.col("p_brand").rlike(r"^Brand#[0-9]+\z"), "price": F.col("p_retailprice") >= 950}
    twice = gates.duplicates(parts, "p_name").agg(F.lit("duplicate-name").alias("rule"), F.count("*").alias("n_errors"))
    return gates.rule_errors(parts, rules).unionByName(twice)


@registered("""WITH n AS (SELECT count(*) AS n FROM documents), w AS (SELECT CAST(i AS INT) AS sample_no, CAST(floor(i * (n - 1) / 19.0 + 0.5) AS BIGINT) AS place FROM n, range(20) t(i)), d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) SELECT sample_no, doc_id FROM w JOIN d USING (place)""")
def equidistant_sample(table):
    return search.equidistant(table("documents").select("doc_id"), ["doc_id"], 20).select("sample_no", "doc_id")


@registered("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND upper(lang) <> lang THEN 'lang' ELSE '' END || CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN ',source' ELSE '' END AS differences FROM documents""")
def review_diff(table):
    d = table("documents")
    stored = d.select("doc_id", F.col("lang").alias("stored_lang"), F.col("source").alias("stored_source"))
    edit = F.col("doc_id") % 3 == 0
    live = d.select("doc_id", F.when(edit, F.upper("lang")).otherwise(F.col("lang")).alias("live_lang"), F.when(edit & (F.col("doc_id") % 2 == 0), F.lit(None)).otherwise(F.col("source")).alias("live_source"))
    return gates.differences(stored.join(live, "doc_id"), ["lang", "source"]).select("doc_id", F.array_join("differences", ",").alias("differences"))


@registered("""WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id FROM labels) SELECT CAST((SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS BIGINT) AS n_unmatched, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) = 0 AS equal""")
def multiset_equal(table):
    return gates.multiset_equal(table("documents").select("doc_id"), table("labels").select("doc_id"))


@registered("""WITH m AS (SELECT count(*) AS n_documents, count(DISTINCT doc_id) AS n_ids, (SELECT count(*) FROM labels) AS n_labels, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_strays FROM documents)
SELECT n_documents, n_ids, n_labels, n_strays, CASE WHEN n_ids <> n_documents THEN 'ids repeat' WHEN n_strays > 0 THEN 'labels without document' WHEN n_labels < n_documents THEN 'documents without label' END AS first_failure, NOT (n_ids <> n_documents OR n_strays > 0 OR n_labels < n_documents) AS released FROM m""")
def promotion_gates(table):
    docs, labels = table("documents"), table("labels")
    counts = docs.agg(F.count("*").alias("n_documents"), F.count_distinct("doc_id").alias("n_ids"))
    others = labels.agg(F.count("*").alias("n_labels")).join(F.broadcast(labels.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n_strays"))), F.lit(True))
    metrics = counts.join(F.broadcast(others), F.lit(True))
    rules = [("ids repeat", F.col("n_ids") == F.col("n_documents")), ("labels without document", F.col("n_strays") == 0), ("documents without label", F.col("n_labels") >= F.col("n_documents"))]
    return gates.first_failure(metrics, rules)


@registered("SELECT sha256(string_agg(n_nationkey || '|' || n_name || '|' || n_regionkey, chr(10) ORDER BY n_nationkey)) AS sha256 FROM nation")
def fingerprint(table):
    return gates.fingerprint(table("nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


_DIGEST = "sha256(coalesce(string_agg(d, chr(10) ORDER BY k NULLS FIRST, d), ''))"
_CELL = "coalesce(length({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_PRINTED = ("doc_id", "text", "lang", "source", "n_chars")


@registered(f"""WITH l0 AS (SELECT doc_id AS k, sha256(concat_ws('|', {', '.join(_CELL.format(c) for c in _PRINTED)})) AS d FROM documents), {', '.join(f"l{i + 1} AS (SELECT b AS k, d FROM (SELECT k >> 12 AS b, {_DIGEST} AS d FROM l{i} GROUP BY 1))" for i in range(5))} SELECT {_DIGEST} AS sha256 FROM l5""")
def fingerprint_documents(table):
    return gates.fingerprint_in_blocks(table("documents").select(*_PRINTED), "doc_id")


def _sides(table) -> tuple[DataFrame, DataFrame]:
    d = table("documents").select(F.sha2("text", 256).alias("key"), F.col("lang").alias("content"), F.col("doc_id").alias("ordinal"), "source")
    old = d.where("source in ('src0', 'src1', 'src2')").groupBy("key").agg(F.min_by("content", "ordinal").alias("content"))
    return old, d.where("source not in ('src0', 'src1', 'src2')")


@registered("""WITH d AS (SELECT sha256(text) AS key, lang AS content, doc_id, source FROM documents), o AS (SELECT key, arg_min(content, doc_id) AS was FROM d WHERE source IN ('src0', 'src1', 'src2') GROUP BY key), g AS (SELECT key, arg_min(content, doc_id) AS content, count(*) AS n_rows FROM d WHERE source NOT IN ('src0', 'src1', 'src2') GROUP BY key)
SELECT key, content, n_rows, CASE WHEN was IS NULL THEN 'new' WHEN was = content THEN 'same' ELSE 'conflict' END AS action FROM g LEFT JOIN o USING (key)""")
def merge_uncontested(table):
    return merge.merged_simple(*_sides(table))


@registered("""SELECT CASE WHEN quality = 1 THEN 'success' WHEN quality = 0 AND toxic = 0 THEN 'no-x1' WHEN doc_id % 2 = 0 THEN 'unavailable' ELSE 'error' END AS status, count(*) AS n FROM labels GROUP BY 1""")
def outcome_counts(table):
    variants = F.when(F.col("quality") == 1, 1).when(F.col("toxic") == 0, 0)
    return table("labels").groupBy(state.outcome(variants, F.when(F.col("doc_id") % 2 == 0, 404).otherwise(500)).alias("status")).agg(F.count("*").alias("n"))


@registered("""WITH q AS (SELECT DISTINCT lower(substr(p_type, 1, 3)) AS query FROM part UNION SELECT DISTINCT substr(p_name, 1, 4) FROM part), h AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^\\p{Latin}]', '', 'g') AS n FROM part) SELECT query AS query_id, id FROM q JOIN h ON contains(n, query) WHERE length(query) >= 2""")
def batch_search(table):
    p = table("part")
    queries = p.select(F.lower(F.substring("p_type", 1, 3)).alias("query")).union(p.select(F.substring("p_name", 1, 4).alias("query"))).distinct().withColumn("query_id", F.col("query"))
    return search.batch_contains(queries, _catalog(table))


@registered("""WITH h AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^\\p{Latin}]', '', 'g') AS n FROM part) SELECT q.id AS query_id, h.id AS id FROM h q JOIN h ON contains(h.n, q.n) WHERE q.id % 50 = 0 AND length(q.n) >= 2""")
def batch_search_names(table):
    index = _catalog(table)
    return search.batch_contains(index.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("title_norm").alias("query")), index)


def _stored(table, forms: list[str]) -> search.GramIndex:
    """Customers as songs of their names, by their segments, in a stored index."""
    c = table("customer")
    index = search.indexed(c.select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.lit(" "), F.translate("c_name", "0123456789#", "abcdefghij")).alias("title"), F.col("c_mktsegment").alias("artist")), plain=True)
    path = new_path(c.sparkSession, "grams")
    search.write_gram_index(index, path, forms)
    return search.read_gram_index(c.sparkSession, path)


_NAMES = "SELECT c_custkey AS id, lower(c_mktsegment) AS artist, lower(c_mktsegment) || regexp_replace(lower(translate(c_name, '0123456789#', 'abcdefghij')), '[^a-z]', '', 'g') AS title FROM customer"


@registered(f"""WITH h AS ({_NAMES}), q AS (SELECT id AS query_id, substr(title, 1 + id % 5, 9 + id % 12) AS query FROM h WHERE id % 50 = 0 UNION ALL SELECT id, title FROM h WHERE id % 50 = 25), m AS (SELECT query_id, id, title = query AS exact FROM q JOIN h ON contains(title, query))
SELECT query_id, id, CASE WHEN exact THEN 0 ELSE 1 END AS tier FROM m WHERE exact OR query_id NOT IN (SELECT query_id FROM m WHERE exact)""")
def gram_title_search(table):
    """Pieces of titles that all open alike, looked up by their rarest pair of characters."""
    stored = _stored(table, ["title", "han", "exact"])
    titles = stored.held.where("form = 'exact'").select("id", "held")
    place, size = (1 + F.col("id") % 5).cast("int"), (9 + F.col("id") % 12).cast("int")
    asked = titles.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.substr("held", place, size).alias("query")).unionByName(titles.where("id % 50 = 25").select(F.col("id").alias("query_id"), F.col("held").alias("query")))
    return search.batch_search(asked, stored)


@registered(f"WITH h AS ({_NAMES}), q AS (SELECT DISTINCT substr(artist, 2, 5) AS query FROM h) SELECT query AS query_id, id FROM q JOIN h ON contains(artist, query)")
def gram_artist_search(table):
    stored = _stored(table, ["artist"])
    asked = stored.held.where("form = 'artist'").select(F.substring("held", 2, 5).alias("query_id"), F.lit("artist").alias("form"), F.substring("held", 2, 5).alias("query"))
    return search.lookup(asked, stored).select("query_id", "id")


@registered("""WITH r AS (SELECT c_nationkey AS component, c_custkey AS ordinal, c_mktsegment AS url FROM customer WHERE c_nationkey IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY component, url ORDER BY ordinal) AS i FROM r)
SELECT CAST(component AS VARCHAR) AS component, kind, count(*) AS n FROM (SELECT component, CASE WHEN i = 1 THEN 'accepted' ELSE 'variant-metadata' END AS kind FROM f) GROUP BY ALL""")
def merge_fold(table):
    c = table("customer")
    rows = c.select(
        F.col("c_nationkey").cast("string").alias("component"), F.col("c_custkey").alias("ordinal"), F.col("c_mktsegment").alias("url"), F.col("c_mktsegment").alias("song_id"), F.lit("t").alias("title"),
        F.lit("a").alias("artist"), F.col("c_mktsegment").alias("number"), F.col("c_name").alias("variant_id"), F.col("c_name").alias("meta"),
    )
    return merge.folded(rows).groupBy("component", "kind").agg(F.count("*").alias("n"))
