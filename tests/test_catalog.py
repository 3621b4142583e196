import hashlib

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import discovery, gates, merge, paging, search, state
from sparkloom.plans import catalog_queries
from sparkloom.sources import extract, songpages


def norm(spark, raw):
    return spark.createDataFrame([(raw,)], "x string").select(T.searchable(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "raw,expected",
    [("ＡＢＣ・Song", "abcsong"), ("カタカナ", "かたかな"), ("ｶﾅ", "かな"), ("ヴ", "ゔ"), ("櫻坂46!", "桜坂"), ("ラーメン々", "らーめん々"), ("한글 a1", "a"), ("", "")],
)
def test_search_form(spark, raw, expected):
    assert norm(spark, raw) == expected


def catalog(spark):
    v = [("v1", "1", "t", "other", True), ("v2", "2", "t", "standard", True), ("v3", "3", "t", "standard", False)]
    rows = [("s1", "夜に駆ける", "Y", "u1", 1, v), ("s2", "夜", "Yo", "u2", 2, v[:1]), ("s3", "らーめん", "Y feat. Z", "u3", 3, v[2:])]
    ddl = "id string, title string, artist string, source_url string, ordinal long, variants array<struct<id string, song_number string, version_title string, version_type string, supports_x1 boolean>>"
    return search.indexed(spark.createDataFrame(rows, ddl))


def test_title_tiers(spark):
    c = catalog(spark)
    ids = lambda df: [r.id for r in df.orderBy("ordinal").collect()]
    assert ids(search.by_title(c, "夜")) == ["s2"]
    assert ids(search.by_title(c, "夜驱")) == ["s1"]
    assert ids(search.by_title(c, "駆け")) == ["s1"]
    assert ids(search.by_title(c, "る")) == []
    assert ids(search.by_title(c, "123")) == []
    assert ids(search.by_title(c, "ラメン")) == ["s3"]


def test_artist_tiers_and_variants(spark):
    c = catalog(spark)
    assert [(r.id, r.tier) for r in search.by_artist(c, "y").orderBy("tier", "ordinal").collect()] == [("s1", 0)]
    assert [(r.id, r.tier) for r in search.by_artist(c, "yf").collect()] == [("s3", 1)]
    got = {r.id: [v.id for v in r.variants] for r in search.supported_variants(c).collect()}
    assert got == {"s1": ["v2", "v1"], "s2": ["v1"]}


@pytest.mark.parametrize("total,at,strip", [(3, 2, [1, 2, 3]), (58, 4, [1, 2, 3, 4, 5, 0, 58]), (58, 5, [1, 0, 4, 5, 6, 0, 58]), (58, 55, [1, 0, 54, 55, 56, 57, 58]), (8, 99, [1, 0, 4, 5, 6, 7, 8]), (12, -3, [1, 2, 3, 4, 5, 0, 12])])
def test_page_strip(spark, total, at, strip):
    assert search.page_strip(spark.createDataFrame([(total, at)], "total int, current int")).first().strip == strip


def test_numeric_title_order(spark):
    df = spark.createDataFrame([("a10",), ("A2",), ("a9",), ("曲12",), ("曲3",)], "t string")
    assert [r.t for r in df.orderBy(T.numeric_order(F.col("t"))).collect()] == ["A2", "a9", "a10", "曲3", "曲12"]


def test_order_of_long_numbers(spark):
    titles = ["A" + "9" * 20, "A1" + "0" * 20, "A2" + "0" * 21, "A" + "3" * 30, "A" + "0" * 40 + "7", "A07x", "A"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").orderBy(T.numeric_order(F.col("t")))
    assert [r.t for r in rows.collect()] == ["A", "A" + "0" * 40 + "7", "A07x", "A" + "9" * 20, "A1" + "0" * 20, "A2" + "0" * 21, "A" + "3" * 30]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Tokyo"])
def test_retry_after(spark, zone):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        ahead = (datetime.now(UTC) + timedelta(minutes=10)).strftime("%a, %d %b %Y %H:%M:%S GMT")
        said = {"5": 5000, " 5 ": 5000, "1.5": 1500, "-3": 0, ".25": 250, "1e3": 1_000_000, " ": 0, "": None, "soon": None, "5 s": None, "Wed, 21 Oct 2015 07:28:00 GMT": 0, "2015-10-21T07:28:00Z": 0, "1e300": 9 * 10**18, None: None}
        got = {r.x: r.ms for r in spark.createDataFrame([(x,) for x in [*said, ahead]], "x string").select("x", T.retry_after_ms(F.col("x")).alias("ms")).collect()}
        late = got.pop(ahead)
        assert got == said and 570_000 < late <= 600_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_sitemap(spark):
    xml = "<urlset xmlns='x'><url><loc> https://s.example/song/1 </loc><lastmod>2024-01-01</lastmod></url><url><loc>https://other/2</loc></url></urlset>"
    rows = extract.sitemap_entries(spark.createDataFrame([(xml,)], "xml string"), r"^https://s\.example/song/[0-9]+\z").collect()
    assert [(r.url, r.last_modified) for r in rows] == [("https://s.example/song/1", "2024-01-01")]


def test_page_plan_and_pending(spark):
    plan = discovery.page_plan(spark.createDataFrame([("7", 41)], "artist_id string, declared_total long"))
    assert sorted((r.page, r.first, r.last) for r in plan.collect()) == [(1, 1, 20), (2, 21, 40), (3, 41, 41)]
    stored = spark.createDataFrame([("7", 1, "success"), ("7", 2, "error")], "artist_id string, page int, status string")
    assert sorted(r.page for r in discovery.pending(plan, stored).collect()) == [2, 3]


def test_checkpoint_summary(spark):
    index = spark.createDataFrame([(c,) for c in "abcd"], "url string")
    ck = spark.createDataFrame([("a", "success"), ("b", "success"), ("c", "error"), ("z", "success")], "url string, status string")
    r = state.status_summary(index, ck).first()
    assert (r.n_success, r.n_error, r.n_pending, r.percent) == (2, 1, 1, 75.0)
    assert [x.url for x in state.outside_index(ck, index).collect()] == ["z"]


def test_fold_chain(spark):
    row = lambda o, url, number, vid: ("c", o, url, f"id-{url}", "t", "a", number, vid, f"{number}-{vid}")
    cols = "component string, ordinal long, url string, song_id string, title string, artist string, number string, variant_id string, meta string"
    rows = spark.createDataFrame([row(0, "u", "1", "A"), row(1, "u", "2", "A"), row(2, "u", "2", "B"), row(3, "w", "1", "C")], cols)
    assert [r.kind for r in merge.folded(rows).orderBy("ordinal").collect()] == ["accepted", "variant-id", "accepted", "song-number"]


def test_gates(spark):
    one = spark.range(1).select(F.lit(3).alias("n"))
    assert gates.first_failure(one, [("few", F.col("n") > 2), ("odd", F.col("n") % 2 == 0)]).first().first_failure == "odd"
    with pytest.raises(ValueError, match="odd"):
        gates.require(one, [("odd", F.col("n") % 2 == 0)])
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert gates.multiset_equal(a, a).first().equal and not gates.multiset_equal(a, a.distinct()).first().equal


def test_sample_needs_rows(spark):
    rows = spark.range(57)
    got = sorted(r.id for r in search.equidistant(rows, ["id"], 20).collect())
    assert len(got) == 20 and got[0] == 0 and got[-1] == 56
    with pytest.raises(ValueError):
        search.equidistant(rows, ["id"], 58)


def test_ranked_variants_without_gathering(spark):
    kinds = ["standard", "other", "guide-vocal"]
    rows = [(1, k * 3000 % 20_011, n, k % 4 != 0, kinds[k % 3]) for k in range(40) for n in (1, 2)] + [(2, 5, 1, False, "other"), (None, 9, 1, True, "other")]
    table = spark.createDataFrame(rows, "id long, k long, n int, supports_x1 boolean, version_type string")
    ranked = search.ranked_variants(table, "k", ["n"])
    want, last = set(), {}
    for r in sorted((r for r in rows if r[3]), key=lambda r: (r[0] or 0, search.PRIORITY[r[4]], r[1], r[2])):
        last[r[0]] = last.get(r[0], 0) + 1
        want.add((r[0], r[1], r[2], last[r[0]]))
    assert {(r.id, r.k, r.n, r.place) for r in ranked.collect()} == want
    plan = catalog_queries.QUERIES["variant_filter_rank"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_fingerprint_in_blocks(spark):
    rows = [(k, f"t{k}") for k in range(0, 40_000, 7)] + [(None, "x"), (-5, None), (7, "twice")]
    a = spark.createDataFrame(rows, "k long, t string")
    digest = lambda df: gates.fingerprint_in_blocks(df, "k").first().sha256
    assert digest(a) == digest(a.repartition(7, "t")) != digest(a.where("k is null or k <> 14"))
    assert digest(a) != digest(a.fillna("", ["t"])) and digest(a) != digest(a.unionByName(a.limit(1)))
    assert digest(a.limit(0)) == hashlib.sha256(b"").hexdigest()
    # the registered query grows with documents
    documents = catalog_queries.QUERIES["fingerprint_documents"](spark, "/root/testdata/sf0.001")
    assert "documents.parquet" in documents.inputFiles()[0]


def test_whole_index_and_growing_queries(spark):
    d = "/root/testdata/sf0.001"
    run = lambda name: catalog_queries.QUERIES[name](spark, d)
    docs, parts = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/part.parquet")
    assert run("checkpoint_status_all").first().n_index == docs.count()
    assert {r.url for r in run("reuse_predicate_all").collect()} == {r.doc_id for r in docs.collect()}
    orders = {r.o_orderkey for r in spark.read.parquet(f"{d}/orders.parquet").collect()}
    assert {r.url for r in run("outside_index_orders").collect()} == orders - {r.doc_id for r in docs.collect()}
    assert {r.query_id for r in run("batch_search_names").collect()} == {r.p_partkey for r in parts.where("p_partkey % 50 = 0").collect()}


def test_gram_index(spark, tmp_path):
    """All titles open alike; queries meet by their rarest pair, so candidates stay few; results are those of the single searches."""
    titles = [f"とてもながい{chr(0x4E00 + i)}{chr(0x5000 + i % 7)}うた{'ー' * (i % 3)}" for i in range(120)] + ["とてもながい", "花", "花火", "花の 火", "", None, "ab", "ab"]
    rows = [(i, t, f"うたう人{i % 4}", i) for i, t in enumerate(titles)]
    index = search.indexed(spark.createDataFrame(rows, "id long, title string, artist string, ordinal long"))
    search.write_gram_index(index, f"file://{tmp_path}/grams")
    stored = search.read_gram_index(spark, f"file://{tmp_path}/grams")
    raw = ["とてもながい", "とてもながい" + chr(0x4E00 + 5), "花火", "花", "うたー", "ab", "b", "zz", chr(0x5003) + "うた"]
    forms = {i: T.searchable_text(spark, q) for i, q in enumerate(raw)}
    asked = spark.createDataFrame([(i, q) for i, q in forms.items()] + [(1, forms[1]), (98, None), (99, "")], "query_id long, query string")
    got = sorted(tuple(r) for r in search.batch_search(asked, stored).collect())
    want = sorted((i, r.id, r.tier) for i, q in enumerate(raw) for r in search.by_title(index, q).collect())
    assert got == want
    near = search.candidates(asked.where("query_id = 1").select("query_id", F.lit("title").alias("form"), "query"), stored)
    assert near.count() <= 2  # not the 121 that open alike
    artists = search.lookup(spark.createDataFrame([(0, "artist", "人"), (1, "artist", "うたう人")], "query_id long, form string, query string"), stored)
    assert {r.query_id for r in artists.collect()} == {1} and artists.count() == len([r for r in rows])
    probe = search.candidates(asked.select("query_id", F.lit("title").alias("form"), "query"), stored)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in probe and "CartesianProduct" not in probe


def test_pages_of_a_long_list(spark, tmp_path):
    """A page is read from the files that hold it, wherever it lies; the last one is short, one behind it empty."""
    rows = spark.range(1000).select(F.col("id"), F.concat(F.lit("t"), F.col("id") % 250).alias("title"), F.lit("a").alias("artist")).repartition(3)
    path = f"file://{tmp_path}/list"
    paging.write_ordered(paging.title_order(rows), path, ["__title", "__artist", "id"], rows_per_file=64)
    want = sorted(range(1000), key=lambda i: (i % 250, i))
    for number, size, files in ((1, 10, 1), (50, 10, 1), (13, 10, 2), (100, 10, 1), (7, 150, 2)):
        page = paging.read_page(spark, path, number, size)
        assert [r.id for r in page.collect()] == want[(number - 1) * size : number * size] and len(page.inputFiles()) <= files
    assert [paging.read_page(spark, path, n).count() for n in (0, 101, -5)] == [0, 0, 0] and paging.about(spark, path) == (1000, 64)
    got = paging.spread(rows, ["id"], 5, f"file://{tmp_path}/spread")
    assert [r.id for r in got.orderBy("sample_no").collect()] == [0, 250, 500, 749, 999]
    paging.write_ordered(paging.title_order(rows.limit(0)), f"file://{tmp_path}/none", ["__title", "__artist", "id"])
    assert paging.read_page(spark, f"file://{tmp_path}/none", 1).count() == 0


def test_large_sitemaps_are_split(spark, tmp_path):
    entry = "<url>\n <loc>https://s.example/song/{0}</loc>\n <loc>https://s.example/song/999999</loc><lastmod>{0}</lastmod></url>\n"
    text = "<?xml version='1.0'?>\n<urlset xmlns='x'>\n" + "".join(entry.format(i % 20_000) for i in range(50_000)) + "<url><loc>https://other/1</loc></url><url></url></urlset>"
    (tmp_path / "a.xml").write_text(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        lines = spark.read.option("lineSep", "</url>").text(f"file://{tmp_path}/a.xml")
        assert lines.rdd.getNumPartitions() > 5
        rows = extract.sitemap_files(spark, f"file://{tmp_path}/a.xml", r"^https://s\.example/song/[0-9]+\z").orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [(r.url.rsplit("/", 1)[1], r.last_modified, r.ordinal) for r in rows] == [(str(i % 20_000), str(i % 20_000), i) for i in range(50_000)]


def test_recordings_without_python(spark):
    script = lambda x: f'<script id="a" type="application/ld+json">{x}</script>'
    record = lambda name, by: f'{{"@type": "MusicRecording", "name": {name}, "byArtist": {by}}}'
    pages = [
        script(record('" n "', '{"name": "b"}')), script("nonsense") + script(f'{{"@graph": [{{"@type": "X"}}, {record(chr(34) + "n" + chr(34), "[{}, 5, null]")}]}}'), script(record('"n"', '[{"name": "a"}, {"name": " "}, {"name": 7}, {"name": "c"}]')),
        script(record("5", '{"name": 3}')), script(record("null", "null")), script('{"@graph": 5, "@type": "MusicRecording"}'), "", None, script("[]"), script("5") + script(record('"é\\u00e9"', '"text"')), script(record('"first"', "{}")) + script(record('"second"', "{}")),
    ]
    frame = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    got = {r.id: tuple(r.r) if r.r else None for r in frame.select("id", extract.recordings(F.col("html")).alias("r")).collect()}
    assert got == {0: ("n", "b"), 1: ("n", None), 2: ("n", "a、c"), 3: (None, None), 4: (None, None), 5: (None, None), 6: None, 7: None, 8: None, 9: ("éé", None), 10: ("first", None)}
    for i in (0, 2, 6, 10):  # as the reader of whole pages has it
        record = songpages.recording(songpages.tree(pages[i]))
        assert got[i] is None and not record or got[i] == (record["name"].strip(), songpages.names(record.get("byArtist")) or None)
    assert "Python" not in frame.select(extract.recordings(F.col("html")))._jdf.queryExecution().executedPlan().toString()


def test_parts_of_addresses(spark):
    rows = spark.createDataFrame([("/a/b", "12"), ("/a/", "-9007199254740991"), ("a", "9007199254740992"), ("", "1e3"), (None, None), ("//", "9" * 60), ("x/é", "007.0")], "url string, n string")
    got = [tuple(r) for r in rows.select(T.last_segment(F.col("url")), T.safe_integer(F.col("n"))).collect()]
    assert got == [("b", 12), ("", -(2**53) + 1), ("a", None), ("", None), (None, None), ("", None), ("é", 7)]
    assert rows.limit(1).select(T.filled("/{x}/{y}?{x}", {"x": F.lit("a b/c"), "y": F.lit(7)})).first()[0] == "/a%20b%2Fc/7?a%20b%2Fc"
