"""Merge, gates, discovery, pages and files against plain reckonings on small tables."""

import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom.operators import discovery, gates, graph, merge, search, state
from sparkloom.sources import commits, files, release, songpages

CATALOG = "song_ord long, var_ord long, url string, song_id string, title string, artist string, number string, variant_id string, meta string"


def one_after_the_other(production, generated):
    """The merge as its rules say it, over lists of songs."""
    songs = {s["url"]: dict(s, variants=list(s["variants"])) for s in production}
    ids = {s["id"]: s["url"] for s in production}
    by_number, by_id = {}, {}
    for s in production:
        for number, vid, meta in s["variants"]:
            by_number[number], by_id[vid] = (s["url"], meta), s["url"]
    conflicts, added, overlap, new = [], 0, 0, 0
    for s in generated:
        known = songs.get(s["url"])
        overlap += known is not None
        if known and known["about"] != s["about"]:
            conflicts.append(("song-metadata", s["url"]))
            continue
        if not known and s["id"] in ids:
            conflicts.append(("song-id", s["id"]))
            continue
        target = known or dict(s, variants=[])
        for number, vid, meta in s["variants"]:
            if number in by_number:
                url, was = by_number[number]
                if url != target["url"]:
                    conflicts.append(("song-number", number))
                elif was != meta:
                    conflicts.append(("variant-metadata", number))
            elif vid in by_id:
                conflicts.append(("variant-id", vid))
            else:
                target["variants"].append((number, vid, meta))
                by_number[number], by_id[vid] = (target["url"], meta), target["url"]
                added += 1
        if not known and target["variants"]:
            songs[s["url"]], ids[s["id"]] = target, s["url"]
            new += 1
    return songs, conflicts, (new, overlap, added)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_in_random_order(spark, seed):
    r = random.Random(seed)
    pick = lambda p, n: f"{p}{r.randrange(n)}"
    variants = lambda: [(pick("n", 60), pick("v", 60), pick("m", 2)) for _ in range(r.choice([0, 1, 1, 2, 3]))]
    production = [{"url": f"u{i}", "id": f"i{i}", "about": ("t", "a"), "variants": [(f"n{i}", f"v{i}", "m0")]} for i in range(6)]
    generated = [{"url": pick("u", 30), "id": pick("i", 40), "about": (r.choice("tttx"), "a"), "variants": variants()} for _ in range(40)]

    def table(songs):
        rows = [(o, k, s["url"], s["id"], *s["about"], *v) for o, s in enumerate(songs) for k, v in enumerate(s["variants"] or [(None, None, None)])]
        return spark.createDataFrame(rows, CATALOG)

    got = merge.merge_catalog(table(production), table(generated))
    songs, conflicts, (new, overlap, added) = one_after_the_other(production, generated)
    assert sorted((c.kind, c.key) for c in got.conflicts.collect()) == sorted(conflicts)
    assert sorted((v.url, v.number, v.variant_id, v.meta) for v in got.variants.collect()) == sorted((s["url"], *v) for s in songs.values() for v in s["variants"])
    assert sorted((s.url, s.song_id, s.title) for s in got.songs.collect()) == sorted((s["url"], s["id"], s["about"][0]) for s in songs.values())
    n = got.stats.first()
    assert (n.new_songs, n.overlapping_songs, n.added_variants, n.merged_songs) == (new, overlap, added, len(songs))
    empty = merge.merge_catalog(table([]), table([]))
    assert empty.songs.count() == empty.conflicts.count() == 0 and empty.stats.first().merged_variants == 0


def test_merge_of_crowded_keys(spark):
    """Half of the songs share a number, a variant id, an address or an id: few rounds, since all of them are decided side by side."""
    def rows(size, **same):
        own = lambda i, c: same.get(c, f"{c}{i}") if i % 2 else f"{c}{i}"
        return [{"url": own(i, "u"), "id": own(i, "i"), "about": ("t", "a"), "variants": [(own(i, "n"), own(i, "v"), "m")] if i % 5 or "i" not in same else []} for i in range(size)]

    def table(songs):
        flat = [(o, k, s["url"], s["id"], *s["about"], *v) for o, s in enumerate(songs) for k, v in enumerate(s["variants"] or [(None, None, None)])]
        return spark.createDataFrame(flat, CATALOG)

    for same in ({"n": "hot"}, {"v": "hot"}, {"u": "hot"}, {"i": "hot"}):
        rounds, songs = [], rows(60, **same)
        found = merge.settled(table([]), table(songs), rounds)
        _, conflicts, (new, overlap, added) = one_after_the_other([], songs)
        got = [(r.kind, r.key) for r in found.collect()]
        assert sorted(x for x in got if x[0] in merge.CONFLICTS) == sorted(conflicts)
        assert [sum(k == want for k, _ in got) for want in ("new", "accepted")] == [new, added]
        assert len(rounds) <= 3 and rounds[-1] == 0, same
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_merge_passes_over_nulls(spark):
    """Null addresses, ids and variant ids are taken by no one; a shared number still is."""
    songs = [(0, 0, None, None, "t", "a", "n0", None, "m"), (1, 0, None, None, "t", "a", "n1", None, "m"), (2, 0, "u", None, "t", "a", "n1", "v", "m"), (3, 0, "u", "i", None, None, "n2", "w", None)]
    got = {(r.song_ord, r.var_ord): r.kind for r in merge.settled(spark.createDataFrame([], CATALOG), spark.createDataFrame(songs, CATALOG)).collect()}
    assert got == {(0, -1): "new", (0, 0): "accepted", (1, -1): "new", (1, 0): "accepted", (2, -1): "dropped", (2, 0): "song-number", (3, -1): "new", (3, 0): "accepted"}


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (41, 40), (60, 60)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 41: 40, 50: 40}


def test_search_keeps_hiding(spark):
    """An exact title hides partial ones even if none of its variants is supported; blank queries list all songs."""
    v = lambda ok: [("1", "other", ok), ("2", "standard", ok)]
    rows = [("a", "星 10", "y", 0, "s/1", v(True)), ("b", "星", "y", 1, "s/2", v(False)), ("c", "星 9", "yy", 2, "s/3", v(True))]
    index = search.indexed(spark.createDataFrame(rows, "id string, title string, artist string, ordinal int, source_url string, variants array<struct<number string, version_type string, supports_x1 boolean>>"))
    # the digits are no part of the search form, so all three are exact
    assert [r.id for r in search.search_songs(index, "星").collect()] == ["a", "c"]
    hidden = index.where("id != 'a'").withColumn("title_norm", F.when(F.col("id") == "c", "星空").otherwise(F.col("title_norm"))).withColumn("title_loose", F.col("title_norm"))
    assert search.search_songs(hidden, "星").collect() == []
    assert [r.id for r in search.browse(index, " 　", 1).collect()] == ["c", "a"]
    assert [[x.version_type for x in r.variants] for r in search.search_songs_by_artist(index, "y").collect()] == [["standard", "other"]]
    assert search.search_songs(index, "!").count() == 0


def test_song_page():
    page = """<title>[ミュージックビデオ観放題]夏の歌／歌う人-楽曲検索 | s</title><h1>h</h1>
    <script type="application/ld+json">nonsense</script><script type="application/ld+json">{"@type": "WebPage"}</script>
    <div data-testid="card-information"><p>アニメカラオケ</p> 曲番号 : 12 <b>Device X1</b></div>
    <div data-testid="card-information"><p>x</p> 曲番号:12 Device X1</div><div data-testid="card-information"><p>y</p> 曲番号:13 Other</div>"""
    assert songpages.song_of(page, "Device X1") == {"title": "夏の歌", "artist": "歌う人", "variants": [{"number": "12", "label": "アニメカラオケ"}]}
    record = json.dumps({"@graph": [{"@type": "MusicRecording", "name": " n ", "byArtist": {"name": "b"}}]})
    assert songpages.song_of(f'<script type="application/ld+json">{record}</script>', "d") == {"title": "n", "artist": "b", "variants": []}
    assert songpages.song_of(None, "d") == {"title": None, "artist": None, "variants": []}
    assert songpages.names([{"name": " a "}, {"name": ""}, {}, {"name": "b"}]) == "a、b" and songpages.names("x") == ""


def test_bad_song_pages_keep_the_others(spark):
    record = lambda name: f'<script type="application/ld+json">{{"@type": "MusicRecording", "name": {name}, "byArtist": {{"name": "b"}}}}</script>'
    pages = [record('"n"'), record("5"), record("[]"), record("null") + "<h1>" + "<b>" * 5000 + "deep", "<![foo", None, "</i>" * 20000 + record('"m"')]
    rows = spark.createDataFrame([(f"https://h/song/{i}", p) for i, p in enumerate(pages)], "url string, html string")
    found = {int(r.page_id): (r.title, r.fault) for r in songpages.song_pages(rows, "d", r"/song/([0-9]+)\z").collect()}
    assert found[0] == ("n", None) and found[3] == ("deep", None) and found[6] == ("m", None) and found[5] == (None, "no title or artist")
    assert found[1] == found[2] == (None, "unreadable page: the record's name is no text") and len(found) == 7 and found[4][1]


def test_source_pages_in_one_pass(spark):
    """Each page is read once, by its parser; bad, empty, deep and unknown ones have defined rows."""
    link = lambda x: f"<a href='/s/{x}?q'>x</a>"
    pages = [
        (1, "annual", f"<h2>A</h2><p>{link(2)}{link(1)}</p><h2>B</h2><p>{link(3)}</p><h2>A</h2><p>{link(1)}</p>"), (2, "lists", f"<div id=one>{link(5)}{link(4)}</div><div id=two></div>"), (3, "artist-catalog", f"<section><h2>2件(1-2件目表示)</h2>{link(9)}{link(8)}{link(9)}</section>"),
        (4, "artist-catalog", "<h2>5件(1-5件目表示)</h2>"), (5, "artist-catalog", None), (6, "annual", ""), (7, "other", link(1)), (8, None, link(1)), (9, "annual", "<h2>A</h2>" + "<b>" * 5000 + link(7)), (10, "lists", "<![x"),
    ]
    frame = spark.createDataFrame([(i, "u", p, h) for i, p, h in pages], "id int, url string, parser string, html string").repartition(3)
    found = songpages.dispatched(frame, {"a": "^A$", "b": "^B$"}, r"/s/\d+", ["one", "two"])
    got = {}
    for r in found.collect():
        got.setdefault(r.id, []).append((r.section, r.link, r.fault))
    assert got.pop(7) == got.pop(8) == [(None, None, "unknown parser")] and 5 not in got and 6 not in got
    assert got == {
        1: [("a", "/s/1", None), ("a", "/s/2", None), ("b", "/s/3", None)], 2: [("one", "/s/4", None), ("one", "/s/5", None)], 3: [("artist", "/s/9", None), ("artist", "/s/8", None)],
        4: [("artist", None, songpages.NO_LINKS)], 9: [("a", "/s/7", None)], **({10: got[10]} if 10 in got else {}),
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("EvalPythonUDTF") == 1


def test_song_pages_take_linear_time():
    import time

    for page in ("<b>" * 60_000, "<div>" * 30_000 + "</i>" * 30_000, "<h2>A</h2><i>x</i>" * 8_000, "<p>" * 60_000):
        began = time.process_time()
        songpages.song_of(page, "d")
        songpages.section_links(page, "^A$", "/x")
        assert time.process_time() - began < 10


def test_section_links():
    page = "<h2>A</h2><p><a href='/s/2'>x</a><a href='/s/1?q'>x</a><a href='/t/1'>x</a></p><h2>B</h2><a href='/s/9'>x</a><h2>A</h2><ul><li><a href='/s/3#f'>x</a></ul>"
    assert songpages.section_links(page, "^A$", r"/s/\d+") == ["/s/1", "/s/2", "/s/3"]
    assert songpages.section_links("", "A", "x") == [] and songpages.catalog_page("<h2>no</h2>", "x")["total"] == 0


def test_files(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"songs": [{"id": "a", "title": "t", "variants": [{"number": "1", "supports_x1": True}]}, {"id": "b"}]}, indent=1))
    bad.write_text("{ not json")
    rows = files.catalog_scan(spark, f"file://{good}").collect()
    assert [(r.song_ord, r.id) for r in rows] == [(0, "a"), (1, "b")] and rows[0].variants[0].supports_x1
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_json(spark, f"file://{bad}", "a int").collect()
    for path in (bad, tmp_path / "none.json"):
        assert files.read_json_or_none(spark, f"file://{path}", "a int").count() == 0
    out = f"file://{tmp_path}/out"
    for n in (3, 5):  # the second replaces the first
        files.write_snapshot(spark.range(n), out, ["id"])
        assert sorted(r.id for r in files.read_snapshot(spark, out, "id long").collect()) == list(range(n))
    assert files.read_snapshot(spark, f"file://{tmp_path}/none", "id long").count() == 0


STATE = "url long, status string, ordinal long"


def rows_of(spark, root):
    return sorted(tuple(r) for r in commits.read(spark, root, "url", STATE).collect())


@pytest.mark.parametrize("step", ["write", "_publish", "rename"])
def test_a_crash_leaves_the_old_state(spark, tmp_path, monkeypatch, step):
    """Whatever step fails, readers see the state before, and the next commit succeeds."""
    root = f"file://{tmp_path}/state"
    put = lambda *rows: commits.commit(spark.createDataFrame(rows, STATE), root, "url")
    put((1, "a", 1), (2, "a", 1))
    with monkeypatch.context() as m:
        if step == "write":
            m.setattr(commits, "one_per_key", lambda rows, key, order: rows.select("*", F.raise_error(F.lit("lost")).alias("x")))
        elif step == "_publish":
            m.setattr(commits, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        else:  # the manifest lies beside its place, but was not renamed
            def half(spark, root, manifest):
                out = commits._fs(spark, root).create(commits._path(spark, f"{root}/manifests/.half.tmp"), False)
                out.write(bytearray(b"{"))
                out.close()
                raise OSError("lost")

            m.setattr(commits, "_publish", half)
        with pytest.raises((OSError, PySparkException, Py4JJavaError)):
            put((2, "b", 2), (3, "b", 2))
    assert rows_of(spark, root) == [(1, "a", 1), (2, "a", 1)]
    assert put((2, "c", 3)) == 2 and rows_of(spark, root) == [(1, "a", 1), (2, "c", 3)]
    assert commits.vacuum(spark, root) >= 1 and rows_of(spark, root) == [(1, "a", 1), (2, "c", 3)]


def test_two_writers_cannot_mix(spark, tmp_path, monkeypatch):
    """One that finds its number taken puts its rows on top of the other's; a merge keeps what came meanwhile."""
    root = f"file://{tmp_path}/state"
    table = lambda *rows: spark.createDataFrame(rows, STATE)
    publish, between = commits._publish, []

    def late(spark, where, manifest):
        if between:
            between.pop()()
        return publish(spark, where, manifest)

    monkeypatch.setattr(commits, "_publish", late)
    between.append(lambda: commits.commit(table((1, "other", 0), (2, "other", 0)), root, "url"))
    assert commits.commit(table((1, "mine", 0)), root, "url") == 2
    assert rows_of(spark, root) == [(1, "mine", 0), (2, "other", 0)] and commits.versions(spark, root) == [1, 2]
    assert not publish(spark, root, commits.NOTHING._replace(version=2))
    between.append(lambda: commits.commit(table((2, "late", 0), (3, "late", 0)), root, "url"))
    commits.compact(spark, root, "url")
    assert rows_of(spark, root) == [(1, "mine", 0), (2, "late", 0), (3, "late", 0)] and len(commits.latest(spark, root).folders) == 2
    between.append(lambda: commits.commit(table((9, "new", 0)), root, "url", replace=True))
    commits.compact(spark, root, "url")  # of no use any more
    assert rows_of(spark, root) == [(9, "new", 0)]


def test_batches_count_once(spark, tmp_path):
    root = f"file://{tmp_path}/state"
    table = lambda *rows: spark.createDataFrame(rows, STATE)
    commits.commit(table((1, "a", 1), (1, "b", 2), (1, "b", 2)), root, "url", order="ordinal", stream="s", batch=0)
    commits.commit(table((1, "c", 3)), root, "url", stream="s", batch=1)
    assert commits.commit(table((1, "a", 1)), root, "url", stream="s", batch=0) == 2
    assert rows_of(spark, root) == [(1, "c", 3)] and commits.latest(spark, root).applied == {"s": 1}
    assert commits.commit(table((5, "z", 1)), root, "url", about={"version": 2}) == 3 and rows_of(spark, root) == [(5, "z", 1)]
    assert commits.read(spark, root, "url", STATE, {"version": 1}).count() == 0
    assert commits.read(spark, f"file://{tmp_path}/none", "url", STATE).count() == 0


def test_production_catalog(spark):
    fine = dict.fromkeys("n_error n_conflicts listed_error listed_conflicts listed_outside n_no_x1 n_unavailable n_pending listed_pending song_errors stats_no_x1 stats_unavailable stats_error unmatched_addresses bad_samples".split(), 0)
    fine |= dict.fromkeys("n_success n_processed n_index listed_songs merged_songs listed_variants merged_variants stats_success generated_songs review_size listed_samples distinct_samples".split(), 20)
    fine |= dict.fromkeys("catalog_version songs_version review_version".split(), 1) | {"ready": True, "allow_partial": False, "review_passed": True, "review_path": "p", "songs_path": "p", "review_sha256": "x", "songs_sha256": "x", "percent": 100.0}
    assert len(gates.RELEASE) == 28
    rows = gates.production_catalog(spark.createDataFrame([fine]), spark.range(2).withColumnRenamed("id", "number")).collect()
    assert len(rows) == 2 and rows[0].percent == 100.0 and not rows[0].partial
    for name, change in (("pages outside the index", {"listed_outside": 1}), ("crawl incomplete", {"ready": False}), ("reviewed content", {"songs_sha256": "y"}), ("review too small", dict.fromkeys("review_size listed_samples distinct_samples".split(), 19))):
        with pytest.raises(ValueError, match=name):
            gates.production_catalog(spark.createDataFrame([fine | change]), spark.range(1))


FAILS = {
    "catalog format": {"catalog_version": 2}, "songs format": {"songs_version": None}, "review format": {"review_version": 0}, "crawl incomplete": {"ready": False}, "error pages": {"n_error": 1}, "conflicts": {"n_conflicts": 1},
    "error list": {"listed_error": 1}, "conflict list": {"listed_conflicts": 2}, "pages outside the index": {"listed_outside": 1}, "processed pages": {"n_processed": 19}, "indexed pages": {"n_index": 21}, "pending list": {"listed_pending": 1},
    "merged songs": {"listed_songs": 19}, "merged variants": {"listed_variants": 21}, "song errors": {"song_errors": 1}, "success count": {"stats_success": 19}, "no-x1 count": {"stats_no_x1": 1}, "unavailable count": {"stats_unavailable": 1}, "error count": {"stats_error": 1},
    "generated songs": {"generated_songs": 19}, "generated addresses": {"unmatched_addresses": 2}, "review failed": {"review_passed": False}, "review too small": {"review_size": 19, "listed_samples": 19, "distinct_samples": 19}, "review size": {"listed_samples": 21},
    "review samples": {"bad_samples": 1}, "repeated samples": {"distinct_samples": 19}, "reviewed file": {"review_path": "q"}, "reviewed content": {"songs_sha256": "y"},
}


def test_each_release_rule_fails_once(spark):
    zeros = "n_error n_conflicts listed_error listed_conflicts listed_outside n_no_x1 n_unavailable n_pending listed_pending song_errors stats_no_x1 stats_unavailable stats_error unmatched_addresses bad_samples".split()
    full = "n_success n_processed n_index listed_songs merged_songs listed_variants merged_variants stats_success generated_songs review_size listed_samples distinct_samples".split()
    fine = dict.fromkeys(zeros, 0) | dict.fromkeys(full, 20) | dict.fromkeys(("catalog_version", "songs_version", "review_version"), 1)
    fine |= {"ready": True, "allow_partial": False, "review_passed": True, "review_path": "p", "songs_path": "p", "review_sha256": "x", "songs_sha256": "x"}
    assert list(FAILS) == [name for name, _ in gates.RELEASE]
    rows = [{**fine, **change, "case": name} for name, change in FAILS.items()] + [{**fine, "case": "fine"}]
    kinds = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string' if isinstance(v, str) else 'long'}" for k, v in {**fine, "case": ""}.items())
    told = {r.case: (r.first_failure, r.released) for r in gates.release(spark.createDataFrame([[r[k] for k in (*fine, "case")] for r in rows], kinds)).collect()}
    assert told.pop("fine") == (None, True) and told == {name: (name, False) for name in FAILS}


def test_release_over_files(spark, tmp_path):
    at = lambda x: f"file://{tmp_path}/{x}"
    index = spark.createDataFrame([(f"p{i}", i) for i in range(30)], "url string, ordinal long")
    checkpoint = spark.createDataFrame([(f"p{i}", "success" if i < 25 else "no-x1", f"p{i}" if i < 25 else None) for i in range(28)], "url string, status string, song_url string")
    songs = spark.createDataFrame([(f"p{i}", i, v, f"p{i}", f"i{i}", "t", "a", f"{10 * i + v}", f"v{i}.{v}", "m") for i in range(25) for v in range(2)], f"page string, {CATALOG}")
    release.write_catalog(merge.catalog_snapshot(index, checkpoint, songs, songs.drop("page").limit(0)), at("catalog"))
    release.write_songs(checkpoint, songs.drop("page"), at("songs"))
    samples = lambda n, ok=True: spark.createDataFrame([(f"p{i}", ok or i > 0, []) for i in range(n)], release.SAMPLES)
    release.write_review(samples(20), at("songs"), at("review"))
    args = (at("catalog"), at("songs"), at("review"))
    row = gates.release(release.promotion_metrics(spark, *args, True, "^p[0-9]+$")).first()
    assert row.released and (row.listed_songs, row.listed_variants, row.n_pending, row.listed_pending, row.stats_no_x1) == (25, 50, 2, 2, 3)
    release.promote(spark, *args, at("out"), True, "^p[0-9]+$")
    kept = files.read_snapshot(spark, at("out"), f"{release.VARIANTS}, songs_sha256 string, partial boolean").collect()
    assert len(kept) == 50 and kept[0].partial and kept[0].songs_sha256 == row.songs_sha256
    judged = lambda partial=True, pattern="^p[0-9]+$": release.promotion_metrics(spark, *args, partial, pattern)
    first = lambda m: gates.release(m).first().first_failure
    assert first(judged(False)) == "crawl incomplete" and first(judged(True, "^q")) == "song errors"
    release.write_review(samples(19), at("songs"), at("review"))
    assert first(judged()) == "review too small"
    release.write_review(samples(20, False), at("songs"), at("review"))
    assert first(judged()) == "review failed"
    release.write_review(samples(20), at("songs"), at("review"))
    release.write_songs(checkpoint, songs.drop("page").withColumn("title", F.lit("changed")), at("songs"))  # after the review
    assert first(judged()) == "reviewed content"
    with pytest.raises(ValueError, match="reviewed content"):
        release.promote(spark, *args, at("never"), True, "^p[0-9]+$")
    assert commits.versions(spark, at("never")) == []
    release.write_songs(checkpoint, songs.drop("page").where("url != 'p3'"), at("songs"))
    assert first(judged()) == "generated songs"


def test_review_of_variants(spark):
    v = lambda *x: [tuple(r) for r in x]
    a, b, c = ("1", "x", "standard", True), ("2", "y", "other", True), (None, None, None, None)
    rows = [(0, v(a, b), v(b, a), "t", "t"), (1, v(a), v(a, b), "t", None), (2, v(a, b), v(("1", "x", "standard", False)), None, None), (3, None, [], "t", "t"), (4, v(a, a), v(a), "t", "t"), (5, v(c), v(c), "t", "t"), (6, v(a), v(("1", None, "standard", True)), "t", "u")]
    kind = "array<struct<number: string, label: string, version_type: string, supports_x1: boolean>>"
    pairs = spark.createDataFrame(rows, f"id int, stored_variants {kind}, live_variants {kind}, stored_title string, live_title string").withColumns({"stored_artist": F.lit("a"), "live_artist": F.lit("a")})
    got = {r.id: (r.differences, r.added, r.lost, r.changed, r.matched) for r in gates.song_differences(pairs).collect()}
    assert got == {
        0: ([], [], [], [], True), 1: (["title", "variants"], ["2"], [], [], False), 2: (["variants"], [], ["2"], ["1"], False), 3: ([], [], [], [], True),
        4: (["variants"], [], [], ["1"], False), 5: ([], [], [], [], True), 6: (["title", "variants"], [], [], ["1"], False),
    }


def test_discovery_output(spark):
    """A later mention replaces an earlier one, excluded sources stay listed without candidates, limits cut in order, a page without links is at fault."""
    sources = spark.createDataFrame([("a", "u", "p", "success", False, 9, None), ("b", "u", "p", "success", None, 9, 2), ("c", "u", "p", "success", True, 9, None), ("d", "u", "p", "success", False, 3, None), ("e", "u", "p", "unavailable", False, 3, None), ("f", "u", "p", "success", False, 0, None)], "id string, url string, parser string, status string, excluded boolean, total int, limit int")
    rows = [("a", "x", "s", 1, 2001, 1), ("a", "x", "t", 2, 2000, 2), ("a", "x", "t", 2, 2000, 2), ("b", "z", "s", 3, None, 3), ("b", "x", "s", 1, None, 1), ("b", "y", "s", 2, None, 2), ("c", "w", "s", 1, None, 1)]
    found = spark.createDataFrame(rows, "source string, url string, section string, rank int, year int, ordinal int")
    out = discovery.discovery_output(sources, found, spark.createDataFrame([("x",), ("x",)], "url string"), ["s", "t"])
    assert sorted(tuple(r) for r in out.entries.collect()) == [("x", True, "a", "t", 2, [2000, 2001]), ("x", True, "b", "s", 1, []), ("y", False, "b", "s", 2, [])]
    assert {r.id: (r.n_candidates, r.fault) for r in out.sources.collect()} == {"a": (1, None), "b": (2, None), "c": (1, None), "d": (0, discovery.NO_LINKS), "e": (0, None), "f": (0, None)}
    n = out.summary.first()
    assert (n.n_sources, n.n_success, n.n_unavailable, n.n_excluded, n.n_faults, n.n_pages, n.n_known, n.n_new, n.n_s, n.n_t) == (6, 5, 1, 1, 1, 2, 1, 1, 2, 1)
    empty = discovery.discovery_output(sources.limit(0), found.limit(0), spark.createDataFrame([], "url string"), ["s"])
    assert empty.summary.first().n_pages == 0 and empty.entries.count() == 0


def test_candidate_index_files(spark, tmp_path):
    entry = lambda i, known: {"url": f"song/{i}", "last_modified": "d" if i % 2 else None, "known": known}
    cases = {"good": {"version": 1, "entries": [entry(1, True), entry(2, False), entry(3, None)]}, "old": {"version": 0, "entries": []}, "none": {"version": 1}, "twice": {"version": 1, "entries": [entry(1, True), entry(1, False)]}, "bad": {"version": 1, "entries": [{"url": "x"}]}}
    for name, held in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(held, indent=1))
    load = lambda name, **k: files.load_index(spark, f"file://{tmp_path}/{name}.json", 1, "^song/[0-9]+$", **k)
    source, rows = load("good")
    assert source.endswith("good.json") and sorted(map(tuple, rows.collect())) == [("song/1", "d"), ("song/2", None), ("song/3", "d")]
    source, rows = load("good", new_only=True)
    assert source.endswith("good.json#new-only") and sorted(r.url for r in rows.collect()) == ["song/2", "song/3"]
    assert load("twice", new_only=True)[1].count() == 1
    for name in ("old", "none", "twice", "bad"):
        with pytest.raises(ValueError):
            load(name)


def test_songs_are_checked_before_they_are_written(spark, tmp_path):
    songs = spark.createDataFrame([(0, 0, "song/1", "i", "t", "a", "1", "v", "m"), (1, 0, "song/2", "j", " ", "a", "2", "w", "m")], CATALOG)
    done = spark.createDataFrame([("song/1", "success")], "url string, status string")
    with pytest.raises(ValueError, match="blank: song/2"):
        release.write_songs(done, songs, f"file://{tmp_path}/x", "^song/")
    assert commits.versions(spark, f"file://{tmp_path}/x/songs") == []
    release.write_songs(done, songs.where("song_ord = 0"), f"file://{tmp_path}/x", "^song/")
    assert commits.versions(spark, f"file://{tmp_path}/x/songs") == [1]


def test_state_rules(spark):
    fetched = spark.createDataFrame([("a", 1, 200), ("a", 2, 429), ("a", 3, 200), ("b", 1, 404)], "source string, ordinal int, http_status int")
    assert sorted((r.source, r.ordinal) for r in state.aborted(fetched).collect()) == [("a", 1), ("b", 1)]
    local = spark.createDataFrame([("x", True), ("y", False), ("z", None)], "url string, known boolean")
    site = spark.createDataFrame([("s", "d")], "url string, last_modified string")
    assert [r.url for r in state.normalized_index(site.limit(0), local, new=True).collect()] == ["y"]
    with pytest.raises(ValueError):
        state.normalized_index(site, local, new=True)
    artists = spark.createDataFrame([(1, 3, 1), (2, 1, 1)], "artist_id long, declared_total long, planned_pages long")
    pages = spark.createDataFrame([(1, 1, "success", "old"), (2, 1, "success", "old")], "artist_id long, page long, status string, imported_from string")
    urls = spark.createDataFrame([(1, 1, "u", 0), (1, 1, "u", 1), (2, 1, "w", 0)], "artist_id long, page long, url string, pos long")
    found = discovery.artist_state(artists, pages, urls)
    assert {r.artist_id: r.inconsistent for r in found.collect()} == {1: True, 2: False}
    assert [r.artist_id for r in discovery.without_drift(found, pages).collect()] == [2]
