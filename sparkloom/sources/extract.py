"""Records from XML, HTML and embedded JSON, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import trimmed
from sparkloom.operators.search import numbered_rows


def sitemap_entries(files: DataFrame, url_pattern: str) -> DataFrame:
    """(url, last_modified, ordinal) of the entries of sitemap texts (`xml`) whose address fits the pattern; doubles stay."""
    parsed = F.from_xml("xml", "url array<struct<loc string,lastmod string>>")
    rows = files.select(F.posexplode(parsed["url"]).alias("ordinal", "e"))
    url = trimmed(F.col("e.loc"))
    return rows.where(url.rlike(url_pattern)).select(url.alias("url"), F.nullif(trimmed(F.col("e.lastmod")), F.lit("")).alias("last_modified"), "ordinal")


def _inner(xml: Column, tag: str) -> Column:
    """Text of the first such element, entities and CDATA decoded; null if there is none or it is blank."""
    raw = F.regexp_extract(xml, rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    decoded = F.from_xml(F.concat(F.lit("<x><v>"), raw, F.lit("</v></x>")), "v string")["v"]
    return F.nullif(trimmed(F.when(raw.contains("&") | raw.contains("<"), decoded).otherwise(raw)), F.lit(""))


def sitemap_files(spark: SparkSession, path: str, url_pattern: str) -> DataFrame:
    """(url, last_modified, file, ordinal) of the entries of sitemap files of any size whose address fits the pattern; doubles stay.

    A record ends with each </url>, so that a file is read by as many tasks as it has splits and no file is held as a
    whole. Of several addresses or dates in an entry the first one counts; ordinals count from 0 in order of files and
    places in them, and skip what does not fit.
    """
    lines = spark.read.option("lineSep", "</url>").text(path)
    order = {"file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()}
    # what stands before the entry, the head of the file, is no part of it
    entry = F.concat(F.regexp_extract("value", r"(?s)(<url(?:\s[^>]*)?>(?!.*<url[\s>]).*)\z", 1), F.lit("</url>"))
    rows = lines.select(entry.alias("entry"), *[v.alias(k) for k, v in order.items()])
    read = rows.select(_inner(F.col("entry"), "loc").alias("url"), _inner(F.col("entry"), "lastmod").alias("last_modified"), *order).where(F.col("url").rlike(url_pattern))
    return numbered_rows(read, [F.col(c) for c in order]).select("url", "last_modified", "file", F.col("place").alias("ordinal"))


def recordings(html: Column) -> Column:
    """(title, artist) of the first record of a piece of music in a page's embedded JSON, as VARIANT, without Python; null if there is none.

    Scripts that aren't JSON are passed over. A record stands alone or in a @graph; the artist is an object or an array
    of them, whose names are joined, blank ones left out. A name that is no text gives null.
    """
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    parsed = F.transform(scripts, lambda x: F.try_parse_json(x))
    graph = lambda v: F.try_variant_get(v, "$['@graph']", "array<variant>")
    records = F.flatten(F.transform(parsed, lambda v: F.when(v.isNull(), F.array().cast("array<variant>")).otherwise(F.coalesce(graph(v), F.array(v)))))
    music = F.get(F.filter(records, lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "string") == "MusicRecording", F.lit(False))), F.lit(0))
    said = lambda v: F.when(F.schema_of_variant(v) == "STRING", trimmed(v.cast("string")))
    name = lambda v: _once(F.try_variant_get(v, "$.name", "variant"), said)
    several = lambda by: F.coalesce(F.try_variant_get(by, "$", "array<variant>"), F.array(by))
    names = lambda v: F.filter(F.transform(_once(F.try_variant_get(v, "$.byArtist", "variant"), several), name), lambda x: F.coalesce(x != "", F.lit(False)))
    found = lambda v: F.struct(F.nullif(name(v), F.lit("")).alias("title"), F.nullif(F.array_join(names(v), "、"), F.lit("")).alias("artist"))
    return _once(music, lambda v: F.when(v.isNotNull(), found(v)))


def _once(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def links(html: Column, pattern: str) -> Column:
    """Distinct matches in order, in mark-up and in embedded JSON alike."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))))


def heading(html: Column) -> Column:
    """Text of the first h1: tags off, four entities decoded, white space collapsed."""
    x = F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def version_type(label: Column, title: Column) -> Column:
    """Kind of a version by what its label holds, first rule first."""
    # fixed values
    rules = (("本人映像", "official-video"), ("アニメカラオケ", "anime-video"), ("ガイドボーカル", "guide-vocal"), ("ギタナビ", "guitar-guide"))
    out = F.when(label.contains(rules[0][0]), rules[0][1])
    for words, kind in rules[1:]:
        out = out.when(label.contains(words), kind)
    return out.when(label == title, "standard").otherwise("other")


def absolute_paths(paths: Column, host: str, pattern: str) -> Column:
    """Paths without query and fragment that fit the pattern, under the host, once each."""
    bare = F.transform(paths, lambda p: F.regexp_extract(p, r"^[^?#]*", 0))
    return F.array_distinct(F.transform(F.filter(bare, lambda p: p.rlike(pattern)), lambda p: F.concat(F.lit(host), p)))
