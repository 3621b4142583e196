"""Title and artist search over a catalog (id, title, artist, source_url, ordinal, variants)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.session import new_path, written

# Fixed values.
PRIORITY = {"standard": 1, "official-video": 2, "anime-video": 3, "guide-vocal": 4, "guitar-guide": 5, "other": 6}
PAGE = 10
BLOCK_BITS = 12


def indexed(catalog: DataFrame, plain: bool = False) -> DataFrame:
    """Search forms as columns, worked out once at ingest, so that searches are filters on plain columns."""
    form = T.searchable_folded if plain else T.searchable
    out = catalog.withColumns({"title_norm": form(F.col("title")), "artist_loose": T.loose(form(F.col("artist")))})
    return out.withColumns({"title_loose": T.loose(F.col("title_norm")), "title_han": T.han_only(F.col("title_norm"))})


def supported_variants(catalog: DataFrame) -> DataFrame:
    """Supported variants in order of version priority (ties by place); entries left without any go."""
    prio = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    kept = F.filter("variants", lambda v: v["supports_x1"])
    keyed = F.transform(kept, lambda v, i: F.struct(prio[v["version_type"]].alias("p"), i.alias("i"), v.alias("v")))
    return catalog.withColumn("variants", F.transform(F.array_sort(keyed), lambda x: x["v"])).where(F.size("variants") > 0)


def ranked_variants(variants: DataFrame, order: str, ties: list[str]) -> DataFrame:
    """`place`, from 1, of supported variant rows (id, supports_x1, version_type) in order of version priority, then `order` (whole numbers) and ties.

    Rows of an id are placed in blocks of neighbouring numbers, after the counts of the blocks before, so no id is one task's.
    """
    prio = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    rows = variants.where("supports_x1").withColumns({"__p": prio[F.col("version_type")], "__block": F.shiftright(F.col(order).cast("long"), BLOCK_BITS)})
    inside = rows.withColumn("__at", F.row_number().over(Window.partitionBy("id", "__p", "__block").orderBy(order, *ties)))
    sizes = rows.groupBy("id", "__p", "__block").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy("id").orderBy("__p", "__block")) - F.col("__n")).drop("__n")
    same = [inside[c].eqNullSafe(before[c]) for c in ("id", "__p", "__block")]
    return inside.join(before, same).select(*[inside[c] for c in variants.columns], (F.col("__before") + F.col("__at")).cast("int").alias("place"))


def by_title(index: DataFrame, raw: str) -> DataFrame:
    """Exact titles if there are any, in the whole catalog; else titles that hold the query (two characters at least)."""
    query = T.searchable_text(index.sparkSession, raw)
    if not query:
        return index.limit(0).withColumn("tier", F.lit(0))
    part, han = query.replace(T.LONG_MARK, ""), T.han_only_text(index.sparkSession, query)
    exact = F.col("title_norm") == query
    partial = F.lit(False)
    if len(part) >= 2:
        partial = F.col("title_loose").contains(part)
        if len(han) >= 2 and han == query:
            partial |= F.col("title_han").contains(han)
    hits = index.where(exact | partial).withColumn("tier", F.when(exact, 0).otherwise(1))
    best = hits.agg(F.min("tier").alias("best"))  # one row
    return hits.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")


def by_artist(index: DataFrame, raw: str) -> DataFrame:
    """Exact artists (tier 0), then artists that hold the query (tier 1); the long mark never counts."""
    query = T.searchable_text(index.sparkSession, raw).replace(T.LONG_MARK, "")
    if not query:
        return index.limit(0).withColumn("tier", F.lit(0))
    exact = F.col("artist_loose") == query
    found = exact | F.col("artist_loose").contains(query) if len(query) >= 2 else exact
    return index.where(found).withColumn("tier", F.when(exact, 0).otherwise(1))


def in_title_order(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(T.numeric_order(F.col("title")), T.numeric_order(F.col("artist")), "source_url")


def page(ordered: DataFrame, number: int) -> DataFrame:
    return ordered.offset((number - 1) * PAGE).limit(PAGE)


def search_songs(index: DataFrame, raw: str) -> DataFrame:
    """Songs by title: exact titles, else titles that hold the query; only then songs without supported variants go. In the catalog's order.

    An exact title whose variants are all unsupported still hides the partial ones.
    """
    return supported_variants(by_title(index, raw)).orderBy("ordinal")


def search_songs_by_artist(index: DataFrame, raw: str) -> DataFrame:
    """Songs by artist with their supported variants: exact artists first, each part in the catalog's order."""
    return supported_variants(by_artist(index, raw)).orderBy("tier", "ordinal")


def list_songs(index: DataFrame) -> DataFrame:
    """All songs with supported variants, in order of titles."""
    return in_title_order(supported_variants(index))


def browse(index: DataFrame, raw: str, number: int, by: str = "title") -> DataFrame:
    """A page of ten: of the list of songs if the query is blank, else of the search."""
    if not raw.strip():
        return page(list_songs(index), number)
    return page(search_songs(index, raw) if by == "title" else search_songs_by_artist(index, raw), number)


def marked_strip(pages: DataFrame) -> DataFrame:
    """page_strip() as text, with different marks for the gap at the start and the one at the end."""
    strip = page_strip(pages).withColumn("__n", F.size("strip"))
    text = F.transform("strip", lambda x, i: F.when(x > 0, x.cast("string")).when(i == 1, "start-gap").otherwise("end-gap"))
    head = F.transform("strip", lambda x, i: F.when(x > 0, x.cast("string")).otherwise("end-gap"))
    return strip.withColumn("strip", F.when(F.element_at("strip", 2) == 0, text).otherwise(head)).drop("__n")


def page_strip(pages: DataFrame) -> DataFrame:
    """(total, current) rows with `strip`: page numbers to show, 0 for a gap."""
    last = F.greatest(F.lit(1), F.floor("total")).cast("int")
    at = F.least(last, F.greatest(F.lit(1), F.floor("current"))).cast("int")
    gap = F.lit(0)
    strip = (
        F.when(last <= 7, F.sequence(F.lit(1), last))
        .when(at <= 4, F.array(*[F.lit(i) for i in range(1, 6)], gap, last))
        .when(at >= last - 3, F.array(F.lit(1), gap, *[last - i for i in range(4, -1, -1)]))
        .otherwise(F.array(F.lit(1), gap, at - 1, at, at + 1, gap, last))
    )
    return pages.withColumn("strip", strip)


def empty_state(query, norm, hits):
    """Why a search shows what it does."""
    return F.when(T.trimmed(query) == "", "catalog").when(norm == "", "invalid").when((F.length(norm) < 2) & (hits == 0), "too-short").when(hits == 0, "none").otherwise("results")


#: Forms of a catalog that searches look into, and the fewest characters that may be looked for in them.
FORMS = {"title": "title_loose", "han": "title_han", "artist": "artist_loose", "exact": "title_norm"}
SHARDS = 16
#: Parts of the ids of an answer, and the most ids and queries in a packed row.
DEALS, IDS, QUERIES = 64, 1024, 256


def grams(form) -> F.Column:
    """Distinct neighbouring pairs of characters."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(form) - 1), lambda i: F.substr(form, i, F.lit(2)))
    return F.array_distinct(F.when(F.length(form) >= 2, pairs).otherwise(F.array().cast("array<string>")))


class GramIndex(NamedTuple):
    """Postings (form, gram, shard, id), how many each gram has (form, gram, n), and the forms themselves (form, id, held)."""

    postings: DataFrame
    counts: DataFrame
    held: DataFrame


def shard_of(*columns) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SHARDS)).cast("int")


def write_gram_index(index: DataFrame, path: str, forms: list[str] | None = None) -> None:
    """The stored index of a catalog's search forms, worked out once.

    Postings lie in a folder per form and shard of their gram, in order of grams, so that a gram's are found by the
    folder and Parquet's statistics; a common gram's many postings are spread over files by the ranges of (gram, id).
    """
    spark = index.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = forms or [f for f, c in FORMS.items() if c in index.columns]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.col(FORMS[f]).alias("held")) for f in wanted]))
    held = index.select("id", each.alias("x")).select("x.form", "id", "x.held").where(F.length("held") > 0)
    held.write.mode("errorifexists").partitionBy("form").parquet(f"{path}/held")
    # whole titles are met as they are, by equality
    rows = spark.read.parquet(f"{path}/held").where("form != 'exact'").select("form", "id", F.explode(grams(F.col("held"))).alias("gram")).withColumn("shard", shard_of("form", "gram"))
    rows.repartitionByRange(n, "form", "shard", "gram", "id").sortWithinPartitions("form", "shard", "gram", "id").write.mode("errorifexists").partitionBy("form", "shard").parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings").groupBy("form", "shard", "gram").agg(F.count("*").alias("n"))
    counts.write.mode("errorifexists").partitionBy("form").parquet(f"{path}/counts")


def read_gram_index(spark: SparkSession, path: str) -> GramIndex:
    return GramIndex(*(spark.read.parquet(f"{path}/{x}") for x in ("postings", "counts", "held")))


def rarest_gram(texts: DataFrame, stored: GramIndex) -> DataFrame:
    """(form, query, gram, n): of each text of two characters or more the gram with the fewest postings; none if one has no postings."""
    asked = texts.select("form", "query", F.explode(grams(F.col("query"))).alias("gram"))
    met = asked.join(stored.counts.select("form", "gram", "n"), ["form", "gram"], "left")
    least = met.groupBy("form", "query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    return least.where("g.n > 0").select("form", "query", "g.gram", "g.n")


def candidates(texts: DataFrame, stored: GramIndex) -> DataFrame:
    """(form, query, id) that share each text's rarest gram: as many rows as that gram has postings."""
    # written, so that its size is known when the postings are met: they are not shuffled for a few texts
    probes = written(rarest_gram(texts, stored).withColumn("shard", shard_of("form", "gram")), "probes")
    return probes.join(stored.postings, ["form", "shard", "gram"]).select("form", "query", "id")


def packed(rows: DataFrame, on: list[str], value: str, deals: int, most: int) -> DataFrame:
    """(on..., __deal, value): the distinct values of each `on`, null too, dealt by their hashes and packed, at most `most` in an array."""
    keys = [*on, "__deal"]
    dealt = rows.select(*on, value, F.pmod(F.xxhash64(value), F.lit(deals)).cast("int").alias("__deal"))
    # equal values have one rank, and so one array
    placed = dealt.withColumn("__block", F.floor((F.dense_rank().over(Window.partitionBy(*keys).orderBy(value)) - 1) / most))
    # collect_set passes over null
    null = F.array_repeat(F.lit(None).cast(rows.schema[value].dataType), F.max(F.isnull(value).cast("int")))
    return placed.groupBy(*keys, "__block").agg(F.concat(F.collect_set(value), null).alias(value)).drop("__block")


def for_each_query(found: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `found` (on..., id, others) for all of `asked` (on..., query_id) that ask for them: a row for each pair, however many ask for the same.

    Ids and queries meet in packed rows, each part of a text's ids in a task with all queries for it; pairs are made
    after the last shuffle and none is held. There are many more parts than tasks and more tasks than cores, so that
    all cores end at about the same time.
    """
    spark = found.sparkSession
    rest = [c for c in found.columns if c not in (*on, "id")]
    ids = written(packed(found, [*on, *rest], "id", DEALS, IDS), "answers")
    cells = ids.select(*on, "__deal").distinct()
    queries = packed(asked.select(*on, "query_id"), on, "query_id", SHARDS, QUERIES).drop("__deal").join(cells, on)
    n = max(16 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = queries.repartition(n, *on, "__deal").join(ids.repartition(n, *on, "__deal"), [*on, "__deal"]).drop("__deal")
    # a lambda is not compiled with the operators around it: their loop would hold all pairs of two packed rows, this one hands on query by query
    each = met.withColumn("query_id", F.explode(F.transform("query_id", lambda q: q)))
    return each.withColumn("id", F.explode("id"))


def found_texts(texts: DataFrame, stored: GramIndex) -> DataFrame:
    """(form, query, id) of all entries whose form holds the text (form, query), of two characters at least: looked up by its rarest gram, confirmed on the form."""
    near = candidates(texts, stored)
    return near.join(stored.held, ["form", "id"]).where(F.contains("held", "query")).select("form", "query", "id")


def lookup(queries: DataFrame, stored: GramIndex) -> DataFrame:
    """(query_id, form, id) of all entries whose form holds the query (query_id, form, query), for many queries at once.

    Queries of two characters or more are looked up by their rarest gram and confirmed on the form, a text that many
    of them ask for once; shorter ones have no gram and hold nothing, as in the searches. Equal rows of queries count
    once; null queries are passed over.
    """
    asked = queries.select("query_id", "form", "query").where(F.length("query") >= 2).distinct()
    found = found_texts(asked.select("form", "query").distinct(), stored)
    return for_each_query(found, asked, ["form", "query"]).select("query_id", "form", "id")


def batch_search(queries: DataFrame, stored: GramIndex) -> DataFrame:
    """(query_id, id, tier) by title for many queries (query_id, query: the search form): as by_title(), one after the other.

    Exact titles hide all others of their query; a query of Han characters alone is looked for among the titles' Han
    characters too. The stored index has the titles under "title" and "han", and under "exact" with their long marks.
    Queries that ask the same are answered once, and only the answer is repeated for each.
    """
    asked = queries.where(F.length("query") > 0).groupBy("query_id").agg(F.array_sort(F.collect_set("query")).alias("asked"))
    texts = asked.select("asked").distinct().select("asked", F.explode("asked").alias("query"))
    titles = stored.held.where("form = 'exact'").select("id", F.col("held").alias("query"))
    exact = texts.join(titles, "query").select("asked", "id")
    # what has an exact title needs no other
    rest = texts.join(exact.select("asked").distinct(), "asked", "left_anti")
    han = T.han_only(F.col("query"))
    loose = rest.select("asked", F.lit("title").alias("form"), F.replace(F.col("query"), F.lit(T.LONG_MARK), F.lit("")).alias("query"))
    only = rest.where((han == F.col("query")) & (F.length("query") >= 2)).select("asked", F.lit("han").alias("form"), han.alias("query"))
    wanted = written(loose.unionByName(only).where(F.length("query") >= 2).distinct(), "wanted")
    partial = found_texts(wanted.select("form", "query").distinct(), stored).join(wanted, ["form", "query"]).select("asked", "id")
    found = exact.withColumn("tier", F.lit(0)).unionByName(partial.withColumn("tier", F.lit(1)))
    return for_each_query(found, asked, ["asked"]).select("query_id", "id", "tier")


def batch_contains(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, id) for many queries at once, through a gram index written for this call."""
    path = new_path(index.sparkSession, "grams")
    write_gram_index(index.select("id", "title_loose"), path)
    asked = queries.select("query_id", F.lit("title").alias("form"), "query")
    return lookup(asked, read_gram_index(index.sparkSession, path)).select("query_id", "id")


def equidistant(rows: DataFrame, order: list, k: int) -> DataFrame:
    """k rows at equal distances in `order`, first and last included."""
    if k < 2:
        raise ValueError("a sample has two rows at least")
    n = rows.count()
    if n < k:
        raise ValueError(f"{n} rows are fewer than {k}")
    wanted = rows.sparkSession.range(k).select(F.col("id").cast("int").alias("sample_no"), F.floor(F.col("id") * (n - 1) / (k - 1) + 0.5).alias("place"))
    numbered = numbered_rows(rows, order)
    return numbered.join(F.broadcast(wanted), "place")


def numbered_rows(rows: DataFrame, order: list) -> DataFrame:
    """`place`, 0-based in `order`, without one task for all: counts of range partitions come before places inside them."""
    # a fixed number of partitions, which adaptive execution leaves alone: both branches below must see the same ones
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    inside = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = inside.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    return inside.join(F.broadcast(before), "__part").withColumn("place", F.col("__before") + F.col("__at") - 1).drop("__part", "__at", "__before")
