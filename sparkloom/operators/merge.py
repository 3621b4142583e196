"""Catalog merge with conflicts, first come first served, decided in parallel rounds of joins.

A catalog has one row per variant: song_ord, var_ord (order of songs, and of variants in a song), url, song_id, title,
artist, number, variant_id, meta (what must agree for the same number). A song without variants is a row without number.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import drop_written, written

SONG = ["song_ord", "url", "song_id", "title", "artist"]
VARIANT = ["var_ord", "number", "variant_id", "meta"]
#: The kinds of conflicts.
CONFLICTS = ["song-metadata", "song-id", "song-number", "variant-metadata", "variant-id"]


class Merged(NamedTuple):
    songs: DataFrame
    variants: DataFrame
    outcomes: DataFrame
    conflicts: DataFrame
    stats: DataFrame


def merged_simple(production: DataFrame, generated: DataFrame) -> DataFrame:
    """(key, source, action) of generated rows (key, content) against production: same, conflict or new; later rows of a key repeat it."""
    first = generated.groupBy("key").agg(F.min_by("content", "ordinal").alias("content"), F.count("*").alias("n_rows"))
    both = first.join(production.select("key", F.col("content").alias("__was")), "key", "left")
    action = F.when(F.col("__was").isNull(), "new").when(F.col("__was") == F.col("content"), "same").otherwise("conflict")
    return both.withColumn("action", action).drop("__was")


def _held(keys: DataFrame, kind: str) -> DataFrame:
    """Keys of one kind (number, variant_id, url or song_id) that are taken, with (at, seat) of their holder."""
    return keys.where(F.col("kind") == kind).drop("kind").withColumnRenamed("key", kind)


def _production_keys(production: DataFrame) -> DataFrame:
    """(kind, key, at, seat, holder, about): what production has taken; of repeated keys the last holder's."""
    at = F.struct("song_ord", "var_ord")
    about = F.struct(F.col("title").alias("x"), F.col("artist").alias("y"))
    kinds = [("number", "number", F.struct(F.col("meta").alias("x"), F.lit(None).cast("string").alias("y"))), ("variant_id", "variant_id", None), ("url", "url", about), ("song_id", "song_id", None)]
    none = F.struct(F.lit(None).cast("string").alias("x"), F.lit(None).cast("string").alias("y"))
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key"), (none if more is None else more).alias("about")) for k, c, more in kinds])
    rows = production.select("url", at.alias("order"), "number", F.explode(named).alias("k")).where("k.key is not null and (number is not null or k.kind in ('url', 'song_id'))")
    last = rows.groupBy("k.kind", "k.key").agg(F.max_by(F.struct("url", "k.about"), "order").alias("h"))
    return last.select("kind", "key", F.lit(-1).cast("long").alias("at"), F.lit(-1).cast("long").alias("seat"), F.col("h.url").alias("holder"), F.col("h.about").alias("about"))


def _gates(songs: DataFrame, variants: DataFrame, keys: DataFrame) -> DataFrame:
    """The open songs with `gate`: overlap, song-metadata, song-id, try, or null while an earlier open song may settle it.

    Only songs that still may get a variant can take their address and id.
    """
    known = _held(keys, "url").select("url", F.col("at").alias("url_at"), F.col("about").alias("url_about"))
    ids = _held(keys, "song_id").select("song_id", F.col("at").alias("id_at"), F.col("holder").alias("id_holder"))
    seen = songs.join(known, "url", "left").join(ids, "song_id", "left")
    seen = seen.withColumns({"was": F.coalesce("was", F.when(F.col("url_at") < F.col("song_ord"), F.col("url_about"))), "id_url": F.coalesce("id_url", F.when(F.col("id_at") < F.col("song_ord"), F.col("id_holder")))}).drop("url_at", "url_about", "id_at", "id_holder")
    able = songs.join(variants.where("held is null and id_held is null").select("song_ord"), "song_ord", "left_semi")
    first = lambda c: able.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("song_ord").alias(f"first_{c}"))
    seen = seen.join(first("url"), "url", "left").join(first("song_id"), "song_id", "left")
    waits = lambda c: F.coalesce(F.col(f"first_{c}") < F.col("song_ord"), F.lit(False))
    same = F.col("was.x").eqNullSafe(F.col("title")) & F.col("was.y").eqNullSafe(F.col("artist"))
    gate = (
        F.when(F.col("gate").isNotNull(), F.col("gate")).when(F.col("was").isNotNull() & same, "overlap").when(F.col("was").isNotNull(), "song-metadata")
        .when(waits("url"), F.lit(None)).when(F.col("id_url").isNotNull(), "song-id").when(waits("song_id"), F.lit(None)).otherwise("try")
    )
    return seen.withColumn("gate", gate).drop("first_url", "first_song_id")


def _claims(variants: DataFrame, gates: DataFrame) -> DataFrame:
    """The open variants of songs that weren't refused, with `kind`: what becomes of them, or null while it depends on an earlier one."""
    told = gates.select("song_ord", F.col("gate").alias("song_gate"))
    rows = variants.join(told, "song_ord", "left").withColumn("gate", F.coalesce("gate", "song_gate")).drop("song_gate").where("coalesce(gate, '') not in ('song-metadata', 'song-id')")
    me = F.struct(F.col("song_ord").alias("o"), F.col("var_ord").alias("v"))
    able = rows.where("held is null and id_held is null")
    first = lambda c: able.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(me).alias(f"first_{c}"))
    rows = rows.join(first("number"), "number", "left").join(first("variant_id"), "variant_id", "left")
    ahead = lambda c: F.coalesce(F.col(f"first_{c}") < me, F.lit(False))
    own = F.col("held.holder").eqNullSafe(F.col("url"))
    kind = (
        F.when(F.col("gate").isNull(), F.lit(None)).when(F.col("held").isNotNull() & own & F.col("held.about.x").eqNullSafe(F.col("meta")), "same").when(F.col("held").isNotNull() & own, "variant-metadata")
        .when(F.col("held").isNotNull(), "song-number").when(ahead("number"), F.lit(None)).when(F.col("id_held").isNotNull(), "variant-id").when(ahead("variant_id"), F.lit(None)).otherwise("accepted")
    )
    return rows.withColumn("kind", kind).drop("first_number", "first_variant_id")


def _told(variants: DataFrame, keys: DataFrame) -> DataFrame:
    """The open variants with the holders of their number and id, if those have just been taken by an earlier one."""
    for c, name in (("number", "held"), ("variant_id", "id_held")):
        taken = _held(keys, c).select(c, F.struct("at", "seat").alias("taken_at"), F.struct("holder", "about").alias("taken"))
        me = F.struct(F.col("song_ord").alias("at"), F.col("var_ord").alias("seat"))
        variants = variants.join(taken, c, "left").withColumn(name, F.coalesce(name, F.when(F.col("taken_at") < me, F.col("taken")))).drop("taken_at", "taken")
    return variants


_ABOUT = "struct<x: string, y: string>"
_TAKEN = f"struct<holder: string, about: {_ABOUT}>"


def settled(production: DataFrame, generated: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """Outcomes of all generated songs and variants, first come first served, found in parallel rounds.

    In a round, a song is let through once no earlier open song can still take its address or id, and a variant is
    decided once no earlier open one can still take its number or id; what cannot take a key any more holds up no one.
    All rows of all songs are decided side by side, so a key that half of the songs share takes two rounds: the first
    one takes it, and the others find it taken. The number of rounds is the length of the longest chain in which each
    decision waits for another; a chain that is as long as the table would take as many.

    rounds: gets the number of rows left open after each round.
    """
    empty = lambda kind: F.lit(None).cast(kind)
    songs = generated.groupBy("song_ord").agg(*[F.first(c).alias(c) for c in SONG[1:]]).withColumns({"gate": empty("string"), "was": empty(_ABOUT), "id_url": empty("string")})
    variants = generated.where("number is not null").select("song_ord", "url", *VARIANT).withColumns({"gate": empty("string"), "held": empty(_TAKEN), "id_held": empty(_TAKEN)})
    keys = written(_production_keys(production), "keys")
    songs, variants = written(songs, "songs"), written(_told(variants, keys), "variants")
    outcomes, spent = [], []
    none = F.struct(empty("string").alias("x"), empty("string").alias("y"))
    while True:
        gates = written(_gates(songs, variants, keys), "gates")
        claims = written(_claims(variants, gates), "claims")
        won = claims.where("kind = 'accepted'").select("song_ord").distinct().withColumn("won", F.lit(True))
        left = claims.where("kind is null").select("song_ord").distinct().withColumn("left", F.lit(True))
        trying = gates.where("gate = 'try'").join(won, "song_ord", "left").join(left, "song_ord", "left")
        ended = written(trying.withColumn("end", F.when(F.col("won"), "new").when(F.col("left").isNull(), "dropped")).drop("won", "left"), "ended")
        refused = gates.where("gate in ('overlap', 'song-metadata', 'song-id')")
        is_id = F.col("gate") == "song-id"
        song = lambda kind, key, other: ["song_ord", F.lit(-1).cast("long").alias("var_ord"), F.col(kind).alias("kind"), key.alias("key"), "url", other.alias("other_url")]
        outcomes += [
            refused.select(*song("gate", F.when(is_id, F.col("song_id")).otherwise(F.col("url")), F.when(is_id, F.col("id_url")).otherwise(F.col("url")))),
            ended.where("end is not null").select(*song("end", F.col("url"), F.col("url"))),
            claims.where("kind is not null").select("song_ord", "var_ord", "kind", F.when(F.col("kind") == "variant-id", F.col("variant_id")).otherwise(F.col("number")).alias("key"), "url", F.when(F.col("kind") == "accepted", F.col("url")).when(F.col("kind") == "variant-id", F.col("id_held.holder")).otherwise(F.col("held.holder")).alias("other_url")),
        ]
        taken = claims.where("kind = 'accepted'")
        more = [taken.select(F.lit(k).alias("kind"), F.col(k).alias("key"), F.col("song_ord").alias("at"), F.col("var_ord").alias("seat"), F.col("url").alias("holder"), (F.struct(F.col("meta").alias("x"), empty("string").alias("y")) if k == "number" else none).alias("about")) for k in ("number", "variant_id")]
        became = ended.where("end = 'new'")
        more += [became.select(F.lit(k).alias("kind"), F.col(k).alias("key"), F.col("song_ord").alias("at"), F.lit(-1).cast("long").alias("seat"), F.col("url").alias("holder"), (F.struct(F.col("title").alias("x"), F.col("artist").alias("y")) if k == "url" else none).alias("about")) for k in ("url", "song_id")]
        old, old_songs, old_variants = keys, songs, variants
        keys = written(more[0].unionByName(more[1]).unionByName(more[2]).unionByName(more[3]).where("key is not null"), "keys")
        songs = written(gates.where("gate is null").unionByName(ended.where("end is null").drop("end")), "songs")
        variants = written(_told(claims.where("kind is null").drop("kind"), keys), "variants")
        for done in (old, old_songs, old_variants):
            drop_written(done)
        spent += [gates, claims, ended]
        open_ = songs.count() + variants.count()
        if rounds is not None:
            rounds.append(open_)
        if not open_:
            break
    found = outcomes[0]
    for part in outcomes[1:]:
        found = found.unionByName(part)
    found = written(found, "outcomes")
    for done in (*spent, keys, songs, variants):
        drop_written(done)
    return found


def folded(rows: DataFrame) -> DataFrame:
    """(component, ordinal, kind, key) of single-variant songs that compete within their component only: accepted, same, or the conflict.

    ordinal orders all rows and names them.
    """
    apart = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("|", F.length("component"), "component", c)).alias(c)
    fields = [F.col("ordinal").alias("song_ord"), F.lit(0).cast("long").alias("var_ord"), apart("url"), apart("song_id"), "title", "artist", apart("number"), apart("variant_id"), "meta"]
    keyed = rows.select(*fields)
    found = settled(keyed.limit(0), keyed).where(F.col("kind").isin(["accepted", "same", *CONFLICTS])).select(F.col("song_ord").alias("ordinal"), "kind", "key")
    # keys without the name of their component
    named = rows.select("component", "ordinal").join(found, "ordinal")
    return named.withColumn("key", F.expr("substring(key, length(concat_ws('|', length(component), component)) + 2)")).select("component", "ordinal", "kind", "key")


def merge_catalog(production: DataFrame, generated: DataFrame) -> Merged:
    """Production with the generated songs merged into it, first come first served, and what was refused.

    song_ord orders the songs of a side and names them, var_ord orders the variants of a song and differs among them.
    A null address, id, number or variant id is taken by no one and refuses no one.
    """
    outcomes = settled(production, generated)
    accepted = outcomes.where("kind = 'accepted'").select("song_ord", "var_ord", F.col("url").alias("target"))
    added = generated.where("number is not null").join(accepted, ["song_ord", "var_ord"]).withColumn("url", F.col("target"))
    names = ["url", *VARIANT[1:]]
    variants = production.where("number is not null").select(*names, F.lit(False).alias("added")).unionByName(added.select(*names, F.lit(True).alias("added")))
    told = generated.join(outcomes.where("kind = 'new'").select("song_ord"), "song_ord", "left_semi")
    song = lambda df, new: df.groupBy("song_ord").agg(*[F.first(c).alias(c) for c in SONG[1:]]).select(*SONG[1:], F.lit(new).alias("added"))
    songs = song(production, False).unionByName(song(told, True))
    conflicts = outcomes.where(F.col("kind").isin(CONFLICTS))
    sizes = lambda df, p: df.agg(F.count_distinct("song_ord").alias(f"{p}_songs"), F.count("number").alias(f"{p}_variants"))
    made = outcomes.agg(F.count_if(F.col("kind") == "new").alias("new_songs"), F.count_if(F.col("kind").isin("overlap", "song-metadata")).alias("overlapping_songs"), F.count_if(F.col("kind") == "accepted").alias("added_variants"))
    one = sizes(production, "production").join(F.broadcast(sizes(generated, "generated")), F.lit(True)).join(F.broadcast(made), F.lit(True))  # one row each
    stats = one.withColumns({"merged_songs": F.col("production_songs") + F.col("new_songs"), "merged_variants": F.col("production_variants") + F.col("added_variants")})
    return Merged(songs, variants, outcomes, conflicts, stats)


class Snapshot(NamedTuple):
    summary: DataFrame
    pages: DataFrame
    conflicts: DataFrame
    merged: Merged


def catalog_snapshot(index: DataFrame, checkpoint: DataFrame, songs: DataFrame, production: DataFrame) -> Snapshot:
    """State of a crawl: index (url, ordinal) against checkpoint (url, status, song_url), and the merge of the songs of its good pages.

    songs are the variants of the checkpoint's songs, by `page`, the checkpoint's url. Pages with a success without song,
    with another page's song, with an unknown status or outside of the index are conflicts of kind checkpoint.
    """
    known = ["success", "no-x1", "unavailable", "error"]
    state = index.select("url", "ordinal").join(checkpoint.select("url", "status", "song_url"), "url", "left")
    fault = (
        F.when((F.col("status") == "success") & F.col("song_url").isNull(), "success without song")
        .when((F.col("status") == "success") & (F.col("song_url") != F.col("url")), "song of another page")
        .when(~F.col("status").isin(known), "unknown status")
    )
    place = F.when(F.col("status").isNull(), "pending").when(F.col("status").isin(known), F.col("status")).otherwise("unknown")
    inside = state.select("url", "ordinal", place.alias("place"), fault.alias("fault"))
    outside = checkpoint.join(index.select("url"), "url", "left_anti").select("url", F.lit(None).cast("long").alias("ordinal"), F.lit("outside-index").alias("place"), F.lit("outside the index").alias("fault"))
    pages = written(inside.unionByName(outside), "pages")
    good = pages.where("place = 'success' and fault is null").select(F.col("url").alias("page"), F.col("ordinal").alias("song_ord"))
    merged = merge_catalog(production, songs.drop("song_ord").join(good, "page"))
    count = lambda p: F.count_if(F.col("place") == p).alias("n_" + p.replace("-", "_"))
    counts = pages.agg(F.count_if(F.col("place") != "outside-index").alias("n_index"), *[count(p) for p in [*known, "pending", "outside-index"]], F.count("fault").alias("n_faults"))
    refused = merged.conflicts.agg(F.count("*").alias("n_refused"))
    done = F.col("n_success") + F.col("n_no_x1") + F.col("n_unavailable") + F.col("n_error")
    summary = counts.join(F.broadcast(refused), F.lit(True)).join(F.broadcast(merged.stats), F.lit(True))  # one row each
    summary = summary.withColumns({"n_processed": done, "percent": F.when(F.col("n_index") == 0, F.lit(100.0)).otherwise(F.floor(done / F.col("n_index") * 10000 + 0.5) / 100), "n_conflicts": F.col("n_faults") + F.col("n_refused")})
    summary = summary.withColumn("ready", (F.col("n_pending") == 0) & (F.col("n_error") == 0) & (F.col("n_conflicts") == 0))
    conflicts = pages.where("fault is not null").select(F.lit("checkpoint").alias("kind"), F.col("url").alias("key"), F.col("fault").alias("message")).unionByName(merged.conflicts.select("kind", "key", F.concat_ws(" / ", "other_url", "url").alias("message")))
    return Snapshot(summary, pages, conflicts, merged)
