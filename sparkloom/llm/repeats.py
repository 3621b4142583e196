"""Exact removal of repeated byte strings (suffix-array style) by distributed prefix doubling.

A byte goes if a SPAN-byte string that covers it also starts at any other place. Ranking every position would shuffle
some forty times the input in the first round (measured, see the README), so the positions that are ranked are thinned
first, without losing a repeat:
of each SPAN-byte window the smallest hash of its GRAM-byte strings (the first, of those with equal high bits) is its
anchor. Equal windows have their anchors at equal places, so only windows whose anchor strings are equal can be equal, and the
windows of one anchor are one run of neighbours. Ranks are 64-bit hashes of strings at the anchor; Spark counts them in
three fixed rounds, and drops what is unique after each (there is no loop that doubles the offset):

1. rank of GRAM bytes at the anchor: runs whose rank is unique drop out;
2. rank pair (anchor, all bytes of the run): runs that meet an equal run are repeated in whole;
3. what is left beside others of its anchor: rank pairs (anchor, window of SPAN bytes) of the single windows.

From step 2 on two hashes of 64 bits must agree, of different strings of bytes.

Defined results: null counts as the empty text; repeated rows are documents of their own, so each is a copy of the
other; texts under SPAN bytes lose nothing; extra columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textbytes as tb
from sparkloom.llm.frames import documents, prepare
from sparkloom.session import written

SPAN, GRAM = 200, 64
WIDE = SPAN - GRAM + 1
#: Anchors with up to so many different runs are compared in one go (some MB); the windows of larger ones are counted by Spark one by one.
CROWD = 4000

#: Bits of a place in a batch; a column of an Arrow batch has under 2**32 bytes.
PLACE_BITS = np.uint64(32)

KEY = ["doc_id", "text_hash"]


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row, by doubling."""
    out, have = h, 1
    while 2 * have <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    n = len(h) - w + 1
    return np.minimum(out[:n], out[w - have : w - have + n]) if have < w else out


def window_starts(offsets: np.ndarray) -> np.ndarray:
    """Starts of all SPAN-byte windows that lie in one text."""
    size = np.maximum(np.diff(offsets) - SPAN + 1, 0)
    return np.repeat(offsets[:-1] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def anchor_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rank of the anchor, rank of the run, first window, last window) of all runs, in order of place."""
    at = window_starts(offsets)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z
    prefix = tb.prefix_hash(data)
    place = np.arange(len(data) - GRAM + 1)
    h = tb.span_hash(prefix, place, place + GRAM)
    # the same bits at any size of a batch, so that equal windows always choose alike
    low = window_minima((h >> PLACE_BITS << PLACE_BITS) | place.astype(np.uint64), WIDE)[at]
    first = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    anchor = (low[first] & ((tb.U64(1) << PLACE_BITS) - tb.U64(1))).astype(np.int64)
    start, last = at[first], at[np.concatenate((first[1:], [len(at)])) - 1]
    return h[anchor], tb.mix(tb.span_hash(prefix, start, last + SPAN) + (anchor - start).astype(np.uint64)), start, last


def runs_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, anchor, whole, first, last) for each run of each document."""

    def run(batches):
        for b in batches:
            data, offsets = tb.utf8(b.column(2))
            for i, j in tb.runs(offsets):
                own = offsets[i : j + 1] - offsets[i]
                anchor, whole, start, last = anchor_runs(data[offsets[i] : offsets[j]], own)
                text = np.searchsorted(own, start, side="right") - 1
                seat = pa.array(text + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(seat), b.column(1).take(seat), pa.array(tb.signed(anchor)), pa.array(tb.signed(whole)), pa.array(start - own[text]), pa.array(last - own[text])],
                    names=[*KEY, "anchor", "whole", "first", "last"],
                )

    return docs.select(*KEY, "text").mapInArrow(run, "doc_id long, text_hash long, anchor long, whole long, first long, last long")


def ranked_windows(asked: DataFrame) -> DataFrame:
    """For (doc_id, text_hash, text, asked) rows the rank of each window of the runs asked for."""

    def run(batches):
        for b in batches:
            data, offsets = tb.utf8(b.column(2))
            lists = b.column(3)
            ends = lists.offsets.to_numpy()
            fields = {f: lists.values.field(f).to_numpy(zero_copy_only=False) for f in ("anchor", "first", "last", "spare", "crowd")}
            for i in range(b.num_rows):
                part = slice(ends[i], ends[i + 1])
                prefix = tb.prefix_hash(data[offsets[i] : offsets[i + 1]])
                first, size = fields["first"][part], fields["last"][part] - fields["first"][part] + 1
                bounds = np.concatenate(([0], np.cumsum(size)))
                at = np.repeat(first - bounds[:-1], size) + np.arange(bounds[-1])
                ranks = tb.span_hash(prefix, at, at + SPAN)
                n = pa.array(np.full(len(first), i))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(n), b.column(1).take(n), pa.array(fields["anchor"][part]), pa.array(first), pa.array(fields["spare"][part]), pa.array(fields["crowd"][part]), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tb.signed(ranks)))],
                    names=[*KEY, "anchor", "first", "spare", "crowd", "ranks"],
                )

    return asked.select(*KEY, "text", "asked").mapInArrow(run, "doc_id long, text_hash long, anchor long, first long, spare boolean, crowd long, ranks array<long>")


def _met_in_groups(windows: DataFrame) -> DataFrame:
    """Repeated windows where all runs of an anchor come together in one task (up to CROWD runs each)."""

    def emit(rows):
        ids, hashes, first, spare, ranks = zip(*rows, strict=True)
        flat = np.concatenate(ranks)
        _, back, n = np.unique(flat, return_inverse=True, return_counts=True)
        met = n[back] > 1
        at = 0
        for k, r in enumerate(ranks):
            own = met[at : at + len(r)]
            at += len(r)
            if not spare[k] and own.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    yield ids[k], hashes[k], first[k] + a, first[k] + b - 1

    def run(batches):
        held, name = [], None
        out = []
        for b in batches:
            cols = [c.to_pylist() for c in b.columns[:5]]
            ends, flat = b.column(6).offsets.to_numpy(), b.column(6).values.to_numpy()
            for i in range(b.num_rows):
                if cols[2][i] != name:
                    if len(held) > 1:
                        out.extend(emit(held))
                    held, name = [], cols[2][i]
                held.append((cols[0][i], cols[1][i], cols[3][i], cols[4][i], flat[ends[i] : ends[i + 1]]))
            if len(out) > 5000:
                yield _spans(out)
                out = []
        if len(held) > 1:
            out.extend(emit(held))
        yield _spans(out)

    return windows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc_id long, text_hash long, first long, last long")


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[*KEY, "first", "last"])


def _met_by_rank(windows: DataFrame) -> DataFrame:
    """Repeated windows of anchors with very many runs: each rank is counted by Spark, with partial sums."""
    single = windows.select(*KEY, "anchor", "first", "spare", F.posexplode("ranks").alias("i", "rank"))
    twice = written(single.groupBy("anchor", "rank").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "rank"), "twice")
    at = F.col("first") + F.col("i")
    return single.where("not spare").join(twice, ["anchor", "rank"]).select(*KEY, at.alias("first"), at.alias("last"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, first, last): windows that start elsewhere too, as ranges of starts, over (doc_id, text_hash, text)."""
    runs = runs_of(docs)
    groups = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("whole").alias("x"), F.max("whole").alias("y")).where("n > 1")
    # written, so that both sides of the join come from a shuffle and Spark can split the partition of a hot anchor
    groups = written(groups.select("anchor", (F.col("x") == F.col("y")).alias("pure")), "groups")
    met = written(runs.join(groups, "anchor"), "met")
    mixed = met.where("not pure")
    classes = written(mixed.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "first", "last")).alias("one")), "classes")
    crowds = classes.groupBy("anchor").agg(F.count("*").alias("crowd"), F.min("n").alias("least")).where("least = 1").select("anchor", "crowd")
    asked = classes.join(crowds, "anchor").select("one.*", "anchor", (F.col("n") > 1).alias("spare"), "crowd")
    lists = asked.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "first", "last", "spare", "crowd")).alias("asked"))
    texts = docs.withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "t")
    found = texts.join(lists, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("text_hash"))).select(*KEY, "text", "asked")
    windows = written(ranked_windows(found), "windows")
    whole = met.where("pure").select(*KEY, "first", "last")
    some = mixed.join(classes.where("n > 1").select("anchor", "whole"), ["anchor", "whole"]).select(*KEY, "first", "last")
    small, large = windows.where(F.col("crowd") <= CROWD), windows.where(F.col("crowd") > CROWD)
    return whole.unionByName(some).unionByName(_met_in_groups(small)).unionByName(_met_by_rank(large))


def covered(ranges: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows of `ranges`."""
    out: list[list[int]] = []
    for a, b in sorted((r["first"], r["last"] + SPAN) for r in ranges or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def with_ranges(docs: DataFrame) -> DataFrame:
    """Each row of `docs` with `__ranges`: its repeated windows as an array of (first, last), null if none."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    ranges = repeated_windows(slim).groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("__ranges")).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    return docs.join(ranges, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left").drop("__id", "__hash")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of `docs`."""

    def run(batches):
        for b in batches:
            data, offsets = tb.utf8(b.column(1))
            raw, out = data.tobytes(), []
            for i, ranges in enumerate(b.column(2).to_pylist()):
                a, z = int(offsets[i]), int(offsets[i + 1])
                spans = covered(ranges, z - a)
                digest, at = hashlib.sha256(), a
                for x, y in spans:
                    digest.update(raw[at : a + x])
                    at = a + y
                digest.update(raw[at:z])
                out.append((z - a, sum(y - x for x, y in spans), len(spans), digest.hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_ranges(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "__ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(docs: DataFrame) -> DataFrame:
    """`docs` without their repeated bytes, in whole characters: a character cut in two is kept. Fills `__kept` with the new text."""
    from pyspark.sql.types import BooleanType, StringType, StructType

    ranged = with_ranges(docs)
    schema = StructType(list(docs.schema.fields)).add("__kept", StringType()).add("__cut", BooleanType())
    names, at = list(schema.names), docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts, cuts = [], []
            for text, ranges in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                raw = (text or "").encode()
                spans, keep, place = covered(ranges, len(raw)), [], 0
                for x, y in spans:
                    while x < len(raw) and raw[x] & 0xC0 == 0x80:
                        x += 1
                    while y < len(raw) and y > x and raw[y] & 0xC0 == 0x80:
                        y -= 1
                    keep.append(raw[place:x])
                    place = y
                texts.append(b"".join([*keep, raw[place:]]).decode() if spans else text)
                cuts.append(bool(spans))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names) - 2], pa.array(texts, pa.string()), pa.array(cuts)], names=names)

    return ranged.mapInArrow(run, schema)


def op5_repeats(spark, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
