"""Benchmark decontamination by winnowing.

Texts become sequences of words (A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`). Of each window of SPAN words the
smallest hash of its K-word grams is kept, so two texts that share SPAN words in a row keep a common hash at the same
place of that run. Kept hashes of documents and items are joined; where they meet, the windows around the hash are
compared in whole, and the equal ones, side by side, make up the common runs. A document's windows are looked up among
the items' distinct windows, so that the work is linear in the text, however often its words repeat. Items of fewer
words are matched whole.

Defined results: a null or wordless text has no words and no hits; repeated rows are judged one by one; items that
repeat an id count once; an item without id bears the empty name; an empty benchmark hits nothing; extra columns are
passed over.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textbytes as tb
from sparkloom.llm.frames import add_columns, documents, prepare
from sparkloom.session import written

SPAN, K = 10, 5
#: Benchmarks of up to so many bytes of text go whole to each task; larger ones meet the documents in a shuffle join.
BROADCAST_BYTES = 16 << 20

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the first word's place for each text (one more at the end)."""
    low = tb.LOWER[data]
    start, end = tb.word_spans(low, offsets, IS_WORD)
    return tb.span_hash(tb.prefix_hash(low), start, end), np.searchsorted(start, offsets)


def window_minima(grams: np.ndarray) -> np.ndarray:
    """Smallest of each SPAN - K + 1 grams in a row."""
    n = SPAN - K + 1
    out = grams[: len(grams) - n + 1].copy()
    for j in range(1, n):
        np.minimum(out, grams[j : len(grams) - n + 1 + j], out=out)
    return out


def whole_windows(bounds: np.ndarray, n: int) -> np.ndarray:
    """Starts of all windows of n words that lie in one text."""
    sizes = np.maximum(np.diff(bounds) - n + 1, 0)
    return np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


class Index:
    """Fingerprints and distinct windows of benchmark items; the windows of short items are the items."""

    def __init__(self, names: list[str], texts: list[str | None]) -> None:
        data, offsets = tb.utf8(pa.array(texts, pa.large_string()))
        self.words, bounds = hashed_words(data, offsets)
        self.names = names
        size = np.diff(bounds)
        at = whole_windows(bounds, SPAN)
        self.prints = np.unique(window_minima(tb.ngrams(self.words, K))[at]) if len(at) else np.zeros(0, tb.U64)
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in range(1, SPAN + 1):
            at = whole_windows(bounds, SPAN) if m == SPAN else bounds[:-1][size == m]
            if len(at):
                self.of[m] = self._distinct(at, m, np.searchsorted(bounds, at, side="right") - 1)

    def _distinct(self, at: np.ndarray, m: int, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each distinct window, a place of it, head of its items, items) for windows of m words."""
        h = tb.ngrams(self.words, m)[at]
        order = np.lexsort((item, h))
        h, item, at = h[order], item[order], at[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (item[1:] != item[:-1])))
        h, item, at = h[new], item[new], at[new]
        heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[heads], at[heads], np.append(heads, len(item)), item

    def hits(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end) of the windows that stand in an item, and (text, item) of each text and item that share one."""
        start, end, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        for m, (known, place, heads, items) in self.of.items():
            at = whole_windows(bounds, m)
            if m == SPAN and len(at):
                low = window_minima(tb.ngrams(words, K))[at]
                at = at[self.prints[np.minimum(np.searchsorted(self.prints, low), len(self.prints) - 1)] == low]
            if not len(at):
                continue
            h = tb.ngrams(words, m)[at]
            seat = np.minimum(np.searchsorted(known, h), len(known) - 1)
            met = known[seat] == h
            at, seat = at[met], seat[met]
            same = np.ones(len(at), bool)
            for j in range(m):
                same &= words[at + j] == self.words[place[seat] + j]
            at, seat = at[same], seat[same]
            start.append(at)
            end.append(at + m)
            own = np.unique(np.stack([np.searchsorted(bounds, at, side="right") - 1, seat], 1), axis=0)
            n = heads[own[:, 1] + 1] - heads[own[:, 1]]
            of = items[np.repeat(heads[own[:, 1]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            pairs.append(np.stack([np.repeat(own[:, 0], n), of], 1))
        both = np.unique(np.concatenate(pairs), axis=0)
        return np.concatenate(start), np.concatenate(end), both[:, 0], both[:, 1]


NO_ITEMS = hashlib.sha256(b"").hexdigest()


def word_counts(words: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words of each text that lie in the ranges start..end."""
    edge = np.bincount(start, minlength=len(words) + 1) - np.bincount(end, minlength=len(words) + 1)
    return np.diff(np.concatenate(([0], np.cumsum(np.cumsum(edge)[:-1] > 0)))[bounds])


def judge(index: Index, texts: pa.Array) -> list[pa.Array]:
    """The columns FIELDS for each text."""
    data, offsets = tb.utf8(texts)
    n = len(offsets) - 1
    n_words, n_hit, n_items = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    digests = [NO_ITEMS] * n
    for a, b in tb.runs(offsets):
        words, bounds = hashed_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n_words[a:b] = np.diff(bounds)
        start, end, text, item = index.hits(words, bounds)
        if not len(start):
            continue
        n_hit[a:b] = word_counts(words, bounds, start, end)
        heads = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        for i, own in zip(text[heads].tolist(), np.split(item, heads[1:]), strict=True):
            names = sorted({index.names[x] for x in own.tolist()})
            n_items[a + i] = len(names)
            digests[a + i] = hashlib.sha256(",".join(names).encode()).hexdigest()
    return [pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(digests, pa.string()), pa.array(n_hit > 0)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each row of `docs` with what it shares with the items of `benchmark` (columns FIELDS)."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        rows = sorted((r.item_id, r.text) for r in items.collect())  # bounded by the check above
        held = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
        made: list[Index] = []

        def make(texts):
            if not made:
                made.append(Index(*held.value))
            return judge(made[0], texts)

        return add_columns(docs, make, FIELDS, keep)
    return _joined(docs, items, keep)


def windows_of(df: DataFrame, key: str, short: list[int], items: bool) -> DataFrame:
    """(key, print, size, first, windows): hashes of neighbouring windows that keep the same gram, for each gram kept.

    Windows have SPAN words, or the lengths `short` of items under that, of which an item has only its own.
    """

    def run(batches):
        for b in batches:
            data, offsets = tb.utf8(b.column(1))
            for i, j in tb.runs(offsets):
                words, bounds = hashed_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for m in [SPAN, *short]:
                    at = bounds[:-1][np.diff(bounds) == m] if items and m < SPAN else whole_windows(bounds, m)
                    if not len(at):
                        continue
                    h = tb.ngrams(words, m)[at]
                    low = window_minima(tb.ngrams(words, K))[at] if m == SPAN else h
                    text = np.searchsorted(bounds, at, side="right") - 1
                    heads = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (text[1:] != text[:-1]))))
                    seat = text[heads]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(h)).astype(np.int32)), pa.array(tb.signed(h)))
                    columns = [b.column(0).take(pa.array(seat + i)), pa.array(tb.signed(low[heads])), pa.array(np.full(len(heads), m)), pa.array(at[heads] - bounds[seat]), lists]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "print", "size", "first", "windows"])

    return df.select(key, "text").mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, print long, size long, first long, windows array<long>")


def _joined(docs: DataFrame, items: DataFrame, keep: list[str] | None) -> DataFrame:
    """For benchmarks too large to send whole: prints meet in a semi join, then the windows that are left, by their hashes."""
    sizes = F.size(F.regexp_extract_all(F.lower("text"), F.lit("([^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+)"), F.lit(1)))
    short = sorted(r.n for r in items.select(sizes.alias("n")).where(f"n between 1 and {SPAN - 1}").distinct().collect())  # at most SPAN - 1 numbers
    text = F.col("text").cast("string")
    keyed = docs.withColumn("__key", F.sha2(F.coalesce(text, F.lit("")), 256))
    match = ["print", "size", "window"]
    theirs = windows_of(items, "item_id", short, True).select("item_id", "print", "size", F.explode("windows").alias("window")).distinct()
    theirs = written(theirs, "windows")
    mine = windows_of(keyed.select("__key", text.alias("text")).dropDuplicates(["__key"]), "__key", short, False)
    near = mine.join(theirs.select("print", "size").distinct(), ["print", "size"], "left_semi")
    single = near.select("__key", "print", "size", "first", F.posexplode("windows").alias("i", "window")).withColumn("at", F.col("first") + F.col("i"))
    seen = written(single.join(theirs.select(*match).distinct(), match, "left_semi").select("__key", *match, "at"), "seen")
    # as many places as the text has words, at most; as many names as the digest joins
    places = seen.groupBy("__key").agg(F.collect_set(F.struct("at", "size")).alias("__places"))
    names = seen.select("__key", *match).distinct().join(theirs, match).groupBy("__key").agg(F.array_sort(F.collect_set("item_id")).alias("__names"))
    found = keyed.join(places, "__key", "left").join(names, "__key", "left")
    listed = F.coalesce("__names", F.array().cast("array<string>"))
    shown = [c for c in (docs.columns if keep is None else keep) if c not in [x.split()[0] for x in FIELDS.split(", ")]]
    found = found.select(*[F.col(f"`{c}`") for c in shown], F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), F.struct(text.alias("t"), "__places").alias("__both"))

    def make(both):
        data, offsets = tb.utf8(both.field("t"))
        words, bounds = hashed_words(data, offsets)
        start, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, rows in enumerate(both.field("__places").to_pylist()):
            at = np.array([(r["at"], r["size"]) for r in rows or []], np.int64).reshape(-1, 2)
            start.append(at[:, 0] + bounds[i])
            end.append(at.sum(axis=1) + bounds[i])
        n_hit = word_counts(words, bounds, np.concatenate(start), np.concatenate(end))
        return [pa.array(np.diff(bounds)), pa.array(n_hit), pa.array(n_hit > 0)]

    return add_columns(found, make, "n_words long, n_hit long, contaminated boolean", [*shown, "n_items", "items_sha256"], text="__both").select(*shown, *[x.split()[0] for x in FIELDS.split(", ")])


def op10_winnowing(spark, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
