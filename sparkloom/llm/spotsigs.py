"""Document fingerprints by SpotSigs.

A spot is a common word of the list below with the next CHAIN content words (words not on the list) after it; its
signature is a 32-bit hash of the chain. A text's fingerprint is the set of its signatures, written as ascending
eight-digit hexadecimal numbers. Two fingerprints are as alike as the Jaccard ratio of their sets.

Defined results: a text without common words takes a spot at each word; one without words is one signature of its
bytes; the empty (and null) text has the empty fingerprint, which is like itself only (1.0). Equal texts have equal
fingerprints. Rows that repeat an id stand in order of their texts; null ids come first. An only document is its own
next one. Extra columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import textbytes as tb
from sparkloom.llm.frames import documents, prepare, width
from sparkloom.session import written

CHAIN = 3
LIKE = 0.75
#: Common words of English, German, French and Spanish.
COMMON = (
    "the of and to in a is that for it as with was on be by this are or from at an not have which but "
    "der die das und den von zu mit ist im dem nicht ein eine auf für sich des als auch "
    "de la le et les en un du une que est pour qui dans sur pas au par "
    "el los las por con una su para al del y es lo como se"
).split()

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def _names(texts: list[str]) -> np.ndarray:
    data, offsets = tb.utf8(pa.array(texts, pa.large_string()))
    return np.sort(tb.span_hash(tb.prefix_hash(data), offsets[:-1], offsets[1:]))


ANCHORS = _names(COMMON)


def signature_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of each text."""
    low = tb.LOWER[data]
    prefix = tb.prefix_hash(low)
    start, end = tb.word_spans(low, offsets, IS_WORD)
    words = tb.span_hash(prefix, start, end)
    bounds = np.searchsorted(start, offsets)
    seat = np.minimum(np.searchsorted(ANCHORS, words), len(ANCHORS) - 1)
    common = ANCHORS[seat] == words
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    plain = np.bincount(text[common], minlength=len(offsets) - 1) == 0  # no common word: every word is a spot
    spots = np.flatnonzero(common | plain[text]) if len(words) else np.zeros(0, np.int64)
    content = np.flatnonzero(~common)
    owner = text[content]
    at = np.searchsorted(content, spots, side="right")
    chain = words[spots] * tb.U64(tb.BASE) if len(spots) else np.zeros(0, np.uint64)
    for j in range(CHAIN):
        k = np.minimum(at + j, max(len(content) - 1, 0))
        real = (at + j < len(content)) & (owner[k] == text[spots]) if len(content) else np.zeros(len(spots), bool)
        chain = tb.mix(chain + np.where(real, words[content[k]], tb.U64(j)) if len(content) else chain)
    sigs = (chain >> tb.U64(32)).astype(np.uint32)
    heads = np.searchsorted(text[spots], np.arange(len(offsets)))
    whole = (tb.span_hash(prefix, offsets[:-1], offsets[1:]) >> tb.U64(32)).astype(np.uint32)
    out = []
    for i in range(len(offsets) - 1):
        if heads[i + 1] > heads[i]:
            out.append(np.unique(sigs[heads[i] : heads[i + 1]]))
        else:
            out.append(whole[i : i + 1] if offsets[i + 1] > offsets[i] else whole[:0])
    return out


def sets_of(texts: list[str]) -> list[np.ndarray]:
    data, offsets = tb.utf8(pa.array(texts, pa.large_string()))
    out = []
    for i, j in tb.runs(offsets):
        out += signature_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
    return out


def fingerprint(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_following(docs: DataFrame) -> DataFrame:
    """(bucket, extra, doc_id, text) where each bucket of a range of ids also has, as its `extra` row, the document after its last.

    Rows are dealt by bucket and sorted, so that in each task every row stands before the next document.
    """
    spark = docs.sparkSession
    n = max(2, width(spark))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the n borders of buckets
    borders = slim.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10000).alias("b")).first().b or []
    borders = F.array(*[F.lit(int(x)) for x in sorted(set(borders))]).cast("array<long>")
    bucket = F.coalesce(F.size(F.filter(borders, lambda x: x <= F.col("doc_id"))), F.lit(0))
    rows = slim.withColumn("bucket", bucket)
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    heads = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "text")).alias("h"))
    # one row per bucket from here
    every = Window.orderBy("bucket")
    last = F.max("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = heads.select("h", F.coalesce(F.lag("bucket").over(every), last).alias("to"))
    extras = firsts.select(F.col("to").alias("bucket"), F.lit(True).alias("extra"), "h.doc_id", "h.text")
    both = rows.select("bucket", F.lit(False).alias("extra"), "doc_id", "text").unionByName(extras)
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", *order)


def compared(docs: DataFrame) -> DataFrame:
    """Each document with its fingerprint, that of its edited text, and its likeness to that and to the next document."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (extra, doc_id, text); all but the last go out, unless they are extra."""
        texts = [r[2] for r in rows]
        sets = sets_of(texts)
        use = [i for i in range(len(rows) - 1) if not rows[i][0]]
        new = [edited(texts[i], texts[i + 1]) for i in use]
        theirs = sets_of(new)
        cols = (
            [rows[i][1] for i in use],
            [len(texts[i]) for i in use],
            [hashlib.sha256(t.encode()).hexdigest() for t in new],
            [fingerprint(sets[i]) for i in use],
            [fingerprint(s) for s in theirs],
            [likeness(sets[i], s) for i, s in zip(use, theirs, strict=True)],
            [likeness(sets[i], sets[i + 1]) for i in use],
        )
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            new = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
            held += new
            if len(held) > 1:
                yield finish(held)
                held = held[-1:]

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_following(docs).mapInArrow(run, schema)


def keyed_sets(docs: DataFrame) -> DataFrame:
    """(id, key, sigs) of each document with signatures: the key is a 128-bit hash of its set, equal for equal fingerprints only."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            sets = sets_of([x or "" for x in b.column(1).to_pylist()])
            keys = [hashlib.blake2b(s.astype("<u4").tobytes(), digest_size=16).hexdigest() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "key", "sigs"])

    slim = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "id long, key string, sigs array<long>").where("size(sigs) > 0")


def near_pairs(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """(a, b, key_a, key_b, likeness) of classes of equal fingerprints that are alike, by set length and pruned Jaccard.

    A class goes by its key (`keyed_sets` has the members) and its smallest id, which is null if no member has one; a is
    the smaller id, nulls first. Sets of a length n meet only those of n to n / like signatures, in partitions of
    lengths; in a meeting pair, one of the n - ceil(like * n) + 1 rarest signatures is common, and what can be common
    before and after it must suffice.
    """
    sets = keyed_sets(docs).groupBy("key").agg(F.min("id").alias("id"), F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs"))
    sets = written(sets, "sets")
    single = sets.select("key", "n", F.explode("sigs").alias("sig"))
    rarity = single.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    ranked = single.join(rarity, "sig").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("common"))
    # signatures that no other set has come first in rarity and can't meet
    alone = F.col("n") - F.size("common")
    use = F.greatest(F.lit(0), F.col("n") - F.ceil(F.lit(like) * F.col("n")) + 1 - alone).cast("int")
    prefix = ranked.select("key", "n", alone.alias("alone"), F.posexplode(F.slice("common", 1, use)).alias("i", "c"))
    prefix = prefix.select("key", "n", (F.col("alone") + F.col("i")).alias("at"), F.col("c.sig").alias("sig"))
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(like)))).cast("int")
    left = prefix.select(F.col("key").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), "sig", F.explode(F.array(part, part + 1)).alias("part"))
    right = prefix.select(F.col("key").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"), "sig", part.alias("part"))
    fits = (F.col("nx") >= like * F.col("ny")) & ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))))
    most = F.least("ax", "ay") + F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay"))
    pairs = left.join(right, ["sig", "part"]).where(fits & (most * (1 + like) >= like * (F.col("nx") + F.col("ny")))).select("x", "y").distinct()
    found = pairs.join(sets.select(F.col("key").alias("x"), F.col("id").alias("ix"), F.col("sigs").alias("sx")), "x")
    found = found.join(sets.select(F.col("key").alias("y"), F.col("id").alias("iy"), F.col("sigs").alias("sy")), "y")
    both = F.size(F.array_intersect("sx", "sy"))
    found = found.withColumn("likeness", both / (F.size("sx") + F.size("sy") - both)).where(F.col("likeness") >= like)
    # true and false are ordered, so that null ids come first
    ends = [F.struct(F.col(i).isNotNull().alias("known"), F.col(i).alias("id"), F.col(k).alias("key")) for i, k in (("ix", "x"), ("iy", "y"))]
    found = found.select(F.sort_array(F.array(*ends)).alias("e"), "likeness")
    return found.select(F.col("e")[0]["id"].alias("a"), F.col("e")[1]["id"].alias("b"), F.col("e")[0]["key"].alias("key_a"), F.col("e")[1]["key"].alias("key_b"), "likeness")


def op7_spotsigs(spark, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))
