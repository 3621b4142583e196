"""Near-duplicate groups by one-permutation MinHash.

A document's set holds its distinct 5-word shingles (A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`; fewer words count as
one shingle, no words as the empty set). One hash of each shingle is cut into BINS equal ranges; the minimum of each
range is a signature value, and empty ranges borrow from filled ones by optimal densification (each empty range walks
its own random sequence of ranges until it meets a filled one). ROWS values make a band; BANDS bands make buckets.

Equal sets fold into one class before anything is paired. In each bucket one class is the centre and the others get
one edge to it, so edges grow with rows, not with pairs. Edges are confirmed on the full sets. A centre may be unlike
members that are like each other, so in buckets that still hold more than one group, members outside the bucket's
largest group are compared with all members: in blocks of BLOCK, on sketches (the shingles whose hash is under a limit
set by the size of the set, at most about SAMPLE; smaller sets whole). Tasks give out edges only, never pairs: as many
sure ones as it takes to join the block's groups, and those that a sketch leaves open (from UNLIKE standard errors
below to SURE above). Both are confirmed on full sets; if a sure one fails, the comparison is done again with all edges given out. No
number of members, centres or edges is capped.

Defined results: null, empty and wordless texts have an empty set and stay alone; repeated rows fold into one class
and each gets its row; rows without id take part, but ids of groups are the smallest ids there are (null if none);
extra columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textbytes as tb
from sparkloom.llm.components import connected
from sparkloom.llm.frames import documents, prepare
from sparkloom.session import drop_written, written

WORDS = 5
LIKE_NUM, LIKE_DEN = 75, 100
ROWS, BANDS = 4, 32
#: Members of a bucket that a task compares with as many others; shingles of a sketch; standard errors of its estimate
#: above which a pair is taken for sure (and confirmed), and below which it is given up (about one in 10**9 alike pairs).
BLOCK, SAMPLE, SURE, UNLIKE = 1024, 512, 4.0, 6.0
BINS = ROWS * BANDS
SHIFT = np.uint64(64 - BINS.bit_length() + 1)

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

_walk = np.random.default_rng(74207281).integers(0, BINS, (BINS, 4096), dtype=np.int16)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    low = tb.LOWER[data]
    start, end = tb.word_spans(low, offsets, IS_WORD)
    words = tb.span_hash(tb.prefix_hash(low), start, end)
    bounds = np.searchsorted(start, offsets)
    grams = tb.ngrams(words, WORDS)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            out.append(tb.ngrams(words[a:b], b - a))
        else:
            out.append(np.zeros(0, tb.U64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, BINS) signature values of nonempty sets."""
    edges = np.arange(BINS, dtype=np.uint64) << SHIFT
    values, filled = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, edges)
        in_range = at < len(s)
        at = np.minimum(at, len(s) - 1)
        filled[i] = in_range & (s[at] >> SHIFT == np.arange(BINS, dtype=np.uint64))
        values[i] = s[at]
    row, col = np.nonzero(~filled)
    for step in range(_walk.shape[1]):
        if not len(row):
            break
        to = _walk[col, step]
        got = filled[row, to]
        values[row[got], col[got]] = values[row[got], to[got]]
        row, col = row[~got], col[~got]
    for r, c in zip(row, col, strict=True):  # the walk has no end in theory: take the next filled range
        values[r, c] = values[r, np.flatnonzero(filled[r])[0]]
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    out = np.full((len(values), BANDS), 0, np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = tb.mix(out * tb.U64(tb.BASE) + values[:, j::ROWS])
    return out


def set_name(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a = tb.mix(s + tb.U64(len(s)))
    b = tb.mix(s ^ tb.U64(0xD6E8FEB86659FD93))
    return int(np.bitwise_xor.reduce(a) ^ tb.U64(len(s))) if len(s) else 0, int(b.sum(dtype=np.uint64))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, h1, h2, n_shingles, bands) of each row; bands is null for empty sets."""

    def run(batches):
        for b in batches:
            data, offsets = tb.utf8(b.column(2))
            for i, j in tb.runs(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = np.array([len(s) for s in sets])
                names = np.array([set_name(s) for s in sets], np.uint64).reshape(-1, 2)
                keys = band_keys(signatures([s for s in sets if len(s)]))
                flat = pa.array(tb.signed(keys.reshape(-1)))
                ends = np.concatenate(([0], np.cumsum(size > 0) * BANDS)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(tb.signed(names[:, 0].copy())), pa.array(tb.signed(names[:, 1].copy())), pa.array(size), pa.ListArray.from_arrays(pa.array(ends), flat)],
                    names=["doc_id", "text_hash", "h1", "h2", "n_shingles", "bands"],
                )

    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, text_hash long, h1 long, h2 long, n_shingles long, bands array<long>")


def full_sets(texts: DataFrame) -> DataFrame:
    """(h1, h2, shingles, sketch) with the sorted 64-bit hashes of each row's set, and the least of them, as bytes."""

    def run(batches):
        for b in batches:
            data, offsets = tb.utf8(b.column(2))
            for i, j in tb.runs(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                least = [s[: np.searchsorted(s, limit(k))] if k else s for s, k in zip(sets, levels(np.array([len(s) for s in sets])), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *(pa.array([s.tobytes() for s in x], pa.binary()) for x in (sets, least))],
                    names=["h1", "h2", "shingles", "sketch"],
                )

    return texts.select("h1", "h2", "text").mapInArrow(run, "h1 long, h2 long, shingles binary, sketch binary")


def levels(sizes: np.ndarray) -> np.ndarray:
    """How often the hash range is halved until a set of that size has at most about SAMPLE hashes in it."""
    return np.ceil(np.log2(np.maximum(sizes, SAMPLE) / SAMPLE)).astype(np.int64)


def limit(level: int) -> np.uint64:
    return np.uint64((1 << (64 - int(level))) - 1)


def common(rows: np.ndarray, others: np.ndarray, owner: np.ndarray, column: np.ndarray) -> np.ndarray:
    """(rows, others) numbers of columns that both have; member owner[k] has column[k]."""
    out = np.zeros((len(rows), len(others)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    place = np.full((2, max(rows.max(), others.max(), owner.max(initial=0)) + 1), -1)
    place[0, rows], place[1, others] = np.arange(len(rows)), np.arange(len(others))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, z = np.searchsorted(column, (first, first + 2048))
        one, two = (np.zeros((n, 2048), np.float32) for n in out.shape)
        for side, p in ((one, place[0, owner[a:z]]), (two, place[1, owner[a:z]])):
            side[p[p >= 0], column[a:z][p >= 0] - first] = 1
        out += one @ two.T
    return out


def within_block(members: pa.Table, whole: bool) -> list[tuple[int, int, bool]]:
    """(row, row, sure) edges between rows of different groups, from sketches.

    Of the sure ones, only those that join groups not joined yet, unless `whole`.
    """
    size = members["size"].to_numpy()
    sketch = [np.frombuffer(x.as_buffer(), np.uint64) for x in members["sketch"]]
    _, group = np.unique(np.stack([members["g1"].to_numpy(), members["g2"].to_numpy()], 1), axis=0, return_inverse=True)
    group = group.reshape(-1)
    copy, minor = (np.array(members[c].to_pylist(), bool) for c in ("copy", "minor"))
    rows, others = np.flatnonzero(copy if copy.any() else minor), np.flatnonzero(~copy)
    flat = np.concatenate(sketch)
    owner = np.repeat(np.arange(len(size)), [len(x) for x in sketch])
    _, column, uses = np.unique(flat, return_inverse=True, return_counts=True)
    level = levels(size)
    root = list(range(len(size)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    found = []
    for k in np.unique(level):
        some, rest = rows[(level[rows] == k) | (level[rows] == k - 1)], others[(level[others] == k) | (level[others] == k - 1)]
        if not len(some) or not len(rest):
            continue
        low = flat <= limit(k)
        n = np.bincount(owner[low], minlength=len(size)).astype(np.float32)
        low &= (uses > 1)[column]
        _, at = np.unique(column[low], return_inverse=True)
        both = common(some, rest, owner[low], at)
        either = n[some][:, None] + n[rest][None, :] - both
        x, y = size[some][:, None], size[rest][None, :]
        open_ = (group[some][:, None] != group[rest][None, :]) & (np.maximum(level[some][:, None], level[rest][None, :]) == k)
        open_ &= np.minimum(x, y) * LIKE_DEN >= np.maximum(x, y) * LIKE_NUM
        like = LIKE_NUM / LIKE_DEN
        error = np.sqrt(like * (1 - like) * either) if k else 0
        sure = open_ & (LIKE_DEN * both >= LIKE_NUM * either) & (both >= like * either + SURE * error)
        p, q = np.nonzero(sure)
        one, two = group[some[p]], group[rest[q]]
        _, first = np.unique(np.minimum(one, two) * len(size) + np.maximum(one, two), return_index=True)
        for i in range(len(p)) if whole else first.tolist():
            a, b = top(int(one[i])), top(int(two[i]))
            if whole or a != b:
                root[a] = b
                found.append((int(some[p[i]]), int(rest[q[i]]), True))
        if k:
            p, q = np.nonzero(open_ & ~sure & (both >= like * either - UNLIKE * error))
            found += [(a, b, False) for a, b in zip(some[p].tolist(), rest[q].tolist(), strict=True)]
    return found


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * LIKE_DEN < max(len(a), len(b)) * LIKE_NUM:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LIKE_DEN * both >= LIKE_NUM * (len(a) + len(b) - both)


def confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (a1, a2, b1, b2) edges whose sets are alike."""

    def run(batches):
        for b in batches:
            left, right = b.column(4), b.column(5)
            keep = [linked(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)], names=["a1", "a2", "b1", "b2"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("shingles").alias("left"))
    two = sets.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("shingles").alias("right"))
    both = edges.join(one, ["a1", "a2"]).join(two, ["b1", "b2"]).select("a1", "a2", "b1", "b2", "left", "right")
    return both.mapInArrow(run, "a1 long, a2 long, b1 long, b2 long")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) for each row of `docs` (doc_id, text), and (g1, g2), its group's name."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = written(sketches(docs), "sketch")
    classes = sketch.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("low_id"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    members = classes.select("h1", "h2", "size", F.posexplode("bands").alias("band", "cell"))
    shared = members.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    crowd = written(members.join(shared, "cell"), "crowd")
    edges = written(_star(crowd), "edges")

    # Sets are worked out for classes that meet another one only.
    busy = crowd.select("h1", "h2").distinct().join(classes.select("h1", "h2", "row.*"), ["h1", "h2"]).withColumnRenamed("doc_id", "row_id").withColumnRenamed("text_hash", "row_hash")
    found = (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("row_hash")) & F.col("doc_id").eqNullSafe(F.col("row_id"))
    sets = written(full_sets(docs.join(busy, found)).dropDuplicates(["h1", "h2"]), "sets")

    links = written(confirmed(edges, sets), "links")
    groups = connected(links)
    spent = [crowd, edges, sets, links]
    for whole in (False, True):
        found = _further(crowd, groups, sets, whole).join(edges, ["a1", "a2", "b1", "b2"], "left_anti")
        found = written(found.groupBy("a1", "a2", "b1", "b2").agg(F.max("sure").alias("sure")), "found")
        sure = found.where("sure").drop("sure")
        new = written(confirmed(sure, sets), "links")
        links = links.unionByName(new)
        spent += [found, new, groups]
        groups = connected(links)
        open_ = _apart(found.where("not sure").drop("sure"), groups)
        more = written(confirmed(open_, sets), "links")
        spent.append(more)
        if not more.isEmpty():
            links = links.unionByName(more)
            spent.append(groups)
            groups = connected(links)
        if sure.join(new, ["a1", "a2", "b1", "b2"], "left_anti").isEmpty():
            break
    # the result reads sketch, classes and groups only
    for done in spent:
        drop_written(done)

    ids = classes.select("h1", "h2", "low_id").join(groups, ["h1", "h2"])
    named = ids.groupBy("g1", "g2").agg(F.min("low_id").alias("component")).join(ids.select("h1", "h2", "g1", "g2"), ["g1", "g2"])
    alone = classes.select("h1", "h2", "low_id")
    final = alone.join(named, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("g1", "h1").alias("g1"), F.coalesce("g2", "h2").alias("g2"), F.coalesce("component", "low_id").alias("component"))
    rows = sketch.select("doc_id", "text_hash", "h1", "h2", "n_shingles").join(final, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"), "g1", "g2")


def _apart(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges whose ends are not in one group yet."""
    for side in "ab":
        own = groups.select(F.col("h1").alias(f"{side}1"), F.col("h2").alias(f"{side}2"), F.struct("g1", "g2").alias(f"{side}_group"))
        edges = edges.join(own, [f"{side}1", f"{side}2"], "left")
    a, b = (F.coalesce(f"{x}_group", F.struct(F.col(f"{x}1").alias("g1"), F.col(f"{x}2").alias("g2"))) for x in "ab")
    return edges.where(a != b).select("a1", "a2", "b1", "b2")


def _star(cells: DataFrame) -> DataFrame:
    """Edges (a1, a2, b1, b2) from each cell's smallest member to those of like size."""
    lead = cells.groupBy("cell").agg(F.min(F.struct("h1", "h2", "size")).alias("c"))
    both = cells.join(lead, "cell").where((F.least("size", "c.size") * LIKE_DEN >= F.greatest("size", "c.size") * LIKE_NUM) & ((F.col("h1") != F.col("c.h1")) | (F.col("h2") != F.col("c.h2"))))
    return both.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("c.h1").alias("b1"), F.col("c.h2").alias("b2")).distinct()


def _further(cells: DataFrame, groups: DataFrame, sets: DataFrame, whole: bool) -> DataFrame:
    """Edges (a1, a2, b1, b2, sure) from within_block() over all cells of three or more members and two or more groups."""
    state = cells.join(groups, ["h1", "h2"], "left").withColumn("g1", F.coalesce("g1", "h1")).withColumn("g2", F.coalesce("g2", "h2"))
    counts = state.groupBy("cell", "g1", "g2").agg(F.count("*").alias("n"))
    # a cell of two has been seen by its centre
    torn = counts.groupBy("cell").agg(F.sum("n").alias("all"), F.max(F.struct("n", "g1", "g2")).alias("most")).where("all > 2 and all > most.n")
    torn = torn.select("cell", "most", F.ceil((F.col("all") - F.col("most.n")) / BLOCK).cast("int").alias("lefts"), F.ceil(F.col("all") / BLOCK).cast("int").alias("rights"))
    minor = (F.col("g1") != F.col("most.g1")) | (F.col("g2") != F.col("most.g2"))
    rows = state.join(torn, "cell").withColumn("minor", minor).join(sets.select("h1", "h2", "sketch"), ["h1", "h2"])

    def seats(i, j, copy: bool):
        return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(copy).alias("copy"))

    left, right = F.pmod("h2", F.col("lefts")), F.pmod("h2", F.col("rights"))
    as_other = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: seats(i, right, False))
    as_row = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: seats(left, j, True))
    dealt = F.when(F.col("minor") & (F.col("lefts") * F.col("rights") > 1), F.concat(as_other, as_row)).otherwise(as_other)
    blocks = rows.select("cell", F.explode(dealt).alias("seat"), "h1", "h2", "g1", "g2", "size", "minor", "sketch").select("cell", "seat.*", "h1", "h2", "g1", "g2", "size", "minor", "sketch")

    def run(block: pa.Table) -> pa.Table:
        found = within_block(block, whole)
        name = list(zip(block["h1"].to_pylist(), block["h2"].to_pylist(), strict=True))
        ends = [(*max(name[i], name[j]), *min(name[i], name[j]), sure) for i, j, sure in found]
        columns = list(zip(*ends, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, pa.bool_() if k == 4 else pa.int64()) for k, c in enumerate(columns)], names=["a1", "a2", "b1", "b2", "sure"])

    return blocks.groupBy("cell", "i", "j").applyInArrow(run, "a1 long, a2 long, b1 long, b2 long, sure boolean")


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")
