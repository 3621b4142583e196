"""Trie of the turns that conversations begin with, grouped exactly where prefixes may be shared.

Each conversation opens with the first turns of its base (conv_id - conv_id % 20), as many as crc32(conv_id) % 4, and
goes on with its own turns after as many. A prefix is known by a digest of its turns, each hashed with its depth, so
that digests of a long conversation add up over blocks of turns. A count-min sketch over all digests is sent to every
task: its estimates never fall below the true count, so an estimate of one proves that no other conversation has the
prefix, nor any longer one of the same conversation. Rows below such a prefix are finished where they stand; the rest,
down to the first proven singleton of each conversation, is shuffled and grouped exactly.

Sums over a node's subtree are sums over its members: each node belongs to its smallest member, each conversation adds
up what belongs to it from its end towards the root, and a node takes the sum over its members at its depth.

Nothing gathers a conversation, a node or a list of members: places and digests come from sums over blocks of BLOCK
turns first; members that end at a node are sorted, joined in pieces and hashed piece by piece. The sketch has at most
MOST_CELLS bytes; once there are more prefixes than about a quarter of that, fewer singletons are proven and more rows
are grouped exactly, with the same result.

Defined results: null roles and texts are empty; turns without number come first; turns that share their number stand
in order of role and of the SHA-256 of their text; repeated rows are turns of their own; rows without conversation
belong to none and are passed over; an empty table gives an empty result, without root; extra columns are passed over.
The sign of conv_id % 20 is that of conv_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.frames import prepare, width
from sparkloom.session import drop_written, written

BASE, HEADS, BLOCK = 20, 4, 256
#: Cells of the sketch: a power of two, at least four for each prefix while they are fewer than this.
LEAST_CELLS, MOST_CELLS, HASHES, SLICE = 1 << 12, 1 << 26, 3, 1 << 16
PIECE = 4096
NODE = ["depth", "a", "b"]
PREFIX = "conv_id long, depth long, total long, words long, a long, b long, pa long, pb long"
EMPTY = hashlib.sha256(b"").hexdigest()


def tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def narrow(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text_key, words): a text is its SHA-256 from here on."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    return rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("text_key"), tokens(F.col("text")).alias("words"))


def numbered(rows: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """(conv_id, at, role, text_key, words): `at` counts a conversation's turns from 1.

    Rows are range-partitioned by their whole order, so that a long conversation is spread over tasks; a count for each
    conversation and task then gives the place of its first row in each task. spent: gets the frame whose files the
    result reads.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_key")]
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(width(spark), *order).sortWithinPartitions(*order)

    def count(batches):
        # a row's place in its conversation within this task; the sort above keeps a conversation together
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(0).to_numpy(zero_copy_only=False)
            first = np.concatenate(([0], np.flatnonzero(conv[1:] != conv[:-1]) + 1))
            start = np.repeat(first, np.diff(np.append(first, len(conv))))
            n = np.arange(len(conv)) - start + 1
            if last is not None and conv[0] == last:
                n[start == 0] += seen
            last, seen = conv[-1], int(n[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], names=["conv_id", "role", "text_key", "words", "task", "n"])

    slim = ranged.select("conv_id", "role", "text_key", "words", F.spark_partition_id().alias("task"))
    local = written(slim.mapInArrow(count, "conv_id long, role string, text_key string, words long, task int, n long"), "turns")
    spent.append(local)
    sizes = local.groupBy("task", "conv_id").agg(F.max("n").alias("size"))
    before = F.sum("size").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    # at most one conversation goes on from one task to the next: a row for each task at most
    later = sizes.select("task", "conv_id", before.alias("before")).where("before is not null")
    return local.join(F.broadcast(later), ["task", "conv_id"], "left").select("conv_id", (F.col("n") + F.coalesce("before", F.lit(0))).alias("at"), "role", "text_key", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, total), and their turns (conv_id, depth, total, role, text_key, words)."""
    sizes = turns.groupBy("conv_id").agg(F.max("at").alias("own"))
    head = F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = sizes.select("conv_id", "own", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"))
    bases = sizes.where(f"conv_id % {BASE} = 0").select(F.col("conv_id").alias("base"), F.col("own").alias("has"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("total")), "convs")
    opening = turns.where(f"conv_id % {BASE} = 0 and at < {HEADS}").withColumnRenamed("conv_id", "base")
    opening = opening.join(convs.select("conv_id", "base", "taken", "total"), "base").where("at <= taken").select("conv_id", F.col("at").alias("depth"), "total", "role", "text_key", "words")
    own = turns.join(convs.select("conv_id", "h", "taken", "total"), "conv_id").where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "total", "role", "text_key", "words")
    return convs.select("conv_id", "total"), opening.unionByName(own)


def running(rows: DataFrame, combine, columns: list[str], down: bool, spent: list[DataFrame]) -> DataFrame:
    """Each of `columns` combined over a conversation's rows up to this depth (down: from this depth on).

    Over the turns of a block first, then, for conversations of several blocks, over blocks; results end in `_run`. spent: gets the frame whose files the
    result reads.
    """
    blocked = rows.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK)).repartition("conv_id", "block")
    order = (lambda c: F.col(c).desc()) if down else F.col
    inner = Window.partitionBy("conv_id", "block").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("conv_id").orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    inside = written(blocked.withColumns({f"{c}_run": combine(c).over(inner) for c in columns}), "blocks")
    spent.append(inside)
    long = inside.where(F.col("total") > BLOCK)
    whole = F.min_by if down else F.max_by
    per = long.groupBy("conv_id", "block").agg(*[whole(f"{c}_run", "depth").alias(c) for c in columns])
    before = per.select("conv_id", "block", *[F.coalesce(combine(c).over(outer), F.lit(0)).alias(f"{c}_before") for c in columns])
    both = (lambda a, b: a.bitwiseXOR(b)) if combine is F.bit_xor else (lambda a, b: a + b)
    long = long.join(before, ["conv_id", "block"]).withColumns({f"{c}_run": both(F.col(f"{c}_run"), F.col(f"{c}_before")) for c in columns})
    return inside.where(F.col("total") <= BLOCK).unionByName(long.select(*inside.columns)).drop("block")


def prefixes(turns: DataFrame, spent: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, total, words, a, b, pa, pb): each rebuilt turn with its prefix's digest and its parent's."""
    x = turns.select("conv_id", "depth", "total", "words", F.xxhash64("depth", "role", "text_key").alias("x"), F.xxhash64("text_key", "role", "depth").alias("y"))
    x = running(x, F.bit_xor, ["x", "y"], False, spent)
    return x.select("conv_id", "depth", "total", "words", F.col("x_run").alias("a"), F.col("y_run").alias("b"), F.col("x_run").bitwiseXOR(F.col("x")).alias("pa"), F.col("y_run").bitwiseXOR(F.col("y")).alias("pb"))


def cells_of(depth: np.ndarray, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """HASHES cells for each digest, each in a part of the sketch of its own."""
    part = np.uint64(size // HASHES)
    a, b = a.view(np.uint64) + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), b.view(np.uint64)
    return np.stack([((a + np.uint64(i) * (b | np.uint64(1))) >> np.uint64(11)) % part + np.uint64(i) * part for i in range(HASHES)]).astype(np.int64)


def sketch(found: DataFrame, size: int) -> bytes:
    """Count-min sketch of all prefixes; a cell says 0, 1 or 2 for more. Tasks' sketches are added up by slices."""

    def count(batches):
        table = np.zeros(size, np.uint8)
        for d in batches:
            if d.num_rows:
                at, n = np.unique(cells_of(*(c.to_numpy(zero_copy_only=False) for c in d.columns), size), return_counts=True)
                table[at] = np.minimum(2, table[at] + np.minimum(n, 2))
        for i in range(0, size, SLICE):
            if (part := table[i : i + SLICE]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()])], names=["i", "part"])

    def merge(batches):
        at, table = None, None
        for d in batches:
            for i, part in zip(d.column(0).to_pylist(), d.column(1).to_pylist(), strict=True):
                if at is not None and at != i:
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([table.tobytes()])], names=["i", "part"])
                    at = None
                more = np.frombuffer(part, np.uint8)
                at, table = i, more.copy() if at is None else np.minimum(2, table + more)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([table.tobytes()])], names=["i", "part"])

    parts = found.select("depth", "a", "b").mapInArrow(count, "i long, part binary")
    slices = parts.repartition("i").sortWithinPartitions("i").mapInArrow(merge, "i long, part binary").collect()
    table = bytearray(size)
    for r in slices:
        table[r.i : r.i + len(r.part)] = r.part
    return bytes(table)


def screened(found: DataFrame, size: int) -> DataFrame:
    """The prefixes with `single` (the estimate is one) and `below` (the parent's estimate is one; the root's never)."""
    spark = found.sparkSession
    sent = spark.sparkContext.broadcast(sketch(found, size))
    names = found.columns

    def look(batches):
        table = np.frombuffer(sent.value, np.uint8)
        for d in batches:
            if not d.num_rows:
                continue
            c = {n: d.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
            single = table[cells_of(c["depth"], c["a"], c["b"], size)].min(axis=0) == 1
            below = (table[cells_of(c["depth"] - 1, c["pa"], c["pb"], size)].min(axis=0) == 1) & (c["depth"] > 1)
            yield pa.RecordBatch.from_arrays([*d.columns, pa.array(single), pa.array(below)], names=[*names, "single", "below"])

    return found.mapInArrow(look, f"{PREFIX}, single boolean, below boolean")


def ends_hash(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the conversations (depth, a, b, conv_id) that end at each node, in order of id."""
    spark = ends.sparkSession
    ranged = ends.select(*NODE, "conv_id").repartitionByRange(width(spark), *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")

    def join(batches):
        # runs of ids of one node, as pieces of text; a piece ends with its task or after PIECE ids
        for b in batches:
            depth, x, y, conv = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(conv):
                continue
            new = (depth[1:] != depth[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            first = np.unique(np.concatenate(([0], np.flatnonzero(new) + 1, np.arange(0, len(conv), PIECE))))
            text = [",".join(map(str, part.tolist())) for part in np.split(conv, first[1:])]
            yield pa.RecordBatch.from_arrays([*(pa.array(v[first]) for v in (depth, x, y, conv)), pa.array(text)], names=[*NODE, "least", "piece"])

    pieces = ranged.mapInArrow(join, "depth long, a long, b long, least long, piece string")

    def digest(batches):
        at, state = None, None
        for b in batches:
            out = []
            for depth, x, y, piece in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3)), strict=True):
                if at != (depth, x, y):
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (depth, x, y), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], names=[*NODE, "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, state.hexdigest())], names=[*NODE, "ends_sha256"])

    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "least").select(*NODE, "piece").mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def trie(turns: DataFrame, most_cells: int = MOST_CELLS, log: dict | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    log: gets the number of prefixes, and of those that were grouped exactly.
    """
    prepare(turns.sparkSession)
    spent: list[DataFrame] = []
    convs, turns = rebuilt(numbered(narrow(turns), spent))
    found = written(prefixes(turns, spent), "prefixes")
    n = found.count()
    size = min(most_cells, max(LEAST_CELLS, 1 << (4 * n).bit_length()))
    rows = written(screened(found, size), "screened")
    for done in (found, *spent):
        drop_written(done)
    spent.clear()

    # each conversation's first proven singleton; all below it is finished
    open_ = rows.where("not below")
    proven = open_.where("single").groupBy("conv_id").agg(F.min("depth").alias("proven"))
    open_ = open_.join(proven, "conv_id", "left").drop("single", "below")
    tail = F.coalesce(F.col("depth") > F.col("proven"), F.lit(False))
    marked = written(open_.withColumn("tail", tail).withColumn("last", F.coalesce(F.col("depth") == F.col("proven"), F.lit(False)) | (F.col("depth") == F.col("total"))), "open")
    shared = marked.where("not tail").drop("tail")
    tails = rows.where("below").select("conv_id", "depth", "total").unionByName(marked.where("tail").select("conv_id", "depth", "total"))
    ended = F.col("depth") == F.col("total")
    alone = F.sha2(F.col("conv_id").cast("string"), 256)
    one = F.lit(1).cast("long")
    tails = tails.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(ended, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(ended, alone).otherwise(F.lit(EMPTY)).alias("ends_sha256"))

    # exact nodes of the possibly shared prefixes
    nodes = shared.groupBy(*NODE).agg(
        F.min("conv_id").alias("least"), F.count("*").alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("words").alias("node_words"),
        F.sum(F.when(ended, 1).otherwise(0)).alias("n_ends"), F.min(F.when(ended, F.col("conv_id"))).alias("first_end"), F.max("total").alias("longest"),
    )
    nodes = written(nodes, "nodes")
    spent.append(nodes)
    if log is not None:
        log |= {"prefixes": n, "grouped": shared.count(), "nodes": nodes.count()}
    children = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("below"))
    # a node of one conversation has its child, if any, among the tails or here; one of several has all of them here
    lone = F.when(F.col("longest") > F.col("depth"), 1).otherwise(0)
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.when(F.col("n_convs") == 1, lone).otherwise(F.coalesce("below", F.lit(0))).cast("long")).drop("below", "longest")
    nodes = written(nodes, "nodes")

    own = F.col("conv_id") == F.col("least")
    member = shared.join(nodes.select(*NODE, "least", "n_convs", "node_words", "n_children"), NODE)
    leaf = F.col("last") & own & ((F.col("depth") < F.col("total")) | (F.col("n_children") == 0))
    weights = member.select("conv_id", "total", *NODE, F.when(own, (F.col("n_convs") - 1) * F.col("node_words")).otherwise(F.lit(0)).alias("saved"), F.when(leaf, 1).otherwise(0).cast("long").alias("leaves"))
    sums = written(running(weights, lambda c: F.sum(c), ["saved", "leaves"], True, spent), "sums")
    # the result reads convs, screened, open, nodes, sums and ends only
    for done in spent:
        drop_written(done)
    total = sums.groupBy(*NODE).agg(F.sum("saved_run").alias("saved_tokens"), F.sum("leaves_run").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("least").alias("parent"))

    ends = shared.where(ended).select(*NODE, "conv_id").join(nodes.where("n_ends > 1").select(*NODE), NODE, "left_semi")
    at_root = convs.where("total = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv_id")
    hashes = written(ends_hash(ends.unionByName(at_root)), "ends")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    first = sums.where("depth = 1").agg(F.coalesce(F.sum("saved_run"), F.lit(0)).alias("saved_tokens"), F.sum("leaves_run").alias("n_leaves"))
    tops = nodes.where("depth = 1").agg(F.count("*").alias("n_children"))
    # rows of one: the root's
    root = root.crossJoin(first).crossJoin(tops).join(hashes.where("depth = 0").select("ends_sha256"), F.lit(True), "left")
    root = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))

    top = convs.agg(F.min("conv_id").alias("top"))
    one_end = F.when(F.col("n_ends") == 0, F.lit(EMPTY)).when(F.col("n_ends") == 1, F.sha2(F.col("first_end").cast("string"), 256)).otherwise(F.col("ends_sha256"))
    exact = nodes.join(total, NODE).join(hashes.where("depth > 0"), NODE, "left").join(parents, ["depth", "pa", "pb"], "left").crossJoin(F.broadcast(top))
    exact = exact.select(F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") == 1, F.col("top")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", one_end.alias("ends_sha256"))
    return root.unionByName(exact).unionByName(tails)


SQL = r"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, place, {'key': sha256(length(role) || ':' || role || text), 'words': len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> ''))} AS turn FROM o),
s AS (SELECT conv_id, max(place) AS own FROM o GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS h FROM s, t),
c AS (SELECT h.conv_id, h.h, h.own, least(h.h, coalesce(b.own, 0)) AS taken, h.conv_id - h.conv_id % 20 AS base FROM h LEFT JOIN s b ON b.conv_id = h.conv_id - h.conv_id % 20),
r AS (SELECT c.conv_id, place AS d, turn FROM c JOIN k ON k.conv_id = base AND place <= taken UNION ALL SELECT c.conv_id, place - h + taken, turn FROM c JOIN k ON k.conv_id = c.conv_id AND place > h),
l AS (SELECT c.conv_id, coalesce(list(turn ORDER BY d) FILTER (turn IS NOT NULL), []) AS turns FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
m AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM l),
n AS MATERIALIZED (SELECT depth, turns[1:depth] AS key, CASE WHEN depth > 0 THEN turns[1:depth - 1] END AS up, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth), '') AS ends FROM m GROUP BY ALL),
b AS (SELECT up AS key, count(*) AS n FROM n WHERE depth > 0 GROUP BY up),
w AS MATERIALIZED (SELECT n.*, coalesce(b.n, 0) AS n_children FROM n LEFT JOIN b ON b.key = n.key),
u AS (SELECT v.key, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(CASE WHEN x.depth > 0 THEN (x.n_convs - 1) * x.key[x.depth].words ELSE 0 END) AS saved FROM w v JOIN w x ON x.depth >= v.depth AND x.key[1:v.depth] = v.key GROUP BY v.key)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, w.n_convs, CAST(w.n_children AS BIGINT) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN u ON u.key = w.key LEFT JOIN w p ON p.key = w.up
"""


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
