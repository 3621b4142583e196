"""Exact k-means whose clusters keep their vectors in heaps of bounds.

A vector's gap is the least distance to another centroid minus the distance to its own. While centroids move, the gap
shrinks by at most its own centroid's step plus the longest step of the others. Each cluster adds these up in its
drift, and files a vector under gap + drift at that time: the vector can change cluster only once the drift has reached
its key, so a round pops the keys up to the drift and leaves all others unread and unmoved. Popped vectors are measured
against all centroids, in integers, and filed anew.

A cluster's heap is held as sorted runs in the shared folder: each round's files are ordered by (cluster, key), so that
a pop is a range of keys per cluster that Parquet's statistics of row groups and pages narrow down. Whether a key of an
older run is still in the heap follows from the drift alone, since drift never falls; runs are therefore never written
again, until they hold twice the vectors and are merged into one. Gaps are rounded down and drifts up, so that rounding
can only pop too much. The driver holds centroids, drifts and counts; sums of moved vectors are added up in tasks first.

Defined results: a vector without `n` components, with a null, infinite or NaN component, or with one of 2**51 or more
in size (whose distances fit no long) is not kept; a null id is an id like any other and hashes as `3:`; rows that
repeat an id are vectors of their own, and stand in order of their components where their hashes decide; fewer vectors
than clusters give fewer centroids; an empty table gives an empty result; a distance or inertia that fits no long is
null; extra columns are passed over.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.frames import prepare
from sparkloom.session import drop_written, written

SCALE, LIMIT, SAFE = 1024, 2.0**51, 1 << 26
RUN = "vec_id long, point array<long>, cluster int, key double, old int"
LONG = (1 << 63) - 1


def kept(vectors: DataFrame, n: int, column: str = "embedding") -> DataFrame:
    """(vec_id, point) of the vectors with n finite components, in whole 1024ths rounded down."""
    x = F.col(column).cast("array<double>")
    fit = (F.size(x) == n) & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < LIMIT), F.lit(False)))
    return vectors.where(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * SCALE).cast("long")).alias("point"))


def points(column: pa.Array, n: int) -> np.ndarray:
    """Rows of n integers; as Python's own where squares could pass a long."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), n)
    return x if not x.size or max(-int(x.min()), int(x.max())) < SAFE else x.astype(object)


def squared(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distance of each row to each centroid."""
    wide = x.dtype == object or any(abs(v) >= SAFE for c in centroids for v in c)
    kind = object if wide else np.int64
    x = x.astype(kind)
    out = np.empty((len(x), len(centroids)), kind)
    for j, c in enumerate(centroids):
        step = x - np.array(c, kind)
        out[:, j] = (step * step).sum(axis=1)
    return out


def nearest(x: np.ndarray, centroids: list[list[int]], drift: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row (the smaller number where two are as near) and its key in that cluster's heap."""
    far = squared(x, centroids)
    best = far.argmin(axis=1)
    rows = np.arange(len(x))
    d = np.sqrt(far.astype(np.float64))
    own = d[rows, best].copy()
    d[rows, best] = np.inf
    other = d.min(axis=1)
    gone = np.array(drift)[best]
    slack = 1e-9 * (np.where(np.isinf(other), 0, other) + own + 1) + 1e-12 * gone
    return best.astype(np.int32), other - own + gone - slack


def scanned(rows: DataFrame, n: int, centroids: list[list[int]], drift: list[float]) -> DataFrame:
    """(vec_id, point, old) measured against all centroids, as rows of a run."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                cluster, key = nearest(points(b.column(1), n), centroids, drift)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster), pa.array(key), b.column(2)], names=["vec_id", "point", "cluster", "key", "old"])

    return rows.select("vec_id", "point", "old").mapInArrow(run, RUN)


def moves(run: DataFrame, n: int) -> dict[int, tuple[int, list[int]]]:
    """By cluster: how many vectors it won less those it lost in this run, and the sum of their points."""

    def add(batches):
        sums: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = points(b.column(0), n)
            for which, sign in ((b.column(1), 1), (b.column(2), -1)):
                cluster = which.to_numpy(zero_copy_only=False)
                for j in np.unique(cluster[cluster >= 0]).tolist():
                    at = cluster == j
                    have = sums.setdefault(int(j), [0] * (n + 1))
                    for i, v in enumerate([int(at.sum()), *map(int, x[at].sum(axis=0))]):
                        have[i] += sign * v
        found = [(j, i, str(v)) for j, s in sums.items() for i, v in enumerate(s)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["cluster", "i", "v"])

    moved = run.where("old is not null and old != cluster").select("point", "cluster", "old")
    rows = moved.mapInArrow(add, "cluster long, i long, v string").groupBy("cluster", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = {j: [0] * (n + 1) for j in {r.cluster for r in rows}}
    for r in rows:
        out[r.cluster][r.i] = int(r.v)
    return {j: (s[0], s[1:]) for j, s in out.items()}


@dataclass
class Heaps:
    """The sorted runs of all clusters' heaps, with the drift up to which each has been popped."""

    n: int
    total: int
    runs: list[tuple[DataFrame, int, bool]] = field(default_factory=list)  # rows, their number, and whether popped since
    scanned: list[int] = field(default_factory=list)

    def popped(self, before: list[float], now: list[float]) -> DataFrame:
        """Keys that the drift has reached since the last pop; of a new run, all up to the drift."""
        parts = []
        for run, _, seen in self.runs:
            due = [f"(cluster = {j} and key <= {b!r}D" + (f" and key > {a!r}D)" if seen else ")") for j, (a, b) in enumerate(zip(before, now, strict=True))]
            parts.append(run.where(" or ".join(due)))
        return union(parts)

    def live(self, now: list[float]) -> DataFrame:
        """What the heaps hold after a pop up to `now`."""
        left = " or ".join(f"(cluster = {j} and key > {b!r}D)" for j, b in enumerate(now))
        return union([run.where(left) if seen else run for run, _, seen in self.runs])

    def file(self, rows: DataFrame, now: list[float]) -> DataFrame:
        """Writes the rows measured in this round as a new run; merges all runs once they hold twice the vectors."""
        self.runs = [(run, size, True) for run, size, _ in self.runs]
        full = sum(size for _, size, _ in self.runs) > 2 * self.total
        if full:
            rows = rows.unionByName(self.live(now).withColumn("old", F.lit(None).cast("int")))
        run = written(rows.sortWithinPartitions("cluster", "key"), "heaps")
        fresh = run.where("old is not null").count()
        if full:
            self.drop()
        self.runs.append((run, self.total if full else fresh, False))
        self.scanned.append(fresh)
        return run

    def drop(self) -> None:
        for run, _, _ in self.runs:
            drop_written(run)
        self.runs = []


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drifted(drift: list[float], old: list[list[int]], new: list[list[int]]) -> list[float]:
    step = [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) * (1 + 1e-9) for x, y in zip(old, new, strict=True)]
    return [d + step[j] + max([s for i, s in enumerate(step) if i != j], default=0.0) for j, d in enumerate(drift)]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, n: int = 64, seed: int = 3, log: list[int] | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector after `rounds` rounds.

    log: gets the number of vectors measured against all centroids in each assignment.
    """
    spark = vectors.sparkSession
    prepare(spark)
    base = kept(vectors, n)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [list(r.point) for r in base.orderBy(name, "point").limit(k).select("point").collect()]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    heaps = Heaps(n, base.count())
    before = drift = [0.0] * len(centroids)
    size, sums = [0] * len(centroids), [[0] * n for _ in centroids]
    rows = base.withColumn("old", F.lit(-1))
    for r in range(rounds + 1):
        if r:
            rows = heaps.popped(before, drift).withColumn("old", F.col("cluster"))
        run = heaps.file(scanned(rows, n, centroids, drift), drift)
        if r == rounds:
            break
        for j, (more, added) in moves(run, n).items():
            size[j] += more
            sums[j] = [a + b for a, b in zip(sums[j], added, strict=True)]
        after = [[v // size[j] for v in sums[j]] if size[j] else c for j, c in enumerate(centroids)]
        before, drift, centroids = drift, drifted(drift, centroids, after), after
    if log is not None:
        log += heaps.scanned
    done = written(measured(heaps.live(drift), n, centroids), "clusters")
    heaps.drop()
    return with_inertia(done, centroids)


def measured(rows: DataFrame, n: int, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, exact): each vector's squared distance to its own centroid, whatever its size."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, own = points(b.column(1), n), b.column(2).to_numpy(zero_copy_only=False)
                far = np.empty(len(x), object)
                for j in np.unique(own).tolist():
                    at = np.flatnonzero(own == j)
                    far[at] = squared(x[at], [centroids[j]])[:, 0].astype(object)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([str(v) for v in far])], names=["vec_id", "cluster", "exact"])

    return rows.select("vec_id", "point", "cluster").mapInArrow(run, "vec_id long, cluster int, exact string").withColumn("exact", F.col("exact").cast("decimal(38,0)"))


def as_long(x) -> F.Column:
    return F.when(x <= LONG, x).cast("long")


def with_inertia(done: DataFrame, centroids: list[list[int]]) -> DataFrame:
    named = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    names = done.sparkSession.createDataFrame(named, "cluster int, centroid_sha256 string")
    per = done.groupBy("cluster").agg(F.sum("exact").alias("s"))
    whole = per.agg(F.sum("s").alias("t"))
    # one row for each centroid, and one for all
    facts = names.join(per, "cluster").crossJoin(whole).select("cluster", as_long(F.col("s")).alias("cluster_inertia"), as_long(F.col("t")).alias("inertia"), "centroid_sha256")
    return done.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", as_long(F.col("exact")).alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def op11_heap_kmeans(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def sql(k: int = 8, rounds: int = 10, n: int = 64, seed: int = 3) -> str:
    """The same by measuring every vector against every centroid in every round."""
    far = "list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings WHERE len(embedding) = {n} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {n})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), p) - 1 AS k, p FROM v ORDER BY 1 LIMIT {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT v.id, any_value(v.vec_id) AS vec_id, min({{'d': {far}, 'k': c.k}}) AS m FROM v, c{r} c GROUP BY v.id)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT a.m.k AS k, unnest(v.p) AS x, generate_subscripts(v.p, 1) AS i FROM a{r} a JOIN v ON v.id = a.id) GROUP BY k, i)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(w.p, c.p) AS p FROM c{r} c LEFT JOIN (SELECT k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS p FROM s{r} GROUP BY k) w ON w.k = c.k)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.m.k"""
