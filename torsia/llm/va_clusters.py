"""Nearest-centroid clustering of integer vectors through a file of approximations (VA-file).

Each dimension's range is cut into 2^BITS cells, of equal width between the outer
quantiles of a bounded sample; the first and last cell hold what lies beyond. A
vector is approximated by its cell in every dimension. For a set of centroids, two
lookup tables give for every dimension, cell and centroid the least and the greatest
squared difference that a component in that cell can have. Their sums over the
dimensions enclose the distance of the vector to each centroid. Where one interval
lies below all others, the centroid is decided by the cells alone. Only where
intervals overlap is the full vector fetched, by a join on the row number, and
compared exactly with the centroids that are left.

Cells and full vectors are two tables in buckets of the row number, so fetching
needs no shuffle. A centroid's new place needs the sum of its vectors: it is kept
from round to round, and only vectors whose centroid changed are added and taken
away; they are among those fetched, as a vector is decided under the old and the
new centroids in the same pass. No state per vector is kept between rounds, so a
lost executor repeats its own tasks only. The driver holds the centroids and
their sums, a number that doesn't grow with the vectors.

Defined results: vectors of another length and such with a null or non-finite
component are left out, as are null vectors; components are held within
2^27 in size, so that distances stay exact 64-bit numbers; of rows with one id
each is a vector of its own, and ties between start vectors with one hash go by
their components; with fewer vectors than centroids there are fewer centroids;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torsia.session import scratch_path

from .common import id_type, written

BITS = 7
#: Vectors from which the cells' range is drawn, share of them beyond it at either end, and bytes that a bucket of full vectors may hold.
SAMPLE, OUTER, BUCKET = 4096, 0.001, 64 << 20
LIMIT = 1 << 27


@dataclass(frozen=True)
class Cells:
    """Inner edges of the cells, and the least and greatest component, per dimension."""

    edges: np.ndarray  # (dims, cells - 1), ascending
    low: np.ndarray
    high: np.ndarray

    def approximate(self, v: np.ndarray) -> np.ndarray:
        """(vectors, dims) cell numbers; a cell begins at its left edge."""
        out = np.empty(v.shape, np.uint8)
        for d in range(v.shape[1]):
            out[:, d] = np.searchsorted(self.edges[d], v[:, d], side="right")
        return out

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared difference, by (dims, cells, centroids)."""
        left = np.concatenate([self.low[:, None], self.edges], 1)[:, :, None]
        right = np.concatenate([self.edges - 1, self.high[:, None]], 1)[:, :, None]
        c = centroids.T[:, None, :]
        near = np.maximum(0, np.maximum(left - c, c - right))
        far = np.maximum(np.abs(c - left), np.abs(right - c))
        return near * near, far * far


def intervals(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of every vector to every centroid."""
    near = np.zeros((len(cells), tables[0].shape[2]), np.int64)
    far = np.zeros_like(near)
    for d in range(cells.shape[1]):
        near += tables[0][d][cells[:, d]]
        far += tables[1][d][cells[:, d]]
    return near, far


def left_over(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(vectors, centroids): whether the centroid can be the nearest."""
    near, far = intervals(cells, tables)
    return near <= far.min(axis=1, keepdims=True)


def exact(v: np.ndarray, centroids: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid among those left, the smallest number of equals, and its distance."""
    row, c = np.nonzero(open_)
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    best = np.zeros(len(v), np.int64)
    least = np.zeros(len(v), np.int64)
    far = np.empty(len(row), np.int64)
    for at in range(0, len(row), 65536):
        gap = v[row[at : at + 65536]] - centroids[c[at : at + 65536]]
        far[at : at + 65536] = (gap * gap).sum(axis=1)
    if len(row):
        least[row[starts]] = np.minimum.reduceat(far, starts)
        hit = np.flatnonzero(far == np.repeat(least[row[starts]], np.diff(np.r_[starts, len(row)])))
        first = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
        best[row[first]] = c[first]
    return best, least


def stack(blobs, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(-1, dims).astype(np.int64 if kind == "<i4" else np.uint8)


def integers(vector: Column, dims: int) -> tuple[Column, Column]:
    """Whether a vector is kept, and its components as integers."""
    numbers = vector.cast("array<double>")
    inside = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(
        numbers, lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x, F.lit(-1e9)), F.lit(1e9)) * 256), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int")
    )
    return F.coalesce((F.size(numbers) == dims) & inside, F.lit(False)), whole


def packed(v: Column) -> Column:
    """Integers as little-endian bytes."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([np.asarray(x, "<i4").tobytes() for x in b], dtype=object)

    return F.pandas_udf(run, "binary")(v)


def start_vectors(kept: DataFrame, count: int, salt: str) -> np.ndarray:
    """The vectors with the least hash of their id, in the order of the hash."""
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(name.alias("h"), "v").orderBy("h", "v").limit(count).collect()
    return np.array([r["v"] for r in rows], np.int64)


def range_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest components of a task's vectors."""
    low = high = None
    for b in batches:
        if b.num_rows:
            v = np.stack(b.column("v").to_numpy(zero_copy_only=False))
            low = v.min(axis=0) if low is None else np.minimum(low, v.min(axis=0))
            high = v.max(axis=0) if high is None else np.maximum(high, v.max(axis=0))
    rows = [[] if x is None else [x.tolist()] for x in (low, high)]
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())) for x in rows], ["low", "high"])


def cells_of(kept: DataFrame, dims: int, bits: int) -> Cells:
    """Even cells from SAMPLE vectors, those with the least hash; the range over all vectors."""
    ends = (
        kept.mapInArrow(range_of, "low array<int>, high array<int>")
        .select(F.posexplode(F.arrays_zip("low", "high")).alias("d", "x"))
        .groupBy("d")
        .agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
        .orderBy("d")
        .collect()  # one row per dimension
    )
    rows = kept.select("v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE).collect()
    v = np.array([r["v"] for r in rows], np.int64)
    lo, hi = np.quantile(v, OUTER, axis=0)[:, None], np.quantile(v, 1 - OUTER, axis=0)[:, None]
    edges = np.floor(lo + (hi - lo) * np.arange(1, 1 << bits) / (1 << bits)).astype(np.int64)
    return Cells(edges, *(np.array([r[k] for r in ends], np.int64) for k in ("low", "high")))


def stored(kept: DataFrame, cells: Cells, dims: int) -> tuple[DataFrame, DataFrame]:
    """The file of cells and the file of full vectors, both in buckets of the row number."""
    spark = kept.sparkSession

    def cell_blobs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            got = cells.approximate(stack(b, dims, "<i4")) if len(b) else []
            yield pd.Series([x.tobytes() for x in got], dtype=object)

    base = written(
        kept.select(F.monotonically_increasing_id().alias("row"), "id", packed(F.col("v")).alias("v")), "vectors"
    )
    buckets = max(spark.sparkContext.defaultParallelism, -(-base.count() * (4 * dims + 16) // BUCKET))
    out = []
    for label, df in (("cells", base.select("row", F.pandas_udf(cell_blobs, "binary")("v").alias("cells"))), ("full", base)):
        name = f"va_{label}_{uuid4().hex}"
        (
            df.repartition(buckets, "row")
            .write.bucketBy(buckets, "row")
            .sortBy("row")
            .option("path", scratch_path(spark, name))
            .saveAsTable(name)
        )
        out.append(spark.table(name))
        spark.sql(f"DROP TABLE {name}")  # the name only; the files stay
    return out[0], out[1]


def undecided(cells: Column, sets: list[tuple[np.ndarray, np.ndarray]]) -> Column:
    """Null where every set of centroids leaves one, the same in all; else who is left, as bytes."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            if not len(b):
                yield pd.Series([], dtype=object)
                continue
            got = stack(b, sets[0][0].shape[0], "<u1")
            open_ = [left_over(got, s) for s in sets]
            first = open_[0].argmax(axis=1)
            same = np.ones(len(got), bool)
            for o in open_:
                same &= (o.sum(axis=1) == 1) & (o.argmax(axis=1) == first)
            bits = np.packbits(np.stack(open_, 1).reshape(len(got), -1), axis=1)
            yield pd.Series([None if s else x.tobytes() for s, x in zip(same, bits)], dtype=object)

    return F.pandas_udf(run, "binary")(cells)


def opened(blobs, sets: int, count: int) -> np.ndarray:
    """(vectors, sets, centroids) of ``undecided``."""
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
    return np.unpackbits(raw, axis=1, count=sets * count).reshape(len(blobs), sets, count).astype(bool)


def added(rows: list, count: int, dims: int) -> tuple[list[int], list[list[int]]]:
    """Vectors and exact sums per cluster from (cluster, place, sum); place 0 holds the count."""
    sums = [[0] * (dims + 1) for _ in range(count)]
    for r in rows:
        sums[r["cluster"]][r["d"]] = int(r["x"])
    return [x[0] for x in sums], [x[1:] for x in sums]


def partial_sums(frame: DataFrame, part, count: int, dims: int) -> list:
    """(cluster, place, sum) over all rows; ``part`` gives a batch's changes as (count,), (count, dims)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((count, dims + 1), np.int64)
        for b in batches:
            if b.num_rows:
                many, own = part(b)
                sums[:, 0] += many
                sums[:, 1:] += own
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"]
        )

    # One row per task and cluster; places are summed before the shuffle.
    parts = frame.mapInArrow(run, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("d", "x"))
    return parts.groupBy("cluster", "d").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # bounded by both


def count_into(cluster: np.ndarray, v: np.ndarray, count: int, sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros((count, v.shape[1]), np.int64)
    np.add.at(sums, cluster, v)
    return sign * np.bincount(cluster, minlength=count), sign * sums


def clusters(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = 64,
    count: int = 40,
    rounds: int = 5,
    salt: str = "2:",
    bits: int = BITS,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per kept vector."""
    keep, whole = integers(F.col(vector_col), dims)
    kept = vectors.filter(keep).select(F.col(id_col).alias("id"), whole.alias("v"))
    kept = written(kept, "kept")
    centroids = start_vectors(kept, count, salt)
    count = len(centroids)
    schema = f"id {id_type(vectors, id_col)}, cluster int, distance long"
    if not count:
        return told(kept.sparkSession.createDataFrame([], schema), centroids)
    cells = cells_of(kept, dims, bits)
    approx, full = stored(kept, cells, dims)

    def first_round(b: pa.RecordBatch, c=centroids) -> tuple[np.ndarray, np.ndarray]:
        v = stack(b.column("v").to_pylist(), dims, "<i4")
        open_ = left_over(stack(b.column("cells").to_pylist(), dims, "<u1"), cells.tables(c))
        return count_into(exact(v, c, open_)[0], v, count)

    old = centroids
    for k in range(rounds):
        if k == 0:
            found = approx.join(full, "row").select("cells", "v")
            many, sums = added(partial_sums(found, first_round, count, dims), count, dims)
        else:
            sets = [old, centroids]
            tables = [cells.tables(c) for c in sets]

            def moves(b: pa.RecordBatch, sets=sets) -> tuple[np.ndarray, np.ndarray]:
                v = stack(b.column("v").to_pylist(), dims, "<i4")
                open_ = opened(b.column("open").to_pylist(), 2, count)
                was, now = (exact(v, c, open_[:, i])[0] for i, c in enumerate(sets))
                moved = was != now
                gone, came = count_into(was[moved], v[moved], count, -1), count_into(now[moved], v[moved], count)
                return gone[0] + came[0], gone[1] + came[1]

            asked = approx.select("row", undecided(F.col("cells"), tables).alias("open")).filter("open IS NOT NULL")
            found = asked.join(full, "row").select("open", "v")
            change = added(partial_sums(found, moves, count, dims), count, dims)
            many = [x + y for x, y in zip(many, change[0])]
            sums = [[x + y for x, y in zip(a, b)] for a, b in zip(sums, change[1])]
        old = centroids
        centroids = np.array(
            [[s // n for s in row] if n else c.tolist() for n, row, c in zip(many, sums, centroids)], np.int64
        ).reshape(count, dims)

    def last(batches: Iterator[pa.RecordBatch], c=centroids) -> Iterator[pa.RecordBatch]:
        tables = cells.tables(c)
        for b in batches:
            v = stack(b.column("v").to_pylist(), dims, "<i4")
            near, far = exact(v, c, left_over(stack(b.column("cells").to_pylist(), dims, "<u1"), tables))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(near.astype(np.int32)), pa.array(far)], ["id", "cluster", "distance"]
            )

    # Every distance is asked for, so every vector is fetched once more, for the centroids its cells leave.
    rows = approx.join(full, "row").select("id", "cells", "v").mapInArrow(last, schema)
    return told(written(rows, "clusters"), centroids)


def told(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with sums of distances and the centroids' hashes."""
    spark = rows.sparkSession
    names = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    hashes = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    sums = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    # One row per centroid, and one row.
    facts = sums.join(F.broadcast(hashes), "cluster").crossJoin(F.broadcast(total))
    return rows.join(F.broadcast(facts), "cluster").select(
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
