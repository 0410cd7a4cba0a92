"""Centroid clustering of integer vectors, with N-simplex bounds in front of the exact distances.

A few pivots span a simplex. From its distances to them a vector gets apex coordinates in as many dimensions
as there are pivots (Connor et al., "High-dimensional simplexes for supermetric search", 2017): the
distance between two apexes is never more than that of the vectors, and with the last coordinate mirrored
never less. Distances to pivots are taken once, and the apex is stored beside the vector for all rounds. A
round projects the centroids, compares the one with the smallest lower bound, drops every centroid whose lower
bound lies above that distance or above the smallest upper bound, and compares the rest exactly, in integers.
The bounds are widened by the rounding of floating point, so the filter never decides a result; it only saves
exact comparisons.

Rows are read once and stored in the shared folder; each round is a pass over them that hands over one row
per batch and cluster. Only centroids (k x dimensions) are on the driver.

Defined results: vectors with another number of components, or with a null, NaN or infinite one, are left out; a
component beyond +-524288 counts as that (squared distances would not fit a long); rows with equal id stay, ordered
by vector where start centroids tie; a null id hashes as an empty one; with fewer than k vectors every one starts a
centroid; equal centroids keep the smaller number, the other stays as it is; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.text import small_batches
from logloom.session import run_folder

DIMS, SCALE = 64, 256
LIMIT = 1 << 27
PIVOTS = 32
# relative widening of the bounds; apex coordinates are sums of a few rounded products
SLACK = 1e-6


@dataclass(frozen=True)
class Simplex:
    """Pivots in integers and their own apex coordinates (a lower triangle, one row per pivot)."""

    pivots: np.ndarray
    base: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.base)


def simplex_of(points: np.ndarray, most: int = PIVOTS) -> Simplex:
    """A simplex over the first points that are affinely independent, `most` at most."""
    chosen: list[np.ndarray] = []
    base = np.zeros((0, 0))
    for point in points:
        if len(chosen) == most:
            break
        grown = np.zeros((len(chosen) + 1, len(chosen) + 1))
        if chosen:
            own = _apexes(np.sqrt(squares(point[None, :], np.array(chosen)).astype(float)), base)[0]
            size = np.sqrt(float(((point - chosen[0]) ** 2).sum()))
            # a point inside the span of the others has no height of its own
            if own[-1] <= 1e-6 * max(size, 1.0):
                continue
            grown[:-1, :-1] = base
            grown[-1, :-1] = own
        chosen.append(point)
        base = grown
    return Simplex(np.array(chosen, dtype=np.int64).reshape(len(chosen), -1), base)


def squares(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all points, as integers."""
    out = np.empty((len(rows), len(points)), dtype=np.int64)
    for n, point in enumerate(points):
        gap = rows - point
        out[:, n] = np.einsum("ij,ij->i", gap, gap)
    return out


def _apexes(distances: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Apex coordinates over a simplex of n pivots (n coordinates) from the distances to the pivots.

    Pivot j lies at `base[j]`, zero from coordinate j on; the difference of two spheres' equations gives one
    coordinate after the other, and what is left of the first distance is the height.
    """
    rows, n = distances.shape
    out = np.zeros((rows, n))
    square = distances ** 2
    for j in range(1, n):
        corner = base[j]
        inner = out[:, : j - 1] @ corner[: j - 1]
        out[:, j - 1] = (square[:, 0] - square[:, j] + corner @ corner - 2 * inner) / (2 * corner[j - 1])
    out[:, n - 1] = np.sqrt(np.maximum(square[:, 0] - (out[:, : n - 1] ** 2).sum(axis=1), 0.0))
    return out


def apexes(simplex: Simplex, rows: np.ndarray) -> np.ndarray:
    return _apexes(np.sqrt(squares(rows, simplex.pivots).astype(float)), simplex.base)


def bounds(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances between all apexes of both sets."""
    flat, top = one[:, :-1], two[:, :-1]
    level = ((flat[:, None, :] - top[None, :, :]) ** 2).sum(axis=2)
    high, low = one[:, -1][:, None], two[:, -1][None, :]
    return level + (high - low) ** 2, level + (high + low) ** 2


def nearest(rows: np.ndarray, tops: np.ndarray, centroids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of every row (ties: the smaller number), its exact squared distance, and the number
    of exact comparisons."""
    low, high = bounds(tops, places)
    # both sides of a bound carry rounding errors in proportion to the coordinates' squares
    slack = SLACK * ((tops ** 2).sum(axis=1)[:, None] + (places ** 2).sum(axis=1)[None, :] + 1.0)
    # the centroid with the smallest lower bound is compared first and lowers the bar
    likely = low.argmin(axis=1)
    gap = rows - centroids[likely]
    first = np.einsum("ij,ij->i", gap, gap)
    keep = low - slack <= np.minimum(first, (high + slack).min(axis=1))[:, None]
    keep[np.arange(len(rows)), likely] = False
    at, number = np.nonzero(keep)
    gap = rows[at] - centroids[number]
    exact = np.full(keep.shape, np.iinfo(np.int64).max)
    exact[np.arange(len(rows)), likely] = first
    exact[at, number] = np.einsum("ij,ij->i", gap, gap)
    best = exact.argmin(axis=1)
    return best.astype(np.int32), exact[np.arange(len(rows)), best], len(rows) + len(at)


def integers(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows of an Arrow list column, and their components as scaled integers."""
    lists = batch.column(column)
    fits = np.asarray(lists.value_lengths().fill_null(-1)) == DIMS
    chosen = lists.filter(pa.array(fits))
    flat = chosen.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, DIMS)
    good = np.isfinite(values).all(axis=1)
    if flat.null_count:
        good &= flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, DIMS).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(np.clip(values[good] * SCALE, -LIMIT, LIMIT)).astype(np.int64)
    return np.flatnonzero(fits)[good], scaled


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def scaled_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Usable vectors as (id, vector): 64 integers of four bytes."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = integers(batch, "vector")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), _binary(values.astype(np.int32))], names=["id", "vector"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")).mapInArrow(
        scale, "id bigint, vector binary")


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hash of `seed:id`, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(k).collect()
    return np.array([np.frombuffer(r["vector"], dtype=np.int32) for r in rows], dtype=np.int64).reshape(-1, DIMS)


def with_apexes(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """Vectors with their apex coordinates."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("vector"), np.int32, DIMS).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _binary(apexes(simplex, rows))], names=[*batch.schema.names, "apex"])

    return vectors.mapInArrow(project, "id bigint, vector binary, apex binary")


def assigned(stored: DataFrame, simplex: Simplex, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance (squared) of every stored vector."""
    places = apexes(simplex, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("vector"), np.int32, DIMS).astype(np.int64)
            best, distance, _ = nearest(rows, _matrix(batch.column("apex"), np.float64, simplex.dims), centroids, places)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    return stored.mapInArrow(assign, "id bigint, cluster int, distance bigint")


def moved(stored: DataFrame, simplex: Simplex, centroids: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Centroids after one round; vectors seen, and exact comparisons made.

    Each batch hands over a row of sums per cluster; sums are added as decimals, so none overflows.
    """
    places = apexes(simplex, centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("vector"), np.int32, DIMS).astype(np.int64)
            best, _, made = nearest(rows, _matrix(batch.column("apex"), np.float64, simplex.dims), centroids, places)
            found = np.unique(best)
            parts = [rows[best == c] for c in found]
            yield pa.RecordBatch.from_arrays([
                pa.array(found, pa.int32()), pa.array([len(p) for p in parts], pa.int64()),
                pa.array([p.sum(axis=0).tolist() for p in parts], pa.list_(pa.int64())),
                pa.array([made if n == 0 else 0 for n in range(len(parts))], pa.int64())], names=["cluster", "n", "total", "made"])

    rows = stored.mapInArrow(sums, "cluster int, n bigint, total array<bigint>, made bigint")
    whole = rows.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("made").alias("made"),
        F.array(*[F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(DIMS)]).alias("total")).collect()
    out = centroids.copy()
    for r in whole:
        out[r["cluster"]] = [int(t) // r["n"] for t in r["total"]]
    return out, sum(r["n"] for r in whole), sum(r["made"] for r in whole)


@dataclass(frozen=True)
class Clusters:
    """`rows`: id, cluster, distance. `compared`: exact comparisons per vector and round, of k possible ones."""

    rows: DataFrame
    centroids: np.ndarray
    compared: list[float]


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5,
            seed: str = "2", pivots: int = PIVOTS) -> Clusters:
    """`rounds` rounds of assignment and integer means, then a last assignment."""
    spark = df.sparkSession
    small_batches(spark)
    folder = run_folder(spark)
    vectors = scaled_vectors(df, id_col, vector_col)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return Clusters(spark.createDataFrame([], "id bigint, cluster int, distance bigint"), centroids, [])
    simplex = simplex_of(centroids, pivots)
    with_apexes(vectors, simplex).write.parquet(f"{folder}/vectors")
    stored = spark.read.parquet(f"{folder}/vectors")
    compared = []
    for _ in range(rounds):
        centroids, seen, made = moved(stored, simplex, centroids)
        compared.append(made / seen)
    return Clusters(assigned(stored, simplex, centroids), centroids, compared)


def summary(found: Clusters) -> DataFrame:
    """Every vector with its cluster's and the whole inertia, and a digest of its centroid."""
    spark = found.rows.sparkSession
    marks = [(n, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for n, c in enumerate(found.centroids.tolist())]
    per = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("cluster_inertia"))
    # one row per centroid on this side, so the join may broadcast it
    names = spark.createDataFrame(marks, "cluster int, centroid_sha256 string").join(per, "cluster")
    side = names.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))).cast("bigint"))
    return found.rows.join(F.broadcast(side), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", F.col("cluster_inertia").cast("bigint").alias("cluster_inertia"),
        "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5) -> str:
    """DuckDB SQL for `summary(cluster(embeddings))`."""
    finite = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings"
        f" WHERE len(embedding) = {DIMS} AND {finite} = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, q FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, q"
        f" FROM v ORDER BY h LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        # exact: all sums stay far below 2 ** 53
        gap = "list_inner_product(v.q, v.q) + list_inner_product(c.q, c.q) - 2 * list_inner_product(v.q, c.q)"
        parts.append(
            f"a{n} AS MATERIALIZED (SELECT vec_id, q, cluster, distance FROM (SELECT v.vec_id, v.q, c.cluster, {gap} AS distance,"
            f" row_number() OVER (PARTITION BY v.vec_id ORDER BY {gap}, c.cluster) AS nth FROM v CROSS JOIN c{n} c) WHERE nth = 1)")
        if n < rounds:
            parts.append(
                f"m{n} AS (SELECT cluster, d, floor(sum(x) / count(*)) AS x FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS d"
                f" FROM a{n}) GROUP BY cluster, d)")
            parts.append(
                f"c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN"
                f" (SELECT cluster, list(x ORDER BY d) AS q FROM m{n} GROUP BY cluster) m USING (cluster))")
    return (
        f"WITH {', '.join(parts)} SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,"
        " CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,"
        " sha256(array_to_string(list_transform(c.q, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256"
        f" FROM a{rounds} a JOIN c{rounds} c USING (cluster)")
