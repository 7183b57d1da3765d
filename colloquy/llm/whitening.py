"""Whitening of embeddings by a covariance weighted with multiplicities.

Entries are put on a grid, ``x = floor(64 c) + 1000000``, so that equal vectors can
be grouped and sums are exact. Each distinct x is centred, multiplied and whitened once,
with its number of copies (or one) as its weight in the fit, and joined back to
the rows that hold it.

How it runs. Copies are counted by a map-side combined aggregate on x. Sums by
dimension and then the products of centred vectors are made per partition by NumPy
and added up as one row for each cell of the matrix, so what reaches the driver is one
d x d matrix, whatever the number of rows. Its eigenvectors go to the tasks. Rows
meet their distinct vector by a digest of x; one with more copies than a 2000th of the
rows is dealt over as many salts as bring it below that (at most 2000 such vectors, so
the list of them is bounded). The covariance of the result is merged from partitions
that each centre on their own mean.

Rows: a vector that is NULL or empty, or holds a NULL or non-finite entry, or one too large for
the grid (2^52 in size), is dropped, and so are vectors of another length than most
rows have (of equally frequent lengths, the longest stays). Repeated rows and NULL ids are rows like any other.
Without remaining rows there is no result. Directions in which the vectors do not
differ (eigenvalue zero to double precision) cannot be whitened and give no component. A
deviation that does not fit a long is NULL. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries of this size and more are not on the grid.
LARGEST = float(1 << 52)
#: No vector has more than this part of the rows under one join key.
HOT_PART, LEAST_HOT = 2000, 256
#: Eigenvalues below this part of the largest, times the dimension, are zero.
ZERO = 1e-14


@dataclass
class Fit:
    """n and S are exact; ``axes`` has one column for each component, ``values`` its eigenvalue."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S: exact, as longs where they fit and else as Python's whole numbers."""
        small = max((abs(int(s)) for s in self.sums), default=0) < 1 << 61
        if small and (not x.size or self.n * int(np.abs(x).max()) < 1 << 61):
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def deviation(self, centred: np.ndarray) -> list[int | None]:
        if not centred.size or float(np.abs(centred).max()) ** 2 * centred.shape[1] < 2.0**62:
            return (centred * centred).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in centred]
        return [v if v < 1 << 63 else None for v in exact]

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.axes / np.sqrt(self.values)


def on_grid(vector: Column) -> Column:
    """x as an array of longs."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(SHIFT))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)) & ~F.isnan(c))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False)
    return rows.reshape(len(column), -1)


def _sums(distinct: DataFrame, weight: str) -> tuple[int, np.ndarray]:
    """n and S, by exact whole numbers."""

    def run(batches):
        n, total = 0, None
        for batch in batches:
            x, w = _matrix(batch.column("_x")), batch.column("_w").to_numpy(zero_copy_only=False)
            if len(x):
                low = x - SHIFT  # small numbers, so that sums of a batch fit
                fits = float(np.abs(low).max()) * float(w.sum()) < 2.0**62
                part = w @ low if fits else w.astype(object) @ low.astype(object)
                total = part.astype(object) + (0 if total is None else total)
                n += int(w.sum())
        if n:
            at = pa.array(range(-1, len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([at, pa.array([str(v) for v in [n, *total]])], names=["at", "v"])

    parts = distinct.select("_x", F.col(weight).alias("_w")).mapInArrow(run, "at int, v string")
    found = parts.groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("at").collect()
    if not found:
        return 0, np.zeros(0, object)
    n = int(found[0]["v"])
    return n, np.array([int(r["v"]) + n * SHIFT for r in found[1:]], object)


def _cells(matrix: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(matrix))
    return pa.RecordBatch.from_arrays([pa.array(i * len(matrix) + j), pa.array(matrix[i, j])], names=["at", "v"])


def _symmetric(rows, d: int) -> np.ndarray:
    out = np.zeros(d * d)
    for r in rows:
        out[r["at"]] = r["v"]
    out = out.reshape(d, d)
    return out + np.triu(out, 1).T


def fit(distinct: DataFrame, weight: str, components: int = COMPONENTS) -> Fit | None:
    """``distinct`` has ``_x`` and the weights; None without rows."""
    n, sums = _sums(distinct, weight)
    if not n:
        return None
    d = len(sums)
    start = Fit(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)

    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            c = start.centred(_matrix(batch.column("_x"))).astype(np.float64) / n
            w = batch.column("_w").to_numpy(zero_copy_only=False).astype(np.float64)
            total += (c * w[:, None]).T @ c
        yield _cells(total)

    parts = distinct.select("_x", F.col(weight).alias("_w")).mapInArrow(run, "at bigint, v double")
    v = _symmetric(parts.groupBy("at").agg(F.sum("v").alias("v")).collect(), d) / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    kept = values[:components] > values[0] * d * ZERO
    return Fit(n, sums, axes[:, :components][:, kept].copy(), values[:components][kept].copy(), float(np.trace(v)))


def whitened(distinct: DataFrame, model: Fit) -> DataFrame:
    """``distinct`` with the whitened vector ``_y`` and the exact ``_deviation``."""

    def run(batches):
        for batch in batches:
            c = model.centred(_matrix(batch.column("_x")))
            y = model.whiten(c)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(y.reshape(-1)), y.shape[1]) if y.shape[1] else None
            lists = flat.cast(pa.list_(pa.float64())) if flat is not None else pa.array([[]] * len(y), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_copies"), batch.column("_w"), lists, pa.array(model.deviation(c), pa.int64())],
                names=["_id", "_copies", "_w", "_y", "_deviation"],
            )

    return distinct.mapInArrow(run, "_id binary, _copies bigint, _w bigint, _y array<double>, _deviation bigint")


def identity_error(vectors: DataFrame, k: int) -> float:
    """Largest entry by size of the weighted covariance of ``_y`` minus the identity.

    Every partition gives its weight, mean and centred products; two of them merge
    by the product of their means' difference.
    """

    def partial(batches):
        n, mean, products = 0.0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            y, w = _matrix(batch.column("_y")), batch.column("_w").to_numpy(zero_copy_only=False).astype(np.float64)
            if len(y):
                own = w @ y / w.sum()
                n, mean, products = _merge((n, mean, products), (w.sum(), own, ((y - own) * w[:, None]).T @ (y - own)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.r_[n, mean, products.ravel()].tolist()])], names=["v"])

    def merged(batches):
        total = (0.0, np.zeros(k), np.zeros((k, k)))
        for batch in batches:
            for v in _matrix(batch.column("v")):
                total = _merge(total, (v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k)))
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array([np.r_[total[0], total[1], total[2].ravel()].tolist()])], names=["v"])

    parts = vectors.select("_y", "_w").mapInArrow(partial, "v array<double>")
    total = parts.coalesce(64).mapInArrow(merged, "v array<double>").collect()  # at most 64 small matrices
    n, mean, products = (0.0, np.zeros(k), np.zeros((k, k)))
    for r in total:
        v = np.array(r["v"])
        n, mean, products = _merge((n, mean, products), (v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k)))
    return float(np.abs(products / n - np.eye(k)).max()) if n and k else 0.0


def _merge(a, b):
    (n, mean, products), (m, other, more) = a, b
    apart = other - mean
    return n + m, mean + apart * (m / (n + m)), products + more + np.outer(apart, apart) * (n * m / (n + m))


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
    weighted: bool = True,
) -> DataFrame:
    """One row for each remaining row of ``vectors`` and component.

    ``weighted`` counts each distinct x as often as rows hold it, else once; ``n`` is
    the number of vectors so counted.
    """
    rows = vectors.where(usable(F.col(vector))).select(F.col(key).alias("_key"), on_grid(F.col(vector)).alias("_x"))
    lengths = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = rows.where(F.size("_x") == (lengths[0]["d"] if lengths else 0))
    digest = F.unhex(F.sha2(F.array_join(F.col("_x"), ","), 256))
    copies = rows.groupBy("_x").agg(F.count(F.lit(1)).alias("_copies"))
    weight = F.col("_copies") if weighted else F.lit(1).cast("bigint")
    distinct = stored(copies.select(digest.alias("_id"), "_x", "_copies", weight.alias("_w")), "distinct")
    model = fit(distinct, "_w", components)
    kind = vectors.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
        "identity_error double"
    )
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    done = stored(whitened(distinct, model), "whitened")
    error = identity_error(done, len(model.values))
    most = max(LEAST_HOT, -(-distinct.agg(F.sum("_copies")).first()[0] // HOT_PART))
    found = _joined(rows.select("_key", digest.alias("_id")), done, most)
    explained = F.split(F.lit(",".join(repr(float(v / model.trace)) for v in model.values)), ",").cast("array<double>")
    return found.select("_key", "_deviation", F.posexplode("_y").alias("_at", "_value")).select(
        F.col("_key").alias(key),
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        F.col("_deviation").alias("deviation"),
        F.col("_value").alias("whitened"),
        F.get(explained, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _joined(rows: DataFrame, done: DataFrame, most: int) -> DataFrame:
    """Rows with their distinct vector's results; one with over ``most`` copies is salted."""
    salts = F.ceil(F.col("_copies") / F.lit(most)).cast("int")
    hot = F.broadcast(done.where(F.col("_copies") > most).select("_id", salts.alias("_salts")))  # at most HOT_PART rows
    left = rows.withColumn("_row", F.monotonically_increasing_id()).join(hot, "_id", "left")
    left = left.select("_key", "_id", F.pmod("_row", F.coalesce("_salts", F.lit(1))).cast("int").alias("_salt"))
    right = done.select("_id", "_deviation", "_y", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    return left.join(right, ["_id", "_salt"])
