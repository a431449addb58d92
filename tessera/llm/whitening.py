"""Whitening of embeddings by a tall-skinny QR: no covariance is formed to find the components.

Exact whole-number sums centre the rows.  Each partition reduces its centred
rows to one triangular factor R, a batch at a time; factors are stacked and
factored again up a tree whose rounds are written tables, and the singular value
decomposition of the last R has the covariance's eigenvectors as its right
vectors.  Only d x d numbers for each dimension d reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.staging import stage

#: Entries become floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Factors that are stacked at a node of the tree; components at most; the longest vector whose d x d factor the driver takes.
FAN_IN, COMPONENTS, MOST_DIMENSION = 16, 8, 4096
#: Rows that are centred together.
TOGETHER = 4096
#: A component counts as one if its singular value is above this, relative to the largest, times the dimension.
NO_RANK = 1e-13


@dataclass
class Fit:
    """The model of the vectors of one length; ``vectors`` has a component a row, ``values`` the eigenvalues, both by falling value."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole(vector: Column) -> Column:
    """The vector as an array of longs; NULL if it is NULL or holds a NULL or non-finite entry. Entries beyond a long take its limits."""
    as_double = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(as_double, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    least, most = float(-(1 << 52)), float(1 << 52)
    scaled = lambda c: F.floor(F.greatest(F.lit(least), F.least(F.lit(most), c * SCALE))).cast("long") + OFFSET
    return F.when(~bad, F.transform(as_double, scaled))


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, rows, matrix) for each length of vector in a batch."""
    sizes = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, flat[starts[rows][:, None] + np.arange(d)]


def exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S in whole numbers: longs where they hold it, else Python's."""
    most = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0)
    if most >= 1 << 62:
        return x.astype(object) * n - np.array(sums, dtype=object)
    return x * n - np.array(sums, dtype=np.int64)


def centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    """x - S / n, with one rounding for each entry."""
    return exact(x, fit.n, fit.sums).astype(np.float64) / fit.n


def totals(rows: DataFrame) -> dict[int, Fit]:
    """For each length of vector its number of rows and exact sums; lengths and positions bound what the driver gets."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for d, own, x in by_length(batch.column(0)):
                # halves of 32 bits, whose sums over a batch fit a long
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                n, held = sums.setdefault(d, [0, [0] * d])
                sums[d] = [n + len(own), [a + (h << 32) + b for a, h, b in zip(held, high, low)]]
        out = [(d, i, n, Decimal(v)) for d, (n, s) in sums.items() for i, v in enumerate(s)]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.decimal128(38, 0))], ["d", "i", "n", "s"])

    parts = rows.select("__x").mapInArrow(add, "d int, i int, n long, s decimal(38,0)")
    found = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("d", "i").collect()
    fits: dict[int, Fit] = {}
    for r in found:
        fits.setdefault(r["d"], Fit(r["n"], [], np.zeros(0), np.zeros((0, 0)), 0.0)).sums.append(int(r["s"]))
    return fits


def triangle(stacked: np.ndarray) -> np.ndarray:
    """The R factor of rows."""
    return np.linalg.qr(stacked, mode="r") if len(stacked) else stacked


def factors(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """(d, node, r): one R for each length and partition, row by row."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in by_length(batch.column(0)):
                for at in range(0, len(x), TOGETHER):
                    held[d] = triangle(np.vstack([held.get(d, np.zeros((0, d))), centred(x[at : at + TOGETHER], fits[d])]))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([r.ravel() for r in held.values()], pa.list_(pa.float64()))], ["d", "r"])

    return rows.where(F.size("__x") > 0).select("__x").mapInArrow(reduce, "d int, r array<double>").withColumn("node", F.spark_partition_id().cast("long"))


def merge_tree(parts: DataFrame) -> dict[int, np.ndarray]:
    """The last R of each length: rounds of FAN_IN factors a node, each round a written table."""
    parts = stage(parts, "factors")
    top = parts.agg(F.max("node")).first()[0]

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        d = int(group["d"].iloc[0])
        rows = np.vstack([np.asarray(r, np.float64).reshape(-1, d) for r in group.sort_values("node")["r"]])
        return pd.DataFrame({"d": [d], "node": [group["node"].iloc[0] // FAN_IN], "r": [triangle(rows).ravel()]})

    while top:
        parts = stage(parts.groupBy("d", F.expr(f"node div {FAN_IN}").alias("__up")).applyInPandas(merge, "d int, node long, r array<double>"), "factors")
        top //= FAN_IN
    return {r["d"]: np.array(r["r"]).reshape(-1, r["d"]) for r in parts.collect()}


def fit(rows: DataFrame) -> dict[int, Fit]:
    """The model of each length of vector in ``__x``."""
    fits = {d: f for d, f in totals(rows).items()}
    if too_long := [d for d in fits if d > MOST_DIMENSION]:
        raise ValueError(f"vectors of {too_long} entries: a factor of more than {MOST_DIMENSION} squared is not sent to the driver")
    for d, r in merge_tree(factors(rows, fits)).items():
        _, s, vt = np.linalg.svd(r)
        s = np.concatenate([s, np.zeros(d - len(s))])
        values = s * s / fits[d].n
        fits[d].values, fits[d].vectors, fits[d].trace = values, vt, float(values.sum())
        fits[d].values[s <= NO_RANK * d * s[:1].max(initial=0.0)] = 0.0
    return fits


def whiten(embeddings: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """The ``keep`` columns with ``component, n, deviation, whitened, explained, identity_error``, a row for each vector and component.

    Vectors that are NULL or hold a NULL or non-finite entry take no part; nor
    do empty ones, which have no component.  Vectors of another length than the
    others are whitened among themselves: ``n``, the components and
    ``identity_error`` are those of their length.  A component without variance
    (fewer vectors than entries, or all alike) has ``whitened`` NULL, and all
    have ``explained`` NULL where there is no variance at all; ``identity_error``
    is over the others, and NULL if there is none.  ``deviation`` is a
    decimal(38,0).  Repeated rows count and come out as often as they are there.
    Components with equal eigenvalues are any basis of their space.  A ``keep``
    column with a result column's name is refused.  An empty table gives an
    empty one.
    """
    made = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    if clash := set(keep) & set(made):
        raise ValueError(f"columns {sorted(clash)} have the names of result columns; rename them first")
    kept = [F.col(f"`{k}`") for k in keep]
    rows = embeddings.select(*kept, whole(F.col(f"`{vector}`")).alias("__x")).where(F.size("__x") > 0)
    fits = fit(rows)
    held = embeddings.sparkSession.sparkContext.broadcast({d: (Fit(f.n, f.sums, f.values[:components], f.vectors[:components], f.trace)) for d, f in fits.items()})

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, many = len(keep), len(batch)
            sizes, deviations, projected = np.zeros(many, np.int32), np.zeros(many, object), [None] * many
            for d, own, x in by_length(batch.column(width)):
                model = held.value[d]
                sizes[own] = d
                for i, row in zip(own, exact(x, model.n, model.sums).tolist()):
                    deviations[i] = Decimal(sum(v * v for v in row))
                scores = centred(x, model) @ model.vectors.T
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = scores / np.sqrt(model.values)
                for i, row in zip(own, scores):
                    projected[i] = [v if e > 0 else None for v, e in zip(row.tolist(), model.values)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(sizes), pa.array(deviations, pa.decimal128(38, 0)), pa.array(projected, pa.list_(pa.float64()))], [*keep, "__d", "deviation", "__w"]
            )

    kinds = "".join(f"`{k}` {kind}, " for k, kind in embeddings.select(*kept).dtypes)
    projected = stage(rows.mapInArrow(project, kinds + "__d int, deviation decimal(38,0), __w array<double>"), "whitened")
    errors = identity_errors(projected, fits, components)
    out = None
    for d, f in sorted(fits.items()):
        own = projected.where(F.col("__d") == d) if len(fits) > 1 else projected
        shares = [float(e / f.trace) if f.trace > 0 else None for e in f.values[:components]]
        own = own.select(
            *kept, F.posexplode("__w").alias("__k", "whitened"), F.lit(f.n).cast("long").alias("n"), "deviation"
        ).select(
            *kept, (F.col("__k") + 1).alias("component"), "n", "deviation", "whitened",
            F.get(F.array(*(F.lit(s).cast("double") for s in shares)), F.col("__k")).alias("explained"), F.lit(errors[d]).cast("double").alias("identity_error"),
        )
        out = own if out is None else out.unionAll(own)
    schema = kinds + "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return embeddings.sparkSession.createDataFrame([], schema) if out is None else out


def identity_errors(projected: DataFrame, fits: dict[int, Fit], components: int = COMPONENTS) -> dict[int, float | None]:
    """For each length the largest entry of |covariance of the whitened - identity|, over components with variance."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    w = [F.get("__w", F.lit(i)) for i in range(components)]
    sums = projected.groupBy("__d").agg(*(F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs))
    out: dict[int, float | None] = {d: None for d in fits}
    for r in sums.collect():  # a row for each length
        gaps = [abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < r["__d"] and fits[r["__d"]].values[j] > 0]
        out[r["__d"]] = max(gaps, default=None)
    return out
