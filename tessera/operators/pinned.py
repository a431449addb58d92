"""Errors of a chain's fitted states, with the neutral state's rate held: the coordinates that the data identify.

A clone's rates count only against its own mean rate over its path, so all
rates can move together at no cost; holding the neutral one at 1 takes that
freedom away.  The information is the curvature of the chains' log-likelihood by
central differences: all corners are settings of one pass, scored side by side
where a chain's rows are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.chunks import in_order, whole_groups
from tessera.operators.fitting import Params, neutral_state
from tessera.operators.starts import bb, nb_by_size
from tessera.staging import stage

#: Shares nearer than this to 0 or 1 have no curvature in their logit and are held.
BOUNDARY = 1e-3
#: Bins scored together.
TOGETHER = 1024


@dataclass
class Errors:
    """States' rates and minor shares with their covariance, (states, 2, 2); which state is pinned, and how far from its optimum the fit was."""

    mu: np.ndarray
    minor: np.ndarray
    covariance: np.ndarray
    neutral: int
    decrement: float
    theta: np.ndarray
    information: np.ndarray


@dataclass(frozen=True)
class Coordinates:
    """The free log rates and logits of shares; the others are held at the values they came with."""

    rates: tuple[int, ...]
    shares: tuple[int, ...]
    log_mu: tuple[float, ...]
    p: tuple[float, ...]

    def values(self) -> np.ndarray:
        return np.array([self.log_mu[k] for k in self.rates] + [math.log(self.p[k] / (1 - self.p[k])) for k in self.shares])

    def at(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log rates, shares) of all states."""
        log_mu, p = np.array(self.log_mu), np.array(self.p)
        log_mu[list(self.rates)] = theta[: len(self.rates)]
        p[list(self.shares)] = 1 / (1 + np.exp(-theta[len(self.rates) :]))
        return log_mu, p


def path_weights(cells: DataFrame, path: DataFrame) -> dict[object, dict[int, float]]:
    """For each clone the share of the baseline that lies on each state of its path; baselines are summed over clones, as a bin has one."""
    profile = cells.groupBy("contig", "bin").agg(F.sum("base").alias("base"))
    whole = profile.agg(F.sum("base").alias("whole"))  # one row
    shares = profile.join(F.broadcast(whole), how="cross").select("contig", "bin", (F.col("base") / F.col("whole")).alias("share"))
    out: dict[object, dict[int, float]] = {}
    for r in path.join(shares, ["contig", "bin"]).groupBy("clone", "state").agg(F.sum("share").alias("w")).collect():
        out.setdefault(r["clone"], {})[int(r["state"])] = float(r["w"] or 0.0)
    return out


def levels(cells: DataFrame, points: list[tuple[np.ndarray, np.ndarray]], weights: dict[object, dict[int, float]], alpha: float, tau: float, stay: float) -> np.ndarray:
    """The chains' log-likelihood at each point (log rates, shares), summed over clones and contigs; one pass.

    A clone's rates are taken against their mean over its path.
    """
    k = len(points[0][0])
    log_mu, p = np.stack([x[0] for x in points]), np.stack([x[1] for x in points])
    shifts = {c: np.log(sum(w * np.exp(log_mu[:, s]) for s, w in own.items())) for c, own in weights.items()}
    keep, move = math.log(stay) if k > 1 else 0.0, math.log((1 - stay) / (k - 1)) if k > 1 else -math.inf
    rows = cells.withColumn("__chain", F.to_json(F.struct("clone", "contig")))
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("umi", "base", "a", "total")})
    rows = in_order(rows, "__chain", ["bin"], "umi", "base", "a", "total", "clone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in whole_groups(batches):
            umi, base, a, total = (batch.column(i).to_numpy() for i in range(2, 6))
            sums = np.zeros(len(points))
            for lo, hi in zip(edges[:-1], edges[1:]):
                shift = shifts[batch.column(6)[int(lo)].as_py()]
                rates, ahead = np.exp(log_mu - shift[:, None]), None
                for t in range(lo, hi, TOGETHER):
                    part = slice(t, min(hi, t + TOGETHER))
                    reads, own = np.unique(np.stack([umi[part], base[part]]), axis=1, return_inverse=True)
                    counts, of = np.unique(np.stack([a[part], total[part]]), axis=1, return_inverse=True)
                    nb = nb_by_size(reads[0][:, None, None], reads[1][:, None, None] * rates, np.array(1 / alpha))[own.ravel()]
                    e = nb + bb(counts[0][:, None, None], counts[1][:, None, None], p, np.array(tau))[of.ravel()]
                    for row in e:
                        if ahead is None:
                            ahead = row - math.log(k)
                            continue
                        top = ahead.max(axis=1, keepdims=True)
                        w = np.exp(ahead - top)
                        # from the same state by ``stay``, from the others by what is left
                        whole = w.sum(axis=1, keepdims=True)
                        ahead = top + np.log(w * math.exp(keep) + (whole - w) * (math.exp(move) if k > 1 else 0.0)) + row
                top = ahead.max(axis=1, keepdims=True)
                sums += (top + np.log(np.exp(ahead - top).sum(axis=1, keepdims=True)))[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(points), dtype=np.int32)), pa.array(sums)], ["at", "level"])

    out = np.zeros(len(points))
    for r in rows.mapInArrow(run, "at int, level double").groupBy("at").agg(F.sum("level").alias("level")).collect():
        out[r["at"]] = r["level"]
    return out


def curvature(score, theta: np.ndarray, step: float = 1e-3) -> tuple[float, np.ndarray, np.ndarray]:
    """(level, gradient, Hessian) of a function that scores many points at once."""
    n, unit = len(theta), np.eye(len(theta)) * step
    points, at = [theta], {}
    for i in range(n):
        for s in (1, -1):
            at[i, s] = len(points)
            points.append(theta + s * unit[i])
        for j in range(i):
            for s, t in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
                at[i, j, s, t] = len(points)
                points.append(theta + s * unit[i] + t * unit[j])
    v = score(points)
    gradient = np.array([(v[at[i, 1]] - v[at[i, -1]]) / (2 * step) for i in range(n)])
    hessian = np.zeros((n, n))
    for i in range(n):
        hessian[i, i] = (v[at[i, 1]] - 2 * v[0] + v[at[i, -1]]) / step**2
        for j in range(i):
            hessian[i, j] = hessian[j, i] = (v[at[i, j, 1, 1]] - v[at[i, j, 1, -1]] - v[at[i, j, -1, 1]] + v[at[i, j, -1, -1]]) / (4 * step**2)
    return float(v[0]), gradient, hessian


def pinned_errors(cells: DataFrame, path: DataFrame, params: Params, normal, stay: float, refits: int = 4) -> Errors:
    """Rates and minor shares of the states with their covariance, given the dispersions, in coordinates with the neutral state's rate at 1.

    ``cells`` is (clone, contig, bin, umi, base, a, total), ``path`` (clone,
    contig, bin, state).  The neutral state is the balanced one that the clone
    ``normal`` is in most often; without one this is refused.  States that no
    bin visits and shares at their boundary carry no information: they are held
    and have errors of 0.  The point is first moved to the likelihood's optimum
    by Newton steps, each the best of several lengths, none included.
    """
    neutral = neutral_state(path, params, normal)
    if neutral is None:
        raise ValueError("no balanced state is on the normal clone's path, so no rate can be pinned")
    cells, path = stage(cells.select("clone", "contig", "bin", "umi", "base", "a", "total"), "cells"), stage(path.select("clone", "contig", "bin", "state"), "path")
    weights = path_weights(cells, path)
    visited = {s for own in weights.values() for s in own}
    log_mu = np.array(params.log_mu) - params.log_mu[neutral]
    p = np.clip(params.p, 1e-6, 1 - 1e-6)
    free = Coordinates(tuple(k for k in range(params.states) if k != neutral and k in visited), tuple(k for k in sorted(visited) if BOUNDARY < p[k] < 1 - BOUNDARY), tuple(log_mu.tolist()), tuple(p.tolist()))
    score = lambda points: levels(cells, [free.at(x) for x in points], weights, params.alpha[0], params.tau[0], stay)
    theta = free.values()
    now, gradient, hessian = curvature(score, theta)
    for _ in range(refits if len(theta) else 0):
        step = np.linalg.pinv(-hessian, hermitian=True) @ gradient
        lengths = (0.0, 1.0, 0.5, 0.25, 0.1, 0.03, -0.1)
        tried = score([theta + x * step for x in lengths])
        best = int(np.argmax(tried))
        if tried[best] - now < 1e-8 * max(1.0, abs(now)):
            break
        theta = theta + lengths[best] * step
        now, gradient, hessian = curvature(score, theta)
    return translated(free, theta, gradient, -hessian, neutral)


def translated(free: Coordinates, theta: np.ndarray, gradient: np.ndarray, information: np.ndarray, neutral: int) -> Errors:
    """Errors of rates and minor shares from the information in free coordinates, by the delta method."""
    inverse = np.linalg.pinv(information, rcond=1e-12, hermitian=True) if len(theta) else np.zeros((0, 0))
    log_mu, p = free.at(theta)
    mu, flipped = np.exp(log_mu), p > 0.5
    rate = {k: i for i, k in enumerate(free.rates)}
    share = {k: len(free.rates) + i for i, k in enumerate(free.shares)}
    out = np.zeros((len(mu), 2, 2))
    for k in range(len(mu)):
        slope = (mu[k], p[k] * (1 - p[k]) * (-1 if flipped[k] else 1))
        at = (rate.get(k), share.get(k))
        for i in range(2):
            for j in range(2):
                if at[i] is not None and at[j] is not None:
                    out[k, i, j] = inverse[at[i], at[j]] * slope[i] * slope[j]
    return Errors(mu, np.where(flipped, 1 - p, p), out, neutral, float(gradient @ inverse @ gradient) if len(theta) else 0.0, theta, information)
