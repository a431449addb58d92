"""Core inference: alternate copy paths of clones and clone labels of spots until the labels settle."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.likelihood import bb_log_pmf, nb_log_pmf
from tessera.operators import hmm, spatial
from tessera.staging import stage


@dataclass
class State:
    """A copy state's log mean, NB dispersion, share of haplotype A and BB concentration."""

    log_mu: float
    alpha: float
    share: float
    tau: float


@dataclass
class Fit:
    labels: DataFrame
    path: DataFrame
    states: list[State]
    rounds: int


def emissions(df: DataFrame, states: list[State]) -> DataFrame:
    """Adds ``e0, e1, ...``: each state's log-likelihood of (k, base, a, n)."""
    k, base, a, n = (F.col(c).cast("double") for c in ("k", "base", "a", "n"))
    return df.withColumns({f"e{i}": nb_log_pmf(k, base, F.lit(s.log_mu), F.lit(s.alpha)) + F.when(n > 0, bb_log_pmf(a, n, F.lit(s.share), F.lit(s.tau))).otherwise(0.0) for i, s in enumerate(states)})


def pseudobulk(counts: DataFrame, labels: DataFrame) -> DataFrame:
    return counts.join(labels, "spot").groupBy("label", "bin").agg(*(F.sum(c).alias(c) for c in ("k", "base", "a", "n")))


def field(counts: DataFrame, path: DataFrame, states: list[State]) -> DataFrame:
    """(spot, label, value): the log-likelihood of each spot's bins in each clone's path.

    Each bin is evaluated in every state once, and the paths (clones times
    bins) then pick; a spot's values are summed inside the tasks.
    """
    evaluated = emissions(counts, states).select("spot", "bin", F.array(*(F.col(f"e{i}") for i in range(len(states)))).alias("e"))
    picked = evaluated.join(path, "bin").select("spot", "label", F.get("e", F.col("state").cast("int")).alias("v"))
    return picked.groupBy("spot", "label").agg(F.sum("v").alias("value"))


def fit(counts: DataFrame, labels: DataFrame, edges: DataFrame, states: list[State], stay: float = 0.99, beta: float = 1.0, rounds: int = 5, colours: int = 4) -> Fit:
    """``counts`` (spot, bin, k, base, a, n), ``labels`` (spot, label) to start from, ``edges`` (src, dst, w).

    State 0 is pinned to log mean 0, the neutral level.  Only the states' sums
    and the share of labels that moved reach the driver.
    """
    trans, start = hmm.transitions(len(states), stay), [-math.log(len(states))] * len(states)
    path, turn = None, 0
    for turn in range(1, rounds + 1):
        bulk = stage(pseudobulk(counts, labels), "bulk")
        names = [f"e{i}" for i in range(len(states))]
        found = hmm.viterbi(emissions(bulk, states), "label", ["bin"], names, trans, start)
        path = stage(found.select("label", "bin", F.col("state").cast("int").alias("state")), "path")
        sums = {r["state"]: r for r in bulk.join(path, ["label", "bin"]).groupBy("state").agg(*(F.sum(c).alias(c) for c in ("k", "base", "a", "n"))).collect()}
        states = [
            State(0.0 if i == 0 or i not in sums or not sums[i]["k"] or not sums[i]["base"] else math.log(sums[i]["k"] / sums[i]["base"]), s.alpha, min(0.99, max(0.01, sums[i]["a"] / sums[i]["n"])) if i in sums and sums[i]["n"] else s.share, s.tau)
            if i in sums or i == 0
            else s
            for i, s in enumerate(states)
        ]
        before = labels
        labels = spatial.icm(stage(field(counts, path, states), "field"), edges, before, beta, sweeps=2, colours=colours, seed=turn)
        moved = labels.join(before.withColumnRenamed("label", "old"), "spot").where("label != old")
        if moved.isEmpty():
            break
    return Fit(labels, path, states, turn)
