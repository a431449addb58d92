"""Fitting hidden Markov chains over count cells: parameters, expectation steps on the cluster, gradient steps on sums of distinct counts.

A cell is (group, order, umi, base, a, total): gene reads with their baseline,
and reads of one allele among all.  Each state has a log-rate and a dispersion
for the first and a share and a concentration for the second.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.likelihood import bb_log_pmf, nb_log_pmf
from tessera.functions.special import bb_partials, nb_partials
from tessera.operators import hmm
from tessera.staging import stage


@dataclass(frozen=True)
class Params:
    """One number a state: log_mu, alpha, p, tau; and the log of the start."""

    log_mu: tuple[float, ...]
    alpha: tuple[float, ...]
    p: tuple[float, ...]
    tau: tuple[float, ...]

    @property
    def states(self) -> int:
        return len(self.log_mu)


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _expit(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def packed(params: Params, share_alpha: bool = False, share_tau: bool = False, fix_alpha: bool = False, fix_tau: bool = False) -> np.ndarray:
    """The free parameters on the whole line: rates, logits of shares, logs of dispersions; a shared one comes once, a fixed one not at all."""
    out = [*params.log_mu, *map(_logit, params.p)]
    for values, shared, fixed in ((params.alpha, share_alpha, fix_alpha), (params.tau, share_tau, fix_tau)):
        if not fixed:
            out += [math.log(values[0])] if shared else list(map(math.log, values))
    return np.array(out)


def unpacked(x: np.ndarray, start: Params, share_alpha: bool = False, share_tau: bool = False, fix_alpha: bool = False, fix_tau: bool = False) -> Params:
    """The inverse of ``packed``; fixed parameters keep their values in ``start``."""
    k = start.states
    out, at = [tuple(map(float, x[:k])), tuple(map(_expit, x[k : 2 * k]))], 2 * k
    for values, shared, fixed in ((start.alpha, share_alpha, fix_alpha), (start.tau, share_tau, fix_tau)):
        if fixed:
            out.append(values)
        else:
            n = 1 if shared else k
            own = tuple(math.exp(v) for v in x[at : at + n])
            out.append(own * k if shared else own)
            at += n
    return Params(out[0], out[2], out[1], out[3])


def errors(params: Params, inverse: np.ndarray) -> dict[str, list[float]]:
    """Standard errors from the inverse Hessian in packed coordinates, all free, by the delta method."""
    k = params.states
    sd = np.sqrt(np.maximum(0.0, np.diag(inverse)))
    slope = [1.0] * k + [p * (1 - p) for p in params.p] + list(params.alpha) + list(params.tau)
    out = (sd * np.array(slope)).tolist()
    return {"log_mu": out[:k], "p": out[k : 2 * k], "alpha": out[2 * k : 3 * k], "tau": out[3 * k :]}


def observed_errors(objective, theta: np.ndarray, step: float = 1e-4, rcond: float = 1e-10) -> np.ndarray:
    """The inverse of the observed information of a log-likelihood at ``theta``, by central differences; flat directions are left out."""
    n = len(theta)
    hessian, unit = np.zeros((n, n)), np.eye(n) * step
    for i in range(n):
        for j in range(i, n):
            corners = (objective(theta + unit[i] + unit[j]) - objective(theta + unit[i] - unit[j]) - objective(theta - unit[i] + unit[j]) + objective(theta - unit[i] - unit[j])) / (4 * step * step)
            hessian[i, j] = hessian[j, i] = corners
    return np.linalg.pinv(-hessian, rcond=rcond, hermitian=True)


def listed(rows: list[dict], fields: str) -> Column:
    """A short list of settings as an array of structs in the plan."""
    return F.from_json(F.lit(json.dumps(rows)), F.lit(f"array<struct<{fields}>>"))


def state_values(df: DataFrame, columns: list[str], settings: Column, value: Column, name: str) -> DataFrame:
    """``df`` with an array of one value for each setting, computed once for each distinct tuple of ``columns``.

    ``settings`` is an array of structs that begin with ``k``; ``value`` refers
    to it as ``s`` and is written out once, however many settings there are.
    """
    each = df.select(*columns).distinct().withColumn("s", F.explode(settings)).withColumn("v", value)
    known = each.groupBy(*columns).agg(F.transform(F.array_sort(F.collect_list(F.struct("s.k", "v"))), lambda x: x["v"]).alias(name)).withColumnsRenamed({c: f"__{c}" for c in columns})
    return df.join(known, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]).drop(*(f"__{c}" for c in columns))


DEPTH, SHARE = "k: int, log_mu: double, alpha: double", "k: int, p: double, tau: double"


def _settings(params: Params, nb: bool) -> list[dict]:
    if nb:
        return [{"k": k, "log_mu": m, "alpha": a} for k, (m, a) in enumerate(zip(params.log_mu, params.alpha))]
    return [{"k": k, "p": p, "tau": t} for k, (p, t) in enumerate(zip(params.p, params.tau))]


def emissions(cells: DataFrame, params: Params, nb: bool = True, bb: bool = True, shift: str | None = None) -> DataFrame:
    """``cells`` with e0, e1 ...: each state's log-likelihood of each cell, computed once for each distinct tuple of counts.

    Cells without a baseline say nothing by their reads, and cells without
    allele reads nothing by their share.  ``shift`` is a column taken off the
    log-rate.
    """
    out, zero = cells, F.array(*(F.lit(0.0) for _ in range(params.states)))
    rate = F.col("s.log_mu") - (F.col(shift) if shift else F.lit(0.0))
    out = state_values(out, ["umi", "base", *([shift] if shift else [])], listed(_settings(params, True), DEPTH), nb_log_pmf(F.col("umi"), F.col("base"), rate, F.col("s.alpha")), "__nb") if nb else out.withColumn("__nb", zero)
    share = F.when(F.col("total") > 0, bb_log_pmf(F.col("a"), F.col("total"), F.col("s.p"), F.col("s.tau"))).otherwise(0.0)
    out = state_values(out, ["a", "total"], listed(_settings(params, False), SHARE), share, "__bb") if bb else out.withColumn("__bb", zero)
    part = lambda name, k: F.coalesce(F.get(name, F.lit(k)), F.lit(0.0))
    return out.withColumns({f"e{k}": part("__nb", k) + part("__bb", k) for k in range(params.states)}).drop("__nb", "__bb")


def responsibilities(cells: DataFrame, params: Params, stay: float, group: str, order: list[str], nb: bool = True, bb: bool = True) -> tuple[DataFrame, float]:
    """(cells with ``posterior``, log-likelihood) of a chain that stays with probability ``stay``."""
    k = params.states
    scored = stage(emissions(cells, params, nb, bb), "emissions")
    trans, start = hmm.transitions(k, stay), [-math.log(k)] * k
    names = [f"e{i}" for i in range(k)]
    level = hmm.forward(scored, group, order, names, trans, start).agg(F.sum("log_likelihood").alias("l")).first()["l"]
    post = hmm.posteriors(scored, group, order, names, trans, start)
    return cells.join(post, [group, *order]), float(level or 0.0)


STEPS = (0.0, 1.0, 0.3, 0.1, 0.03, 0.01, 0.003)


def _term(nb: bool) -> Column:
    if nb:
        return nb_log_pmf(F.col("umi"), F.col("base"), F.col("s.log_mu"), F.col("s.alpha"))
    return bb_log_pmf(F.col("a"), F.col("total"), F.col("s.p"), F.col("s.tau"))


def _best_of(codes: DataFrame, tries: list[Params], nb: bool) -> int:
    """Which of some parameters has the greatest expected log-likelihood, all tried in one pass over the distinct counts."""
    rows = [{"t": t, **s} for t, p in enumerate(tries) for s in _settings(p, nb)]
    each = codes.withColumn("s", F.explode(listed(rows, "t: int, " + (DEPTH if nb else SHARE))))
    got = {r["t"]: r["v"] for r in each.groupBy("s.t").agg(F.sum(F.get("w", F.col("s.k")) * _term(nb)).alias("v")).collect()}
    return max(range(len(tries)), key=lambda i: (got.get(i, float("-inf")), -i))


def _climbed(codes: DataFrame, params: Params, nb: bool, free_dispersion: bool, share_dispersion: bool, rounds: int) -> Params:
    """Gradient steps of the expected log-likelihood; the best of several lengths, none included, is taken, so it never falls."""
    k = params.states
    for _ in range(rounds):
        each = codes.withColumn("s", F.explode(listed(_settings(params, nb), DEPTH if nb else SHARE)))
        weight = F.get("w", F.col("s.k"))
        if nb:
            part, scale = nb_partials(F.col("umi"), F.col("base"), F.col("s.log_mu"), F.col("s.alpha")), F.col("umi")
            main_by, spread_by = part["log_mu"], part["log_alpha"]
        else:
            part, scale = bb_partials(F.col("a"), F.col("total"), F.col("s.p"), F.col("s.tau")), F.col("total") / 4
            main_by, spread_by = part["logit_p"], part["log_tau"]
        sums = {r["k"]: r for r in each.groupBy("s.k").agg(F.sum(weight * main_by).alias("m"), F.sum(weight * spread_by).alias("d"), F.sum(weight * scale).alias("s"), F.sum(weight).alias("n")).collect()}
        g = {f"{c}{i}": (sums[i][c] if i in sums else 0.0) for i in range(k) for c in "mdsn"}
        # scaled by what the counts and the cells can say at most
        main = [(g[f"m{i}"] or 0.0) / max(1.0, g[f"s{i}"] or 0.0) for i in range(k)]
        spread = [(g[f"d{i}"] or 0.0) / max(1.0, g[f"n{i}"] or 0.0) for i in range(k)]
        if share_dispersion:
            spread = [sum(g[f"d{i}"] or 0.0 for i in range(k)) / max(1.0, sum(g[f"n{i}"] or 0.0 for i in range(k)))] * k
        clip = lambda x: max(-1.0, min(1.0, x))

        def moved(t: float, u: float) -> Params:
            if nb:
                return replace(params, log_mu=tuple(m + t * clip(4 * d) for m, d in zip(params.log_mu, main)), alpha=tuple(min(50.0, max(1e-6, a * math.exp(u * clip(8 * d)))) for a, d in zip(params.alpha, spread)))
            return replace(params, p=tuple(min(1 - 1e-6, max(1e-6, _expit(_logit(p) + t * clip(4 * d)))) for p, d in zip(params.p, main)), tau=tuple(min(1e6, max(0.1, x * math.exp(u * clip(8 * d)))) for x, d in zip(params.tau, spread)))

        tries = [moved(t, u) for t in STEPS for u in (STEPS if free_dispersion else (0.0,))]
        best = _best_of(codes, tries, nb)
        if best == 0:
            break
        params = tries[best]
    return params


def dispersions(cells: DataFrame, params: Params, state: str = "state", rounds: int = 6) -> Params:
    """Dispersions and concentrations of greatest likelihood for cells whose state is given."""
    k = params.states
    hard = F.array(*(F.sum(F.when(F.col(state) == i, 1.0).otherwise(0.0)) for i in range(k)))
    nb = stage(cells.where("base > 0").groupBy("umi", "base").agg(hard.alias("w")), "codes")
    bb = stage(cells.where("total > 0").groupBy("a", "total").agg(hard.alias("w")), "codes")
    first = _climbed(nb, params, True, True, False, rounds)
    second = _climbed(bb, params, False, True, False, rounds)
    return Params(params.log_mu, first.alpha, params.p, second.tau)


def fitted(cells: DataFrame, params: Params, stay: float, group: str, order: list[str], rounds: int = 10, tolerance: float = 1e-4, share_dispersion: bool = True, free_dispersion: bool = True, inner: int = 2) -> tuple[Params, list[float]]:
    """(parameters, log-likelihood before each round): expectation by the chain, maximisation by gradient steps on sums of distinct counts.

    The likelihood never falls from round to round; it ends where a round gains
    less than ``tolerance`` a cell.
    """
    n = max(1, cells.count())
    levels: list[float] = []
    for _ in range(rounds):
        held, level = responsibilities(cells, params, stay, group, order)
        levels.append(level)
        if len(levels) > 1 and level - levels[-2] < tolerance * n:
            break
        held = stage(held.select("umi", "base", "a", "total", "posterior"), "responsible")
        sums = F.array(*(F.sum(F.get("posterior", F.lit(i))) for i in range(params.states)))
        nb = stage(held.where("base > 0").groupBy("umi", "base").agg(sums.alias("w")), "codes")
        bb = stage(held.where("total > 0").groupBy("a", "total").agg(sums.alias("w")), "codes")
        depth = _climbed(nb, params, True, free_dispersion, share_dispersion, inner)
        share = _climbed(bb, params, False, free_dispersion, share_dispersion, inner)
        params = Params(depth.log_mu, depth.alpha, share.p, share.tau)
    return params, levels


def baseline_shifts(cells: DataFrame, path: DataFrame, params: Params, clone: str, key: list[str]) -> DataFrame:
    """(clone, shift): the log of each clone's mean rate over its path, weighted by the baseline: what keeps its total reads."""
    rates = F.array(*map(F.lit, params.log_mu))
    met = cells.join(path, [clone, *key]).where("base > 0").select(clone, (F.get(rates, F.col("state").cast("int")) + F.ln("base")).alias("v"), F.ln("base").alias("b"))
    most = met.groupBy(clone).agg(F.max("v").alias("m"), F.max("b").alias("mb"))
    return met.join(most, clone).groupBy(clone).agg((F.max("m") + F.ln(F.sum(F.exp(F.col("v") - F.col("m")))) - F.max("mb") - F.ln(F.sum(F.exp(F.col("b") - F.col("mb"))))).alias("shift"))


def neutral_state(path: DataFrame, params: Params, normal, clone: str = "clone", slack: float = 0.05) -> int | None:
    """The balanced state that the normal clone is in most often, ties to the smaller; None without one."""
    balanced = [k for k, p in enumerate(params.p) if abs(p - 0.5) <= slack]
    seen = path.where((F.col(clone) == normal) & F.col("state").isin(balanced)).groupBy("state").count().agg(F.max_by("state", F.struct(F.col("count"), -F.col("state"))).alias("s")).first()
    return seen["s"]


def distinct_components(means: np.ndarray, weights: np.ndarray, reach: float) -> list[tuple[np.ndarray, float]]:
    """Mixture components, heaviest first, those within ``reach`` of a heavier one joined to it."""
    out: list[list] = []
    for i in np.argsort(-weights, kind="stable"):
        for held in out:
            if np.linalg.norm(means[i] - held[0]) <= reach:
                held[1] += float(weights[i])
                break
        else:
            out.append([means[i], float(weights[i])])
    return [(m, w) for m, w in sorted(out, key=lambda x: -x[1])]


def spread_starts(cells: DataFrame, states: int, alpha: float = 0.1, tau: float = 30.0, seed: int = 0) -> Params:
    """Starting parameters from cells drawn one by one, each with a chance that falls with how well those before explain it.

    A draw is the cell of greatest badness to the power of one over its seeded
    uniform number, so it needs one pass and no sum.
    """
    usable = cells.where("base > 0 AND total > 0 AND umi > 0").select("umi", "base", "a", "total").distinct()
    mu, p = [0.0], [0.5]
    for k in range(1, states):
        held = Params(tuple(mu), (alpha,) * k, tuple(p), (tau,) * k)
        scored = emissions(usable, held)
        best = F.greatest(*(F.col(f"e{i}") for i in range(k))) if k > 1 else F.col("e0")
        u = (F.pmod(F.xxhash64("umi", "base", "a", "total", F.lit(seed), F.lit(k)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
        row = scored.select("umi", "base", "a", "total", (F.ln(u) / F.greatest(F.lit(1e-9), -best)).alias("draw")).agg(F.max_by(F.struct("umi", "base", "a", "total"), "draw").alias("c")).first()["c"]
        if row is None:
            mu.append(0.1 * k)
            p.append(0.5)
            continue
        mu.append(math.log(max(1e-6, row["umi"]) / row["base"]))
        p.append(min(0.99, max(0.01, (row["a"] + 0.5) / (row["total"] + 1))))
    return Params(tuple(mu), (alpha,) * states, tuple(p), (tau,) * states)


def phased_by_vote(profiles: DataFrame, paths: DataFrame, near: float) -> DataFrame:
    """(bin, phase): the phase of each bin by the majority of clones whose path's share is off balance there."""
    from tessera.operators.summaries import phase_vote

    return phase_vote(profiles.join(paths, ["clone", "bin"]), "bin", "share", near)


def phased_emissions(cells: DataFrame, params: Params) -> tuple[DataFrame, list[str]]:
    """(cells with f0, f1 ... and g0, g1 ..., their names): each state's log-likelihood of each cell, and its twin's whose allele is the other one."""
    k = params.states
    plain = emissions(cells, params).withColumnsRenamed({f"e{i}": f"f{i}" for i in range(k)})
    both = emissions(plain, replace(params, p=tuple(1 - p for p in params.p))).withColumnsRenamed({f"e{i}": f"g{i}" for i in range(k)})
    return both, [*(f"f{i}" for i in range(k)), *(f"g{i}" for i in range(k))]


def initial_phase(cells: DataFrame, params: Params, stay: float, switch: str, near: float, step: float, spacing: int, same_state: bool = False) -> tuple[DataFrame, DataFrame]:
    """((contig, bin, phase), (contig, bin, piece)): phases by vote over clones' phased chains, and pieces between jumps of the minor share.

    ``cells`` is (clone, contig, bin, umi, base, a, total, switch).  A clone's
    share at a bin is that of the likelier twin of its likeliest state.
    """
    from tessera.operators.ordered import cut_at_steps
    from tessera.operators.summaries import phase_vote

    k = params.states
    keyed = cells.withColumn("__group", F.concat_ws("/", F.col("clone").cast("string"), F.col("contig").cast("string")))
    both, names = phased_emissions(keyed, params)
    both = stage(both, "twins")
    _, states = hmm.phased(both, "__group", ["bin"], names, hmm.transitions(k, stay), [-math.log(k)] * k, switch, same_state)
    own = F.get(F.array(*map(F.lit, params.p)), F.col("state").cast("int"))
    shares = stage(both.select("__group", "clone", "contig", "bin").join(states, ["__group", "bin"]).select("clone", "contig", "bin", F.when(F.col("phase") == 0, own).otherwise(1 - own).alias("share")), "phased")
    minor = shares.groupBy("contig", "bin").agg(F.min(F.least(F.col("share"), 1 - F.col("share"))).alias("minor"))
    votes = phase_vote(shares.withColumn("__at", F.struct("contig", "bin")), "__at", "share", near).select("__at.contig", "__at.bin", "phase")
    return votes, cut_at_steps(minor, "contig", ["bin"], "minor", step, spacing).select("contig", "bin", "piece")


#: What is added to variances, so that a component of equal points has one.
LEAST_VARIANCE = 1e-6


def plane_mixture(points: DataFrame, x: str, y: str, states: int, rounds: int = 20) -> tuple[DataFrame, list[float]]:
    """((component, weight, x, y, v_xx, v_xy, v_yy), mean log-likelihood before each round): a mixture of normal laws in the plane by expectation maximisation.

    Components start at even quantiles of x and the mean of y, with the whole
    table's covariance and like weights, and keep that order.  A round is one
    pass that returns six sums for each component.  Rows with a NULL or
    non-finite coordinate take no part; without rows there is no component.
    """
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    held = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    held = stage(held.where(fine("x") & fine("y")).groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")), "plane")
    spark, schema = points.sparkSession, "component int, weight double, x double, y double, v_xx double, v_xy double, v_yy double"
    at = F.percentile("x", F.array(*(F.lit((i + 0.5) / states) for i in range(states))), F.col("n").cast("long"))
    total = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    row = held.agg(at.alias("at"), total(F.col("x")).alias("mx"), total(F.col("y")).alias("my"), total(F.col("x") * F.col("x")).alias("xx"), total(F.col("x") * F.col("y")).alias("xy"), total(F.col("y") * F.col("y")).alias("yy"), F.sum("n").alias("n")).first()
    if not row["n"]:
        return spark.createDataFrame([], schema), []
    whole = (row["xx"] - row["mx"] ** 2 + LEAST_VARIANCE, row["xy"] - row["mx"] * row["my"], row["yy"] - row["my"] ** 2 + LEAST_VARIANCE)
    now = [(1 / states, row["at"][i], row["my"], *whole) for i in range(states)]
    levels: list[float] = []
    for _ in range(rounds):
        logs = []
        for w, mx, my, xx, xy, yy in now:
            det = xx * yy - xy * xy
            dx, dy = F.col("x") - mx, F.col("y") - my
            logs.append(F.lit(math.log(max(w, 1e-300)) - 0.5 * math.log(det) - math.log(2 * math.pi)) - 0.5 * (yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / det)
        each = held.withColumns({f"l{i}": v for i, v in enumerate(logs)})
        top = F.greatest(*(F.col(f"l{i}") for i in range(states))) if states > 1 else F.col("l0")
        each = each.withColumn("top", top).withColumn("whole", F.col("top") + F.ln(sum((F.exp(F.col(f"l{i}") - F.col("top")) for i in range(states)), F.lit(0.0))))
        each = each.withColumns({f"r{i}": F.col("n") * F.exp(F.col(f"l{i}") - F.col("whole")) for i in range(states)})
        by = {"n": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y")}
        s = each.agg(F.sum(F.col("n") * F.col("whole")).alias("level"), *(F.sum(F.col(f"r{i}") * v).alias(f"{k}{i}") for i in range(states) for k, v in by.items())).first()
        levels.append(s["level"] / row["n"])
        following = []
        for i in range(states):
            n = max(s[f"n{i}"], 1e-12)
            mx, my = s[f"x{i}"] / n, s[f"y{i}"] / n
            following.append((n / row["n"], mx, my, s[f"xx{i}"] / n - mx * mx + LEAST_VARIANCE, s[f"xy{i}"] / n - mx * my, s[f"yy{i}"] / n - my * my + LEAST_VARIANCE))
        now = following
    return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(now)], schema), levels
