"""Integer copies from fitted states: credible sets, coordinate descent, lattice paths with purity, and clones that tell nothing apart."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.likelihood import admixed_depth, admixed_share, bb_log_pmf, nb_log_pmf
from tessera.functions.special import chi_square_cut
from tessera.operators import hmm
from tessera.operators.fitting import listed, state_values
from tessera.operators.ranking import first_rows


def copy_pairs(most_total: int = 6, most_allele: int = 5, phased: bool = True) -> list[tuple[int, int]]:
    """Pairs (a, b) with 0 < a + b <= most_total, by total and then by a."""
    pairs = ((a, b) for a, b in itertools.product(range(most_allele + 1), repeat=2) if 0 < a + b <= most_total and (phased or a >= b))
    return sorted(pairs, key=lambda p: (sum(p), p[0]))


def credible_pairs(states: DataFrame, ident: str, level: float = 0.95, pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    """(ident, a, b, distance, consistent): the pair nearest to (depth, share) by Mahalanobis' distance and, nearest first, all within the credible region.

    ``states`` has ``depth, share`` and their covariance ``v_dd, v_ds, v_ss``;
    a covariance that is not positive definite gives NULL.
    """
    known = pairs or copy_pairs()
    cut = chi_square_cut(level)
    options = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit((a + b) / 2).alias("d"), F.lit(b / (a + b)).alias("s")) for i, (a, b) in enumerate(known)))
    det = F.col("v_dd") * F.col("v_ss") - F.col("v_ds") * F.col("v_ds")
    far = lambda p: ((F.col("depth") - p["d"]) * (F.col("depth") - p["d"]) * F.col("v_ss") - 2 * (F.col("depth") - p["d"]) * (F.col("share") - p["s"]) * F.col("v_ds") + (F.col("share") - p["s"]) * (F.col("share") - p["s"]) * F.col("v_dd")) / det
    ranked = F.array_sort(F.transform(options, lambda p: F.struct(far(p).alias("distance"), p["i"].alias("i"), p["a"].alias("a"), p["b"].alias("b"))))
    sound = states.withColumn("__r", F.when((det > 0) & (F.col("v_dd") > 0), ranked))
    best = F.get("__r", F.lit(0))
    consistent = F.transform(F.filter("__r", lambda x: x["distance"] <= cut), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    return sound.select(ident, best["a"].cast("long").alias("a"), best["b"].cast("long").alias("b"), best["distance"].alias("distance"), consistent.alias("consistent"))


def share_variance(alpha: Column, beta: Column, v_aa: Column, v_ab: Column, v_bb: Column) -> Column:
    """Variance of alpha / (alpha + beta) by the delta method; NULL where it is not positive."""
    whole = alpha + beta
    da, db = beta / (whole * whole), -alpha / (whole * whole)
    v = da * da * v_aa + 2 * da * db * v_ab + db * db * v_bb
    return F.when((whole > 0) & (v > 0), v)


def diploid_state(states: Sequence[tuple[float, float, int]], least_share: float = 0.1, slack: float = 0.05) -> int:
    """Of states (depth, share, bins) that are balanced and common enough the one whose depth is nearest 1, ties to the first."""
    bins = sum(s[2] for s in states)
    fine = [i for i, (_, p, n) in enumerate(states) if n >= least_share * bins and abs(p - 0.5) <= slack]
    if not fine:
        raise ValueError("no balanced state is common enough")
    return min(fine, key=lambda i: (abs(1 - states[i][0]), i))


def _cost(states, chosen, base: float, weight: float) -> float:
    return sum(n * (weight * abs(d - (a + b) * base / 2) + abs(p - a / (a + b))) for (d, p, n), (a, b) in zip(states, chosen))


def climbed(states: Sequence[tuple[float, float, int]], diploid: int | None = None, most_total: int = 6, most_allele: int = 5, most_ploidy: int = 4, starts: int = 20, weight: float = 0.3, seed: int = 0) -> list[tuple[int, int]]:
    """Copy pairs by coordinate descent from seeded starts for each mean ploidy; the diploid state, if given, stays (1, 1).

    Without a diploid state depths are relative to the mean of the copies.
    Every restart is bounded by its ploidy and a half; the first of equal costs wins.
    """
    pairs, bins = copy_pairs(most_total, most_allele), sum(s[2] for s in states)
    best: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    for ploidy in range(1, most_ploidy + 1):
        rng = random.Random(seed)
        near = [p for p in pairs if sum(p) <= ploidy + 1]
        for _ in range(starts):
            chosen = [(1, 1) if i == diploid else rng.choice(near) for i in range(len(states))]

            def level(c: list[tuple[int, int]]) -> float:
                if sum(n * sum(x) for (_, _, n), x in zip(states, c)) > (ploidy + 0.5) * bins:
                    return float("inf")
                base = states[diploid][0] if diploid is not None else 2 * bins / sum(n * sum(x) for (_, _, n), x in zip(states, c))
                return _cost(states, c, base, weight)

            now = level(chosen)
            while True:
                step = min(((level([*chosen[:i], x, *chosen[i + 1 :]]), i, x) for i in range(len(states)) if i != diploid for x in pairs), key=lambda s: s[0], default=(now, 0, (1, 1)))
                if step[0] >= now - 1e-12:
                    break
                now, chosen = step[0], [*chosen[: step[1]], step[2], *chosen[step[1] + 1 :]]
            if now < best[0] - 1e-12:
                best = (now, chosen)
    return best[1]


def lattice_paths(cells: DataFrame, purities: Sequence[float], shifts: Sequence[float], alpha: float, tau: float, stay: float = 0.99, parsimony: float = 0.5, most_total: int = 6, most_allele: int = 5) -> tuple[DataFrame, DataFrame]:
    """((clone, purity, shift, log_likelihood), (clone, contig, bin, a, b)): each clone's purity and depth shift of greatest likelihood, and its best path of copy pairs.

    ``cells`` is (clone, contig, bin, umi, base, a, total).  All settings of
    the two short lists are chains side by side in one pass; pairs far from
    (1, 1) pay ``parsimony`` for each copy and bin.
    """
    pairs = copy_pairs(most_total, most_allele)
    k = len(pairs)
    trans, start = hmm.transitions(k, stay), [-math.log(k)] * k
    names = [f"e{i}" for i in range(k)]

    # emissions of each distinct cell, setting and pair once
    settings = cells.sparkSession.createDataFrame([(float(p), float(s)) for p in purities for s in shifts], "purity double, shift double")
    tried = cells.join(F.broadcast(settings), how="cross")  # a short list of settings
    a, b = F.col("s.a"), F.col("s.b")
    depth = F.ln(F.greatest(F.lit(1e-6), admixed_depth(a, b, F.col("purity")))) + F.col("shift")
    share = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), admixed_share(a, b, F.col("purity"))))
    level = nb_log_pmf(F.col("umi"), F.col("base"), depth, F.lit(alpha)) + F.when(F.col("total") > 0, bb_log_pmf(F.col("a"), F.col("total"), share, F.lit(tau))).otherwise(0.0) - parsimony * F.abs(a + b - 2)
    options = listed([{"k": i, "a": x, "b": y} for i, (x, y) in enumerate(pairs)], "k: int, a: int, b: int")
    tried = state_values(tried, ["umi", "base", "a", "total", "purity", "shift"], options, level, "__e").withColumns({n: F.get("__e", F.lit(i)) for i, n in enumerate(names)}).drop("__e")
    tried = tried.withColumn("__chain", F.concat_ws("/", *(F.col(c).cast("string") for c in ("clone", "contig", "purity", "shift"))))
    levels = hmm.forward(tried, "__chain", ["bin"], names, trans, start)
    chains = tried.select("__chain", "clone", "purity", "shift").distinct()
    sums = chains.join(levels, "__chain").groupBy("clone", "purity", "shift").agg(F.sum("log_likelihood").alias("log_likelihood"))
    best = first_rows(sums, "clone", F.desc("log_likelihood"), "purity", "shift")
    own = tried.join(best.select("clone", "purity", "shift"), ["clone", "purity", "shift"])
    path = hmm.viterbi(own, "__chain", ["bin"], names, trans, start)
    copies = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    found = path.join(own.select("__chain", "clone", "contig").distinct(), "__chain").withColumn("c", F.get(copies, F.col("state").cast("int")))
    return best, found.select("clone", "contig", "bin", F.col("c.a").cast("long").alias("a"), F.col("c.b").cast("long").alias("b"))


def swap_statistics(scores: DataFrame) -> DataFrame:
    """(c1, c2, s1, s2, t, n): over the bins where two clones have unlike states, the mean of own minus swapped log-likelihood.

    ``scores`` is (clone, bin, state, lls): the state of a clone's path and its
    log-likelihood under every state.
    """
    side = lambda i: scores.select(F.col("clone").alias(f"c{i}"), "bin", F.col("state").cast("int").alias(f"s{i}"), F.col("lls").alias(f"l{i}"))
    met = side(1).join(side(2), "bin").where("c1 < c2 AND s1 <> s2")
    gain = F.get("l1", F.col("s1")) - F.get("l1", F.col("s2")) + F.get("l2", F.col("s2")) - F.get("l2", F.col("s1"))
    return met.groupBy("c1", "c2", "s1", "s2").agg(F.avg(gain).alias("t"), F.count(F.lit(1)).alias("n"))


def mergeable(statistics: DataFrame, clones: DataFrame, least: float = 2.0, bins: int = 10, short: float = 20.0) -> DataFrame:
    """(c1, c2): pairs of clones that no event tells apart: none of ``bins`` or more with t at least ``least``, and no short one with n t over ``short``."""
    apart = statistics.where((F.col("n") >= bins) & (F.col("t") >= least) | (F.col("n") < bins) & (F.col("n") * F.col("t") >= short)).select("c1", "c2").distinct()
    ids = clones.select("clone").distinct()
    # some tens of clones
    pairs = ids.select(F.col("clone").alias("c1")).join(ids.select(F.col("clone").alias("c2")), F.col("c1") < F.col("c2"))
    return pairs.join(apart, ["c1", "c2"], "left_anti")


def clone_groups(pairs: list[tuple[int, int]], clones: list[int], weight: dict[int, float] | None = None) -> list[list[int]]:
    """Disjoint cliques of the merge graph: the largest first, of equal ones the lightest, then the smallest ids."""
    near: dict[int, set[int]] = {c: set() for c in clones}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    left, out = set(clones), []

    def cliques(held: set[int], open_: set[int], done: set[int]):
        if not open_ and not done:
            yield held
            return
        pivot = max(open_ | done, key=lambda v: (len(near[v] & open_), -v))
        for v in sorted(open_ - near[pivot]):
            yield from cliques(held | {v}, open_ & near[v], done & near[v])
            open_, done = open_ - {v}, done | {v}

    while left:
        best = min(cliques(set(), set(left), set()), key=lambda c: (-len(c), sum((weight or {}).get(v, 0.0) for v in c), sorted(c)))
        out.append(sorted(best))
        left -= best
        near = {v: n & left for v, n in near.items() if v in left}
    return out


def named_clones(profiles: DataFrame, clone: str, at: str, state: str, agreement: float) -> DataFrame:
    """(clone, merged): in the order of ids each clone joins the first earlier named one that agrees on at least that share of places.

    Agreements of pairs are counted on the cluster; only they, some tens
    squared, reach the driver, where the order is walked.
    """
    side = lambda i: profiles.select(F.col(clone).alias(f"c{i}"), F.col(at), F.col(state).alias(f"s{i}"))
    both = side(1).join(side(2), at).where("c1 < c2").groupBy("c1", "c2").agg(F.avg(F.col("s1").eqNullSafe(F.col("s2")).cast("double")).alias("share"))
    agree = {(r["c1"], r["c2"]) for r in both.where(F.col("share") >= agreement).collect()}
    named, rows = [], []
    for c in sorted(r[0] for r in profiles.select(clone).distinct().collect()):
        found = next((n for n in named if (n, c) in agree), None)
        if found is None:
            named.append(c)
        rows.append((c, c if found is None else found))
    kind = dict(profiles.dtypes)[clone]
    return profiles.sparkSession.createDataFrame(rows, f"`{clone}` {kind}, merged {kind}")
