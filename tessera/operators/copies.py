"""Integer copy states: the bounded lattice, nearest pairs, ploidy-bounded decoding and label matching."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lattice(spark, most_total: int, most_allele: int, phased: bool = True) -> DataFrame:
    """(a, b): pairs with 0 < a + b <= most_total and neither above most_allele; unphased keeps a >= b."""
    side = F.sequence(F.lit(0), F.lit(most_allele))
    pairs = spark.range(1).select(F.explode(side).alias("a")).select("a", F.explode(side).alias("b"))
    kept = pairs.where((F.col("a") + F.col("b") > 0) & (F.col("a") + F.col("b") <= most_total))
    return kept if phased else kept.where("a >= b")


def depth_and_share(a: Column, b: Column) -> tuple[Column, Column]:
    return (a + b) / 2.0, F.try_divide(b.cast("double"), a + b)


def nearest_pair(df: DataFrame, ident: str, depth: str, share: str, most_total: int, most_allele: int, weight: float = 0.3) -> DataFrame:
    """(ident, a, b, cost): the pair of least weight * |depth - (a + b) / 2| + |share - b / (a + b)|, ties to small total, then small a.

    Costs that agree to 12 digits tie.  The lattice is a literal array of at most (most_allele + 1)^2 pairs, so no
    join is needed.
    """
    pairs = sorted(((a, b) for a, b in itertools.product(range(most_allele + 1), repeat=2) if 0 < a + b <= most_total), key=lambda p: (sum(p), p[0]))
    options = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit((a + b) / 2).alias("d"), F.lit(b / (a + b)).alias("s")) for i, (a, b) in enumerate(pairs)))
    cost = F.transform(options, lambda p: F.struct(F.round(weight * F.abs(F.col(depth) - p["d"]) + F.abs(F.col(share) - p["s"]), 12).alias("cost"), p["i"].alias("i"), p["a"].alias("a"), p["b"].alias("b")))
    return df.select(ident, F.array_min(cost).alias("best")).select(ident, F.col("best.a").cast("long").alias("a"), F.col("best.b").cast("long").alias("b"), F.col("best.cost").alias("cost"))


def decode_within_ploidy(states: Sequence[tuple[float, float, int]], diploid: int, most_total: int = 6, most_allele: int = 5, most_ploidy: int = 4, weight: float = 0.3) -> list[tuple[int, int]]:
    """Copy pairs of states (depth, share, bins) of least cost, the diploid one (1, 1), under a mean-ploidy budget of 1 to most_ploidy and a half.

    Exact: the states are few and the budget is in whole copies times bins, so
    a table over (state, copies used) replaces a solver.
    """
    base = states[diploid][0]
    pairs = [(a, b) for a, b in itertools.product(range(most_allele + 1), repeat=2) if 0 < a + b <= most_total]
    bins = sum(s[2] for s in states)
    best: tuple[float, list[tuple[int, int]]] = (float("inf"), [])
    for ploidy in range(1, most_ploidy + 1):
        budget = int((ploidy + 0.5) * bins)
        table: dict[int, tuple[float, list[tuple[int, int]]]] = {0: (0.0, [])}
        for i, (depth, share, n) in enumerate(states):
            grown: dict[int, tuple[float, list[tuple[int, int]]]] = {}
            for used, (cost, chosen) in table.items():
                for a, b in [(1, 1)] if i == diploid else pairs:
                    now = used + n * (a + b)
                    if now > budget:
                        continue
                    c = cost + n * (weight * abs(depth - (a + b) * base / 2) + abs(share - a / (a + b)))
                    if now not in grown or c < grown[now][0]:
                        grown[now] = (c, [*chosen, (a, b)])
            table = grown
        if table and (found := min(table.values(), key=lambda x: x[0]))[0] < best[0]:
            best = found
    return best[1]


def match_labels(counts: dict[tuple[int, int], int]) -> dict[int, int]:
    """One-to-one matching of planted to fitted labels of greatest total overlap, for a table of at most some tens of labels."""
    rows, cols = sorted({a for a, _ in counts}), sorted({b for _, b in counts})
    size = max(len(rows), len(cols))
    cost = [[-counts.get((rows[i], cols[j]), 0) if i < len(rows) and j < len(cols) else 0 for j in range(size)] for i in range(size)]
    # shortest augmenting paths with potentials, one row at a time
    u, v, match = [0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        match[0], j = i, 0
        least, used, way = [float("inf")] * (size + 1), [False] * (size + 1), [0] * (size + 1)
        while True:
            used[j] = True
            row, gap, nxt = match[j], float("inf"), 0
            for k in range(1, size + 1):
                if not used[k]:
                    c = cost[row - 1][k - 1] - u[row] - v[k]
                    if c < least[k]:
                        least[k], way[k] = c, j
                    if least[k] < gap:
                        gap, nxt = least[k], k
            for k in range(size + 1):
                if used[k]:
                    u[match[k]] += gap
                    v[k] -= gap
                else:
                    least[k] -= gap
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    return {rows[match[j] - 1]: cols[j - 1] for j in range(1, size + 1) if match[j] - 1 < len(rows) and j - 1 < len(cols)}
