"""Moves of labels by exact minimum cuts: expansion to one label, and fusion of two labellings.

A move keeps a spot's first label or takes its second.  Its objective is a sum
over spots and edges of two-valued choices, which one cut minimises.  Most spots
need no cut: where what a spot gains or loses by itself outweighs all its edges,
its choice holds in some optimum whatever its neighbours do, and it passes what
its edges weigh on to them.  Such rounds are joins.  What is left falls into
connected pieces; each is cut by augmenting paths in its own task, whose memory
bounds a piece (some 300 bytes a spot), not the graph.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.graph import components
from tessera.operators import spatial
from tessera.operators.labelling import floor_labels
from tessera.staging import stage

#: What is left of a capacity, relative to the largest, that counts as nothing.
NOTHING = 1e-12


def choices(field: DataFrame, edges: DataFrame, first: DataFrame, second: DataFrame, weight: float) -> tuple[DataFrame, DataFrame]:
    """((spot, gain), (u, v, q)): what each spot gains by its second label alone, and what two neighbours lose by choosing unlike; both directions.

    An edge under which one spot alone changing aligns both, and not changing or
    both changing parts them, has no such form; choosing unlike then counts as
    the mean of choosing alike.  That understates labellings between the two,
    never the two themselves, so the best of the rest is still no worse than
    either.  A label that the field lacks, or has at -infinity, is not taken,
    and is left for one that it has.
    """
    value = lambda labels, name: labels.join(field, ["spot", "label"], "left").select("spot", F.col("label").alias(name), F.coalesce("value", F.lit(float("-inf"))).alias(f"v_{name}"))
    both = value(first, "a").join(value(second, "b"), "spot")
    both = stage(both, "choices")
    side = lambda c, x: both.select(F.col("spot").alias(c), F.col("a").alias(f"a{x}"), F.col("b").alias(f"b{x}"))
    half = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), (F.col("w") * (weight / 2)).alias("c"))
    pairs = half.groupBy("u", "v").agg(F.sum("c").alias("c")).join(side("u", 1), "u").join(side("v", 2), "v")
    apart = lambda x, y: F.when(F.col(x) == F.col(y), 0.0).otherwise(F.col("c"))
    pairs = pairs.withColumns({"e00": apart("a1", "a2"), "e11": apart("b1", "b2"), "e01": apart("a1", "b2"), "e10": apart("b1", "a2")})
    mean = (F.col("e00") + F.col("e11")) / 2
    unfit = F.col("e00") + F.col("e11") > F.col("e01") + F.col("e10")
    pairs = pairs.withColumns({"e01": F.when(unfit, mean).otherwise(F.col("e01")), "e10": F.when(unfit, mean).otherwise(F.col("e10"))})
    p = (F.col("e01") + F.col("e10") - F.col("e00") - F.col("e11")) / 2
    pairs = pairs.select("u", "v", p.alias("q"), (F.col("e00") - F.col("e10") + p).alias("gu"), (F.col("e10") - F.col("e11") - p).alias("gv"))
    pairs = stage(pairs, "pairs")
    pulls = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("spot"), F.col("gu").alias("g")), F.struct(F.col("v").alias("spot"), F.col("gv").alias("g")))).alias("x")).select("x.*").groupBy("spot").agg(F.sum("g").alias("pull"))
    own = F.when(F.col("v_b") == float("-inf"), F.lit(float("-inf"))).otherwise(F.col("v_b") - F.col("v_a"))
    nodes = both.join(pulls, "spot", "left").select("spot", (own + F.coalesce("pull", F.lit(0.0))).alias("gain"))
    near = pairs.where("q > 0").select(F.explode(F.array(F.struct("u", "v", "q"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "q"))).alias("x")).select("x.*")
    return stage(nodes, "gains"), stage(near, "near")


def decided(nodes: DataFrame, near: DataFrame, rounds: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((spot, x), nodes left, edges left): the spots whose choice holds whatever the others do, and the rest with what these weigh on them.

    Rounds only shorten what is left to cut; any number of them is exact.
    """
    done = None
    for _ in range(rounds):
        reach = near.groupBy(F.col("u").alias("spot")).agg(F.sum("q").alias("reach"))
        judged = nodes.join(reach, "spot", "left").withColumn("reach", F.coalesce("reach", F.lit(0.0)))
        sure = stage(judged.select("spot", F.when(F.col("gain") > F.col("reach"), 1).when(F.col("gain") <= -F.col("reach"), 0).alias("x"), "gain"), "sure")
        found = sure.where("x IS NOT NULL").select("spot", "x")
        done = found if done is None else done.unionByName(found)
        if found.isEmpty():
            return done, nodes, near
        weighs = near.join(found.withColumnRenamed("spot", "u"), "u").groupBy(F.col("v").alias("spot")).agg(F.sum(F.when(F.col("x") == 1, F.col("q")).otherwise(-F.col("q"))).alias("more"))
        nodes = stage(sure.where("x IS NULL").join(weighs, "spot", "left").select("spot", (F.col("gain") + F.coalesce("more", F.lit(0.0))).alias("gain")), "gains")
        left = nodes.select("spot")
        near = stage(near.join(left.withColumnRenamed("spot", "u"), "u", "left_semi").join(left.withColumnRenamed("spot", "v"), "v", "left_semi"), "near")
    return done, nodes, near


def minimum_cut(gains: list[float], edges: Iterable[tuple[int, int, float]]) -> list[bool]:
    """Which spots take: the fewest that gain most in total, less q for each undirected edge (i, j, q) between unlike choices.

    Levels by breadth from the side of the gains, then augmenting paths along
    them, until the other side is out of reach.
    """
    n = len(gains)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(i: int, j: int, forth: float, back: float) -> None:
        out[i].append(len(to))
        to.append(j)
        cap.append(forth)
        out[j].append(len(to))
        to.append(i)
        cap.append(back)

    for i, g in enumerate(gains):
        if g > 0:
            arc(source, i, g, 0.0)
        elif g < 0:
            arc(i, sink, -g, 0.0)
    for i, j, q in edges:
        arc(i, j, q, q)
    least = NOTHING * max(cap, default=0.0)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            i = queue.popleft()
            for e in out[i]:
                if cap[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        i = source
        while True:
            if i == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                # back to the first arc that is full
                k = next(k for k, e in enumerate(path) if cap[e] <= least)
                i = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[i] < len(out[i]):
                e = out[i][at[i]]
                if cap[e] > least and level[to[e]] == level[i] + 1:
                    break
                at[i] += 1
            if at[i] < len(out[i]):
                path.append(out[i][at[i]])
                i = to[path[-1]]
            elif path:
                i = to[path.pop() ^ 1]
                at[i] += 1
            else:
                break


def cut(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """(spot, x): the cut of each connected piece of (spot, gain) and (u, v, q), an edge in both directions."""
    if nodes.isEmpty():
        return nodes.select("spot", F.lit(0).alias("x"))
    root = stage(components(near.select("u", "v"), "u", "v"), "pieces")
    pieces = nodes.join(root.withColumnRenamed("node", "spot"), "spot", "left").select(F.coalesce("root", "spot").alias("root"), "spot", "gain")
    links = near.where("u < v").join(root.withColumnRenamed("node", "u"), "u").select("root", "u", "v", "q")

    def solve(own: pd.DataFrame, between: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("spot")
        place = {s: i for i, s in enumerate(own["spot"])}
        between = between.sort_values(["u", "v"])
        taken = minimum_cut(own["gain"].tolist(), zip(map(place.get, between["u"]), map(place.get, between["v"]), between["q"].tolist()))
        return pd.DataFrame({"spot": own["spot"], "x": [int(t) for t in taken]})

    kind = dict(nodes.dtypes)["spot"]
    return pieces.groupBy("root").cogroup(links.groupBy("root")).applyInPandas(solve, f"spot {kind}, x int")


def fused(field: DataFrame, edges: DataFrame, first: DataFrame, second: DataFrame, weight: float) -> DataFrame:
    """(spot, label): for each spot of ``first`` its label there or the one in ``second``, together of greatest objective (see ``choices``).

    ``field`` is (spot, label, value), ``edges`` (src, dst, w) in both
    directions or one, labels are (spot, label); the objective is
    ``spatial.potts_energy``.  Spots change only where that gains: of equal
    optima it is the one with fewest changes.  Spots that ``second`` lacks keep
    theirs; a NULL weight, an edge to itself or to a spot without a label says
    nothing.
    """
    nodes, near = choices(field, edges.where("w IS NOT NULL"), first, second, weight)
    done, nodes, near = decided(nodes, near)
    taken = done.unionByName(cut(nodes, near)).where("x = 1").select("spot")
    new = second.join(taken, "spot").select("spot", F.col("label").alias("__new"))
    return stage(first.join(new, "spot", "left").select("spot", F.coalesce("__new", "label").alias("label")), "fused")


def expansion(field: DataFrame, edges: DataFrame, labels: DataFrame, weight: float, label: int) -> DataFrame:
    """(spot, label): the best labelling in which every spot keeps its label or takes ``label``."""
    return fused(field, edges, labels, labels.select("spot", F.lit(label).cast(dict(labels.dtypes)["label"]).alias("label")), weight)


def alpha_expansion(field: DataFrame, edges: DataFrame, labels: DataFrame, weight: float, label_ids: list[int], cycles: int = 5, tolerance: float = 1e-9) -> tuple[DataFrame, list[float]]:
    """(labels, objective after each cycle): expansions to each label in turn, until a whole cycle gains nothing.

    The objective never falls, and at the end no single expansion gains.
    """
    total = lambda x: spatial.potts_energy(field, edges, x, weight).first()["total"]
    levels = [total(labels)]
    for _ in range(cycles):
        for label in label_ids:
            labels = expansion(field, edges, labels, weight, label)
        levels.append(total(labels))
        if levels[-1] - levels[-2] <= tolerance * max(1.0, abs(levels[-1])):
            break
    return labels, levels


def fused_and_floored(field: DataFrame, edges: DataFrame, labels: DataFrame, weight: float, label_ids: list[int], floor: int = 0, sweeps: int = 4, cycles: int = 5) -> DataFrame:
    """(spot, label): expansions from ``labels`` fused with single-spot descent from each spot's best label, then small labels emptied."""
    expanded, _ = alpha_expansion(field, edges, labels, weight, label_ids, cycles)
    best = field.join(labels.select("spot"), "spot", "left_semi").groupBy("spot").agg(F.max_by("label", F.struct("value", -F.col("label"))).alias("label"))
    descended = spatial.icm(field, edges, best, weight, sweeps=sweeps)
    whole = fused(field, edges, expanded, descended, weight)
    return floor_labels(field, whole, floor) if floor else whole
