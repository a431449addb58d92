"""Spots in the plane and their graphs: partitions, neighbours, Potts energy and labelling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import numbered
from tessera.staging import stage


def equal_bands(df: DataFrame, axis: str, ident: str, bands: int, name: str = "band") -> DataFrame:
    """Bands of near equal counts along an axis: floor((rank - 1) k / n), ties by id."""
    n = df.count()
    return numbered(df, axis, ident, name="__at").withColumn(name, F.floor(F.col("__at") * bands / n).cast("long")).drop("__at")


def grid(df: DataFrame, x: str, y: str, nx: int, ny: int, name: str = "cell") -> DataFrame:
    """Cells of an nx by ny grid over the bounding box, each open on the left and closed on the right."""
    box = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()

    def part(c: str, low, high, n: int) -> Column:
        edges = [low + (high - low) * i / n for i in range(1, n)] if low is not None else []
        return sum((F.when(F.col(c) > e, 1).otherwise(0) for e in edges), F.lit(0))

    return df.withColumn(name, (part(x, box["x0"], box["x1"], nx) * ny + part(y, box["y0"], box["y1"], ny)).cast("long"))


def nearest(df: DataFrame, ident: str, x: str, y: str, k: int, most_rings: int = 64) -> DataFrame:
    """(src, dst, rank, d2): the k nearest other points of each point, ties to the smaller id.

    Points meet those of grid cells around them; the ring widens, for points
    that are not yet settled, until the k-th neighbour lies within the cells
    that were searched.
    """
    box = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count(F.lit(1)).alias("n")).first()
    n = box["n"]
    if not n:
        return df.select(F.col(ident).alias("src"), F.col(ident).alias("dst"), F.lit(1).cast("long").alias("rank"), F.lit(0.0).alias("d2")).limit(0)
    side = max(box["x1"] - box["x0"], box["y1"] - box["y0"]) or 1.0
    width = side / max(1.0, math.sqrt(n / max(1, k)))
    at = lambda c, low: F.floor((F.col(c) - low) / width).cast("long")
    points = df.select(F.col(ident).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), at(x, box["x0"]).alias("cx"), at(y, box["y0"]).alias("cy"))
    own = points.select(F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    target = points.select(F.col("id").alias("dst"), F.col("x").alias("tx"), F.col("y").alias("ty"), "cx", "cy")
    reach = math.ceil(side / width) + 1
    done, open_, ring = None, own, 1
    while True:
        steps = F.sequence(F.lit(-ring), F.lit(ring))
        probes = open_.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps)).select("src", "sx", "sy", "ox", "oy", (F.col("ox") + F.col("dx")).alias("cx"), (F.col("oy") + F.col("dy")).alias("cy"))
        d2 = (F.col("sx") - F.col("tx")) * (F.col("sx") - F.col("tx")) + (F.col("sy") - F.col("ty")) * (F.col("sy") - F.col("ty"))
        pairs = probes.join(target, ["cx", "cy"]).where("src != dst").withColumn("d2", d2)
        first = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))).where(F.col("rank") <= k)
        # all points nearer than this lie in the cells that were searched
        inner = F.least(F.col("sx") - (box["x0"] + (F.col("ox") - ring) * width), (box["x0"] + (F.col("ox") + ring + 1) * width) - F.col("sx"), F.col("sy") - (box["y0"] + (F.col("oy") - ring) * width), (box["y0"] + (F.col("oy") + ring + 1) * width) - F.col("sy"))
        last = ring >= reach or ring >= most_rings * reach
        counted = first.withColumns({"__n": F.count(F.lit(1)).over(Window.partitionBy("src")), "__far": F.max("d2").over(Window.partitionBy("src")), "__in": inner})
        settled = F.lit(True) if last else (F.col("__n") >= min(k, n - 1)) & (F.col("__far") < F.col("__in") * F.col("__in"))
        found = stage(counted.withColumn("__ok", settled).select("src", "dst", F.col("rank").cast("long").alias("rank"), "d2", "__ok"), "nearest")
        good = found.where("__ok").drop("__ok")
        done = good if done is None else done.unionByName(good)
        if last:
            return done
        open_ = own.join(done.select("src").distinct(), "src", "left_anti")
        if open_.isEmpty():
            return done
        ring = min(2 * ring, reach)


def lattice_edges(df: DataFrame, ident: str, row: str, col: str, offsets: list[tuple[int, int]]) -> DataFrame:
    """(src, dst, w): neighbours by position plus offset, weighted (z/d_src + z/d_dst) / 2 with z the number of offsets."""
    steps = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets))).alias("o")
    probes = df.select(F.col(ident).alias("src"), F.col(row).alias("__r"), F.col(col).alias("__c"), steps).select("src", (F.col("__r") + F.col("o.r")).alias(row), (F.col("__c") + F.col("o.c")).alias(col))
    edges = probes.join(df.select(F.col(ident).alias("dst"), row, col), [row, col]).select("src", "dst")
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    z = float(len(offsets))
    both = edges.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
    return both.select("src", "dst", ((z / F.col("d") + z / F.col("d2")) / 2).alias("w"))


def potts_energy(field: DataFrame, edges: DataFrame, labels: DataFrame, beta: float) -> DataFrame:
    """One row (field, aligned, total): the labels' field plus beta times half the weight of edges with equal ends.

    field (spot, label, value), edges (src, dst, w) in both directions, labels
    (spot, label).
    """
    own = field.join(labels, ["spot", "label"]).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("field"))
    a, b = labels.select(F.col("spot").alias("src"), F.col("label").alias("la")), labels.select(F.col("spot").alias("dst"), F.col("label").alias("lb"))
    aligned = edges.join(a, "src").join(b, "dst").where("la = lb").agg((F.coalesce(F.sum("w"), F.lit(0.0)) / 2).alias("aligned"))
    return own.join(aligned, how="cross").select("field", "aligned", (F.col("field") + beta * F.col("aligned")).alias("total"))  # one row each


def merge_gains(field: DataFrame, edges: DataFrame, labels: DataFrame, beta: float) -> DataFrame:
    """(u, v, gain): what the objective gains when all of label u becomes v, for labels that touch."""
    unary = labels.withColumnRenamed("label", "u").join(field.withColumnRenamed("label", "v"), "spot").groupBy("u", "v").agg(F.sum("value").alias("s"))
    own = unary.where("u = v").select("u", F.col("s").alias("s_own"))
    a, b = labels.select(F.col("spot").alias("src"), F.col("label").alias("u")), labels.select(F.col("spot").alias("dst"), F.col("label").alias("v"))
    touch = edges.join(a, "src").join(b, "dst").where("u != v").groupBy("u", "v").agg(F.sum("w").alias("g"))
    back = touch.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("g").alias("g2"))
    moved = touch.join(back, ["u", "v"], "left").join(unary, ["u", "v"]).join(own, "u")
    gain = F.col("s") - F.col("s_own") + beta * (F.col("g") + F.coalesce("g2", F.lit(0.0))) / 2
    return moved.select("u", "v", gain.alias("gain"))


def icm(field: DataFrame, edges: DataFrame, labels: DataFrame, beta: float, sweeps: int = 5, colours: int = 8, seed: int = 0) -> DataFrame:
    """(spot, label): labels after sweeps in which spots of one colour move together to their best label.

    Spots take a new colour by hash for each sweep; one that has a neighbour of its colour with a
    smaller id waits, so no two neighbours move at once and the objective never
    falls.  Ties keep the smaller label.  Each sweep's labels are a written
    table.
    """
    for sweep in range(sweeps):
        colour = F.pmod(F.xxhash64("spot", F.lit(seed), F.lit(sweep)), F.lit(colours))
        for c in range(colours):
            moving = labels.where(colour == c).select("spot")
            rival = edges.join(moving.select(F.col("spot").alias("src")), "src").join(moving.select(F.col("spot").alias("dst")), "dst").where("dst < src").select(F.col("src").alias("spot")).distinct()
            free = moving.join(rival, "spot", "left_anti")
            near = edges.join(free.select(F.col("spot").alias("src")), "src").join(labels.select(F.col("spot").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("spot"), "label").agg(F.sum("w").alias("w"))
            local = field.join(free, "spot").join(near, ["spot", "label"], "left").withColumn("v", F.col("value") + beta * F.coalesce("w", F.lit(0.0)))
            best = local.groupBy("spot").agg(F.max_by("label", F.struct(F.col("v"), -F.col("label"))).alias("__best"))
            labels = stage(labels.join(best, "spot", "left").select("spot", F.coalesce("__best", "label").alias("label")), f"icm-{sweep}-{c}")
    return labels
