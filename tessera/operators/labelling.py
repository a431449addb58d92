"""Labels of spots: starts, floors, neighbour graphs of several slices, prior-folded fields and expansion moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import spatial
from tessera.operators.ranking import densified
from tessera.operators.scoring import adjusted_rand, contingency
from tessera.staging import stage


def label_shares(labels: DataFrame, label: str = "label", n: int | None = None) -> DataFrame:
    """(label, share): each label's part of all rows; with ``n``, labels 0 to n - 1 that no row has get 0."""
    sums = labels.groupBy(label).agg(F.count(F.lit(1)).alias("k"))
    whole = sums.agg(F.sum("k").alias("whole"))  # one row
    shares = sums.join(F.broadcast(whole), how="cross").select(label, (F.col("k") / F.col("whole")).alias("share"))
    if n is None:
        return shares
    every = labels.sparkSession.range(n).select(F.col("id").cast(dict(labels.dtypes)[label]).alias(label))
    return every.join(shares, label, "left").select(label, F.coalesce("share", F.lit(0.0)).alias("share"))


def members(labels: DataFrame, spot: str = "spot", label: str = "label") -> DataFrame:
    """(label, spots): the spots of each label, sorted."""
    return labels.groupBy(label).agg(F.sort_array(F.collect_list(spot)).alias("spots"))


def from_members(groups: DataFrame, label: str = "label") -> DataFrame:
    """(spot, label): one row for each member of each label's list."""
    return groups.select(F.explode("spots").alias("spot"), label)


def label_faults(labels: DataFrame, label: str = "label") -> DataFrame:
    """One row (labels, least, most, dense): whether labels are 0 to n - 1 without a gap."""
    sums = labels.agg(F.count_distinct(label).alias("labels"), F.min(label).alias("least"), F.max(label).alias("most"))
    return sums.withColumn("dense", (F.col("least") == 0) & (F.col("most") == F.col("labels") - 1))


def folded(field: DataFrame, prior: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """``field`` (spot, slice, label, value) with each slice's label prior added, and -infinity where a label is not allowed.

    Of these only the prior, which has a row for each slice and label, may be
    broadcast; a list of what is allowed is as large as the field.
    """
    out = field
    if prior is not None:
        out = out.join(prior.withColumnRenamed("log_weight", "__p"), ["slice", "label"], "left").withColumn("value", F.col("value") + F.coalesce("__p", F.lit(0.0))).drop("__p")
    if allowed is not None:
        marked = out.join(allowed.select("spot", "label").repartition("spot", "label").distinct().withColumn("__ok", F.lit(True)).hint("merge"), ["spot", "label"], "left")
        out = marked.withColumn("value", F.when(F.col("__ok"), F.col("value")).otherwise(F.lit(float("-inf")))).drop("__ok")
    return out


def finite(field: DataFrame, edges: DataFrame, weight: float) -> DataFrame:
    """``field`` with a finite penalty for -infinity that no gain can pay: each spot's least value less the weight of its own edges, less 1.

    Edges that run one way count half at either end.  A spot without any
    finite value has no labelling: the row fails when it is read.
    """
    fine = F.col("value") > float("-inf")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("spot"), (F.abs("w") / 2).alias("w")).groupBy("spot").agg(F.sum("w").alias("__reach"))
    least = field.groupBy("spot").agg(F.min(F.when(fine, F.col("value"))).alias("__least"))
    price = least.join(ends, "spot", "left").select("spot", (F.coalesce("__least", F.raise_error(F.concat(F.lit("every label is forbidden at spot "), F.col("spot").cast("string"))).cast("double")) - weight * F.coalesce("__reach", F.lit(0.0)) - 1).alias("__price"))
    return field.join(price, "spot").withColumn("value", F.when(fine, F.col("value")).otherwise(F.col("__price"))).select(*field.columns)


def floor_labels(field: DataFrame, labels: DataFrame, floor: int, most_rounds: int = 100) -> DataFrame:
    """(spot, label): the smallest label under the floor is emptied first, each of its spots going to its best label that is left.

    Spots without an allowed label that is left stay.  A round costs a pass;
    labels are few, and only their counts reach the driver.
    """
    held = stage(labels.select("spot", "label"), "labels")
    gone: list = []
    for _ in range(most_rounds):
        sizes = sorted((r["n"], r["label"]) for r in held.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect() if r["label"] not in gone)
        if len(sizes) < 2 or sizes[0][0] >= floor:
            return held
        gone.append(sizes[0][1])
        out = held.where(F.col("label") == gone[-1]).select("spot")
        best = field.where(~F.col("label").isin(gone) & (F.col("value") > float("-inf"))).join(out, "spot", "left_semi").groupBy("spot").agg(F.max_by("label", F.struct(F.col("value"), -F.col("label"))).alias("best"))
        held = stage(held.join(best, "spot", "left").select("spot", F.coalesce("best", "label").alias("label")), "labels")
    return held


def expansion(field: DataFrame, edges: DataFrame, labels: DataFrame, weight: float, label: int, colours: int = 4, sweeps: int = 8) -> DataFrame:
    """(spot, label): one expansion move, in which every spot keeps its label or takes ``label``, by descent from taking it everywhere it helps.

    The descent takes neighbours that both keep as aligned, which unlike old
    labels are not; the better of its result and of the labels that went in, by
    the whole objective, is returned, so that a move never loses.
    """
    keep = labels.select("spot", F.col("label").alias("old"))
    own = field.join(keep, "spot")
    two = own.where(F.col("label") == F.col("old")).select("spot", F.lit(0).cast("long").alias("label"), "value").unionByName(own.where(F.col("label") == label).select("spot", F.lit(1).cast("long").alias("label"), "value"))
    start = keep.select("spot", F.lit(1).cast("long").alias("label"))
    moved = spatial.icm(two, edges, start, weight, sweeps=sweeps, colours=colours)
    new = stage(moved.join(keep, "spot").select("spot", F.when(F.col("label") == 1, F.lit(label)).otherwise(F.col("old")).alias("label")), "expanded")
    total = lambda x: spatial.potts_energy(field, edges, x, weight).first()["total"] or float("-inf")
    return new if total(new) >= total(labels) else labels


def grid_starts(spots: DataFrame, across: int, down: int, slice_: str = "slice") -> DataFrame:
    """``spots`` with ``label``: cells of a grid over each slice's own range, numbered on from slice to slice."""
    ranges = spots.groupBy(slice_).agg(*(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))))
    codes = densified(spots, slice_, "__slice")
    met = spots.join(F.broadcast(ranges), slice_).join(F.broadcast(codes), slice_)
    place = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil(F.coalesce(F.try_divide((F.col(c) - F.col(f"lo_{c}")) * n, F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0))) - 1))
    label = F.col("__slice") * (across * down) + place("x", across) * down + place("y", down)
    return met.select(*spots.columns, label.cast("long").alias("label"))


def feasible(sizes: list[int], labels: int, floor: int) -> bool:
    """Whether blocks of these sizes can be shared out so that every label holds at least ``floor``."""
    left = sorted(sizes, reverse=True)

    def fill(need: list[int], at: int) -> bool:
        if all(n <= 0 for n in need):
            return True
        if at == len(left) or sum(left[at:]) < sum(max(0, n) for n in need):
            return False
        tried = set()
        for i, n in enumerate(need):
            if n > 0 and n not in tried:
                tried.add(n)
                if fill([*need[:i], n - left[at], *need[i + 1 :]], at + 1):
                    return True
        return False

    return fill([floor] * labels, 0)


def block_starts(spots: DataFrame, labels: int, seed: int = 0, tries: int = 50) -> DataFrame:
    """``spots`` with ``label``: seeded random blocks of a grid dealt to labels so that each has over a fifth of an equal share.

    Block sizes alone reach the driver.  Where no deal is found in ``tries``,
    equal bands along the axis of more values are taken.
    """
    import random

    rng = random.Random(seed)
    side = max(2, labels)
    cells = grid_starts(spots.withColumn("__one", F.lit(0)), side, side, "__one").withColumnRenamed("label", "__block").drop("__one")
    sizes = {r["__block"]: r["n"] for r in cells.groupBy("__block").agg(F.count(F.lit(1)).alias("n")).collect()}
    floor = int(0.2 * sum(sizes.values()) / labels) + 1
    if feasible(list(sizes.values()), labels, floor):
        for _ in range(tries):
            deal = {b: rng.randrange(labels) for b in sorted(sizes)}
            held = [sum(n for b, n in sizes.items() if deal[b] == k) for k in range(labels)]
            if min(held) >= floor:
                dealt = F.create_map(*(x for b, k in deal.items() for x in (F.lit(b).cast("long"), F.lit(k).cast("long"))))
                return cells.withColumn("label", F.try_element_at(dealt, F.col("__block"))).drop("__block")
    axis = "x" if (r := spots.agg(F.count_distinct("x").alias("x"), F.count_distinct("y").alias("y")).first())["x"] >= r["y"] else "y"
    return spatial.equal_bands(spots, axis, "spot", labels).withColumnRenamed("band", "label")


def refined_starts(spots: DataFrame, weights: DataFrame, parts: int, needed: float) -> DataFrame:
    """(spot, label, parent): each parent label cut into bands of equal counts, ``parts`` of them where its weight reaches ``needed`` and one elsewhere."""
    met = spots.join(weights.groupBy("parent").agg(F.sum("w").alias("w")), "parent", "left")
    order = Window.partitionBy("parent").orderBy("x", "y", "spot")
    n = F.count(F.lit(1)).over(Window.partitionBy("parent"))
    band = F.when(F.coalesce("w", F.lit(0)) >= needed, F.floor((F.row_number().over(order) - 1) * parts / n)).otherwise(F.lit(0))
    return met.select("spot", (F.col("parent") * parts + band).cast("long").alias("label"), "parent")


def allowed_labels(starts: DataFrame) -> DataFrame:
    """(spot, label): the labels that share a spot's parent, which are all that it may take."""
    own = starts.select("parent", "label").distinct()
    return starts.select("spot", "parent").join(own, "parent").select("spot", "label")


def trial_partitions(spots: DataFrame, across: int, down: int, trials: int, seed: int = 0) -> DataFrame:
    """One row (trial, variance): of seeded random grids the one whose cells vary least in size, ties to the earlier.

    Positions are counted once; the trials meet the distinct positions, not the spots.
    """
    held = spots.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    box = spots.agg(*(f(c).alias(f"{m}_{c}") for c in ("x", "y") for m, f in (("lo", F.min), ("hi", F.max))))  # one row
    cut = lambda c, i: F.col(f"lo_{c}") + (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * (F.pmod(F.xxhash64(F.lit(seed), F.col("trial"), F.lit(c), F.lit(i)), F.lit(1 << 20)) / float(1 << 20))
    drawn = spots.sparkSession.range(trials).withColumnRenamed("id", "trial").join(F.broadcast(box), how="cross")
    edges = drawn.select("trial", *(F.array_sort(F.array(*(cut(c, i) for i in range(n - 1)))).alias(f"cuts_{c}") if n > 1 else F.array().cast("array<double>").alias(f"cuts_{c}") for c, n in (("x", across), ("y", down))))
    # a stated number of trials against the positions, in one pass
    met = held.join(F.broadcast(edges), how="cross")
    at = lambda c: F.size(F.filter(f"cuts_{c}", lambda e: e < F.col(c)))
    cells = met.groupBy("trial", at("x").alias("i"), at("y").alias("j")).agg(F.sum("n").alias("n"))
    full = across * down
    spread = cells.groupBy("trial").agg((F.sum(F.col("n") * F.col("n")) / full - F.pow(F.sum("n") / full, F.lit(2))).alias("variance"))
    return spread.agg(F.min(F.struct("variance", "trial")).alias("b")).select("b.trial", "b.variance")


def slices_graph(spots: DataFrame, k: int = 0, offsets: list[tuple[int, int]] | None = None, across: DataFrame | None = None) -> DataFrame:
    """(src, dst, w): each slice's own graph, of k nearest neighbours or of lattice offsets, and given edges between slices.

    Slices are apart by construction: a slice's number is a coordinate that no
    cell of the neighbour search shares.
    """
    codes = densified(spots, "slice", "__slice")
    met = spots.join(F.broadcast(codes), "slice")
    span = met.agg(F.coalesce(F.max("x") - F.min("x"), F.lit(0)).alias("s"), F.coalesce(F.max("y") - F.min("y"), F.lit(0)).alias("t")).first()
    gap = 4 * (int((span["s"] or 0) + (span["t"] or 0)) + 1)
    apart = met.withColumn("x", F.col("x") + F.col("__slice") * gap)
    if offsets:
        edges = spatial.lattice_edges(apart.select("spot", "x", "y"), "spot", "x", "y", offsets)
    else:
        edges = spatial.nearest(apart.select("spot", "x", "y"), "spot", "x", "y", k).select("src", "dst", F.lit(1.0).alias("w"))
    # a slice of at most k spots has neighbours in another one, which are dropped
    slice_of = lambda c: spots.select(F.col("spot").alias(c), F.col("slice").alias(f"slice_{c}"))
    edges = edges.join(slice_of("src"), "src").join(slice_of("dst"), "dst").where("slice_src = slice_dst").select("src", "dst", "w")
    return edges if across is None else edges.unionByName(across.select("src", "dst", "w"))


def no_edges(spark) -> DataFrame:
    """An empty edge table: slices without known alignments have no edges between them."""
    return spark.createDataFrame([], "src long, dst long, w double")


def aligned_spots(weights: DataFrame, significance: float) -> DataFrame:
    """(src, dst, w): of each row of an alignment the columns within ``significance`` of its largest weight."""
    most = F.max("w").over(Window.partitionBy("src"))
    return weights.withColumn("__m", most).where((F.col("w") > 0) & (F.col("w") >= significance * F.col("__m"))).drop("__m")


def lattice_kind(spots: DataFrame) -> DataFrame:
    """(slice, kind): ``square`` where any spot of a slice has one beside it along an axis, else ``triangular`` where any has one diagonally or two columns off, else ``none``."""
    held = spots.select("slice", "x", "y").distinct()
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(axis).alias("axis")) for dx, dy, axis in ((1, 0, True), (0, 1, True), (1, 1, False), (-1, 1, False), (2, 0, False))))
    asked = held.select("slice", "x", "y", F.explode(steps).alias("s")).select("slice", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "s.axis")
    met = asked.join(held, ["slice", "x", "y"]).groupBy("slice").agg(F.bool_or("axis").alias("axis"))
    return held.select("slice").distinct().join(met, "slice", "left").select("slice", F.when(F.col("axis"), "square").when(~F.col("axis"), "triangular").otherwise("none").alias("kind"))


def edge_faults(edges: DataFrame, degree: int | None = None, reciprocity: float = 0.6) -> DataFrame:
    """(fault, n): self loops, repeated edges, spots of another degree than ``degree``, and too few edges that run both ways."""
    loops = edges.where("src = dst").agg(F.count(F.lit(1)).alias("n")).select(F.lit("loops").alias("fault"), "n")
    repeats = edges.groupBy("src", "dst").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeats").alias("fault"), "n")
    back = edges.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("src")).distinct(), ["src", "dst"], "left_semi").count()
    total = edges.count()
    one_way = edges.sparkSession.range(1).select(F.lit("one way").alias("fault"), F.lit(total - back if total and back < reciprocity * total else 0).cast("long").alias("n"))
    out = loops.unionByName(repeats).unionByName(one_way)
    if degree is not None:
        wrong = edges.groupBy("src").count().where(F.col("count") != degree).agg(F.count(F.lit(1)).alias("n")).select(F.lit("degree").alias("fault"), "n")
        out = out.unionByName(wrong)
    return out.where("n > 0")


def lattice_faults(edges: DataFrame, degree: int | None = None, tolerance: float = 1e-9) -> DataFrame:
    """(fault, n): what keeps an edge table from being a lattice's: loops, repeats, edges without an equal one back, and weights that are not the boundary's.

    Inner spots have ``degree`` neighbours (the most that any has, if not
    given); an edge weighs the mean of degree / d over its ends' own degrees d.
    """
    edges = stage(edges.select("src", "dst", "w"), "edges")
    # both directions of a pair meet in one group, so no table of edges is joined to itself; an edge without an end has no other way
    ways = edges.select("src", "dst", F.col("w").alias("__w"), F.lit(0).alias("__back"))
    ways = ways.unionByName(edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("__w"), F.lit(1).alias("__back")))
    there, back = F.col("__back") == 0, F.col("__back") == 1
    w = F.col("__w")
    pairs = ways.groupBy("src", "dst").agg(
        F.count_if(there).alias("n"), F.count_if(back).alias("n_back"), F.count_if(back & w.isNull()).alias("none_back"),
        F.min(F.when(there, w)).alias("low"), F.max(F.when(there, w)).alias("high"), F.min(F.when(back, w)).alias("low_back"), F.max(F.when(back, w)).alias("high_back"),
    ).where("n > 0")
    unlike = (F.col("low") != F.col("high_back")) | (F.col("high") != F.col("low_back"))
    one_way = (F.col("n_back") == 0) | (F.col("none_back") > 0) | F.coalesce(unlike, F.lit(False))
    of_pairs = pairs.agg(F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n"))), F.lit(0)).alias("loops"), F.count_if(F.col("n") > 1).alias("repeats"), F.count_if(one_way).alias("one way"))
    degrees = stage(edges.groupBy("src").agg(F.count(F.lit(1)).alias("d")), "degrees")
    most = degrees.agg(F.max("d").alias("z")).first()["z"] if degree is None else degree
    # spots are as many as the rows allow, so neither side is broadcast
    side = lambda c: degrees.select(F.col("src").alias(c), F.col("d").alias(f"d_{c}")).hint("merge")
    z = F.lit(None).cast("long") if most is None else F.lit(most)
    due = (z / F.col("d_src") + z / F.coalesce("d_dst", F.lit(1))) / 2
    wrong = edges.join(side("src"), "src").join(side("dst"), "dst", "left").where(F.abs(F.col("w") - due) > tolerance)
    counts = of_pairs.select(F.inline(F.array(*(F.struct(F.lit(c).alias("fault"), F.col(c).alias("n")) for c in ("loops", "repeats", "one way")))))
    return counts.unionByName(wrong.agg(F.count(F.lit(1)).alias("n")).select(F.lit("weights").alias("fault"), "n")).where("n > 0")


def cluster_costs(field: DataFrame, edges: DataFrame, cluster: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, node, edge): for each label, the cluster's field and the weight of its edges to spots with it; edges inside add half to every label."""
    inside = cluster.select("spot").distinct()
    node = field.join(inside, "spot", "left_semi").groupBy("label").agg(F.sum("value").alias("node"))
    mark = lambda c: inside.select(F.col("spot").alias(c), F.lit(True).alias(f"in_{c}"))
    out = edges.join(mark("src"), "src").join(mark("dst"), "dst", "left")
    within = out.where("in_dst").agg(F.coalesce(F.sum("w") / 2, F.lit(0.0)).alias("__within"))  # one row
    outer = out.where("in_dst IS NULL").join(labels.select(F.col("spot").alias("dst"), "label"), "dst").groupBy("label").agg(F.sum("w").alias("outer"))
    return node.join(outer, "label", "left").join(F.broadcast(within), how="cross").select("label", "node", (F.coalesce("outer", F.lit(0.0)) + F.col("__within")).alias("edge"))


def field_strength(field: DataFrame, planted: DataFrame) -> DataFrame:
    """One row (margin, q10, wrong, ari): how clearly a field tells planted labels.

    A spot's margin is its planted label's value less the best of the others';
    given are the margins' median and tenth percentile, the share below 0, and
    the adjusted Rand index of each spot's best label, ties to the smaller.
    Spots without a value for their label or for another take no part in the
    margins.
    """
    # tables of a row for each spot are hashed where the field's rows stream by, which are many times as many and are never sorted
    own = planted.select("spot", F.col("label").alias("__own")).hint("shuffle_hash")
    is_own = F.col("label") == F.col("__own")
    tops = field.join(own, "spot").groupBy("spot", "__own").agg(F.max(F.when(is_own, F.col("value"))).alias("v"), F.max(F.when(~is_own, F.col("value"))).alias("o"), F.max("value").alias("__top"))
    met = field.join(tops.hint("shuffle_hash"), "spot")
    each = met.groupBy("spot", "__own", "v", "o").agg(F.min(F.when(F.col("value").eqNullSafe(F.col("__top")), F.col("label"))).alias("best"))
    each = stage(each.select(F.col("__own").alias("planted"), "best", (F.col("v") - F.col("o")).alias("margin")), "margins")
    sums = each.agg(F.percentile("margin", F.lit(0.5)).alias("margin"), F.percentile("margin", F.lit(0.1)).alias("q10"), F.avg((F.col("margin") < 0).cast("double")).alias("wrong"))
    ari = adjusted_rand(contingency(each, "planted", "best"), "planted", "best").select("ari")
    return sums.join(ari, how="cross")  # one row each


def overdispersion(cells: DataFrame, successes: str, trials: str, share: str) -> DataFrame:
    """One row (rho): the beta-binomial overdispersion by moments, over cells of two trials or more with the given shares; NULL without any."""
    n, b, p = F.col(trials), F.col(successes), F.col(share)
    kept = cells.where(n >= 2)
    return kept.agg(F.try_divide(F.sum((b - n * p) * (b - n * p) - n * p * (1 - p)), F.sum(n * (n - 1) * p * (1 - p))).alias("rho"))
