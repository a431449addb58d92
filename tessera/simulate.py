"""Synthetic samples: clone trees with copy events, layouts of clones on slices, and counts under the laws that the models assume.

Trees, placements and polygons are a few rows and are drawn on the driver from
a seed.  Counts are drawn where their spots are, each spot from a stream of its
own that follows from the seed and its id, so they do not depend on partitions.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Event:
    """A stretch of a chromosome whose copies become (a, b) on the edge above ``node``; later ``ord`` wins."""

    node: int
    ord: int
    chrom: int
    start: int
    end: int
    a: int
    b: int


def event_length(rng: random.Random, law: str, mean: float, least: float = 0.0, sigma: float = 0.5) -> float:
    """A length: fixed, exponential, or lognormal of that mean; never under ``least``."""
    if law == "fixed":
        return max(mean, least)
    if law == "exponential":
        return max(rng.expovariate(1 / mean), least)
    if law == "lognormal":
        return max(rng.lognormvariate(math.log(mean) - sigma * sigma / 2, sigma), least)
    raise ValueError(f"no length law {law}")


def placement(rng: random.Random, lengths: dict[int, int], law: str, mean: float, least: float = 0.0) -> tuple[int, int, int]:
    """(chromosome, start, end): a chromosome by its length, a length by the law, and a uniform start at which it fits."""
    chrom = rng.choices(sorted(lengths), weights=[lengths[c] for c in sorted(lengths)])[0]
    size = min(lengths[chrom], max(1, round(event_length(rng, law, mean, least))))
    start = rng.randrange(lengths[chrom] - size + 1)
    return chrom, start, start + size


def edge_counts(rng: random.Random, parents: dict[int, int], leaves: set[int], mean: float) -> dict[int, int]:
    """Events on the edge above each node: one and a Poisson number above leaves, a Poisson number elsewhere."""

    def poisson(m: float) -> int:
        n, p, stop = 0, rng.random(), math.exp(-m)
        while p > stop:
            n, p = n + 1, p * rng.random()
        return n

    return {node: (1 if node in leaves else 0) + poisson(mean) for node in sorted(parents)}


def clone_tree(clones: int, lengths: dict[int, int], mean_events: float = 2.0, law: str = "exponential", mean_length: float = 1e6, least: float = 1e4, most_copies: int = 4, reversible: bool = False, seed: int = 0) -> tuple[dict[int, int], list[Event]]:
    """(parents, events): a random binary tree over the clones, the root's copies (1, 1); a lost haplotype stays lost unless reversible."""
    rng = random.Random(seed)
    open_, parents, node = list(range(clones)), {}, clones
    while len(open_) > 1:
        a, b = rng.sample(open_, 2)
        parents[a] = parents[b] = node
        open_ = [x for x in open_ if x not in (a, b)] + [node]
        node += 1
    if clones == 1:
        parents[0] = node
    lost: dict[int, set[str]] = {}
    events: list[Event] = []
    # from the root down, so that what a parent lost is known
    for n in sorted(parents, key=lambda x: -x):
        held = set(lost.get(parents[n], set()))
        k = edge_counts(rng, {n: parents[n]}, {n} if n < clones else set(), mean_events)[n]
        for _ in range(k):
            chrom, start, end = placement(rng, lengths, law, mean_length, least)
            while True:
                a, b = rng.randrange(most_copies), rng.randrange(most_copies)
                if 0 < a + b <= most_copies and (a, b) != (1, 1) and (reversible or not ("a" in held and a) and not ("b" in held and b)):
                    break
            held |= {h for h, x in (("a", a), ("b", b)) if x == 0 and not reversible}
            events.append(Event(n, len(events), chrom, start, end, a, b))
        lost[n] = held
    return parents, events


def event_table(spark: SparkSession, parents: dict[int, int], events: list[Event], clones: int) -> DataFrame:
    """(clone, ord, chrom, start, end, a, b): the events of each clone's whole lineage, in the order from the root."""
    rows = []
    for c in range(clones):
        line, n = [c], c
        while n in parents:
            n = parents[n]
            line.append(n)
        rows += [(c, e.ord, e.chrom, e.start, e.end, e.a, e.b) for e in events if e.node in line]
    return spark.createDataFrame(rows, "clone long, ord long, chrom long, start long, end long, a long, b long")


def inside(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon, by the parity of the edges that a ray to the right crosses."""
    crossed = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1]):
        if y1 == y2:
            continue
        meets = (F.lit(min(y1, y2)) <= y) & (y < F.lit(max(y1, y2))) & (x < F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1)))
        crossed = crossed + meets.cast("int")
    return F.pmod(crossed, F.lit(2)) == 1


def sized_polygon(points: DataFrame, centre: tuple[float, float], corners: int, target: int, seed: int = 0, rounds: int = 24) -> list[tuple[float, float]]:
    """A seeded star-shaped polygon around ``centre`` whose size is halved in on until it holds about ``target`` points.

    Each round tries eight sizes in one pass over the points.
    """
    rng = random.Random(seed)
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    reach = [rng.uniform(0.6, 1.0) for _ in range(corners)]
    shape = lambda r: [(centre[0] + r * k * math.cos(t), centre[1] + r * k * math.sin(t)) for t, k in zip(angles, reach)]
    low, high = 0.0, 1.0
    box = points.agg(F.max(F.abs(F.col("x") - centre[0]) + F.abs(F.col("y") - centre[1])).alias("r")).first()["r"] or 1.0
    high = 4.0 * float(box) + 1
    for _ in range(max(1, rounds // 3)):
        sizes = [low + (high - low) * (i + 1) / 9 for i in range(8)]
        row = points.agg(*(F.count_if(inside(F.col("x"), F.col("y"), shape(r))).alias(f"n{i}") for i, r in enumerate(sizes))).first()
        below = [r for i, r in enumerate(sizes) if row[f"n{i}"] < target]
        above = [r for i, r in enumerate(sizes) if row[f"n{i}"] >= target]
        low, high = max(below, default=low), min(above, default=high)
    return shape(high)


def laid_out(points: DataFrame, polygons: list[list[tuple[float, float]]]) -> DataFrame:
    """``points`` with ``label``: i + 1 of the last polygon that holds them, 0 in none."""
    label = F.lit(0)
    for i, p in enumerate(polygons):
        label = F.when(inside(F.col("x"), F.col("y"), p), F.lit(i + 1)).otherwise(label)
    return points.withColumn("label", label.cast("long"))


def banded_layout(points: DataFrame, bands: int) -> DataFrame:
    """``points`` with ``label``: equal widths of the x axis."""
    ends = points.agg(F.min("x").alias("__lo"), F.max("x").alias("__hi"))  # one row
    place = F.floor(F.coalesce(F.try_divide((F.col("x") - F.col("__lo")) * bands, F.col("__hi") - F.col("__lo")), F.lit(0.0)))
    return points.join(F.broadcast(ends), how="cross").withColumn("label", F.least(F.lit(bands - 1), place).cast("long")).drop("__lo", "__hi")


def _stream(seed: int, ident: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([seed, ident & 0xFFFFFFFFFFFFFFFF]))


def dirichlet_multinomial(spots: DataFrame, weights: dict[int, list[float]], kappa: float, seed: int = 0, urn: bool = False) -> DataFrame:
    """(spot, gene, n): each spot's ``depth`` reads over genes with the shares of its ``label``, overdispersed by ``kappa``.

    By gamma draws, or with ``urn`` by Pólya's urn, whose time grows with the
    depth and not with the genes; the law is the same.
    """
    shares = {k: np.array(w) / sum(w) for k, w in weights.items()}

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for spot, label, depth in zip(part.spot, part.label, part.depth):
                rng, w = _stream(seed, int(spot)), shares[int(label)]
                if urn:
                    drawn: list[int] = []
                    fresh = rng.choice(len(w), size=int(depth), p=w)
                    for t in range(int(depth)):
                        drawn.append(int(fresh[t]) if rng.random() * (kappa + t) < kappa else drawn[int(rng.integers(t))])
                    n = np.bincount(drawn, minlength=len(w)) if drawn else np.zeros(len(w), np.int64)
                else:
                    g = rng.gamma(kappa * w)
                    n = rng.multinomial(int(depth), g / g.sum()) if g.sum() > 0 else rng.multinomial(int(depth), w)
                at = np.flatnonzero(n)
                out.append(pd.DataFrame({"spot": spot, "gene": at, "n": n[at]}))
            yield pd.concat(out) if out else pd.DataFrame({"spot": [], "gene": [], "n": []})

    return spots.select("spot", "label", "depth").mapInPandas(draw, "spot long, gene long, n long")


@dataclass(frozen=True)
class Mixture:
    """A mixture of negative binomials (weight, mean, dispersion)."""

    parts: tuple[tuple[float, float, float], ...]

    def mass(self, most: int) -> np.ndarray:
        """Probabilities of 0 to ``most``."""
        k = np.arange(most + 1)
        log_factorial = np.array([math.lgamma(i + 1) for i in k])
        out = np.zeros(most + 1)
        for w, mean, alpha in self.parts:
            r = 1 / max(alpha, 1e-10)
            p = 1 / (1 + alpha * mean)
            out += w * np.exp(np.array([math.lgamma(i + r) for i in k]) - math.lgamma(r) - log_factorial + r * math.log(p) + k * math.log(max(1e-300, 1 - p)))
        return out

    def draw(self, rng: np.random.Generator, n: int, positive: bool = False) -> np.ndarray:
        """Draws; with ``positive`` given that they are not 0."""
        w = np.array([p[0] for p in self.parts])
        out, left = np.zeros(n, np.int64), np.arange(n)
        while len(left):
            part = rng.choice(len(w), size=len(left), p=w / w.sum())
            mean, alpha = (np.array([p[i] for p in self.parts])[part] for i in (1, 2))
            out[left] = rng.poisson(rng.gamma(1 / np.maximum(alpha, 1e-10)) * mean * np.maximum(alpha, 1e-10))
            if not positive:
                break
            left = left[out[left] == 0]
        return out


def independent_entries(spark: SparkSession, rows: int, columns: int, law: Mixture, seed: int = 0) -> DataFrame:
    """(row, col, n): a matrix of independent entries of a mixture, its zeros left out."""
    share = 1 - float(law.mass(0)[0])

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.id:
                rng = _stream(seed, int(r))
                at = np.flatnonzero(rng.random(columns) < share)
                out.append(pd.DataFrame({"row": r, "col": at, "n": law.draw(rng, len(at), positive=True)}))
            yield pd.concat(out) if out else pd.DataFrame({"row": [], "col": [], "n": []})

    return spark.range(rows).mapInPandas(draw, "row long, col long, n long")


#: Totals up to which beta-binomial draws are inverted side by side, and pairs that are drawn together.
INVERTED, ABREAST = 512, 1 << 14


def uniforms(seed: int, *keys: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each row that follows from the seed and the row's keys alone (SplitMix64, a round for each key)."""
    state = np.full(len(keys[0]), seed & 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for key in keys:
            state = (state ^ key.astype(np.int64).view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            state = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            state = (state ^ (state >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            state ^= state >> np.uint64(31)
    return (state >> np.uint64(11)) * 2.0**-53


def inverted(u: np.ndarray, n: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """The beta-binomial's quantile at each ``u``: successes of ``n`` trials, by adding up its probabilities from none upward."""
    order = np.argsort(-n, kind="stable")
    u, n, alpha, beta = u[order], n[order], alpha[order], beta[order]
    # rows with more trials come first, so those that a step concerns are a prefix
    least = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1 if len(n) else 1), side="right")
    p = np.ones(len(n))
    for i, m in enumerate(least.tolist()):
        p[:m] *= (beta[:m] + i) / (alpha[:m] + beta[:m] + i)
    left, drawn = u - p, np.zeros(len(n), np.int64)
    for k, m in enumerate(least.tolist()):
        drawn[:m] += left[:m] >= 0
        p[:m] *= (n[:m] - k) / (k + 1) * (alpha[:m] + k) / np.where(n[:m] - k == 1, beta[:m], beta[:m] + n[:m] - k - 1)
        left[:m] -= p[:m]
    out = np.empty(len(n), np.int64)
    out[order] = drawn
    return out


def allele_reads(trials: DataFrame, tau: float, seed: int = 0) -> DataFrame:
    """(spot, snp, a, b): ``total`` reads of each pair split by a beta-binomial of its ``share``; ``flipped`` sites change sides.

    A pair's draw follows from the seed and its two ids.  Many pairs are drawn
    side by side; those of very many reads have a generator each.
    """

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            spot, snp, total = (part[c].to_numpy(np.int64) for c in ("spot", "snp", "total"))
            share = part["share"].to_numpy(float)
            alpha, beta = np.maximum(1e-9, share * tau), np.maximum(1e-9, (1 - share) * tau)
            a, u = np.zeros(len(part), np.int64), uniforms(seed, spot, snp)
            few = np.flatnonzero(total <= INVERTED)
            for lo in range(0, len(few), ABREAST):
                own = few[lo : lo + ABREAST]
                a[own] = inverted(u[own], total[own], alpha[own], beta[own])
            for i in np.flatnonzero(total > INVERTED).tolist():
                rng = np.random.Generator(np.random.PCG64([seed, int(spot[i]) & 0xFFFFFFFF, int(snp[i]) & 0xFFFFFFFF]))
                a[i] = rng.binomial(int(total[i]), rng.beta(alpha[i], beta[i]))
            b = total - a
            flip = part.flipped.to_numpy(bool)
            yield pd.DataFrame({"spot": spot, "snp": snp, "a": np.where(flip, b, a), "b": np.where(flip, a, b)})

    return trials.select("spot", "snp", "total", "share", "flipped").mapInPandas(draw, "spot long, snp long, a long, b long")


def unsegmented(bins: DataFrame, genes: int, seed: int = 0) -> DataFrame:
    """(bin, spot, gene, n): each bin's reads of a spot dealt out to its genes at random, so that they sum to the bin's."""

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for b, spot, umi in zip(part.bin, part.spot, part.umi):
                rng = np.random.Generator(np.random.PCG64([seed, int(b) & 0xFFFFFFFF, int(spot) & 0xFFFFFFFF]))
                n = rng.multinomial(int(umi), np.full(genes, 1 / genes))
                at = np.flatnonzero(n)
                out.append(pd.DataFrame({"bin": b, "spot": spot, "gene": int(b) * genes + at, "n": n[at]}))
            yield pd.concat(out) if out else pd.DataFrame({"bin": [], "spot": [], "gene": [], "n": []})

    return bins.select("bin", "spot", "umi").mapInPandas(split, "bin long, spot long, gene long, n long")


def stained(spots: DataFrame, pixels: int, colours: list[tuple[int, int, int]], seed: int = 0) -> DataFrame:
    """(row, col, red, green, blue): a mock slide on which each spot is a square of its label's colour with seeded noise."""
    side = F.sequence(F.lit(0), F.lit(pixels - 1))
    each = spots.withColumn("i", F.explode(side)).withColumn("j", F.explode(side))
    palette = F.array(*(F.array(*map(F.lit, c)) for c in colours))
    own = F.get(palette, (F.col("label") % len(colours)).cast("int"))
    noise = lambda k: (F.pmod(F.xxhash64("spot", "i", "j", F.lit(k), F.lit(seed)), F.lit(17)) - 8).cast("int")
    shade = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), F.get(own, F.lit(k)) + noise(k))).cast("int")
    return each.select((F.col("y") * pixels + F.col("i")).cast("long").alias("row"), (F.col("x") * pixels + F.col("j")).cast("long").alias("col"), shade(0).alias("red"), shade(1).alias("green"), shade(2).alias("blue"))


def sample_names(n: int, size: int = 4, seed: int = 0) -> list[str]:
    """Distinct hexadecimal names that do not read as numbers."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        name = rng.randbytes(size).hex()
        try:
            float(name)
        except ValueError:
            if name not in out:
                out.append(name)
    return out


def mock_map(spark: SparkSession, contigs: dict[int, int], step: int, rate: float = 1e-6, seed: int = 0) -> DataFrame:
    """(chr, pos, cm): a genetic map with a marker every ``step`` bases and a random rate in each interval."""
    from pyspark.sql import Window

    rows = spark.createDataFrame([(c, n) for c, n in contigs.items()], "chr long, length long")
    marks = rows.select("chr", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length"), F.lit(step).cast("long"))).alias("pos"))
    own = (F.pmod(F.xxhash64("chr", "pos", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) + 0.5) * (rate * step)
    along = Window.partitionBy("chr").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return marks.withColumn("__own", own).withColumn("cm", F.coalesce(F.sum("__own").over(along), F.lit(0.0))).drop("__own")
