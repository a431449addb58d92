"""Starting states of a mixture of count cells: from the lattice of integer copies, classified and then polished.

A cell is (total, exposure, b, trials): reads against an expectation, and reads
of one allele among some.  Every pass goes over the distinct cells with their
multiplicities and returns sums alone, one row for each setting and candidate,
so the driver holds a grid of settings and never cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.special import log_gamma
from tessera.operators.decode import copy_pairs
from tessera.staging import stage

#: Purities and depth scales that are tried, and where shapes are looked for.
PURITIES = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)
SCALES = tuple(math.exp(-0.15 + 0.05 * i) for i in range(7))
SIZES, CONCENTRATIONS, ERRORS = (0.5, 1e4), (1.0, 1e6), (1e-4, 0.1)
#: The shapes before any is fitted.
SIZE, CONCENTRATION, ERROR = 20.0, 200.0, 0.01
#: Candidates of a shape in one pass, and passes: each leaves a quarter of the range.
CANDIDATES, PASSES = 9, 5
#: Cells of a batch that are worked on together.
TOGETHER = 2048


@dataclass(frozen=True)
class Setting:
    """States by depth rate and allele share, with the shapes that they have in common and the logs of their weights."""

    rate: tuple[float, ...]
    share: tuple[float, ...]
    size: float = SIZE
    concentration: float = CONCENTRATION
    error: float = ERROR
    log_weight: tuple[float, ...] = ()

    def __post_init__(self):
        if not self.log_weight:
            object.__setattr__(self, "log_weight", (-math.log(len(self.rate)),) * len(self.rate))


@dataclass(frozen=True)
class Start:
    """Fitted states: logs of depth rates and allele shares as read, with what was fitted beside them."""

    log_mu: tuple[float, ...]
    p: tuple[float, ...]
    weight: tuple[float, ...]
    size: float
    concentration: float
    log_likelihood: float
    purity: float | None = None
    scale: float | None = None
    error: float = 0.0


def distinct_cells(cells: DataFrame) -> DataFrame:
    """(total, exposure, b, trials, n): each cell once, with how often it is there. Cells with a NULL take no part."""
    names = ["total", "exposure", "b", "trials"]
    sums = cells.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna().groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return stage(sums, "cells")


def nb_by_size(k: np.ndarray, mean: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Negative binomial of a mean and a size; 0 where the mean is not positive."""
    fine = mean > 0
    m = np.where(fine, mean, 1.0)
    value = log_gamma(k + size) - log_gamma(size) - log_gamma(k + 1.0) + size * np.log(size / (size + m)) + k * np.log(m / (size + m))
    return np.where(fine, value, 0.0)


def bb(k: np.ndarray, n: np.ndarray, share: np.ndarray, concentration: np.ndarray) -> np.ndarray:
    """Beta-binomial of a mean share and a concentration; 0 where there are no trials or k is outside them."""
    fine = (n > 0) & (k >= 0) & (k <= n)
    k, n = np.where(fine, k, 0.0), np.where(fine, n, 1.0)
    p = np.clip(share, 1e-4, 1 - 1e-4)
    a, b = p * concentration, (1 - p) * concentration
    value = log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + log_gamma(k + a) + log_gamma(n - k + b) - log_gamma(n + a + b) - log_gamma(a) - log_gamma(b) + log_gamma(a + b)
    return np.where(fine, value, 0.0)


def read_share(p: np.ndarray, error: np.ndarray) -> np.ndarray:
    """The share as it is read when each read is of the other allele at the rate ``error``."""
    return error + (1 - 2 * error) * p


def moved_share(p: np.ndarray, by: float) -> np.ndarray:
    """The share whose logit is ``by`` more."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return 1 / (1 + (1 / p - 1) * math.exp(-by))


def swept(cells: DataFrame, settings: list[Setting], ask: list[dict[str, list[float]]] | None = None, soft: bool = False, scored: list[Setting] | None = None) -> list[dict[str, np.ndarray]]:
    """One pass: for each setting ``weight`` (cells of each state), ``level`` (log-likelihood) and what is asked for.

    Cells belong to their likeliest state, ties to the first, or with ``soft``
    to all by their posteriors; ``level`` is accordingly the classification's or
    the mixture's.  ``ask`` has for each setting lists of candidates, named
    ``size``, ``concentration``, ``error``, ``rate`` or ``share`` (the last two
    factors on rates and additions to logits, of each state on its own); their
    expected log-likelihoods come back under these names.  Candidates are taken
    with the other shapes of ``scored``, the settings themselves if not given.
    """
    ask, scored = ask or [{} for _ in settings], scored or settings

    def sums(k: np.ndarray, e: np.ndarray, b: np.ndarray, t: np.ndarray, n: np.ndarray, s: Setting, f: Setting, wanted: dict[str, list[float]]) -> dict[str, np.ndarray]:
        rate, share = np.array(s.rate), np.array(s.share)
        pairs, at = np.unique(np.stack([k, e]), axis=1, return_inverse=True)
        reads, own = np.unique(np.stack([b, t]), axis=1, return_inverse=True)
        at, own = at.ravel(), own.ravel()
        # one value a state, for each distinct half of a cell
        depth = lambda r, size: nb_by_size(pairs[0][:, None], pairs[1][:, None] * r, size)[at]
        allele = lambda p, c: bb(reads[0][:, None], reads[1][:, None], p, c)[own]
        joint = depth(rate, s.size) + allele(read_share(share, s.error), s.concentration) + np.array(s.log_weight)
        top = joint.max(axis=1)
        if soft:
            held = np.exp(joint - top[:, None])
            whole = held.sum(axis=1)
            held, level = held / whole[:, None] * n[:, None], (n * (top + np.log(whole))).sum()
        else:
            held = np.zeros_like(joint)
            held[np.arange(len(n)), joint.argmax(axis=1)] = n
            level = (n * top).sum()
        out = {"weight": held.sum(axis=0), "level": np.array([level])}
        total = lambda values: (held * values).sum()
        each = lambda values: (held * values).sum(axis=0)
        kinds = {
            "size": lambda c: total(depth(rate, c)),
            "concentration": lambda c: total(allele(read_share(share, f.error), c)),
            "error": lambda c: total(allele(read_share(share, c), f.concentration)),
            "rate": lambda c: each(depth(rate * c, f.size)),
            "share": lambda c: each(allele(moved_share(share, c), f.concentration)),
        }
        for kind, values in wanted.items():
            out[kind] = np.stack([kinds[kind](c) for c in values]).ravel()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], np.ndarray] = {}
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(5)]
            for lo in range(0, len(batch), TOGETHER):
                part = [c[lo : lo + TOGETHER] for c in columns]
                for g, (s, f, wanted) in enumerate(zip(settings, scored, ask)):
                    for kind, values in sums(*part, s, f, wanted).items():
                        held[g, kind] = held.get((g, kind), 0.0) + values
        rows = [(g, kind, i, float(v)) for (g, kind), values in held.items() for i, v in enumerate(values)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.float64()))], ["g", "kind", "i", "v"])

    parts = cells.select("total", "exposure", "b", "trials", "n").mapInArrow(run, "g int, kind string, i int, v double")
    out: list[dict[str, dict[int, float]]] = [{} for _ in settings]
    for r in parts.groupBy("g", "kind", "i").agg(F.sum("v").alias("v")).collect():
        out[r["g"]].setdefault(r["kind"], {})[r["i"]] = r["v"]
    return [{kind: np.array([v[i] for i in sorted(v)]) for kind, v in own.items()} for own in out]


def classified(cells: DataFrame, settings: list[Setting], iterations: int = 3) -> tuple[list[Setting], list[float]]:
    """(settings with weights, classification log-likelihoods): cells go to their likeliest state, whose weight follows from them, in turn.

    A state without cells keeps the weight of a tenth of one.  Without any
    cells nothing changes, and the log-likelihoods are 0.
    """
    settings = [replace(s, log_weight=()) for s in settings]
    n = cells.agg(F.sum("n")).first()[0]
    if not n:
        return settings, [0.0] * len(settings)
    for _ in range(iterations):
        settings = [replace(s, log_weight=tuple(np.log(np.maximum(got["weight"] / n, 1 / (10 * n))).tolist())) for s, got in zip(settings, swept(cells, settings))]
    return settings, [float(got["level"][0]) for got in swept(cells, settings)]


def shaped(cells: DataFrame, settings: list[Setting], error: bool = True) -> list[Setting]:
    """Settings with size and concentration, then ``error`` if asked for, of greatest likelihood for cells in their likeliest states.

    Ranges are searched on their logs by grids that narrow, all settings and
    both of the first two shapes at once; states are those of the shapes that
    went in throughout.
    """
    found = settings
    for kinds in ({"size": SIZES, "concentration": CONCENTRATIONS}, {"error": ERRORS})[: 1 + error]:
        ranges = [{kind: (math.log(lo), math.log(hi)) for kind, (lo, hi) in kinds.items()} for _ in settings]
        best = [{} for _ in settings]
        for _ in range(PASSES):
            ask = [{kind: np.exp(np.linspace(lo, hi, CANDIDATES)).tolist() for kind, (lo, hi) in own.items()} for own in ranges]
            for g, got in enumerate(swept(cells, settings, ask, scored=found)):
                for kind, values in ask[g].items():
                    if kind not in got:  # no cells
                        continue
                    i = int(np.argmax(got[kind]))
                    best[g][kind] = values[i]
                    ranges[g][kind] = (math.log(values[max(0, i - 1)]), math.log(values[min(CANDIDATES - 1, i + 1)]))
        found = [replace(s, **b) for s, b in zip(found, best)]
    return found


def lattice(purity: float, scale: float, most: int) -> Setting:
    """All pairs of copies up to ``most`` in total, by first and then second allele, at a purity and a depth scale."""
    pairs = sorted(copy_pairs(most, most))
    rate = tuple(scale * (purity * (a + b) / 2 + 1 - purity) for a, b in pairs)
    share = tuple((purity * a + 1 - purity) / (purity * (a + b) + 2 * (1 - purity)) for a, b in pairs)
    return Setting(rate, share)


def ceiling(cells: DataFrame) -> int:
    """The most copies that are tried: twice the 99.5th percentile of the depth ratio, from 3 to 8."""
    ratio = cells.where("exposure > 0 AND total > 0").select((F.col("total") / F.col("exposure")).alias("r"), F.col("n").cast("long").alias("n"))
    top = ratio.agg(F.percentile("r", F.lit(0.995), F.col("n")).alias("p")).first()["p"]
    return int(min(8, max(3, math.ceil(2 * (2.0 if top is None else top)))))


def lattice_grid(cells: DataFrame, purities: tuple[float, ...] = PURITIES, scales: tuple[float, ...] = SCALES, most: int | None = None) -> list[tuple[float, float, float]]:
    """(purity, scale, level): the classification log-likelihood of each point of the grid at the first shapes; ``cells`` are distinct ones."""
    points = [(p, s) for p in purities for s in scales]
    copies = ceiling(cells) if most is None else most
    _, levels = classified(cells, [lattice(p, s, copies) for p, s in points])
    return [(p, s, level) for (p, s), level in zip(points, levels)]


def lattice_start(cells: DataFrame, states: int, purities: tuple[float, ...] = PURITIES, scales: tuple[float, ...] = SCALES, most: int | None = None, rounds: int = 3) -> Start:
    """The ``states`` pairs of copies that hold most cells, at the purity and depth scale under which the cells are likeliest.

    Each point of the grid is judged with shapes of its own; the best one's
    shapes are then fitted ``rounds`` times in turn with the cells' states.
    ``cells`` are distinct ones; there may be none, which leaves the first
    point.  Ties go to the earlier point and the earlier pair.
    """
    points = [(p, s) for p in purities for s in scales]
    copies = ceiling(cells) if most is None else most
    grid, _ = classified(cells, [lattice(p, s, copies) for p, s in points])
    _, levels = classified(cells, shaped(cells, grid))
    best = max(range(len(points)), key=lambda i: (levels[i], -i))
    held = [lattice(*points[best], copies)]
    for _ in range(rounds):
        held = shaped(cells, classified(cells, held)[0])
    held, level = classified(cells, held)
    s = held[0]
    kept = sorted(range(len(s.rate)), key=lambda i: (-s.log_weight[i], i))[:states]
    share = read_share(np.array(s.share), s.error)
    weight = np.exp(np.array(s.log_weight)[kept])
    return Start(tuple(math.log(s.rate[i]) for i in kept), tuple(float(share[i]) for i in kept), tuple((weight / weight.sum()).tolist()), s.size, s.concentration, level[0], *points[best], s.error)


def polished(cells: DataFrame, start: Start, rounds: int = 40, tolerance: float = 1e-6) -> tuple[Start, list[float]]:
    """(start, log-likelihood before each round): expectation maximisation of a mixture from given states, which never falls.

    Each round is one pass.  It alternates between rates with the concentration
    and shares with the size: of each pair one is in the depth's part of the
    likelihood and one in the allele's, so their best candidates, none of which
    is worse than no change, add up.  Steps get shorter while nothing is gained.
    """
    s = Setting(tuple(math.exp(m) for m in start.log_mu), start.p, start.size, start.concentration, 0.0, tuple(math.log(max(w, 1e-300)) for w in start.weight))
    levels: list[float] = []
    step = 0.3
    for r in range(rounds):
        moves = [step * x for x in (0.0, 1.0, -1.0, 0.4, -0.4, 0.15, -0.15, 0.05, -0.05)]
        factors = [math.exp(m) for m in moves]
        main = "share" if r % 2 else "rate"
        spread = "size" if r % 2 else "concentration"
        ask = {main: moves if r % 2 else factors, spread: [getattr(s, spread) * f * f for f in factors]}
        got = swept(cells, [s], [ask], soft=True)[0]
        if "level" not in got:
            break
        levels.append(float(got["level"][0]))
        if r > 3 and levels[-1] - levels[-3] < tolerance * max(1.0, abs(levels[-1])):
            if step < 0.02:
                break
            step /= 3
        pick = np.argmax(got[main].reshape(len(moves), -1), axis=0)
        if r % 2:
            s = replace(s, share=tuple(float(moved_share(np.array(p), moves[i])) for p, i in zip(s.share, pick)))
        else:
            s = replace(s, rate=tuple(v * factors[i] for v, i in zip(s.rate, pick)))
        n = got["weight"].sum()
        s = replace(s, **{spread: ask[spread][int(np.argmax(got[spread]))]}, log_weight=tuple(np.log(np.maximum(got["weight"] / n, 1e-300)).tolist()))
    final = swept(cells, [s], soft=True)[0]
    level = float(final["level"][0]) if "level" in final else 0.0
    return replace(start, log_mu=tuple(map(math.log, s.rate)), p=s.share, weight=tuple(np.exp(s.log_weight).tolist()), size=s.size, concentration=s.concentration, log_likelihood=level), levels


def run_start(cells: DataFrame, states: int, seed_on: DataFrame | None = None, fit_on: DataFrame | None = None, seed=None, rounds: int = 40) -> Start:
    """A start found on ``seed_on``, polished on ``fit_on`` if given, and then on all ``cells``, by which it is scored.

    All three are tables of cells, not yet distinct; the first two default to
    ``cells`` and to no polish.  ``seed`` makes a start from distinct cells and a
    number of states, ``lattice_start`` if not given.
    """
    whole = distinct_cells(cells)
    start = (seed or lattice_start)(whole if seed_on is None else distinct_cells(seed_on), states)
    if fit_on is not None:
        start = polished(distinct_cells(fit_on), start, rounds)[0]
    return polished(whole, start, rounds)[0]


def drawn_cell(cells: DataFrame, s: Setting, seed: int, cut: float = 0.0):
    """One cell (total, exposure, b, trials), drawn with a chance in proportion to how badly its likeliest state explains it; None if there is none to draw.

    Cells without reads, expectation or trials are not drawn, nor with ``cut``
    those among the best explained share of that size.  The draw is the cell
    whose seeded number, to the power of one over its chance, is the largest, so
    it does not depend on partitions and needs no sum.
    """
    u = (F.pmod(F.xxhash64("total", "exposure", "b", "trials", F.lit(seed)), F.lit(1 << 30)) + 1) / float((1 << 30) + 2)
    rate, share = np.array(s.rate), np.array(s.share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, e, b, t, n, u = (batch.column(i).to_numpy() for i in range(6))
            bad = np.concatenate([-(nb_by_size(k[i:j, None], e[i:j, None] * rate, np.array(s.size)) + bb(b[i:j, None], t[i:j, None], share, np.array(s.concentration))).max(axis=1) for i, j in ((i, i + TOGETHER) for i in range(0, len(k), TOGETHER))]) if len(k) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(bad), pa.array(np.log(u) / np.maximum(1e-12, bad * n))], ["total", "exposure", "b", "trials", "n", "bad", "draw"])

    usable = cells.where("total > 0 AND exposure > 0 AND trials > 0")
    judged = usable.select("total", "exposure", "b", "trials", "n", u.alias("u")).mapInArrow(run, "total double, exposure double, b double, trials double, n double, bad double, draw double")
    if cut > 0:
        judged = stage(judged, "judged")
        least = judged.agg(F.percentile("bad", F.lit(cut), F.col("n").cast("long")).alias("__least"))  # one row
        judged = judged.join(F.broadcast(least), F.col("bad") >= F.col("__least"))
    return judged.agg(F.max_by(F.struct("total", "exposure", "b", "trials"), F.struct("draw", "total", "exposure", "b", "trials")).alias("c")).first()["c"]


def mixture_start(cells: DataFrame, states: int, tries: int = 10, seed: int = 0, anneal: bool = False, most_rate: float = math.inf) -> Start:
    """The likeliest of ``tries`` starts by drawing: from the neutral state on, each further state is a cell that those before explain badly.

    After each try size and concentration are fitted, and the best try's are
    those of the next, so that later ones draw under a law nearer to the cells'.
    With ``anneal`` fewer and fewer well explained cells may be drawn at first
    and more towards the last state.  States whose draw reads beyond
    ``most_rate`` are drawn again, up to ten times, and then held there.
    """
    best: Start | None = None
    size, concentration = 10.0, 1000.0
    for t in range(tries):
        rate, share = [1.0], [0.5]
        while len(rate) < states:
            s = Setting(tuple(rate), tuple(share), size, concentration, 0.0)
            cut = max(0.0, 1 - len(rate) / (states - 1)) if anneal else 0.0
            row = None
            for again in range(10):
                row = drawn_cell(cells, s, hash((seed, t, len(rate), again)) & 0x7FFFFFFF, cut)
                if row is None or row["total"] / row["exposure"] <= most_rate:
                    break
            rate.append(1.0 if row is None else min(most_rate, row["total"] / row["exposure"]))
            share.append(0.5 if row is None else min(1 - 1e-4, max(1e-4, row["b"] / row["trials"])))
        fitted = shaped(cells, [Setting(tuple(rate), tuple(share), size, concentration, 0.0)], error=False)[0]
        got = swept(cells, [fitted], soft=True)[0]
        level = float(got["level"][0]) if "level" in got else 0.0
        weight = got["weight"] / got["weight"].sum() if "weight" in got else np.full(states, 1 / states)
        if best is None or level > best.log_likelihood:
            best = Start(tuple(map(math.log, rate)), tuple(share), tuple(weight.tolist()), fitted.size, fitted.concentration, level)
        size, concentration = best.size, best.concentration
    return best
