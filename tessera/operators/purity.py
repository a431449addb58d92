"""Integer copies of clones by expectation maximisation: paths over the lattice of copies, with each clone's purity and shift and shared dispersions.

Cells are (clone, contig, bin, umi, base, a, total).  A chain, one clone's bins
of a contig in order, lies in blocks, staged once, that tasks score on their
own under many settings side by side: a block says, for each state that it may
begin in and each that it may end in, what its best path is worth.  Joining the
blocks of a chain (the larger of sums, in place of sums of products) is what is
left to do in order, and takes a small matrix for each.  Only scores by clone
and setting, and sums of distinct counts along paths, come back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.chunks import breaks
from tessera.operators.decode import copy_pairs
from tessera.operators.starts import bb, nb_by_size
from tessera.staging import stage

#: Purities that are tried, how far a start moves a shift, the bounds of the dispersions, and the price of each copy off two a bin.
PURITIES = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)
WINDOW = 0.35
ALPHAS, TAUS = (1e-8, 10.0), (1.0, 1e8)
PARSIMONY = 0.5
#: Distinct counts that are scored together; candidates of a number in a pass.
TOGETHER, CANDIDATES = 2048, 9
#: Bins of a block, numbers that the blocks side by side may have, and bins after which it is seen whether starts still matter, with what counts as none.
BLOCK, SPACE, LOOK, SAME = 1024, 1 << 22, 16, 1e-9


@dataclass(frozen=True)
class Lattice:
    """The states of a chain and how it moves."""

    pairs: tuple[tuple[int, int], ...]
    stay: float = 1 - 1e-7
    parsimony: float = PARSIMONY

    @property
    def moves(self) -> tuple[float, float]:
        """Logs of staying and of going to one of the others."""
        k = len(self.pairs)
        return math.log(self.stay), math.log((1 - self.stay) / max(1, k - 1)) if k > 1 else -math.inf


def lattice(most_total: int = 6, most_allele: int = 5, stay: float = 1 - 1e-7, parsimony: float = PARSIMONY) -> Lattice:
    return Lattice(tuple(copy_pairs(most_total, most_allele)), stay, parsimony)


@dataclass(frozen=True)
class At:
    """Where one clone is scored."""

    purity: float
    shift: float
    alpha: float
    tau: float


@dataclass
class Fit:
    """What was fitted: a setting for each clone, the best paths' log-likelihood before each round and at the end, and the paths (clone, contig, bin, a, b)."""

    settings: dict
    levels: list[float] = field(default_factory=list)
    paths: DataFrame | None = None
    settled: bool = False


def emissions(model: Lattice, at: list[At], umi: np.ndarray, base: np.ndarray, a: np.ndarray, total: np.ndarray) -> np.ndarray:
    """(bins, settings, states): log-likelihoods with the prior. Bins without a baseline say nothing by their reads, those without allele reads nothing by their share."""
    pairs = np.array(model.pairs, np.float64)
    copies = pairs.sum(axis=1)
    levels, level = np.unique(copies, return_inverse=True)
    purity, shift, alpha, tau = (np.array([getattr(s, n) for s in at])[:, None] for n in ("purity", "shift", "alpha", "tau"))
    depth = np.maximum(1e-6, purity * levels / 2 + 1 - purity) * np.exp(shift)
    alleles = purity * copies + 2 * (1 - purity)
    share = np.where(alleles > 0, (purity * pairs[:, 0] + 1 - purity) / np.where(alleles > 0, alleles, 1), 0.5)
    reads, own = np.unique(np.stack([umi, base]), axis=1, return_inverse=True)
    counts, of = np.unique(np.stack([a, total]), axis=1, return_inverse=True)
    nb = nb_by_size(reads[0][:, None, None], reads[1][:, None, None] * depth, 1 / np.maximum(alpha, 1e-10))
    be = bb(counts[0][:, None, None], counts[1][:, None, None], share, tau)
    return nb[own.ravel()][:, :, level.ravel()] + be[of.ravel()] - model.parsimony * np.abs(copies - 2)


def blocks(cells: DataFrame) -> DataFrame:
    """(chain, at, clone, contig, bin, umi, base, a, total), staged: each chain's bins in order, as lists of at most ``BLOCK``.

    Rows are dealt by ranges of their order, so a long chain lies in many
    partitions.  Blocks of a chain are in order by ``at``; within a partition
    the next one's is as many more as the block has bins.
    """
    rows = cells.where(F.col("clone").isNotNull() & F.col("contig").isNotNull()).withColumn("__chain", F.to_json(F.struct("clone", "contig")))
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("umi", "base", "a", "total")})
    order, kinds, size = ["__chain", "bin", "umi", "base", "a", "total"], dict(cells.dtypes), BLOCK
    dealt = rows.select(*order, "clone", "contig").repartitionByRange(2 * cells.sparkSession.sparkContext.defaultParallelism, *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            runs = [0, *breaks(batch.column(0)).tolist(), n]
            edges = np.array([*(t for lo, hi in zip(runs[:-1], runs[1:]) for t in range(lo, hi, size)), n], np.int32)
            first = pa.array(edges[:-1])
            lists = [pa.ListArray.from_arrays(pa.array(edges), batch.column(i)) for i in range(1, 6)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(first), pa.array(at + edges[:-1].astype(np.int64)), *(batch.column(i).take(first) for i in (6, 7)), *lists], ["chain", "at", "clone", "contig", *order[1:]])
            at += n

    return stage(dealt.mapInArrow(pack, f"chain string, at long, clone {kinds['clone']}, contig {kinds['contig']}, bin array<{kinds['bin']}>, umi array<double>, base array<double>, a array<double>, total array<double>"), "blocks")


def _beside(batch: pa.RecordBatch, model: Lattice, settings: dict[object, list[At]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(blocks, the longest first, lengths, place of each bin among the emissions by its rank in its block, emissions of distinct counts): blocks of one clone that fit side by side."""
    starts = batch.column(5).offsets.to_numpy().astype(np.int64)
    starts, lengths = starts[:-1] - starts[0], np.diff(starts)
    numbers = np.stack([batch.column(i).flatten().to_numpy() for i in range(5, 9)])
    clones = np.array(batch.column(2).to_pylist(), dtype=object)
    for clone in dict.fromkeys(clones.tolist()):
        own = settings.get(clone, [])
        if not own:
            continue
        at = np.flatnonzero(clones == clone)
        at = at[np.argsort(-lengths[at], kind="stable")]
        lo = 0
        while lo < len(at):
            longest = int(lengths[at[lo]])
            some = at[lo : lo + max(1, SPACE // (longest * len(own) * len(model.pairs)))]
            lo += len(some)
            place = starts[some] + np.minimum(np.arange(longest)[:, None], lengths[some] - 1)
            distinct, which = np.unique(numbers[:, place.ravel()], axis=1, return_inverse=True)
            yield some, lengths[some], which.reshape(place.shape), emissions(model, own, *distinct)


def _joined(model: Lattice, lengths: np.ndarray, which: np.ndarray, e: np.ndarray) -> np.ndarray:
    """(blocks, settings, first state, last state): the best path's worth within each block.

    Once the ways from all first states run alike but for a constant, one of
    them is followed for all; no later step sets them apart.
    """
    stay, move = model.moves
    k = len(model.pairs)
    out = np.full((len(lengths), e.shape[1], k, k), -math.inf)
    out[:, :, np.arange(k), np.arange(k)] = e[which[0]]
    best, ahead = out, None
    for t in range(1, len(which)):
        m = int(np.searchsorted(-lengths, -t, side="left"))  # blocks that have a bin of this rank
        row, now = e[which[t, :m]], best[:m]
        top = now.max(axis=-1, keepdims=True) + move
        now += stay
        np.maximum(now, top, out=now)
        now += row if ahead is not None else row[:, :, None, :]
        if ahead is None and t % LOOK == 0:
            apart = now - now[:, :, :1]
            if bool((apart.max(axis=-1) - apart.min(axis=-1) <= SAME).all()):
                ahead, best = apart[..., 0].copy(), now[:, :, 0].copy()
    if ahead is not None:
        out[: len(best)] = ahead[..., None] + best[:, :, None, :]
    return out


def _entered(model: Lattice, v: np.ndarray) -> np.ndarray:
    """Worth of each state at a bin, before its counts, from that at the bin before."""
    stay, move = model.moves
    return np.maximum(v + stay, v.max(axis=-1, keepdims=True) + move)


def _by_chain(worth: DataFrame) -> DataFrame:
    return worth.repartition("chain").sortWithinPartitions("chain", "at")


def _matrices(batch: pa.RecordBatch, k: int) -> Iterator[tuple[str, int, object, np.ndarray]]:
    """(chain, at, clone, (settings, first state, last state)) of each row."""
    for chain, at, clone, worth in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
        yield chain, at, clone, np.frombuffer(worth.as_buffer(), np.float64).reshape(-1, k, k)


def scores(cells: DataFrame, model: Lattice, tried: dict[object, list[At]]) -> dict[object, np.ndarray]:
    """For each clone the best path's log-likelihood under each of its settings, summed over contigs; clones without cells have none."""
    return _scores(blocks(cells), model, tried)


def _scores(held: DataFrame, model: Lattice, tried: dict[object, list[At]]) -> dict[object, np.ndarray]:
    kind, k = dict(held.dtypes)["clone"], len(model.pairs)

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, np.ndarray] = {}
            for some, lengths, which, e in _beside(batch, model, tried):
                found.update(zip(some.tolist(), _joined(model, lengths, which, e)))
            chains, at, ends = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(5).offsets.to_numpy()
            runs: list[tuple[int, np.ndarray]] = []
            before = None
            for i in sorted(found):
                # blocks that follow each other become one
                if before is not None and chains[i] == chains[before] and at[i] == at[before] + ends[before + 1] - ends[before]:
                    runs[-1] = runs[-1][0], (_entered(model, runs[-1][1])[..., None] + found[i][:, None]).max(axis=2)
                else:
                    runs.append((i, found[i]))
                before = i
            first = pa.array([i for i, _ in runs], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(first) for i in range(3)), pa.array([w.tobytes() for _, w in runs], pa.binary())], ["chain", "at", "clone", "worth"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, best, rows = None, None, []
        kind_of = None
        for batch in batches:
            kind_of = batch.schema.field(2).type
            for own, _, clone, w in _matrices(batch, k):
                if own != chain:
                    chain, best = own, np.full((len(w), k), -math.log(k))
                    rows.append((clone, best))
                else:
                    best = _entered(model, best)
                best = (best[..., None] + w).max(axis=1)
                rows[-1] = clone, best
        if rows:
            levels = [b.max(axis=1) for _, b in rows]
            columns = [pa.array([c for (c, _), x in zip(rows, levels) for _ in x], kind_of), pa.array(np.concatenate([np.arange(len(x)) for x in levels]), pa.int32()), pa.array(np.concatenate(levels))]
            yield pa.RecordBatch.from_arrays(columns, ["clone", "at", "level"])

    made = held.mapInArrow(worth, f"chain string, at long, clone {kind}, worth binary")
    sums = _by_chain(made).mapInArrow(joined, f"clone {kind}, at int, level double").groupBy("clone", "at").agg(F.sum("level").alias("level"))
    out: dict[object, np.ndarray] = {}
    for r in sums.collect():  # clones times settings
        out.setdefault(r["clone"], np.zeros(len(tried[r["clone"]])))[r["at"]] = r["level"]
    return out


def paths(cells: DataFrame, model: Lattice, at: dict[object, At]) -> DataFrame:
    """(clone, contig, bin, umi, base, a, total, state): each chain's best path at its clone's setting; ties to the smaller state, from the end back."""
    return _paths(blocks(cells), model, at)


def _paths(held: DataFrame, model: Lattice, at: dict[object, At]) -> DataFrame:
    kinds, k = dict(held.dtypes), len(model.pairs)
    stay, move = model.moves
    settings = {c: [s] for c, s in at.items()}

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, lengths, which, e in _beside(batch, model, settings):
                found = _joined(model, lengths, which, e)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(some)) for i in range(3)), pa.array([w.tobytes() for w in found], pa.binary())], ["chain", "at", "clone", "worth"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, own = None, []

        def out() -> pa.RecordBatch:
            # states in which blocks begin and end, from the last block back
            last, states = int(own[-1][3].argmax()), []
            for i in range(len(own) - 1, -1, -1):
                place, entered, w, _ = own[i]
                first = int((entered + w[:, last]).argmax())
                states.append((place, first, last))
                if i:
                    v = own[i - 1][3]
                    last = first if v[first] + stay >= v.max() + move else int(v.argmax())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*states), (pa.int64(), pa.int32(), pa.int32()))], ["at", "first", "last"])

        for batch in batches:
            for name, place, _, (w,) in _matrices(batch, k):
                if name != chain:
                    if own:
                        yield out()
                    chain, own = name, []
                entered = _entered(model, own[-1][3]) if own else np.zeros(k)
                own.append((place, entered, w, (entered[:, None] + w).max(axis=0)))
        if own:
            yield out()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, end = batch.column(9).to_numpy(), batch.column(10).to_numpy()
            edges = batch.column(5).offsets.to_numpy().astype(np.int64)
            starts, state = edges[:-1] - edges[0], np.zeros(int(edges[-1] - edges[0]), np.int64)
            for some, lengths, which, e in _beside(batch, model, settings):
                back = np.zeros((len(which), len(some), k), np.int16)
                best = np.full((len(some), k), -math.inf)
                best[np.arange(len(some)), begin[some]] = e[which[0], 0, begin[some]]
                for t in range(1, len(which)):
                    m = int(np.searchsorted(-lengths, -t, side="left"))
                    top = best[:m].argmax(axis=1)[:, None]
                    most = np.take_along_axis(best[:m], top, axis=1) + move
                    back[t, :m] = np.where(best[:m] + stay >= most, np.arange(k), top)
                    best[:m] = np.maximum(best[:m] + stay, most) + e[which[t, :m], 0]
                own = end[some].astype(np.int64)
                for t in range(len(which) - 1, -1, -1):
                    m = int(np.searchsorted(-lengths, -t, side="left"))
                    state[starts[some[:m]] + t] = own[:m]
                    if t:
                        own[:m] = back[t, np.arange(m), own[:m]]
            of = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(edges)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in (2, 3)), *(batch.column(i).flatten() for i in range(4, 9)), pa.array(state)], ["clone", "contig", "bin", "umi", "base", "a", "total", "state"])

    made = held.mapInArrow(worth, f"chain string, at long, clone {kinds['clone']}, worth binary")
    known = _by_chain(made).mapInArrow(ends, "at long, first int, last int")
    bin_kind = kinds["bin"][len("array<") : -1]
    met = held.join(known, "at").select(*held.columns, "first", "last")
    return met.mapInArrow(follow, f"clone {kinds['clone']}, contig {kinds['contig']}, bin {bin_kind}, umi double, base double, a double, total double, state long")


def along(codes: DataFrame, model: Lattice, tried: dict[object, list[At]]) -> dict[object, np.ndarray]:
    """For each clone the log-likelihood along its path under each setting; ``codes`` is (clone, state, umi, base, a, total, n) of distinct counts."""
    pairs = model.pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}
        for batch in batches:
            clones = np.array(batch.column(0).to_pylist(), dtype=object)
            state, umi, base, a, total, n = (batch.column(i).to_numpy() for i in range(1, 7))
            for clone in set(clones.tolist()):
                own = np.flatnonzero(clones == clone)
                for s in np.unique(state[own]):
                    one = replace(model, pairs=(pairs[int(s)],))
                    part = own[state[own] == s]
                    for lo in range(0, len(part), TOGETHER):
                        p = part[lo : lo + TOGETHER]
                        e = emissions(one, tried[clone], umi[p], base[p], a[p], total[p])[:, :, 0]
                        held[clone] = held.get(clone, 0.0) + n[p] @ e
        rows = [(c, i, float(v)) for c, values in held.items() for i, v in enumerate(values)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch_type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64())], ["clone", "at", "level"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(codes.schema["clone"].dataType)
    kind = dict(codes.dtypes)["clone"]
    sums = codes.select("clone", "state", "umi", "base", "a", "total", "n").mapInArrow(run, f"clone {kind}, at int, level double").groupBy("clone", "at").agg(F.sum("level").alias("level"))
    out = {c: np.zeros(len(s)) for c, s in tried.items()}
    for r in sums.collect():
        out[r["clone"]][r["at"]] = r["level"]
    return out


def _narrowed(now: float, lo: float, hi: float) -> list[float]:
    """Candidates over a range, the present value first."""
    return [now, *np.linspace(lo, hi, CANDIDATES).tolist()]


def _searched(values: dict[object, float], reach: dict[object, tuple[float, float]], score, passes: int) -> dict[object, float]:
    """Each clone's best value over its range, by grids that narrow to the cells beside the best; never worse than the present value."""
    values, reach = dict(values), dict(reach)
    for _ in range(passes):
        tried = {c: _narrowed(v, *reach[c]) for c, v in values.items()}
        got = score(tried)
        for c, t in tried.items():
            if c in got:
                values[c] = t[int(np.argmax(got[c]))]
                half = (reach[c][1] - reach[c][0]) / (CANDIDATES - 1)
                reach[c] = (max(reach[c][0], values[c] - half), min(reach[c][1], values[c] + half))
    return values


def decode(
    cells: DataFrame, normal=None, alpha: float = 0.01, tau: float = 100.0, model: Lattice | None = None, shifts: dict | None = None, rounds: int = 5, passes: int = 3,
    purities: tuple[float, ...] = PURITIES, fit_purity: bool = True, fit_shifts: bool = True, fit_dispersions: bool = True, tolerance: float = 1e-6,
) -> Fit:
    """Each clone's copies, with its purity and shift (depths are exp(shift) times what copies and purity say), and shared dispersions.

    A start takes for each purity the shift of the likeliest path.  Each round
    then finds the paths, moves shifts, dispersions and concentrations along
    them, and purities by their best paths.  No step accepts anything worse, so
    the best paths' log-likelihood never falls.  The clone ``normal`` stays at
    purity 1 and shift 0.  Clones are few: their settings are on the driver.
    Bins that are NULL come first in their contig; repeated bins are all kept;
    NULL counts are 0; rows without clone or contig take no part.
    """
    model = model or lattice()
    lain = blocks(cells.select("clone", "contig", "bin", "umi", "base", "a", "total"))
    clones = sorted(r[0] for r in lain.select("clone").distinct().collect())
    held = {c: At(1.0, 0.0 if c == normal else (shifts or {}).get(c, 0.0), alpha, tau) for c in clones}
    if not clones:
        return Fit({}, [0.0], cells.select("clone", "contig", "bin", F.lit(0).alias("a"), F.lit(0).alias("b")), True)
    free = [c for c in clones if c != normal]

    if (fit_purity or fit_shifts) and free:
        grid = purities if fit_purity else (1.0,)
        best = {(c, p): held[c].shift for c in free for p in grid}
        reach = {k: (v - WINDOW, v + WINDOW) if fit_shifts else (v, v) for k, v in best.items()}

        def by_path(tried: dict) -> dict:
            got = _scores(lain, model, {c: [replace(held[c], purity=p, shift=s) for p in grid for s in tried[c, p]] for c in free})
            return {(c, p): x for c, values in got.items() for p, x in zip(grid, np.split(values, len(grid)))}

        best = _searched(best, reach, by_path, passes if fit_shifts else 1)
        final = by_path({k: [v] for k, v in best.items()})
        for c in free:
            p = max(grid, key=lambda p: (float(final[c, p][0]), p))
            held[c] = replace(held[c], purity=p, shift=best[c, p])

    total = lambda: float(sum(x[0] for x in _scores(lain, model, {c: [s] for c, s in held.items()}).values()))
    fit = Fit(held, [total()])
    for _ in range(rounds):
        counts = ["clone", "state", "umi", "base", "a", "total"]
        codes = stage(_paths(lain, model, held).groupBy(*counts).agg(F.count(F.lit(1)).cast("double").alias("n")), "codes")
        if fit_shifts and free:
            now = {c: held[c].shift for c in free}
            moved = _searched(now, {c: (v - 1.0, v + 1.0) for c, v in now.items()}, lambda tried: along(codes, model, {c: [replace(held[c], shift=s) for s in tried.get(c, [held[c].shift])] for c in clones}), passes + 1)
            held.update({c: replace(held[c], shift=v) for c, v in moved.items()})
        if fit_dispersions:
            for name, (lo, hi) in (("alpha", ALPHAS), ("tau", TAUS)):

                def shared(tried: dict, name: str = name) -> dict:
                    got = along(codes, model, {c: [replace(held[c], **{name: math.exp(x)}) for x in tried[0]] for c in clones})
                    return {0: sum(got.values())}

                x = _searched({0: math.log(getattr(held[clones[0]], name))}, {0: (math.log(lo), math.log(hi))}, shared, passes + 2)[0]
                held.update({c: replace(s, **{name: math.exp(x)}) for c, s in held.items()})
        if fit_purity and free:
            now = {c: held[c].purity for c in free}
            by = lambda tried: _scores(lain, model, {c: [replace(held[c], purity=p) for p in values] for c, values in tried.items()})
            held.update({c: replace(held[c], purity=v) for c, v in _searched(now, {c: (0.05, 1.0) for c in free}, by, passes).items()})
        fit.levels.append(total())
        if fit.levels[-1] - fit.levels[-2] <= tolerance * max(1.0, abs(fit.levels[-1])):
            fit.settled = True
            break
    copies = F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in model.pairs))
    found = _paths(lain, model, held).withColumn("__c", F.get(copies, F.col("state").cast("int")))
    fit.paths = stage(found.select("clone", "contig", "bin", F.col("__c.a").alias("a"), F.col("__c.b").alias("b")), "paths")
    return fit

