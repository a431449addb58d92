"""Hidden Markov chains on grouped rows: forward likelihood, posteriors and best paths, and a count mixture by EM."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.likelihood import nb_log_pmf
from tessera.operators.chunks import in_order, whole_groups


def transitions(states: int, stay: float) -> list[list[float]]:
    """Log-probabilities: ``stay`` on the diagonal, the rest shared; one state has 0."""
    if states == 1:
        return [[0.0]]
    move = math.log((1 - stay) / (states - 1))
    return [[math.log(stay) if i == j else move for j in range(states)] for i in range(states)]


def _log_sum(values: list[Column]) -> Column:
    most = F.greatest(*values) if len(values) > 1 else values[0]
    return most + F.ln(sum((F.exp(v - most) for v in values), F.lit(0.0)))


def _sum_logs(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return (most + np.log(np.exp(x - most).sum(axis=axis, keepdims=True))).squeeze(axis)


class Chains:
    """Groups side by side, longest first, so that step t of all of them is one array operation."""

    def __init__(self, edges: np.ndarray):
        length = np.diff(edges)
        self.order = np.argsort(-length, kind="stable")
        self.starts, self.length = edges[:-1][self.order], length[self.order]

    def steps(self) -> range:
        return range(int(self.length[0]) if len(self.length) else 0)

    def rows(self, t: int) -> np.ndarray:
        """The rows of place ``t`` in the groups that are longer than that."""
        return self.starts[: int(np.searchsorted(-self.length, -t))] + t


def _numbers(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)


def forward(df: DataFrame, group: str, order: list[str], emissions: list[str], log_trans: list[list[float]], log_start: list[float]) -> DataFrame:
    """(group, n, log_likelihood) of each group's rows in order; emissions are log-probability columns, one a state.

    Tasks run many groups' lattices side by side and hold one column of each.
    """
    trans, start = np.array(log_trans), np.array(log_start)
    rows = in_order(df, group, order, *emissions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in whole_groups(batches):
            e, chains = _numbers(batch, emissions), Chains(edges)
            a = np.zeros((len(chains.starts), len(start)))
            for t in chains.steps():
                at = chains.rows(t)
                own = a[: len(at)]
                a[: len(at)] = (start if t == 0 else _sum_logs(own[:, :, None] + trans, 1)) + e[at]
            names = batch.column(0).take(pa.array(chains.starts))
            yield pa.RecordBatch.from_arrays([names, pa.array(chains.length), pa.array(_sum_logs(a, 1))], [group, "n", "log_likelihood"])

    return rows.mapInArrow(run, f"`{group}` {dict(rows.dtypes)[group]}, n long, log_likelihood double")


def viterbi(df: DataFrame, group: str, order: list[str], emissions: list[str], log_trans: list[list[float]], log_start: list[float]) -> DataFrame:
    """(group, order..., state): each group's best path; ties to the smaller state, from the end back."""
    trans, start = np.array(log_trans), np.array(log_start)
    rows = in_order(df, group, order, *emissions)
    kinds, keep = dict(rows.dtypes), [group, *order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in whole_groups(batches):
            e, chains = _numbers(batch, emissions), Chains(edges)
            back, out = np.zeros(e.shape, np.int16), np.zeros(len(e), np.int64)
            v = np.zeros((len(chains.starts), len(start)))
            for t in chains.steps():
                at = chains.rows(t)
                own = v[: len(at)]
                if t:
                    step = own[:, :, None] + trans
                    back[at] = step.argmax(axis=1)
                    own = step.max(axis=1)
                else:
                    own = start[None, :]
                v[: len(at)] = own + e[at]
            out[chains.starts + chains.length - 1] = v.argmax(axis=1)
            for t in reversed(chains.steps()):
                after = chains.rows(t + 1)
                out[after - 1] = back[after, out[after]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out)], [*keep, "state"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", state long")


def posteriors(df: DataFrame, group: str, order: list[str], emissions: list[str], log_trans: list[list[float]], log_start: list[float], switch: str | None = None) -> DataFrame:
    """(group, order..., posterior, state): state probabilities of each row and the likeliest state.

    With ``switch``, a column of log-probabilities that the phase flips before
    the next row, every state has a flipped twin: emissions list the plain
    states, then the flipped ones, and the state returned is the plain one.
    """
    trans, start = np.array(log_trans), np.array(log_start)
    rows = in_order(df, group, order, *emissions, *([switch] if switch else []))
    kinds, keep, plain = dict(rows.dtypes), [group, *order], len(start)
    begin = np.concatenate([start, start]) + math.log(0.5) if switch else start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in whole_groups(batches):
            e, chains = _numbers(batch, emissions), Chains(edges)
            flip = _numbers(batch, [switch])[:, 0] if switch else None

            def moves(at: np.ndarray) -> np.ndarray:
                """Log-probabilities from the states of rows ``at`` to those of the next."""
                return trans[None] if flip is None else combined_moves(trans, flip[at])

            a, b = np.zeros(e.shape), np.zeros(e.shape)
            for t in chains.steps():
                at = chains.rows(t)
                a[at] = (begin if t == 0 else _sum_logs(a[at - 1][:, :, None] + moves(at - 1), 1)) + e[at]
            for t in reversed(chains.steps()):
                after = chains.rows(t + 1)
                b[after - 1] = _sum_logs(moves(after - 1) + (e[after] + b[after])[:, None, :], 2)
            g = a + b
            g = np.exp(g - _sum_logs(g, 1)[:, None])
            folded = g.reshape(len(g), -1, plain).sum(axis=1)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1, dtype=np.int32) * plain), pa.array(folded.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), values, pa.array(folded.argmax(axis=1))], [*keep, "posterior", "state"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", posterior array<double>, state long")


#: log of one half: where the phase says nothing.
HALF = math.log(0.5)


def combined_moves(trans: np.ndarray, flip: np.ndarray, same_state: bool = False) -> np.ndarray:
    """(rows, 2K, 2K): log-probabilities from the plain and flipped states of rows to those of the next, ``flip`` the log of each row's switch.

    With ``same_state`` the switch law holds only where the state stays, and
    any other move takes either phase with one half.
    """
    w = np.minimum(flip, -1e-300)[:, None, None]
    stay, turn = trans + np.log(-np.expm1(w)), trans + w
    if same_state:
        off = ~np.eye(len(trans), dtype=bool)[None]
        stay, turn = np.where(off, trans + HALF, stay), np.where(off, trans + HALF, turn)
    return np.concatenate([np.concatenate([stay, turn], axis=2), np.concatenate([turn, stay], axis=2)], axis=1)


def factored_step(a: np.ndarray, trans: np.ndarray, flip: np.ndarray, same_state: bool = False) -> np.ndarray:
    """(rows, 2K): what ``combined_moves`` makes of log-weights ``a``, by states first and phases after: their product is never written out.

    It is its own transpose where ``trans`` is turned over, so the way back is
    the same step.
    """
    k = len(trans)
    w = np.minimum(flip, -1e-300)[:, None, None]
    by_phase = a.reshape(len(a), 2, k)
    mixed = lambda x, stay, turn: np.logaddexp(x + stay, x[:, ::-1] + turn)
    stays, turns = np.log(-np.expm1(w)), w
    if not same_state:
        return mixed(_sum_logs(by_phase[:, :, :, None] + trans, 2), stays, turns).reshape(a.shape)
    kept = mixed(by_phase + np.diag(trans), stays, turns)
    if k == 1:
        return kept.reshape(a.shape)
    others = np.where(np.eye(k, dtype=bool), -np.inf, trans)
    moved = _sum_logs(by_phase[:, :, :, None] + others, 2)
    return np.logaddexp(kept, mixed(moved, HALF, HALF)).reshape(a.shape)


def phased(df: DataFrame, group: str, order: list[str], emissions: list[str], log_trans: list[list[float]], log_start: list[float], switch: str, same_state: bool = False) -> tuple[DataFrame, DataFrame]:
    """((group, n, log_likelihood), (group, order..., posterior, state, phase)): a chain whose every state has a flipped twin.

    ``emissions`` lists the plain states' log-probabilities, then the flipped
    ones'; ``switch`` is a column with the log-probability that the phase flips
    before the next row (the last row's is not read).  A chain begins in either
    phase with one half.  ``posterior`` has all twins; ``state`` is the likeliest
    with both phases together and ``phase`` 1 where its flipped twin is the
    likelier.  With ``same_state`` phases are tied only where the state stays.
    """
    trans, start = np.array(log_trans), np.array(log_start)
    rows = in_order(df, group, order, *emissions, switch)
    kinds, keep, plain = dict(rows.dtypes), [group, *order], len(start)
    begin = np.concatenate([start, start]) + HALF

    def way(e: np.ndarray, flip: np.ndarray, chains: Chains) -> np.ndarray:
        a = np.zeros(e.shape)
        for t in chains.steps():
            at = chains.rows(t)
            a[at] = (begin if t == 0 else factored_step(a[at - 1], trans, flip[at - 1], same_state)) + e[at]
        return a

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in whole_groups(batches):
            e, chains = _numbers(batch, emissions), Chains(edges)
            a = way(e, _numbers(batch, [switch])[:, 0], chains)
            last = chains.starts + chains.length - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(chains.starts)), pa.array(chains.length), pa.array(_sum_logs(a[last], 1))], [group, "n", "log_likelihood"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in whole_groups(batches):
            e, chains = _numbers(batch, emissions), Chains(edges)
            flip = _numbers(batch, [switch])[:, 0]
            a, b = way(e, flip, chains), np.zeros(e.shape)
            for t in reversed(chains.steps()):
                after = chains.rows(t + 1)
                b[after - 1] = factored_step(e[after] + b[after], trans.T, flip[after - 1], same_state)
            g = a + b
            g = np.exp(g - _sum_logs(g, 1)[:, None])
            twins = g.reshape(len(g), 2, plain)
            state = twins.sum(axis=1).argmax(axis=1)
            phase = (twins[np.arange(len(g)), 1, state] > twins[np.arange(len(g)), 0, state]).astype(np.int64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1, dtype=np.int32) * 2 * plain), pa.array(g.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), values, pa.array(state), pa.array(phase)], [*keep, "posterior", "state", "phase"])

    return rows.mapInArrow(level, f"`{group}` {kinds[group]}, n long, log_likelihood double"), rows.mapInArrow(judge, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", posterior array<double>, state long, phase long")


def count_mixture(df: DataFrame, count: str, base: str, states: int, alpha: float, rounds: int = 10) -> DataFrame:
    """(state, weight, log_mu) of a negative binomial mixture by expectation maximisation.

    The likelihood is evaluated on distinct (count, base) pairs with their
    multiplicity; each round sends only the states' sums to the driver.
    """
    codes = df.where(F.col(base) > 0).groupBy(F.col(count).cast("double").alias("k"), F.col(base).cast("double").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n")).cache()
    row = codes.agg(F.sum(F.col("n") * F.col("k")).alias("k"), F.sum(F.col("n") * F.col("b")).alias("b")).first()
    if not row["b"]:
        codes.unpersist()
        return df.sparkSession.createDataFrame([], "state long, weight double, log_mu double")
    centre = math.log(max(1e-9, row["k"]) / row["b"])
    mu = [centre + 0.5 * (i - (states - 1) / 2) for i in range(states)]
    weight = [1 / states] * states
    for _ in range(rounds):
        logs = {f"l{i}": F.lit(math.log(max(1e-300, weight[i]))) + nb_log_pmf(F.col("k"), F.col("b"), F.lit(mu[i]), F.lit(alpha)) for i in range(states)}
        # column by column, so that no likelihood is spelled out twice
        each = codes.withColumns(logs).withColumn("whole", _log_sum([F.col(c) for c in logs]))
        each = each.withColumns({f"s{i}": F.exp(F.col(f"l{i}") - F.col("whole")) * F.col("n") for i in range(states)})
        sums = each.agg(*(F.sum(F.col(f"s{i}") * by).alias(f"{name}{i}") for i in range(states) for name, by in (("n", F.lit(1.0)), ("k", F.col("k")), ("b", F.col("b"))))).first()
        n = sum(sums[f"n{i}"] for i in range(states))
        weight = [sums[f"n{i}"] / n for i in range(states)]
        mu = [math.log(max(1e-9, sums[f"k{i}"]) / max(1e-9, sums[f"b{i}"])) for i in range(states)]
    codes.unpersist()
    return df.sparkSession.createDataFrame([(i, weight[i], mu[i]) for i in range(states)], "state long, weight double, log_mu double")
