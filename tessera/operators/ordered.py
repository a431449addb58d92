"""Operators along an order: packing, cuts, parity, switch laws, moving sums and fills.

Folds run over the rows of a group as they come sorted to a task and keep one
state; windows do the rest inside the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.chunks import Fold, labelled


class Packing(Fold):
    """A segment closes once each of its sums reaches its floor; rows of one that stays open at the end join the segment before."""

    def __init__(self, *floors: float):
        self.floors, self.sums, self.n, self.at = floors, [0.0] * len(floors), 0, 0

    def feed(self, *values: np.ndarray) -> list[int]:
        out: list[int] = []
        for row in zip(*(v.tolist() for v in values)):
            self.n += 1
            self.sums = [s + (0.0 if x != x else x) for s, x in zip(self.sums, row)]
            if all(s >= f for s, f in zip(self.sums, self.floors)):
                out += [self.at] * self.n
                self.at, self.n, self.sums = self.at + 1, 0, [0.0] * len(self.floors)
        return out

    def end(self) -> list[int]:
        return [max(0, self.at - 1)] * self.n


class Steps(Fold):
    """A new piece where the value moves by ``step`` or more, with more than ``spacing`` rows since the last cut."""

    def __init__(self, step: float, spacing: int):
        self.step, self.spacing, self.row, self.since, self.piece, self.last = step, spacing, 0, 0, 0, float("nan")

    def feed(self, *values: np.ndarray) -> list[int]:
        out = []
        for x in values[0].tolist():
            if self.row > self.since + self.spacing and abs(x - self.last) >= self.step:
                self.piece, self.since = self.piece + 1, self.row
            out.append(self.piece)
            self.row, self.last = self.row + 1, x
        return out


def pack(df: DataFrame, group: str, order: list[str], value: str, least: float, name: str = "bin") -> DataFrame:
    """Left to right, a bin closes once its sum reaches ``least``; a last bin short of it joins the one before.

    Bins number from 0 in each group; a group that never reaches the floor is
    one bin.  NULLs add nothing.
    """
    return labelled(df, group, order, [value], lambda: Packing(least), name)


def floored(df: DataFrame, group: str, order: list[str], length: str, weight: str, least_length: float, least_weight: float, name: str = "segment") -> DataFrame:
    """As ``pack`` with two floors: a segment closes once both its length and its weight reach them."""
    return labelled(df, group, order, [length, weight], lambda: Packing(least_length, least_weight), name)


def cut_at_steps(df: DataFrame, group: str, order: list[str], value: str, step: float, spacing: int, name: str = "piece") -> DataFrame:
    """A new piece begins where the value moves by ``step`` or more and over ``spacing`` rows have passed since the last cut."""
    return labelled(df, group, order, [value], lambda: Steps(step, spacing), name)


def parity(df: DataFrame, group: str, order: list[str], flag: Column, name: str = "phase") -> DataFrame:
    """Adds the parity of the flags met so far in the group: the phase after that many switches."""
    along = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.pmod(F.sum(F.when(flag, 1).otherwise(0)).over(along), F.lit(2)).cast("long"))


def switch_probability(df: DataFrame, group: str, order: list[str], distance_at: str, nu: float, least: float, name: str = "p_switch") -> DataFrame:
    """Haldane's law (1 - exp(-2 nu d)) / 2 on the distance to the group's next row; ``least`` is its floor and the last row's."""
    along = Window.partitionBy(group).orderBy(*order)
    gap = F.lead(distance_at).over(along) - F.col(distance_at)
    return df.withColumn(name, F.greatest(F.coalesce((1 - F.exp(-2 * nu * gap)) / 2, F.lit(least)), F.lit(least)))


def log_switch(p: Column, shift: float) -> Column:
    """log p less a shift, and at most log 1/2."""
    return F.ln(F.least(F.lit(0.5), p * F.exp(F.lit(-float(shift)))))


def composable_switch(distance: Column, nu: float, shift: float) -> Column:
    """log of Haldane's law at the rate nu e^-shift, which composes over any binning."""
    return F.ln(-0.5 * F.expm1(-2 * nu * F.exp(F.lit(-float(shift))) * distance))


def moving_sum(df: DataFrame, group: str, order: list[str], value: str, width: int, name: str = "moving") -> DataFrame:
    """Centred sum over ``width`` rows, zero beyond the ends."""
    frame = Window.partitionBy(group).orderBy(*order).rowsBetween(-(width // 2), width - width // 2 - 1)
    return df.withColumn(name, F.sum(value).over(frame))


def range_sum(df: DataFrame, group: str, at: str, value: str, reach: int, name: str = "ranged") -> DataFrame:
    """Sum over the rows of the group within ``reach`` of each row's position."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(group).orderBy(at).rangeBetween(-reach, reach)))


def filled(df: DataFrame, group: str, order: list[str], value: str, name: str = "filled") -> DataFrame:
    """NULLs take the last value before them; leading ones the group's first."""
    along = Window.partitionBy(group).orderBy(*order)
    back = F.last(value, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    # one aggregate of the group, not a frame that reads on from every row
    head = F.min(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("__value")))).over(Window.partitionBy(group))
    return df.withColumn(name, F.coalesce(back, head["__value"]))
