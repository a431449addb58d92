"""Whole groups and running folds over rows that come to a task sorted, in Arrow batches.

Rows are dealt by group and sorted inside the partitions by Spark, which spills
as it needs to; a task then sees its groups one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that are gathered before whole groups are worked on together.
GATHERED = 50_000


def in_order(df: DataFrame, group: str, order: list[str], *values: str) -> DataFrame:
    """The named columns, each group in one partition and in order; equal places are ordered by the values."""
    columns = list(dict.fromkeys([group, *order, *values]))
    return df.select(*columns).repartition(group).sortWithinPartitions(*columns)


def breaks(column: pa.Array) -> np.ndarray:
    """The places at which a sorted column changes its value; NULLs are one value."""
    if len(column) < 2:
        return np.empty(0, np.int64)
    codes = column.dictionary_encode()
    codes = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.flatnonzero(codes[1:] != codes[:-1]) + 1


def same_group(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    """Whether the last row of ``a`` and the first of ``b`` are of one group."""
    return a.column(0)[a.num_rows - 1] == b.column(0)[0] or (not a.column(0)[a.num_rows - 1].is_valid and not b.column(0)[0].is_valid)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = GATHERED) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(batch, edges): batches of complete groups, each at least ``rows`` long if there are as many, and where groups begin and end."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        cuts = breaks(batch.column(0))
        # what lies before the last group that this batch begins is complete
        if len(cuts):
            last = int(cuts[-1])
        elif len(held) > 1 and not same_group(held[-2], batch):
            last = 0
        else:
            continue
        rest = held.pop()
        if last:
            held.append(rest.slice(0, last))
        whole = joined(held)
        yield whole, np.concatenate(([0], breaks(whole.column(0)), [whole.num_rows]))
        held = [rest.slice(last)]
        n = held[0].num_rows
    if held:
        whole = joined(held)
        yield whole, np.concatenate(([0], breaks(whole.column(0)), [whole.num_rows]))


class Fold:
    """A running label: ``feed`` takes the next values of a group and returns labels of its oldest unlabelled rows; ``end`` returns those left."""

    def feed(self, *values: np.ndarray) -> list[int]:
        raise NotImplementedError

    def end(self) -> list[int]:
        return []


def labelled(df: DataFrame, group: str, order: list[str], values: list[str], fold: Callable[[], Fold], name: str) -> DataFrame:
    """(group, order, values, name): each row with the label that a fold over its group gives it.

    A task holds only rows whose label is still open, so groups may be of any size.
    """
    rows = in_order(df, group, order, *values)
    kinds, names = dict(rows.dtypes), list(rows.columns)
    at = [names.index(v) for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        own, before = None, None

        def out(labels: list[int]) -> Iterator[pa.RecordBatch]:
            nonlocal open_
            if labels:
                held = joined(open_)
                done = held.slice(0, len(labels))
                yield pa.RecordBatch.from_arrays([*done.columns, pa.array(labels, pa.int64())], [*names, name])
                open_ = [held.slice(len(labels))] if len(labels) < held.num_rows else []

        for batch in batches:
            if not batch.num_rows:
                continue
            edges = [0, *breaks(batch.column(0)).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                part = batch.slice(lo, hi - lo)
                if own is None or lo > 0 or not same_group(before, part):
                    if own is not None:
                        yield from out(own.end())
                    own = fold()
                open_.append(part)
                yield from out(own.feed(*(part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in at)))
                before = part
        if own is not None:
            yield from out(own.end())

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", `{name}` long"
    return rows.mapInArrow(run, schema)
