"""Sharding by histogram sort: even shards of a key order from exact byte counts, and one exchange.

Every document has a 60-bit key: 24 bits of its text's hash, so that equal
texts are neighbours, then 36 bits of its id's hash, so that a group of copies
of any size can still be cut.  A first pass counts exact bytes and rows below
4,096 key boundaries; each later pass splits, into 256, only the cells that
hold a wanted splitter too coarsely or are too large for one task.  The counts
are summed inside the tasks before they are shuffled, and what reaches the
driver is bounded by the number of cells, not of documents.  Once every
splitter is within tolerance, rows are exchanged once, by key range, and
numbered inside their range from the exact count of rows before it.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import constant_table

KEY_BITS = 60
#: Bits of the key that each pass can tell apart.
DEPTHS = (12, 20, 28, 36, 44, 52, 60)
#: A task's share of the exchange in bytes, and tasks at least and at most (a row of the broadcast table each).
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 1 << 28, 64, 100_000


def sort_key(text: Column, ident: Column) -> Column:
    """The 60-bit key of a document; never negative."""
    high = F.shiftright(F.shiftrightunsigned(F.xxhash64(text), 40), 0)
    return F.shiftleft(high, 36).bitwiseOR(F.shiftrightunsigned(F.xxhash64(ident), 28))


def n_ranges(total: int) -> int:
    """Tasks that the exchange should have, by the bytes it moves."""
    return min(MOST_RANGES, max(LEAST_RANGES, -(-total // RANGE_BYTES)))


def count_cells(keyed: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int, int, int]]:
    """Cells (first key, end key, bytes, rows) in key order, fine enough for the splitters and for the tasks' shares."""
    prefix = lambda bits: F.shiftrightunsigned(F.col("__key"), KEY_BITS - bits)
    done: list[tuple[int, int, int, int]] = []
    split: list[int] | None = None
    total = 0
    below: list[tuple[int, int, int, int]] = []
    for depth, bits in enumerate(DEPTHS):
        rows = keyed if split is None else keyed.where(prefix(DEPTHS[depth - 1]).isin(split))
        counted = rows.groupBy(prefix(bits).alias("cell")).agg(F.sum("__bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        width = KEY_BITS - bits
        below = [(r["cell"] << width, (r["cell"] + 1) << width, r["bytes"], r["n"]) for r in counted]
        total = total or sum(c[2] for c in below)
        cells = sorted(done + below)
        fine, coarse = tolerance * total / shards, total / n_ranges(total)
        before, open_cells, kept = 0, [], set(below)
        for cell in cells:
            after = before + cell[2]
            holds = int(before * shards // total) != int((after - 1) * shards // total) if total else False
            if cell in kept and cell[3] > 1 and (cell[2] > coarse or holds and cell[2] > fine):
                open_cells.append(cell)
            before = after
        if not open_cells or depth + 1 == len(DEPTHS):
            return cells
        again = set(open_cells)
        done = [c for c in cells if c not in again]
        split = [c[0] >> width for c in open_cells]
    return sorted(done + below)


def key_ranges(cells: list[tuple[int, int, int, int]], shards: int) -> list[list[int]]:
    """Ranges [first key, end key, shard, rows of the shard before]: cells of one shard joined up to a task's share."""
    ends, total = [], 0
    for c in cells:
        total += c[2]
        ends.append(total)
    cuts = []
    for j in range(1, shards):
        goal = total * j / shards
        at = bisect.bisect_left(ends, goal)
        # the nearer of the two cell boundaries around the goal
        cuts.append(at if at < len(ends) and goal - (ends[at - 1] if at else 0) < ends[at] - goal else at + 1)
    out: list[list[int]] = []
    shard, slot, held = 0, 0, 0
    for i, (first, end, size, n) in enumerate(cells):
        moved = bisect.bisect_right(cuts, i)
        if moved != shard:
            shard, slot = moved, 0
        if out and out[-1][2] == shard and slot and held + size <= total / n_ranges(total):
            out[-1][1], held = end, held + size
        else:
            out.append([first, end, shard, slot])
            held = size
        slot += n
    return out


def shard(docs: DataFrame, shards: int = 40, text: str = "text", ident: str = "doc_id", tolerance: float = 0.002) -> DataFrame:
    """``docs`` with ``size, text_crc32, law, shard, slot, grown_shard``; shards are near equal in bytes.

    A NULL text counts as an empty one (16 bytes, CRC 0).  Rows that repeat
    both id and text share a key and stay in one shard, in any order among
    themselves; equal texts are neighbours, and only a splitter parts them.
    With fewer rows than shards some shards are empty, and an empty table gives
    an empty one.  Input columns with the names of new ones are replaced.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = (F.octet_length(body) + 16).cast("long")
    plain = docs.drop(*({"size", "text_crc32", "law", "shard", "slot", "grown_shard"} - {text, ident}))
    key = sort_key(body, F.col(f"`{ident}`"))
    cells = count_cells(plain.select(key.alias("__key"), size.alias("__bytes")), shards, tolerance)
    table = key_ranges(cells, shards)
    # each first-pass cell lists the ranges that overlap it: at most 4096 cells and the ranges' own number more
    width = KEY_BITS - DEPTHS[0]
    listed = [[c, i, *r] for i, r in enumerate(table) for c in range(r[0] >> width, ((r[1] - 1) >> width) + 1)]
    names = ("__cell", "__range", "__first", "__end", "shard", "__before")
    found = constant_table(docs.sparkSession, [dict(zip(names, r)) for r in listed], ", ".join(f"{n} bigint" for n in names))
    rows = plain.withColumns({"size": size, "text_crc32": F.crc32(body), "law": F.lit("bytes"), "__key": key})
    rows = rows.withColumn("__cell", F.shiftrightunsigned(F.col("__key"), width))
    placed = rows.join(F.broadcast(found), (rows["__cell"] == found["__cell"]) & (rows["__key"] >= found["__first"]) & (rows["__key"] < found["__end"])).drop(found["__cell"])
    within = Window.partitionBy("__range").orderBy("__key", F.col(f"`{ident}`"), "size", "text_crc32")
    slot = F.col("__before") + F.row_number().over(within) - 1
    return placed.withColumns({"slot": slot.cast("long"), "shard": F.col("shard").cast("int"), "grown_shard": F.lit(None).cast("int")}).drop("__key", "__cell", "__range", "__first", "__end", "__before")
