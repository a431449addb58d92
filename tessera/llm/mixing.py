"""Mixing sources to target weights: Sainte-Laguë seats for equal-token blocks, then seeded blocks.

Sizes are summed by source, which gives each source its target.  Documents are
dealt into shards by hash; in a shard each source lays its documents end to
end in a seeded order and cuts that line into equal-token blocks.  A shard's
blocks are seats that the highest quotients of its sources' shares win, up to
three times the blocks a source has there; a source with more seats than blocks
takes whole rounds of its line first.  The blocks that fill the last, partial
round lie evenly along the line from a seeded place on, so each row finds its
own words' count by arithmetic: no block is ever a row.  Shards are as many as
the words ask for; their seats are found where their rows are, and only the
sizes of the sources reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import constant_table, let, words

#: No document is taken more often than this, and no target exceeds it times the source's size.
REPEATS = 3
#: The driver holds one size for each source, at most this many.
MOST_SOURCES = 1_000_000
#: Rows, at most, of a table of sources or seats (under 100 bytes each) that is broadcast; larger ones are joined by shuffle.
MOST_BROADCAST = 100_000


def targets(sizes: dict[str | None, int], weights: tuple[float, ...]) -> dict[str | None, float]:
    """Each source's target: all tokens by weight, none above ``REPEATS`` times its size, the excess reshared by weight."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    free, left = list(order), float(sum(sizes.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > REPEATS * sizes[s]]
        if not full:
            out |= {s: unit * weight[s] for s in free}
            break
        for s in full:
            out[s] = float(REPEATS * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def seats(votes: Column, most: Column, total: Column) -> Column:
    """Sainte-Laguë over arrays: ``total`` seats by the highest quotients votes/(2k+1), none above ``most``; ties to the earlier.

    The divisor that would just fit is found by halving; seats that are then
    still free go one by one to the highest quotients that are left.
    """
    long = lambda x: x.cast("long")

    def won(x: Column) -> Column:
        fit = lambda d: F.zip_with(x["votes"], x["most"], lambda v, m: F.when(v > 0, F.least(m, long(F.floor(v / d + 0.5)))).otherwise(long(F.lit(0))))
        add = lambda a: F.aggregate(a, long(F.lit(0)), lambda t, n: t + n)
        whole = F.aggregate(x["votes"], F.lit(0.0), lambda t, v: t + v)
        halve = lambda s, _: let(F.struct(s["low"].alias("low"), s["high"].alias("high"), ((s["low"] + s["high"]) / 2).alias("mid")), lambda y: F.when(add(fit(y["mid"])) > x["total"], F.struct(y["mid"].alias("low"), y["high"].alias("high"))).otherwise(F.struct(y["low"].alias("low"), y["mid"].alias("high"))))
        divisor = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(F.lit(0.0).alias("low"), (2 * whole + 1).alias("high")), halve)["high"]
        return let(fit(divisor), lambda first: let(x["total"] - add(first), lambda left: F.when(left <= 0, first).otherwise(topped(x, first, left))))

    def topped(x: Column, first: Column, left: Column) -> Column:
        # at the divisor found, no party is more than one seat short
        quotient = lambda i: F.get(x["votes"], i) / (2 * F.get(first, i) + 1)
        open_ = F.filter(F.sequence(F.lit(0), F.size(first) - 1), lambda i: (F.get(x["votes"], i) > 0) & (F.get(first, i) < F.get(x["most"], i)))
        order = F.array_sort(F.transform(open_, lambda i: F.struct((-quotient(i)).alias("q"), i.alias("i"))))
        lucky = F.transform(F.slice(order, F.lit(1), F.least(left, F.size(order).cast("long")).cast("int")), lambda s: s["i"])
        return let(lucky, lambda chosen: F.transform(first, lambda n, i: n + F.when(F.array_contains(chosen, i), 1).otherwise(0)))

    bound = F.zip_with(votes, most, lambda v, m: F.when(v > 0, m).otherwise(F.lit(0).cast("long")))
    room = F.aggregate(bound, F.lit(0).cast("long"), lambda t, m: t + m)
    return let(F.struct(votes.alias("votes"), most.alias("most"), F.least(total.cast("long"), room).alias("total")), won)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), text: str = "text", source: str = "source", ident: str = "doc_id", seed: int = 20, block: int = 64, shard_tokens: int = 200_000) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken``: the words that the mix takes of each, repeats counted.

    ``weights`` repeat over the sources in code-point order, NULL last.  NULL
    and blank texts have size 0 and take nothing; a source with no words has
    target 0.  Rows that repeat an id and text lie side by side on the line, and
    each has its own share.  Reruns agree, whatever the partitions.  Input
    columns with the names of new ones are replaced; an empty table gives an
    empty one.  More than ``MOST_SOURCES`` sources are refused.
    """
    placed = _placed(docs, weights, text, source, ident, seed, block, shard_tokens)
    return placed.withColumn("taken", taken()).drop(*HIDDEN)


HIDDEN = ("__c", "__k", "__at", "__s", "__c3", "__k3", "__n", "__rounds", "__extra", "__first", "__end", "__line")


def _placed(docs: DataFrame, weights: tuple[float, ...], text: str, source: str, ident: str, seed: int, block: int, shard_tokens: int) -> DataFrame:
    """``docs`` with sizes and targets, each row's place on its line, and the seats of that line."""
    plain = docs.drop(*({"size", "source_size", "target", "taken", *HIDDEN} - {text, source, ident}))
    body, name = F.col(f"`{text}`"), F.col(f"`{source}`")
    rows = plain.withColumn("size", F.size(words(body)).cast("long"))
    place = F.xxhash64(F.lit(seed), F.col(f"`{ident}`"), F.crc32(F.coalesce(body, F.lit(""))))
    sums = rows.groupBy(name.alias("source")).agg(F.sum("size").alias("tokens")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sizes = {r["source"]: r["tokens"] for r in sums}
    goal = targets(sizes, weights)
    shards = max(1, -(-sum(sizes.values()) // shard_tokens))
    # a source's number stands for its name, NULL too, from here on
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    known = constant_table(docs.sparkSession, [{"__s": s, "__c": i, "source_size": sizes[s], "target": goal[s]} for i, s in enumerate(order)], "__s string, __c int, source_size bigint, target double")
    known = F.broadcast(known) if len(order) <= MOST_BROADCAST else known
    rows = rows.join(known, name.eqNullSafe(F.col("__s")), "left").withColumns({"__k": F.pmod(place, F.lit(shards)), "__at": place})
    lines = rows.where("size > 0").groupBy("__c", "__k", "source_size", "target").agg(F.sum("size").alias("line"))
    seated = allotted(lines, block, seed).withColumnsRenamed({"__c": "__c3", "__k": "__k3"})
    seated = F.broadcast(seated) if shards * len(order) <= MOST_BROADCAST else seated
    # where the seats are not broadcast, this join deals rows as the window below needs them
    joined = rows.join(seated, (F.col("__c") == F.col("__c3")) & (F.col("__k") == F.col("__k3")), "left")
    line = Window.partitionBy("__c", "__k")
    ordered = line.orderBy("__at", F.col(f"`{ident}`"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumns({"__end": F.sum("size").over(ordered), "__line": F.sum("size").over(line)})


def allotted(lines: DataFrame, block: int, seed: int) -> DataFrame:
    """(source, shard, n, rounds, extra, first): blocks, whole rounds, blocks of the last round and the place it starts from."""
    n = F.greatest(F.lit(1), F.round(F.col("line") / block).cast("long"))
    # votes in a source's own blocks, so that targets at the limit are met in full
    vote = F.col("target") * F.col("n") / F.col("source_size")
    each = lines.withColumn("n", n).withColumn("vote", vote)
    group = each.groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("__c", "n", "vote"))).alias("all"))
    pick = lambda f: F.transform("all", lambda x: x[f])
    total = F.round(F.aggregate(pick("vote"), F.lit(0.0), lambda t, v: t + v)).cast("long")
    won = group.select("__k", "all", seats(pick("vote"), F.transform("all", lambda x: x["n"] * REPEATS), total).alias("won"))
    row = won.select("__k", F.explode(F.arrays_zip("all", "won")).alias("z")).select(F.col("z.all.__c").alias("__c"), "__k", F.col("z.all.n").alias("__n"), F.col("z.won").alias("__won"))
    start = F.pmod(F.xxhash64(F.lit(seed), "__k", "__c"), F.col("__n"))
    return row.select("__c", "__k", "__n", _floor_div(F.col("__won"), F.col("__n")).alias("__rounds"), F.pmod("__won", "__n").alias("__extra"), start.alias("__first"))


def chosen(block: Column) -> Column:
    """Whether a block of the line is one of those that fill the last round: ``extra`` of ``n``, evenly spread from ``first`` on."""
    n, extra = F.col("__n"), F.col("__extra")
    at = F.pmod(block + F.col("__first"), n)
    return _floor_div((at + 1) * extra, n) > _floor_div(at * extra, n)


def taken() -> Column:
    """Whole rounds of the row's words, and those of its words that lie in a chosen block of the last round."""
    n, size, end, line = F.col("__n"), F.col("size"), F.col("__end"), F.col("__line")
    start = end - size
    # block i spans words floor(i * line / n) up to floor((i + 1) * line / n)
    cut = lambda i: _floor_div(i * line, n)
    first, last = _floor_div((start + 1) * n - 1, line), _floor_div(end * n - 1, line)
    part = lambda i: F.greatest(F.lit(0).cast("long"), F.least(end, cut(i + 1)) - F.greatest(start, cut(i)))
    extra = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda acc, i: acc + F.when(chosen(i), part(i)).otherwise(F.lit(0).cast("long")))
    return F.when((size == 0) | n.isNull(), F.lit(0).cast("long")).otherwise(F.col("__rounds") * size + F.when(F.col("__extra") == 0, F.lit(0).cast("long")).otherwise(extra))


def _floor_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def sample(docs: DataFrame, text: str = "text", ident: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), seed: int = 20, block: int = 64, shard_tokens: int = 200_000) -> DataFrame:
    """``docs`` as the mix takes them, whole: each row once for every round, and once more where the block of its middle word is chosen.

    Rows without words are taken never; the columns are those of ``docs``.
    """
    placed = _placed(docs, weights, text, source, ident, seed, block, shard_tokens)
    middle = _floor_div((F.col("__end") - F.col("size") + _floor_div(F.col("size"), F.lit(2))) * F.col("__n"), F.col("__line"))
    times = F.when((F.col("size") == 0) | F.col("__n").isNull(), 0).otherwise(F.col("__rounds") + chosen(middle).cast("int")).cast("int")
    repeated = placed.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times)))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))
