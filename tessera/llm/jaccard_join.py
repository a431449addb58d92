"""N-gram Jaccard join: exact links between documents whose shingle sets are alike, and their components.

A document's set holds a 64-bit hash of each run of five words.  Equal sets
are one class, and only classes are compared.  Candidate pairs come in tiles: a
tile is the classes that share one necessary token (a set's rarest fifth, of
which two alike sets must share one), in order of size, so that a class meets
only the band of sizes its own allows.  A parity bitmap of each set, as wide as
the set is large, bounds the overlap of a pair from above: bits that differ are
at most the elements that differ.  Pairs that the bound leaves open are decided
by intersecting their sorted arrays.

Large groups of near copies share all their tokens, so a first round links
classes to hubs by a few minimum hashes, and tiles then pair only classes that
are not connected yet: no link between components is lost, and a group costs
its size, not its square.  Members of a common token's tile bring their bitmap
along, so that a class which is alike to none of a large group is told from its
members inside the tile.  A tile of very many classes is split: those of its
largest component are dealt out, and the others come to every part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.graph import components
from tessera.staging import stage

from .text import free_name, words

SHINGLE = 5
#: Two sets link when the intersection is at least this many hundredths of the union.
PERCENT = 80
BANDS, ROWS = 8, 3
#: Hubs of each minimum-hash key, beside its smallest set.
HUBS = 6
#: Tokens that a task meets at least this often may be common ones, which prefixes take last; any list gives right results.
OFTEN, MOST_COMMON = 3, 200_000
WIDEST = 4096
#: Tiles of more classes than about this are split.
TILE = 1 << 15
#: Bits, at most, of the filter that tells which sets a verification needs.
MOST_BITS = 1 << 28

U = np.uint64
FACTOR = U(0x9E3779B97F4A7C15)
SEEDS = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A random number for each byte; A-Z have those of a-z.
LETTER = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LETTER[65:91] = LETTER[97:123]
with np.errstate(over="ignore"):
    POWER = np.cumprod(np.full(1 << 16, FACTOR, np.uint64), dtype=np.uint64)
#: Bytes of text that are hashed at once; the arrays that this makes are some forty times as large.
PIECE = 1 << 18


def hashed_words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie side by side, and where each text's words begin and end among them."""
    word = ~BLANK[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begin = edges[:-1][edges[:-1] < len(data)]
    first[begin] |= word[begin]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(edges), np.int64)
    at = np.flatnonzero(word)
    own = np.cumsum(first)[at] - 1
    place = at - starts[own]
    with np.errstate(over="ignore"):
        # a letter's number times a power of its place in the word
        value = LETTER[data[at]] * POWER[place & 0xFFFF] * (place >> 16 << 1 | 1).astype(np.uint64)
        out = mix(np.add.reduceat(value, np.flatnonzero(first[at])))
    return out, np.searchsorted(starts, edges)


def pieces(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """A long text in pieces that end at blanks."""
    while hi - lo > PIECE:
        blank = np.flatnonzero(BLANK[data[lo + PIECE : hi]])
        cut = lo + PIECE + int(blank[0]) if len(blank) else hi
        yield lo, cut
        lo = cut
    yield lo, hi


def shingles(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle are one, none are none."""
    if not pa.types.is_binary(column.type):  # sessions may use the large types
        column = column.cast(pa.binary())
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    # NULL texts have no length either
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + PIECE, side="right")) - 1)
        if edges[hi] - edges[lo] > PIECE:  # one long text
            values = np.concatenate([hashed_words(data[a:b], np.array([0, b - a]))[0] for a, b in pieces(data, edges[lo], edges[hi])])
            bounds = np.array([0, len(values)])
        else:
            values, bounds = hashed_words(data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo])
        yield from shingle_sets(values, bounds, size)
        lo = hi


def shingle_sets(values: np.ndarray, edges: np.ndarray, size: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, len(values) - size + 1), np.uint64)
        for i in range(size):
            runs = runs * FACTOR + values[i : i + len(runs)]
        runs = mix(runs)
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a >= size:
            s = np.sort(runs[a : b - size + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            with np.errstate(over="ignore"):
                x = np.zeros(1, np.uint64)
                for v in values[a:b]:
                    x = x * FACTOR + v
                yield mix(x + U(int(b - a)))
        else:
            yield np.empty(0, np.uint64)


def name(s: np.ndarray) -> int:
    """The class of a set: a hash of its elements and their number."""
    with np.errstate(over="ignore"):
        x = np.add.reduce(mix(s ^ U(0x5851F42D4C957F2D)), dtype=np.uint64) + U(len(s)) * FACTOR
        return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of elements on each of a power of two of bits, at least as many bits as elements."""
    width = 64
    while width < len(s) and width < WIDEST:
        width *= 2
    return np.packbits(np.bincount((s & U(width - 1)).astype(np.int64), minlength=width) & 1 == 1).tobytes()


def most_overlap(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """An upper bound of two sets' intersection; the wider bitmap is folded to the other's width."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    # bit i of the wide map and of its fold agree modulo the width, as both are powers of two
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (n_a + n_b - int(np.bitwise_count(x ^ y).sum())) // 2


def alike(overlap: int, n_a: int, n_b: int, percent: int) -> bool:
    return overlap * (100 + percent) >= percent * (n_a + n_b)


def bands(s: np.ndarray) -> list[int]:
    with np.errstate(over="ignore"):
        least = (s[None, :] * SEEDS[:, None]).min(axis=1).reshape(BANDS, ROWS)
        out = np.arange(BANDS, dtype=np.uint64)
        for i in range(ROWS):
            out = mix(out * FACTOR + least[:, i])
    return out.view(np.int64).tolist()


def bodies(docs: DataFrame, text: str, ident: str) -> DataFrame:
    """(ident, body): texts as bytes; NULL is empty."""
    return docs.select(F.col(f"`{ident}`").alias("ident"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("body"))


def summaries(rows: DataFrame, size: int) -> DataFrame:
    """(ident, n, class, bits, bands) of each document, and rows (-count, token) of tokens that a task met often."""
    kind = dict(rows.dtypes)["ident"]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, met, seen = None, {}, set()
        for batch in batches:
            n, names, bits, keys, fresh = [], [], [], [], []
            for s in shingles(batch.column(1), size):
                n.append(len(s))
                names.append(name(s) if len(s) else None)
                first = len(s) and names[-1] not in seen
                # copies within a task need only their class
                bits.append(bitmap(s) if first else None)
                keys.append(bands(s) if first else None)
                if first:
                    seen.add(names[-1])
                    fresh.append(s)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays(columns, ["ident", "n", "class", "bits", "bands"])
            schema = out.schema
            if fresh:
                token, count = np.unique(np.concatenate(fresh), return_counts=True)
                for t, c in zip(token[count > 2].view(np.int64).tolist(), count[count > 2].tolist()):
                    met[t] = met.get(t, 0) + c
            yield out
        often = sorted((t for t in met if met[t] >= OFTEN), key=lambda t: -met[t])[:MOST_COMMON]
        if often:
            none = [pa.nulls(len(often), schema.field(i).type) for i in (0, 3, 4)]
            yield pa.RecordBatch.from_arrays([none[0], pa.array([-met[t] for t in often], pa.int64()), pa.array(often, pa.int64()), none[1], none[2]], schema=schema)

    return rows.mapInArrow(summarise, f"ident {kind}, n long, class long, bits binary, bands array<bigint>")


def prefixes(rows: DataFrame, common: list[tuple[int, int]], size: int, percent: int) -> DataFrame:
    """(class, n, tokens, common, bits): each class's necessary tokens, rarest first; a class may come once from each task.

    From place ``common`` on the tokens are among the common ones; only classes
    that have such tokens bring their bitmap.
    """
    order = np.array(sorted(t for t, _ in common), np.int64).view(np.uint64)
    order = np.sort(order)
    count = {t: c for t, c in common}
    often = np.array([count[int(t)] for t in order.view(np.int64)], np.int64)
    held = rows.sparkSession.sparkContext.broadcast((order, often))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, often = held.value
        seen: set[int] = set()
        for batch in batches:
            names, sizes, tokens, firsts, bits = [], [], [], [], []
            for s in shingles(batch.column(1), size):
                if not len(s) or (c := name(s)) in seen:
                    continue
                seen.add(c)
                need = len(s) - -(-percent * len(s) // 100) + 1
                first, whole = need, s
                if len(order):
                    at = np.minimum(np.searchsorted(order, s), len(order) - 1)
                    rank = np.where(order[at] == s, often[at], 0)
                    first = min(need, int((rank == 0).sum()))
                    s = s[np.argsort(rank, kind="stable")]
                names.append(c)
                sizes.append(len(s))
                tokens.append(s[:need].view(np.int64))
                firsts.append(first)
                bits.append(bitmap(whole) if first < need else None)
            columns = [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(firsts, pa.int32()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["class", "n", "tokens", "common", "bits"])

    return rows.mapInArrow(cut, "class long, n long, tokens array<bigint>, common int, bits binary")


def dealt(tokens: DataFrame, often: list[int], tile: int) -> DataFrame:
    """(token, n, class, root, at, bits): the members of each tile together, by size.

    ``often`` are tokens that may have more than ``tile`` members.  Their tiles
    are split.  Members of the token's largest component, which need not meet
    each other, and all others are cut into blocks of some ``tile`` members;
    there is a part for each block of the one with each of the other, and for
    each two blocks of the others, so that no part has more than two blocks,
    whatever components the members are of.
    """

    def members(rows: DataFrame) -> DataFrame:
        spread = rows.select("n", "class", "root", "bits", "common", F.posexplode("tokens").alias("at", "token"))
        return spread.select("token", "n", "class", "root", "at", F.when(F.col("at") >= F.col("common"), F.col("bits")).alias("bits"))

    if not often:
        spread = members(tokens)
    else:
        # as many rows as there are common tokens at most
        named = tokens.sparkSession.createDataFrame([(t,) for t in often], "token long")
        spread = members(stage(tokens, "tokens"))
        by_root = spread.select("token", "root").join(F.broadcast(named), "token").groupBy("token", "root").count()
        sums = by_root.groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("home"), F.max("count").alias("most"), F.sum("count").alias("all")).where(F.col("all") > tile)
        blocks = lambda n: F.greatest(F.lit(1).cast("long"), F.ceil(n / tile))
        parts = sums.select("token", "home", blocks(F.col("most")).alias("own"), blocks(F.col("all") - F.col("most")).alias("other"))
        upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        place = lambda n: F.pmod(F.xxhash64("class"), n)
        to_own = lambda i, j: F.xxhash64("whole", F.lit(0), i, j)
        at_home = F.transform(upto(F.col("other")), lambda j: to_own(place(F.col("own")), j))
        away = F.transform(upto(F.col("own")), lambda i: to_own(i, place(F.col("other"))))
        apart = F.transform(upto(F.col("other")), lambda j: F.xxhash64("whole", F.lit(1), F.least(j, place(F.col("other"))), F.greatest(j, place(F.col("other")))))
        part = F.when(F.col("own").isNull(), F.array(F.col("whole"))).when(F.col("root") == F.col("home"), at_home).when(F.col("other") == 1, away).otherwise(F.concat(away, apart))
        spread = spread.join(F.broadcast(stage(parts, "parts")), "token", "left").withColumnRenamed("token", "whole")
        spread = spread.select(F.explode(part).alias("token"), "n", "class", "root", "at", "bits")
    return spread.repartition(F.col("token")).sortWithinPartitions("token", "n", "class")


class Bits:
    """Bitmaps of a tile's members, by width, to tell which of them can be alike to another."""

    def __init__(self, column: pa.Array):
        found = [b.as_buffer() for b in column]
        self.rows = found
        self.width = np.array([b.size // 8 for b in found], np.int64)
        self.place = np.zeros(len(found), np.int64)
        self.maps: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.place[own] = np.arange(len(own))
            self.maps[w] = np.frombuffer(b"".join(found[i] for i in own.tolist()), np.uint64).reshape(-1, w)

    def differ(self, others: np.ndarray, j: int) -> np.ndarray:
        """For each of the ``others``, none wider than ``j``, the bits in which its map and that of ``j`` differ."""
        out = np.empty(len(others), np.int64)
        x = np.frombuffer(self.rows[j], np.uint64)
        width = self.width[others]
        for w in np.unique(width)[::-1].tolist():
            while len(x) > w:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            own = np.flatnonzero(width == w)
            out[own] = np.bitwise_count(self.maps[w][self.place[others[own]]] ^ x).sum(axis=1)
        return out


def tiles(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of a tile's classes that can be alike and are in different components.

    Sizes must lie within the band, ``at`` (the token's place in the class's
    order) must leave room for the rest of the overlap, and so must the bitmaps
    where the members have them.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column(0).to_numpy()
            last = int(np.searchsorted(token, token[-1]))
            if last or held and held[-1].column(0)[0].as_py() != token[-1]:
                yield from out([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        yield from out(held)

    def out(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(b.num_rows for b in batches) < 2:
            return
        token, n, cls, root, at = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in range(5))
        bits = pa.chunked_array([b.column(5) for b in batches]).combine_chunks()
        edges = np.concatenate(([0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]))
        a_out, b_out, count = [], [], 0
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if hi - lo < 2 or root[lo:hi].min() == root[lo:hi].max():
                continue
            sizes, roots, places, names = n[lo:hi], root[lo:hi], at[lo:hi], cls[lo:hi]
            maps = None
            for j in range(1, hi - lo):
                # the band of smaller sets that are large enough
                first = np.searchsorted(sizes, -(-percent * int(sizes[j]) // 100))
                if first >= j:
                    continue
                i = slice(first, j)
                most = np.minimum(sizes[i] - places[i], sizes[j] - places[j])
                open_ = first + np.flatnonzero((roots[i] != roots[j]) & (most * (100 + percent) >= percent * (sizes[i] + sizes[j])))
                if len(open_) and bits[lo].is_valid:
                    maps = maps or Bits(bits[lo:hi])
                    both = sizes[open_] + sizes[j]
                    open_ = open_[(both - maps.differ(open_, j)) // 2 * (100 + percent) >= percent * both]
                if len(open_):
                    found = names[open_]
                    a_out.append(np.minimum(found, names[j]))
                    b_out.append(np.maximum(found, names[j]))
                    count += len(found)
            if count > 100_000:
                yield batch_of(a_out, b_out)
                a_out, b_out, count = [], [], 0
        if count:
            yield batch_of(a_out, b_out)

    def batch_of(a: list, b: list) -> pa.RecordBatch:
        both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["a", "b"])

    return members.mapInArrow(pairs, "a long, b long").distinct()


def verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link: first by the bitmaps' bound, then by the sets themselves."""
    side = lambda x: classes.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [alike(most_overlap(p, i, q, j), i, j, percent) for i, j, p, q in zip(n_a, n_b, x, y)]
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    open_ = stage(met.mapInArrow(bounded, "a long, b long, n_a long, n_b long"), "pairs")
    needed = open_.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    total = needed.count()
    if not total:
        return open_.select("a", "b")
    width = 1024
    while width < 16 * total and width < MOST_BITS:
        width *= 2
    # a bounded summary of the needed classes; what it lets through in error meets no pair below
    set_bits = needed.select(F.pmod("class", F.lit(width)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    filled = np.zeros(width // 64, np.int64)
    for r in set_bits.toLocalIterator():
        filled[r["at"]] = r["bits"]
    held = rows.sparkSession.sparkContext.broadcast(filled)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, seen = held.value, set()
        for batch in batches:
            names, found = [], []
            for s in shingles(batch.column(1), size):
                if not len(s):
                    continue
                c = name(s)
                bit = c % width
                if c not in seen and filled[bit >> 6] >> (bit & 63) & 1:
                    seen.add(c)
                    names.append(c)
                    found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(found, pa.binary())], ["class", "set"])

    # one reading of the texts serves both sides of the pairs
    whole = stage(rows.mapInArrow(sets, "class long, set binary"), "needed")
    both = open_.join(whole.withColumnsRenamed({"class": "a", "set": "set_a"}), "a").join(whole.withColumnsRenamed({"class": "b", "set": "set_b"}), "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep.append(alike(int((y[at] == x).sum()), len(x), len(y), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "set_a", "set_b").mapInArrow(exact, "a long, b long").distinct()


def join(docs: DataFrame, text: str = "text", ident: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """(ident, n_shingles, component_id) for each document.

    Texts are lower-cased (A-Z) and split at blanks; with fewer than ``size``
    words the whole sequence is the one shingle.  NULL and wordless texts have
    an empty set and link with nothing: their component is their own id.  The
    component is the smallest id reachable by links; NULL ids take part, but
    name no component unless no other id is there.  Repeated rows each get a
    row; an empty table gives an empty one.
    """
    rows = bodies(docs, text, ident)
    found = stage(summaries(rows, size), "sets")
    own = found.where("n > 0")
    classes = stage(own.groupBy("class").agg(F.max("n").alias("n"), F.min("ident").alias("least"), F.max("bits").alias("bits"), F.max("bands").alias("bands")), "classes")
    common = found.where("n < 0").groupBy("class").agg((-F.sum("n")).alias("count")).orderBy(F.desc("count"), "class").limit(MOST_COMMON)
    common_list = [(r["class"], r["count"]) for r in common.collect()]
    # round one: each class to the hub it shares most minimum hashes with, then those that missed it to several more
    keys = classes.select("class", "n", F.explode("bands").alias("key"))
    spread = [F.min(F.struct(F.xxhash64("class", F.lit(i)).alias("h"), "class")).alias(f"h{i}") for i in range(HUBS)]
    hubs = keys.groupBy("key").agg(F.min(F.struct("n", "class")).alias("low"), *spread, F.count(F.lit(1)).alias("of")).where("of > 1")
    each = F.array("low.class", *(f"h{i}.class" for i in range(HUBS)))
    near = keys.join(hubs.select("key", F.array_distinct(each).alias("hubs")), "key").select("class", F.explode("hubs").alias("hub")).where("class != hub")
    near = near.groupBy("class", "hub").count()
    pair = lambda df: df.select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()
    best = near.groupBy("class").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    first = stage(verified(pair(best), classes, rows, size, percent), "links")
    linked = first.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    order = Window.partitionBy("class").orderBy(F.desc("count"), "hub")
    missed = near.join(linked, "class", "left_anti").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= 2 * HUBS)
    first = stage(first.unionByName(verified(pair(missed), classes, rows, size, percent)), "links")
    roots = components(first)
    # round two: every pair of a tile that round one has not connected
    tokens = prefixes(rows, common_list, size, percent).join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    members = dealt(tokens, [t for t, c in common_list if c > tile], tile)
    second = stage(verified(tiles(members, percent), classes, rows, size, percent), "links")
    # what the second round adds are links between the first one's components
    low = F.coalesce("root", "class")
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    between = second.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = components(between).select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    placed = classes.select("class", "least").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", low)
    placed = placed.join(joined, F.col("root") == F.col("__node"), "left").withColumn("root", F.coalesce("__root", "root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = placed.join(ids, "root").select("class", "component_id")
    with_set = own.select("ident", "n", "class").join(by_class, "class").select("ident", F.col("n").alias("n_shingles"), "component_id")
    return with_set.unionByName(found.where("n = 0").select("ident", F.col("n").alias("n_shingles"), F.col("ident").alias("component_id")))


def deduplicate(docs: DataFrame, text: str = "text", ident: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of links, the one with the least id; all columns stay as they are.

    Documents without words are in no group and all stay.  A NULL id is less
    than any other; of texts under one id the one with the least hash stays,
    and of rows that repeat both, one.  Columns may have any names.
    """
    key = F.struct(F.col(f"`{ident}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("print"))
    keyed = docs.select(key.alias("key"), F.col(f"`{text}`").alias("text"))
    found = stage(join(keyed, "text", "key", size, percent), "groups")
    kept = found.where("n_shingles = 0 OR ident = component_id").select(F.col("ident.id").alias("__id"), F.col("ident.print").alias("__print")).distinct()
    print_of = lambda df: F.xxhash64(F.coalesce(df[f"`{text}`"], F.lit("")))
    # bound to their frames, since documents may have columns of these names
    rows = docs.join(kept, docs[f"`{ident}`"].eqNullSafe(kept["__id"]) & (print_of(docs) == kept["__print"]), "left_semi")
    repeats = found.where("n_shingles > 0").groupBy("ident").count().where("count > 1")
    if repeats.isEmpty():
        return rows
    # only where rows repeat an id and a text is there more than one to choose from
    empty = F.size(words(F.col(f"`{text}`"))) == 0
    own = free_name(docs, "__own")
    return rows.where(~empty).withColumn(own, print_of(rows)).dropDuplicates([ident, own]).drop(own).unionByName(rows.where(empty))
