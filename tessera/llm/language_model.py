"""Hashed maximum-entropy language model with a class-factored softmax.

A word's probability is that of its class given the words before it, times that
of its part of the class given both, times its own within the part.  Classes
are a cluster of words that keep like company, crossed with a band of
frequency; rare words join the cluster whose spelling they share.  Parts cut a
class into pieces of like mass, so that its frequent words stand nearly alone.
The first two factors are maximum-entropy models over hashed features of the
context (the last word, the last two, and two skips): a softmax over the summed
weights of the features.  The third factor's weights are its words' counts, the
maximum-entropy solution without context.  Words never seen are one class of
their own, learned from the words that training sees once.

All documents give, for each row of the hashed weights, how often each class
followed; a row's weights are the log-odds of those counts times a strength
that rows of its kind of feature and of like frequency share.  The strengths
are trained by distributed gradient updates: each round sums the gradient of
the likelihood over all training documents, with its products, which stand for
the curvature, and takes a scoring step.  Since counts flatter the tokens they
come from, each token is judged by counts that leave it out.  Sums are of whole
numbers, so that scores do not depend on how documents are dealt to tasks.

Counts come from all training documents.  Only the most frequent words' counts
travel to the workers; the others' are joined to the documents that hold them.
The table of weights grows with the training tokens up to a bound that a worker
can hold, and words that come often enough have a context of their own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.staging import stage

#: The token that ends every text; no word is empty.
END = b""
#: Words whose company is counted, the words that are counted as company, and the clusters they fall into.
HEAD, COMPANY, CLUSTERS = 4096, 64, 12
#: Ranks at which a band of frequency begins; the last band holds the words beyond the head.
BANDS = (0, 32, 512, HEAD)
#: Parts of a class.
PARTS = 16
#: Words, at most, whose counts travel to the workers, and the count from which a word is a context of its own.
CARRIED, OWN_CONTEXT = 300_000, 8
#: Rows of the weights for each training token, at least and at most (2^17 rows are 34 MB), and features a token.
TOKENS_A_ROW, LEAST_BITS, MOST_BITS, FEATURES = 1024, 15, 17, 4
#: Tokens that are worked on at once, and tokens for each task that holds a table of weights.
BATCH, TASK_TOKENS = 4096, 500_000_000
#: The strength that rows start from, the counts that the prior weighs, the rounds, and the classes of frequency that have strengths of their own.
START, PRIOR, ROUNDS, LEVELS = 0.5, 10.0, 2, 8
#: Texts, and bytes of them or of their numbers, that are worked on together; a longer text is alone.
TEXTS, BYTES, NUMBER_BYTES = 2048, 1 << 22, 1 << 18
#: Weights of a token that add up to less than this in size keep their powers, and sums of these, within single precision.
SAFE = 80.0
#: Gradients are summed in this fraction of one, and weights of spelling in that.
GRAIN, SPELLING_GRAIN = 1 << 16, 1 << 40
#: Bits of the filter of words that training sees more than once.
MOST_FILTER = 1 << 27
#: Bytes of texts whose words are counted together, and words whose spelling is looked at together.
COUNTED, SPELLED = 1 << 24, 20_000

N_CLASSES = CLUSTERS * len(BANDS) + 1
UNSEEN = N_CLASSES - 1


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased, parted by blanks (space and 9 to 13)."""
    return text.lower().split() if text else []


def held_out(ident: Column, folds: int, held: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit(""))), F.lit(folds)) == held


@dataclass
class Spelling:
    """Log-weights of groups of three letters for each cluster, in grains; ``rank`` numbers the letters, ``group`` the groups of such numbers."""

    rank: np.ndarray
    group: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, letters: dict[bytes, np.ndarray]) -> Spelling:
        """Letters and groups that no word of the head holds have number 0, whose weights are 0."""
        rank, weights = np.zeros(256, np.int64), np.zeros((len(letters) + 1, CLUSTERS), np.int64)
        known = np.frombuffer(b"".join(letters), np.uint8)
        rank[np.unique(known)] = 1 + np.arange(len(np.unique(known)))
        size = int(rank.max()) + 1
        group = np.zeros(size**3, np.int32)
        a, b, c = rank[known.reshape(-1, 3)].T
        group[(a * size + b) * size + c] = 1 + np.arange(len(letters))
        if letters:
            # whole numbers, so that the order in which groups are added does not matter
            weights[1:] = np.rint(np.array(list(letters.values())) * SPELLING_GRAIN)
        return cls(rank, group, weights)


def spelled(words: list[bytes], spelling: Spelling) -> np.ndarray:
    """The classes of rare words: the cluster whose words are spelled most like each, in the last band."""
    best = np.zeros(len(words), np.int64)
    for lo in range(0, len(words), SPELLED):
        some = words[lo : lo + SPELLED]
        rank = spelling.rank[np.frombuffer(b"^" + b"$^".join(some) + b"$", np.uint8)]
        length = np.fromiter(map(len, some), np.int64, len(some))
        # a word has as many groups as letters, and its edges part it from the next
        of = np.repeat(np.arange(len(some)), length)
        at = np.arange(len(of)) + 2 * of
        size = int(spelling.rank.max()) + 1
        group = spelling.group[(rank[at] * size + rank[at + 1]) * size + rank[at + 2]]
        # each group counts once for a word
        met = np.sort((of * len(spelling.weights) + group)[group > 0])
        of, group = np.divmod(met[np.diff(met, prepend=-1) > 0], len(spelling.weights))
        first = np.flatnonzero(np.diff(of, prepend=-1))
        if len(first):
            best[lo + of[first]] = np.argmax(np.add.reduceat(spelling.weights[group], first, axis=0), axis=1)
    return best * len(BANDS) + len(BANDS) - 1


@dataclass
class Vocabulary:
    """What workers need: spelling weights, of each carried word its place in the arrays, and the filter of repeated words."""

    spelling: Spelling
    place: dict[bytes, int]
    ids: np.ndarray
    classes: np.ndarray
    parts: np.ndarray
    counts: np.ndarray
    repeated: np.ndarray  # packed bits

    def rare(self, words: list[bytes]) -> np.ndarray:
        """The cells of words that are not carried, by spelling and hash, doubled, and one more for each that training sees once, by the filter."""
        h = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
        bit = h & (8 * len(self.repeated) - 1)
        once = 1 - (self.repeated[bit >> 3] >> (bit & 7) & 1).astype(np.int64)
        return 2 * (spelled(words, self.spelling) * PARTS + h % PARTS) + once

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """A carried word's place; the others' numbers lie behind all places."""
        get = self.place.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        seldom = np.flatnonzero(at < 0)
        at[seldom] = len(self.ids) + self.rare([words[i] for i in seldom.tolist()])
        return at


def vocabulary_of(counts: dict[bytes, int], head: dict[bytes, int], own: np.ndarray, letters: Spelling, repeated: np.ndarray) -> Vocabulary:
    """Words that come often have an id of their own; the others' id is their class, so that rare contexts share what they teach."""
    n = np.fromiter(counts.values(), np.int64, len(counts))
    rank = np.fromiter((head.get(w, -1) for w in counts), np.int64, len(counts))
    rare = rank < 0
    classes = own[np.maximum(rank, 0)] * len(BANDS) + sum((rank >= b).astype(np.int64) for b in BANDS[1:-1])
    beyond = [w for w in counts if w not in head]
    classes[rare] = spelled(beyond, letters)
    ids = np.where(n >= OWN_CONTEXT, 100 + np.arange(len(counts)), 10 + classes).astype(np.uint64)
    parts = np.zeros(len(counts), np.int64)
    parts[rare] = [zlib.crc32(w) % PARTS for w in beyond]
    for c in np.unique(classes[~rare]).tolist():
        # words come most frequent first; a part closes once it has its share of the class
        at = np.flatnonzero((classes == c) & ~rare)
        before = np.cumsum(n[at]) - n[at]
        parts[at] = np.minimum(PARTS - 1, before * PARTS // max(1, int(n[at].sum())))
    return Vocabulary(letters, {w: i for i, w in enumerate(counts)}, ids, classes, parts, n.astype(float), repeated)


def grams(word: bytes) -> set[bytes]:
    """All groups of three letters of a word, its edges marked."""
    w = b"^" + word + b"$"
    return {w[i : i + 3] for i in range(len(w) - 2)}


def listed(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()


def parted(bodies: pa.Array) -> pa.Array:
    """The words of each text as a list, A-Z lower-cased; blanks at the edges of a text leave empty ones."""
    # bytes stay as they are: only A-Z and the blanks among the first 128 are looked at
    return pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(bodies.cast(pa.binary()), b"").view(pa.string())))


def split(bodies: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, codes, edges): the tokens of all texts in turn as places among the distinct words, and where each text's begin."""
    lists = parted(bodies)
    coded = lists.flatten().view(pa.binary()).dictionary_encode()
    words, own = listed(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
    end = words.index(END) if END in words else len(words)
    words = words if end < len(words) else [*words, END]
    # each text's own end is put behind its last word
    filled = own != end
    ends = np.concatenate(([0], np.cumsum(filled)))[lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()]
    edges = ends + np.arange(len(ends))
    codes = np.full(int(edges[-1]), end, np.int64)
    last = np.zeros(len(codes), bool)
    last[edges[1:] - 1] = True
    codes[~last] = own[filled]
    return words, codes, edges


def counted(bodies: DataFrame) -> DataFrame:
    """(word, n) over all texts, ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n in runs(batch.column(0), COUNTED, batch.num_rows):
                seen = parted(batch.column(0).slice(lo, n)).flatten().view(pa.binary()).value_counts()
                word, times = seen.field("values"), seen.field("counts")
                filled = pc.greater(pc.binary_length(word), 0)
                yield pa.RecordBatch.from_arrays([word.filter(filled), times.filter(filled)], ["word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([n], pa.int64())], ["word", "n"])

    return bodies.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def company(bodies: DataFrame, head: dict[bytes, int]) -> np.ndarray:
    """Counts of each head word with each of the most frequent words next to it or one further, over all texts."""
    sent = bodies.sparkSession.sparkContext.broadcast(list(head))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(HEAD * COMPANY, np.int64)
        known = pa.array(sent.value, pa.binary())
        for batch in batches:
            for lo, n in runs(batch.column(0)):
                lists = parted(batch.column(0).slice(lo, n))
                words = lists.flatten().view(pa.binary())
                filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
                ids = pc.fill_null(pc.index_in(words, known), -1).to_numpy(zero_copy_only=False)[filled].astype(np.int64)
                of = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[filled]
                for gap in (1, 2):
                    same = of[:-gap] == of[gap:]
                    for a, b in ((ids[:-gap], ids[gap:]), (ids[gap:], ids[:-gap])):
                        near = same & (a >= 0) & (b >= 0) & (b < COMPANY)
                        np.add.at(total, a[near] * COMPANY + b[near], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(HEAD * COMPANY)
    # HEAD * COMPANY cells, whatever the corpus
    found = bodies.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(HEAD, COMPANY)


def clusters(near: np.ndarray, n: np.ndarray) -> np.ndarray:
    """k-means of the head words' company, as weights of surprise, from a fixed start."""
    rows, cols = near.sum(axis=1, keepdims=True), near.sum(axis=0, keepdims=True)
    total = max(1.0, near.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(near > 0, np.maximum(0, np.log(near * total / (rows * cols))), 0.0)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm > 0, norm, 1)
    weigh = np.log1p(n)
    # each further centre is the word least like those before, by its weight
    centres = [x[int(np.argmax(weigh * (norm[:, 0] > 0)))]]
    for _ in range(CLUSTERS - 1):
        alike = np.max(x @ np.array(centres).T, axis=1)
        centres.append(x[int(np.argmax(weigh * (1 - alike) * (norm[:, 0] > 0)))])
    c = np.array(centres)
    for _ in range(30):
        own = np.argmax(x @ c.T, axis=1)
        for k in range(CLUSTERS):
            if (own == k).any():
                c[k] = (weigh[own == k, None] * x[own == k]).sum(axis=0)
        c /= np.maximum(1e-12, np.linalg.norm(c, axis=1, keepdims=True))
    return np.argmax(x @ c.T, axis=1)


def spelling(words: list[bytes], own: np.ndarray) -> Spelling:
    """Log-weights of letter groups for each cluster, by naive Bayes over the head's words."""
    seen: dict[bytes, np.ndarray] = {}
    for w, k in zip(words, own):
        for g in grams(w):
            seen.setdefault(g, np.zeros(CLUSTERS))[k] += 1
    size = np.bincount(own, minlength=CLUSTERS) + 1.0
    return Spelling.of({g: np.log((v + 0.1) / size) for g, v in seen.items()})


MIX = np.uint64(0x9E3779B97F4A7C15)


def scrambled(x: np.ndarray) -> np.ndarray:
    """``x`` itself, changed in place."""
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x


def contexts(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(feature, token) hashes: last word, last two, and the skips of one and two; starts of texts have none."""
    n = len(ids)
    since = np.arange(n) - starts
    first, back = np.flatnonzero(since < 3), []
    for k in (1, 2, 3):
        before = np.concatenate([np.zeros(k, np.uint64), ids[: max(0, n - k)]])[:n]
        before[first[since[first] < k]] = 1
        back.append(before)
    with np.errstate(over="ignore"):
        raw = [back[0] * MIX + np.uint64(11), (back[0] * MIX + back[1]) * MIX + np.uint64(13), back[1] * MIX + np.uint64(17), back[2] * MIX + np.uint64(19)]
        return scrambled(np.stack(raw))


def rows_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The row of each hash; each feature has its own quarter of the table."""
    own = bits - 2
    rows = (hashes >> np.uint64(64 - own)).view(np.int64)
    for k in range(FEATURES):
        rows[k] += k << own
    return rows


def with_class(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Hashes of the features together with a class."""
    with np.errstate(over="ignore"):
        return scrambled(hashes + (classes.astype(np.uint64) + np.uint64(1)) * MIX)


@dataclass
class Encoded:
    """All tokens of some texts in turn: ids, classes, parts, counts (0 where not carried), what was seen once, each text's start and the places of rare words."""

    ids: np.ndarray
    classes: np.ndarray
    parts: np.ndarray
    counts: np.ndarray
    once: np.ndarray
    starts: np.ndarray
    edges: np.ndarray
    rare: np.ndarray


def runs(bodies: pa.Array, most: int = BYTES, texts: int = TEXTS) -> Iterator[tuple[int, int]]:
    """(first, length) of runs of texts that are worked on together, of at most so many bytes and texts."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(bodies), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(bodies):
        before = sizes[lo - 1] if lo else 0
        hi = min(lo + texts, max(lo + 1, int(np.searchsorted(sizes, before + most, side="right"))), len(bodies))
        yield lo, hi - lo
        lo = hi


def encode(rows: DataFrame, vocabulary) -> DataFrame:
    """(ident, held_out, codes, rare): each text's tokens as numbers of four bytes and its words that are not carried, in turn.

    A carried word's number is its place; the others' is their cell, doubled,
    and one more if training sees them once, behind all places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        carried = len(v.ids)
        for batch in batches:
            for lo, n in runs(batch.column(2)):
                piece = batch.slice(lo, n)
                words, own, edges = split(piece.column(2))
                codes = v.numbers(words).astype(np.int32)[own]
                seldom = codes >= carried
                met = pa.array(np.array(words, object)[own[seldom]], pa.binary())
                before = np.concatenate(([0], np.cumsum(seldom)))[edges].astype(np.int32)
                texts = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(4 * edges), pa.py_buffer(codes)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), texts, pa.ListArray.from_arrays(pa.array(before), met)], ["ident", "held_out", "codes", "rare"])

    return rows.mapInArrow(run, f"ident {dict(rows.dtypes)['ident']}, held_out boolean, codes binary, rare array<binary>")


@dataclass
class Kinds:
    """What each number of a token stands for; classes and parts are bytes, which stay in a core's cache."""

    carried: int
    ids: np.ndarray
    classes: np.ndarray
    parts: np.ndarray
    counts: np.ndarray
    once: np.ndarray

    @classmethod
    def of(cls, v: Vocabulary) -> "Kinds":
        own = np.arange(2 * N_CLASSES * PARTS)
        cell = own >> 1
        joint = lambda a, b: np.concatenate([a, b.astype(a.dtype)])
        return cls(len(v.ids), joint(v.ids, cell // PARTS + 10), joint(v.classes.astype(np.uint8), cell // PARTS), joint(v.parts.astype(np.uint8), cell % PARTS), joint(v.counts, 0 * cell), joint(v.counts == 1, own & 1))


def decoded(texts: pa.Array, kinds: Kinds) -> Encoded:
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False) // 4
    edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    codes = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.int32)
    return Encoded(*(x[codes] for x in (kinds.ids, kinds.classes, kinds.parts, kinds.counts, kinds.once)), np.repeat(edges[:-1], sizes), edges, np.flatnonzero(codes >= kinds.carried))


def chances(w: np.ndarray, bias: np.ndarray | None, at: np.ndarray) -> np.ndarray:
    """The softmax of the features' summed weights for each token; ``at`` has a row for each feature."""
    z = np.take(w, at[0], axis=0)
    for rows in at[1:]:
        z += np.take(w, rows, axis=0)
    if bias is not None:
        z += bias
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


class Room:
    """Arrays that a batch's rows of weights are put into, again and again."""

    def __init__(self, width: int):
        self.z, self.y = (np.empty((BATCH, width), np.float32) for _ in range(2))
        self.x = np.empty((FEATURES, BATCH, width), np.float32)
        self.bias, self.over = None, np.empty((BATCH, width), np.float32)

    def spread(self, bias: np.ndarray) -> np.ndarray:
        """``bias`` in each row; the rows are filled once for each bias."""
        if self.bias is not bias:
            self.bias = bias
            self.over[:] = bias
        return self.over


def rated(w: np.ndarray, bias: np.ndarray | None, at: np.ndarray, own: np.ndarray, powers: bool, room: Room) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the softmax up to a factor, its sum, and its value for each token's own class); with ``powers``, ``w`` and ``bias`` are powers of e already."""
    if powers:
        z, y = room.z[: len(own)], room.y[: len(own)]
        np.take(w, at[0], axis=0, out=z, mode="clip")
        for rows in at[1:]:
            z *= np.take(w, rows, axis=0, out=y, mode="clip")
        if bias is not None:
            z *= room.spread(bias)[: len(own)]
    else:
        z = chances(w, bias, at)
    return z, np.einsum("nc->n", z), z[np.arange(len(z)), own]


@dataclass
class Table:
    """Rows of weights, and for each row the number of the strength that it has (feature, then level)."""

    weights: np.ndarray
    strength: np.ndarray

    @classmethod
    def of(cls, seen: np.ndarray, share: np.ndarray) -> "Table":
        """Log-odds of the counts of what follows each row against ``share``, with the prior's counts."""
        n = seen.sum(axis=1, keepdims=True)
        level = np.where(n[:, 0] > 0, np.minimum(LEVELS - 1, 1 + np.log2(np.maximum(1, n[:, 0])).astype(np.int64) // 2), 0)
        kind = np.arange(len(seen)) * FEATURES // len(seen)
        odds = np.log((seen + PRIOR * share) / (n + PRIOR) / share)
        return cls((START * odds).astype(np.float32), (kind * LEVELS + level).astype(np.uint8))

    def stronger(self, factor: np.ndarray) -> "Table":
        return Table(self.weights * factor[self.strength].astype(np.float32)[:, None], self.strength)

    @staticmethod
    def less(seen: np.ndarray, share: np.ndarray) -> np.ndarray:
        """What the weight of a class behind a row loses with one of the tokens that show it."""
        return (START * np.log1p(-1 / (np.maximum(seen, 1) + PRIOR * share))).astype(np.float32)

    def narrow(self, bias: np.ndarray | None) -> bool:
        """Whether products of powers of the weights stay within single precision, whichever rows meet."""
        most = np.abs(self.weights).max(axis=1).reshape(FEATURES, -1).max(axis=1).sum() + (0.0 if bias is None else np.abs(bias).max())
        return bool(most < SAFE)

    def powers(self) -> np.ndarray:
        return np.exp(self.weights)


@dataclass
class Weights:
    """Of classes and of their parts."""

    bits: int
    bias: np.ndarray
    classes: Table
    parts: Table


def observed(texts: DataFrame, kinds, bits: int, tasks: int) -> np.ndarray:
    """How often each class and then each part followed each row, over all texts (codes)."""
    rows, width, blocks = 1 << bits, N_CLASSES + PARTS, 64

    def count(codes: pa.Array, classes: np.ndarray, parts: np.ndarray) -> None:
        x = decoded(codes, kinds.value)
        goal, hashes = np.where(x.once, UNSEEN, x.classes), contexts(x.ids, x.starts)
        seen = np.flatnonzero(~x.once)
        of_part = rows_of(with_class(np.take(hashes, seen, axis=1), x.classes[seen]), bits)
        for table, at, own in ((classes, rows_of(hashes, bits), goal), (parts, of_part, x.parts[seen])):
            for each in at:
                np.add.at(table.ravel(), each * table.shape[1] + own, np.int32(1))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((rows, N_CLASSES), np.int32), np.zeros((rows, PARTS), np.int32)
        for batch in batches:
            for lo, n in runs(batch.column(0), NUMBER_BYTES):
                count(batch.column(0).slice(lo, n), *tables)
        step = rows // blocks
        for b in range(blocks):
            piece = np.concatenate([t[b * step : (b + 1) * step] for t in tables], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([piece.tobytes()], pa.binary())], ["block", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(n.as_buffer(), np.int32).astype(np.int64)
                total[b] = total[b] + own if b in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([n.tobytes() for n in total.values()], pa.binary())], ["block", "n"])

    out = np.zeros((rows, width), np.float32)
    # as many bytes as the table of weights has, whatever the corpus
    for r in texts.coalesce(tasks).mapInArrow(gather, "block long, n binary").repartition(blocks, "block").mapInArrow(add, "block long, n binary").toLocalIterator():
        out[r["block"] * (rows // blocks) : (r["block"] + 1) * (rows // blocks)] = np.frombuffer(r["n"], np.int64).reshape(-1, width)
    return out


def slopes(table: Table, less: np.ndarray, narrow: object, bias: np.ndarray | None, room: Room, at: np.ndarray, goal: np.ndarray, gradient: np.ndarray, curvature: np.ndarray) -> None:
    """Adds the gradient of these tokens' log-likelihood by the logs of the strengths, and its products, in grains.

    Each token is left out of the counts that judge it.  That lowers the weight
    of its own class, by ``less``, alone: what it takes from a row's tokens
    moves all classes alike.  Where ``narrow`` is not None, powers of sums of
    weights stay within single precision, and ``bias`` is a power of e already.
    """
    n, width = len(goal), table.weights.shape[1]
    step, place, flat = np.empty((FEATURES, n)), np.arange(BATCH) * width, less.ravel()
    for a in range(0, n, BATCH):
        rows, own = at[:, a : a + BATCH], goal[a : a + BATCH]
        m = len(own)
        x, z, cell = room.x[:, :m], room.z[:m], place[:m] + own
        # each row is fetched once, for its powers and for its mean under them
        for k in range(FEATURES):
            table.weights.take(rows[k], axis=0, out=x[k], mode="clip")
        np.add(x[0], x[1], out=z)
        for k in range(2, FEATURES):
            z += x[k]
        if narrow is None:
            if bias is not None:
                z += bias
            z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        if narrow is not None and bias is not None:
            z *= room.spread(bias)[:m]
        down = flat.take(rows * width + own)
        hit = z.ravel().take(cell) * np.exp(down.sum(axis=0))
        z.ravel()[cell] = hit
        total = np.einsum("nc->n", z)
        p = hit / total
        has = room.x.ravel().take(cell + np.arange(FEATURES)[:, None] * (BATCH * width))
        step[:, a : a + m] = has + down - np.einsum("knc,nc->kn", x, z) / total - p * down
    # sums by the levels of all features together, then by those of one or two
    levels = np.zeros(n, np.int64)
    for k in range(FEATURES):
        levels = levels * LEVELS + (table.strength.take(at[k]) - np.uint8(k * LEVELS))

    def summed(of: np.ndarray, *kept: int) -> np.ndarray:
        sums = np.bincount(levels, weights=of, minlength=LEVELS**FEATURES).reshape((LEVELS,) * FEATURES)
        return sums.sum(axis=tuple(k for k in range(FEATURES) if k not in kept))

    fine, coarse = np.rint(step * GRAIN), np.rint(step * math.isqrt(GRAIN))
    block = [slice(k * LEVELS, (k + 1) * LEVELS) for k in range(FEATURES)]
    # whole numbers below 2 ** 53 in all, so the sums are exact in any order
    for k in range(FEATURES):
        gradient[block[k]] += summed(fine[k], k)
        curvature[block[k], block[k]] += np.diag(summed(coarse[k] * coarse[k], k))
        for other in range(k + 1, FEATURES):
            both = summed(coarse[k] * coarse[other], k, other)
            curvature[block[k], block[other]] += both
            curvature[block[other], block[k]] += both.T


def moved(gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """The factors of a scoring step on the strengths, damped where few tokens say anything."""
    m = len(gradient)
    step = np.linalg.solve(curvature / GRAIN + np.eye(m) * (1.0 + 1e-3 * np.trace(curvature) / GRAIN / m), gradient / GRAIN)
    return 1 + np.clip(step, -0.9, 2.0)


def train(texts: DataFrame, kinds, bias: np.ndarray, bits: int, tasks: int) -> Weights:
    """Weights from the counts of what follows each context, their strengths by gradient rounds, both over all texts (codes)."""
    prior = np.exp(bias - bias.max())
    seen = observed(texts, kinds, bits, tasks)
    shares = (prior / prior.sum(), np.full(PARTS, 1 / PARTS))
    size = FEATURES * LEVELS
    strengths = [np.ones(size), np.ones(size)]
    tables = [Table.of(seen[:, :N_CLASSES], shares[0]), Table.of(seen[:, N_CLASSES:], shares[1])]
    lesser = [Table(Table.less(n, share), t.strength) for n, share, t in zip((seen[:, :N_CLASSES], seen[:, N_CLASSES:]), shares, tables)]
    for _ in range(ROUNDS):
        own = [(t.stronger(f), less.stronger(f).weights) for t, less, f in zip(tables, lesser, strengths)]
        held = texts.sparkSession.sparkContext.broadcast(own)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [(np.zeros(size), np.zeros((size, size))) for _ in range(2)]
            models = []
            for (t, less), b in zip(held.value, (bias, None)):
                narrow = True if t.narrow(b) else None
                models.append((t, less, narrow, b if narrow is None or b is None else np.exp(b), Room(t.weights.shape[1])))
            for batch in batches:
                for lo, n in runs(batch.column(0), NUMBER_BYTES):
                    x = decoded(batch.column(0).slice(lo, n), kinds.value)
                    goal, hashes = np.where(x.once, UNSEEN, x.classes), contexts(x.ids, x.starts)
                    seen = np.flatnonzero(~x.once)
                    slopes(*models[0], rows_of(hashes, bits), goal, *sums[0])
                    slopes(*models[1], rows_of(with_class(np.take(hashes, seen, axis=1), x.classes[seen]), bits), x.parts[seen], *sums[1])
            flat = np.concatenate([y.ravel() for pair in sums for y in pair]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "n"])

        # some two thousand numbers, whatever the corpus
        table = texts.mapInArrow(gather, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
        flat = np.zeros(2 * size * (size + 1))
        flat[table.column("i").to_numpy()] = table.column("n").to_numpy()
        held.unpersist()
        g, c, g2, c2 = np.split(flat, np.cumsum([size, size * size, size]))
        strengths = [f * moved(x, y.reshape(size, size)) for f, x, y in zip(strengths, (g, g2), (c, c2))]
    return Weights(bits, bias, *(t.stronger(f) for t, f in zip(tables, strengths)))


def most_frequent(words: DataFrame, carried: int) -> dict[bytes, int]:
    """Counts of the most frequent words, most first, at most ``carried``; of equally frequent ones those with the least hash.

    The bar comes from a histogram of counts on a log scale, and within its
    lowest step from one of hashes, so that only what is kept reaches the driver.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    histogram = sorted(((r["s"], r["count"]) for r in words.groupBy(step.alias("s")).count().collect()), reverse=True)
    room, least, partly = carried, None, None
    for s, n in histogram:
        if n > room:
            partly = s
            break
        room, least = room - n, s
    kept = words.where(step >= least) if least is not None else words.limit(0)
    if partly is not None and room:
        slot = F.pmod(F.xxhash64("word"), F.lit(4096))
        at, bar = 0, 0
        for r in sorted(words.where(step == partly).groupBy(slot.alias("h")).count().collect(), key=lambda r: r["h"]):
            at += r["count"]
            if at > room:
                break
            bar = r["h"] + 1
        kept = kept.unionByName(words.where((step == partly) & (slot < bar)))
    table = kept.toArrow()
    rows = sorted(zip(table.column("word").to_pylist(), table.column("n").to_pylist()), key=lambda r: (-r[1], r[0]))
    return dict(rows)


def repeated(words: DataFrame, types: int) -> np.ndarray:
    """Packed bits: that of the crc32 of each word which training sees more than once is set."""
    size = 1024
    while size < 16 * types and size < MOST_FILTER:
        size *= 2
    bit = F.crc32("word").bitwiseAND(F.lit(size - 1))
    found = words.where("n > 1").select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    out = np.zeros(size // 64, np.int64)
    table = found.toArrow()  # a filter of bounded size
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint8)


def score(docs: DataFrame, text: str = "text", ident: str = "doc_id", folds: int = 5, held: int = 1, carried: int = CARRIED) -> DataFrame:
    """(ident, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document.

    Learns from the documents whose crc32 of the id as text, modulo ``folds``,
    is not ``held``.  NULL texts count as empty: their one token is the end.  A
    NULL id hashes as an empty text.  Repeated rows each get a row and each
    teach.  Texts of any length are read whole; what is held at once is bounded
    by bytes.  Without training words the model is uniform over its classes.
    """
    kind = dict(docs.select(F.col(f"`{ident}`").alias("ident")).dtypes)["ident"]
    rows = docs.select(F.col(f"`{ident}`").alias("ident"), held_out(F.col(f"`{ident}`"), folds, held).alias("held_out"), F.col(f"`{text}`").cast("binary").alias("body"))
    bodies = rows.where(~F.col("held_out")).select("body")
    words = stage(counted(bodies), "words")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    total, types = sums["n"], sums["v"]
    counts = most_frequent(words, carried)
    head = {w: i for i, w in enumerate([w for w in counts if w != END][:HEAD])}
    near = company(bodies, head) if head else np.zeros((HEAD, COMPANY))
    own = clusters(near, np.array([counts[w] for w in head] + [0] * (HEAD - len(head)), float))
    vocabulary = vocabulary_of(counts, head, own, spelling(list(head), own[: len(head)]), repeated(words, types))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    cells = N_CLASSES * PARTS

    def mass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, types = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        v = sent.value
        cell_of = np.concatenate([v.classes * PARTS + v.parts, np.arange(2 * cells) >> 1])
        for batch in batches:
            cell = cell_of[v.numbers(listed(batch.column(0)))]
            n += np.bincount(cell, weights=batch.column(1).to_numpy(), minlength=cells).astype(np.int64)
            types += np.bincount(cell, minlength=cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(n), pa.array(types)], ["c", "n", "types"])

    per_cell, in_cell = np.zeros(cells), np.zeros(cells)
    for r in words.mapInArrow(mass, "c long, n long, types long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect():
        per_cell[r["c"]], in_cell[r["c"]] = r["n"], r["types"]
    # within a part, counts and a half for each of its words
    within = np.log10(np.maximum(0.5, per_cell + 0.5 * in_cell))
    share = per_cell.reshape(N_CLASSES, PARTS).sum(axis=1) + 0.5
    share[UNSEEN] = sums["once"] + 0.5
    bias = np.log(share / share.sum()).astype(np.float32)
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, total) / TOKENS_A_ROW))))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_TOKENS))
    numbers = stage(encode(rows, sent), "numbers")
    sent.unpersist()
    stands = docs.sparkSession.sparkContext.broadcast(Kinds.of(vocabulary))
    weights = train(numbers.where(~F.col("held_out")).select("codes"), stands, bias, bits, tasks)
    base_of = math.log10(total + 0.5 * (types + 1))
    models = [(t.powers(), None if b is None else np.exp(b), True) if t.narrow(b) else (t.weights, b, False) for t, b in ((weights.classes, weights.bias), (weights.parts, None))]
    known = docs.sparkSession.sparkContext.broadcast((models, within))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ((of_class_w, bias, powers), (of_part_w, _, part_powers)), within = known.value
        rooms = Room(N_CLASSES), Room(PARTS)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, n in runs(batch.column(2), NUMBER_BYTES):
                piece = batch.slice(lo, n)
                x = decoded(piece.column(2), stands.value)
                hashes = contexts(x.ids, x.starts)
                of_class, of_part, of_unseen = (np.empty(len(x.ids), np.float32) for _ in range(3))
                for lo in range(0, len(x.ids), BATCH):
                    own = slice(lo, lo + BATCH)
                    some, cls = hashes[:, own], x.classes[own]
                    p, total, hit = rated(of_class_w, bias, rows_of(some, bits), cls, powers, rooms[0])
                    _, whole, part = rated(of_part_w, None, rows_of(with_class(some, cls), bits), x.parts[own], part_powers, rooms[1])
                    of_class[own], of_part[own], of_unseen[own] = hit / total, part / whole, p[:, UNSEEN] / total
                of_class, of_part, of_unseen = (np.log10(np.maximum(v, 1e-30)) for v in (of_class, of_part, of_unseen[x.rare]))
                of_class = of_class.astype(float) + of_part - within[x.classes.astype(np.int64) * PARTS + x.parts]
                carried, own = x.counts > 0, np.log10(x.counts + 0.5)
                sums = [np.add.reduceat(np.where(carried, v, 0.0), x.edges[:-1]) for v in (np.ones(len(own)), own - base_of, of_class + own)]
                # words that are not carried, once for each text
                columns: list[list] = [[], [], [], []]
                ends, text_of = [0], np.searchsorted(x.edges, x.rare, side="right") - 1
                seen, unseen = of_class[x.rare].tolist(), of_unseen.astype(float).tolist()
                found: dict[bytes, int] = {}
                at_text = 0
                for i, (t, w) in enumerate(zip(text_of.tolist(), listed(piece.column(3).flatten()))):
                    while at_text < t:
                        ends.append(len(columns[0]))
                        found.clear()
                        at_text += 1
                    j = found.get(w)
                    if j is None:
                        found[w] = len(columns[0])
                        for column, value in zip(columns, (w, 1, seen[i], unseen[i])):
                            column.append(value)
                    else:
                        columns[1][j] += 1
                        columns[2][j] += seen[i]
                        columns[3][j] += unseen[i]
                ends += [len(columns[0])] * (piece.num_rows + 1 - len(ends))
                rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.binary(), pa.int32(), pa.float64(), pa.float64()))], ["word", "times", "seen", "unseen"]))
                numbers = number + np.arange(piece.num_rows)
                number += piece.num_rows
                arrays = [piece.column(0), piece.column(1), pa.array(numbers), pa.array(np.diff(x.edges)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), rest]
                yield pa.RecordBatch.from_arrays(arrays, ["ident", "held_out", "row", "n_tokens", "n_known", "base_score", "score", "rest"])

    schema = f"ident {kind}, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double, rest array<struct<word: binary, times: int, seen: double, unseen: double>>"
    judged = stage(numbers.mapInArrow(judge, schema), "judged")
    # the counts of all words that were not carried come from the table of words
    met = judged.select("row", F.inline("rest")).join(words, "word", "left")
    hit = F.col("n").isNotNull()
    own = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    added = met.groupBy("row").agg(
        F.sum(F.when(hit, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (own - base_of)).alias("more_base"),
        F.sum(F.when(hit, F.col("seen") + F.col("times") * own).otherwise(F.col("unseen"))).alias("more_score"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return judged.drop("rest").join(added, "row", "left").select(
        "ident",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("more_known")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("more_base")).alias("base_score"),
        (F.col("score") + zero("more_score")).alias("score"),
    )
