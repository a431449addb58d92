"""Byte-level BPE: texts to token ids and back, by the ranks of a given vocabulary.

Encodings form a monoid under "join": a long piece is halved down to short
leaves, which are merged directly, and neighbours are joined up the tree.  A
join merges the bytes of a window around the boundary anew, and doubles the
window on each side whose edge is not yet stable.

An edge is stable when its two tokens, merged from their bytes alone, come out
as those two tokens again.  That decides it: merging always takes the least
rank, the leftmost of equals, so what happens within two neighbouring tokens is
the same in the whole piece as alone until a merge crosses their outer edges.
The first merge across any edge would thus also happen between its two tokens
alone, and if none does at any edge, the tokens are those of the whole piece.
For the same reason all edges within an encoding are stable, so only the two at
the window need a look.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import batched, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a leaf, and ids that decoding joins at once.
LEAF, JOINED = 64, 4096
#: Pieces, of a leaf at most, and pairs of tokens whose encodings a worker remembers; beyond that it starts anew.
REMEMBERED = 1 << 20
#: Characters of texts whose pieces are encoded together, and pieces of a longer text that are held at once.
TOGETHER, HELD = 1 << 20, 1 << 17
#: Bytes of a rank file, at most: it is broadcast.
MOST_BYTES = 1 << 26


class Vocabulary:
    """Tokens by rank, and the encoder that merges by them."""

    def __init__(self, file: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines())}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the ranks must hold every single byte")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern)
        self.stable_pairs: dict[tuple[int, int], bool] = {}
        self._forget()
        # each way in which a token is two tokens: what merges into what
        rank = self.ranks.get
        ways = [(a, b, r) for token, r in self.ranks.items() for k in range(1, len(token)) if (a := rank(token[:k])) is not None and (b := rank(token[k:])) is not None]
        ways = np.array(ways, np.int64).reshape(-1, 3)
        self.span = max(self.tokens) + 1
        keys = ways[:, 0] * self.span + ways[:, 1]
        order = np.argsort(keys)
        self.keys, self.merged = np.append(keys[order], np.iinfo(np.int64).max), np.append(ways[order, 2], self.span)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def merged_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the tokens that pairs merge into; ``span`` where there is none."""
        keys = a * self.span + b
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.merged[at], self.span)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, edges): ``merge`` of many short pieces side by side, end to end; in each round every piece has its next merge."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(ids), self.span)
        if len(ids) > 1:
            rank[:-1] = np.where(piece[1:] == piece[:-1], self.merged_rank(ids[:-1], ids[1:]), self.span)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            begins = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            least = np.minimum.reduceat(rank, begins)
            sizes = np.diff(np.append(begins, len(ids)))
            each = np.repeat(least, sizes)
            if (stays := each == self.span).any():  # nothing left to merge in these pieces
                done.append((piece[stays], ids[stays]))
                piece, ids, rank, each = (x[~stays] for x in (piece, ids, rank, each))
                if not len(ids):
                    break
            at = np.flatnonzero(rank == each)
            at = at[np.append(True, piece[at[1:]] != piece[at[:-1]])]  # the leftmost of equals
            ids[at] = each[at]
            left = np.ones(len(ids), bool)
            left[at + 1] = False
            place = np.cumsum(left) - 1
            piece, ids, rank, at = piece[left], ids[left], rank[left], place[at]
            for i in (at, at[at > 0] - 1):  # the pairs that the new tokens begin and end
                after = np.minimum(i + 1, len(ids) - 1)
                rank[i] = np.where((after > i) & (piece[after] == piece[i]), self.merged_rank(ids[i], ids[after]), self.span)
        owner = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        flat = np.concatenate([d[1] for d in done])[order] if done else np.zeros(0, np.int64)
        return flat.astype(np.int32), np.searchsorted(owner[order], np.arange(len(pieces) + 1))

    def merge(self, piece: bytes) -> list[int]:
        """The direct encoding: the pair of least rank is merged, the leftmost of equals, until none is left."""
        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at: list[int | None] = [ranks.get(piece[i : i + 2]) if i + 1 < n else None for i in range(n)]
        heap = [(r, i) for i, r in enumerate(rank_at) if r is not None]
        heapq.heapify(heap)

        def pair(i: int) -> None:
            """The pair that now begins at ``i``."""
            middle = after[i]
            rank_at[i] = ranks.get(piece[i : after[middle]]) if middle < n else None
            if rank_at[i] is not None:
                heapq.heappush(heap, (rank_at[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if rank_at[i] != r:  # one of its tokens has been merged since
                continue
            gone = after[i]
            rank_at[gone] = None
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            pair(i)
            if before[i] >= 0:
                pair(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        """Whether an edge between these tokens stays, whatever is around them."""
        held = self.stable_pairs.get((a, b))
        if held is None:
            if len(self.stable_pairs) >= REMEMBERED:
                self.stable_pairs.clear()
            held = self.stable_pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return held

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of ``left`` and ``right``, which are encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        k, m = min(2, len(left)), min(2, len(right))
        while True:
            middle = self.merge(self.bytes_of(left[-k:] + right[:m]))
            left_holds = k == len(left) or self.stable(left[-k - 1], middle[0])
            right_holds = m == len(right) or self.stable(middle[-1], right[m])
            if left_holds and right_holds:
                return left[: len(left) - k] + middle + right[m:]
            k = k if left_holds else min(2 * k, len(left))
            m = m if right_holds else min(2 * m, len(right))

    def reduce(self, leaves: list[list[int]]) -> list[int]:
        """The encoding of neighbouring leaves, by halves."""
        if len(leaves) == 1:
            return leaves[0]
        half = -(-len(leaves) // 2)
        return self.join(self.reduce(leaves[:half]), self.reduce(leaves[half:]))

    def encode_long(self, piece: bytes) -> list[int]:
        """A piece of several leaves."""
        ids, edges = self.merge_all([piece[i : i + LEAF] for i in range(0, len(piece), LEAF)])
        flat, edges = ids.tolist(), edges.tolist()
        return self.reduce([flat[i:j] for i, j in zip(edges, edges[1:])])

    def encode_pieces(self, pieces: Iterable[str]) -> tuple[list[str], int, np.ndarray, np.ndarray]:
        """(pieces, how many are short, ids, sizes): the pieces anew with the long ones last, and their ids end to end.

        A piece that is a token is that token, even where merging would not reach it.
        """
        tokens, short, long = [], [], []
        for p in pieces:
            body = p.encode()
            kind = tokens if body in self.ranks else short if len(body) <= LEAF else long
            kind.append((p, body))
        merged, edges = self.merge_all([body for _, body in short])
        of_long = [self.encode_long(body) for _, body in long]
        ids = np.concatenate([np.array([self.ranks[body] for _, body in tokens], np.int32), merged, np.array(list(chain.from_iterable(of_long)), np.int32)])
        sizes = np.concatenate([np.ones(len(tokens), np.int64), np.diff(edges), np.array(list(map(len, of_long)), np.int64)])
        return [p for p, _ in chain(tokens, short, long)], len(tokens) + len(short), ids, sizes

    def _forget(self) -> None:
        """Pieces that were met have a number, by which ``sizes`` and ``at`` tell where in ``flat`` their ids lie."""
        self.known: dict[str, int] = {}
        self.flat, self.at, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The ids of each text's pieces end to end; pieces not met before are encoded together, and the short ones remembered."""
        met = set(chain.from_iterable(texts))
        new = met.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = met
        new, stay, ids, sizes = self.encode_pieces(new)
        first = len(self.known)
        flat = np.concatenate([self.flat, ids])
        at = np.concatenate([self.at, len(self.flat) + np.cumsum(sizes) - sizes])
        sizes = np.concatenate([self.sizes, sizes])
        self.known.update(zip(new, range(first, first + len(new))))
        asked = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        own = sizes[asked]
        ends = np.append(0, np.cumsum(own))
        out = flat[np.repeat(at[asked] - ends[:-1], own) + np.arange(ends[-1])]
        for p in new[stay:]:
            del self.known[p]
        stay += first
        self.at, self.sizes = at[:stay], sizes[:stay]
        self.flat = flat[: int(self.sizes.sum())]
        cuts = ends[np.cumsum([0, *map(len, texts)])]
        return [out[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text: its pieces' ids, end to end."""
        held, size = [], 0
        for text in texts:
            if len(text) > TOGETHER:
                yield from self._ids(held)
                held, size = [], 0
                found = (m.group() for m in self.pieces.finditer(text))
                yield np.concatenate([self._ids([list(block)])[0] for block in batched(found, HELD)])
                continue
            held.append(self.pieces.findall(text))
            size += len(text)
            if size > TOGETHER:
                yield from self._ids(held)
                held, size = [], 0
        yield from self._ids(held)

    def bytes_of(self, ids: list[int]) -> bytes:
        """The bytes of the ids; a KeyError where one is not in the vocabulary."""
        blocks = [b"".join(map(self.tokens.__getitem__, ids[i : i + JOINED])) for i in range(0, len(ids), JOINED)]
        while len(blocks) > 1:
            blocks = [b"".join(blocks[i : i + 2]) for i in range(0, len(blocks), 2)]
        return blocks[0] if blocks else b""


_loaded: dict[tuple[int, str], Vocabulary] = {}


def _vocabulary(held, pattern: str) -> Vocabulary:
    """The worker's vocabulary: built once for each file and pattern."""
    key = (hash(held.value), pattern)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(held.value, pattern)
    return _loaded[key]


def _broadcast(df: DataFrame, ranks: str):
    with open(ranks, "rb") as f:
        file = f.read(MOST_BYTES + 1)
    if len(file) > MOST_BYTES:
        raise ValueError(f"{ranks} has more than {MOST_BYTES} bytes, too many to send to every worker")
    return df.sparkSession.sparkContext.broadcast(file)


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``ids array<int>``, one row for each document.

    ``ranks`` names a rank file on the driver (base64 token and rank a line),
    ``pattern`` finds the pieces; no special tokens.  NULL text counts as empty
    and has no ids.  Texts and pieces of any length are encoded whole.  Repeated
    rows each get a row, an empty table gives an empty one, and a ``keep`` column
    named ``ids`` is refused.
    """
    if "ids" in keep:
        raise ValueError("a kept column is named ids, as the result's; rename it first")
    held = _broadcast(docs, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(held, pattern)
        for batch in batches:
            first, found, size = 0, [], 0
            for i, ids in enumerate(vocabulary.encode(body.as_py() or "" for body in batch.column(len(keep)))):
                found.append(ids)
                size += len(ids)
                if size >= TOGETHER or i + 1 == len(batch):
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                    column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, i + 1 - first) for k in range(len(keep))), column], [*keep, "ids"])
                    first, found, size = i + 1, [], 0

    kept = [F.col(f"`{k}`") for k in keep]
    schema = "".join(f"`{k}` {kind}, " for k, kind in docs.select(*kept).dtypes) + "ids array<int>"
    return docs.select(*kept, F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str, pattern: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in the column ``name`` (replaced if there).

    Ids are joined in blocks, and blocks by pairs up the tree.  No ids give no
    bytes; NULL, a NULL id or one that the vocabulary lacks give NULL.
    """
    held = _broadcast(encoded, ranks)
    encoded = encoded.drop(name)
    columns = encoded.columns
    at = columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(held, pattern)
        for batch in batches:
            first, found, size = 0, [], 0
            for i, row in enumerate(batch.column(at)):
                found.append(_decoded(vocabulary, row.values.to_pylist()) if row.is_valid else None)
                size += len(found[-1] or b"")
                if size >= TOGETHER or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([*(c.slice(first, i + 1 - first) for c in batch.columns), pa.array(found, pa.binary())], [*columns, name])
                    first, found, size = i + 1, [], 0

    return encoded.mapInArrow(run, "".join(f"`{c}` {k}, " for c, k in encoded.dtypes) + f"`{name}` binary")


def _decoded(vocabulary: Vocabulary, ids: list[int]) -> bytes | None:
    try:
        return vocabulary.bytes_of(ids)
    except KeyError:
        return None
