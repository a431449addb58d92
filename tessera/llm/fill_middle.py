"""Fill-in-middle: texts are cut in three at code points and put together again in another order.

A deterministic automaton over bytes, written out as one table, knows three
things at once: how many continuation bytes a code point still needs, whether a
byte begins a unit (a code point), and how much of a sentinel has been seen.
Each transition carries what it counts.  Which state a byte meets depends on a
few bytes before it alone, so texts fall into lanes of fixed length that are
scanned side by side, each entered after those few bytes.  The first pass sums
the transitions of each lane; with the sums of the lanes before, a second pass
goes only through the lanes in which a cut lies, and stops at its byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sentinels before the prefix, the suffix and the middle, and the forms' names.
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Percentages of texts left plain, and of the others with the suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20
#: Bytes of a lane; bytes of text that are scanned together (a longer text is scanned alone).
LANE, TOGETHER = 512, 1 << 23
#: What a transition counts: a unit that begins, and a sentinel that ends.
UNIT, HIT = 1, 1 << 16


class Automaton:
    """The table: ``next`` and ``counts`` by state * 256 + byte; ``next`` is multiplied by 256 already."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        self.sentinels = [s.encode() for s in sentinels]
        if not all(self.sentinels) or len(set(self.sentinels)) < len(self.sentinels):
            raise ValueError("sentinels must be unlike each other and not empty")
        for a in self.sentinels:
            for b in self.sentinels:
                if any(a.endswith(b[:k]) for k in range(1, len(b))) or (a != b and b in a):
                    raise ValueError(f"sentinels {a!r} and {b!r} can overlap, so that a text could not be rebuilt")
        #: bytes before a lane that decide its state
        self.before = max(3, *(len(s) for s in self.sentinels))
        starts = sorted({s[:k] for s in self.sentinels for k in range(len(s) + 1)})
        states = {(b"", 0): 0}
        order, self.next, self.counts = [(b"", 0)], [], []
        for seen, needs in order:  # grows as states are reached
            for byte in range(256):
                tail = seen + bytes([byte])
                tail = next(tail[k:] for k in range(len(tail) + 1) if tail[k:] in starts)
                within = needs > 0 and byte >> 6 == 0b10
                state = (tail, needs - 1 if within else self.continuations(byte))
                if state not in states:
                    states[state] = len(order)
                    order.append(state)
                self.next.append(states[state] * 256)
                self.counts.append(UNIT * (not within) + HIT * (tail in self.sentinels))
        self.next, self.counts = np.array(self.next, np.int32), np.array(self.counts, np.int32)

    @staticmethod
    def continuations(lead: int) -> int:
        return 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0

    def entered(self, data: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The state before each byte ``at``; the text's own start where ``first``."""
        state = np.zeros(len(at), np.int32)
        for back in range(self.before, 0, -1):
            state[~first] = self.next[state[~first] + data[at[~first] - back]]
        return state


class Texts:
    """Texts end to end in ``data``, from ``starts`` to ``ends``; their lanes with what the first pass counts in each."""

    def __init__(self, automaton: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.automaton, self.data, self.starts, self.ends = automaton, data, starts, ends
        lanes = -(-(ends - starts) // LANE)
        self.upto = np.concatenate([[0], np.cumsum(lanes)])
        text = np.repeat(np.arange(len(starts)), lanes)
        nth = np.arange(len(text)) - self.upto[text]
        self.at = starts[text] + nth * LANE
        self.length = np.minimum(LANE, ends[text] - self.at)
        self.first = nth == 0
        self.counts = self._pass(np.arange(len(text)), lambda *_: None)
        self.units = np.concatenate([[0], np.cumsum(self.counts & (HIT - 1))])
        self.hits = np.concatenate([[0], np.cumsum(self.counts // HIT)])

    def _pass(self, lanes: np.ndarray, see) -> np.ndarray:
        """The counts of the lanes; ``see(lanes, positions, counts so far, counts of this byte)`` is called for each step."""
        lanes = lanes[np.argsort(-self.length[lanes], kind="stable")]
        at, lengths = self.at[lanes].copy(), self.length[lanes]
        state = self.automaton.entered(self.data, at, self.first[lanes])
        sums = np.zeros(len(lanes), np.int32)
        # lanes are by falling length, so those that still run are the first ones
        running = np.searchsorted(-lengths, -np.arange(LANE), side="left")
        for n in running:
            if not n:
                break
            step = state[:n] + self.data[at[:n]]
            counts = self.automaton.counts[step]
            see(lanes[:n], at[:n], sums[:n], counts)
            sums[:n] += counts
            state[:n] = self.automaton.next[step]
            at[:n] += 1
        out = np.zeros(len(self.at), np.int32)
        out[lanes] = sums
        return out

    def lengths(self) -> np.ndarray:
        return self.units[self.upto[1:]] - self.units[self.upto[:-1]]

    def sentinels(self) -> np.ndarray:
        return self.hits[self.upto[1:]] - self.hits[self.upto[:-1]]

    def cuts(self, units: np.ndarray) -> np.ndarray:
        """Second pass: of each text the byte at which its unit (from 0) begins; its end where there is no such unit."""
        wanted = self.units[self.upto[:-1]] + units
        out = self.ends.copy()
        inner = np.flatnonzero(units < self.lengths())
        lane = np.searchsorted(self.units, wanted[inner], side="right") - 1
        ask = np.full(len(self.at), -1, np.int32)
        ask[lane] = wanted[inner] - self.units[lane]
        found = np.zeros(len(self.at), np.int64)

        def see(lanes, at, sums, counts):
            here = ((counts & UNIT) == 1) & ((sums & (HIT - 1)) == ask[lanes])
            found[lanes[here]] = at[here]

        self._pass(lane, see)
        out[inner] = found[lane]
        return out

    def ends_of_sentinels(self) -> np.ndarray:
        """Second pass: the bytes after each sentinel, in order."""
        found: list[np.ndarray] = [np.zeros(0, np.int64)]
        self._pass(np.flatnonzero(self.counts >= HIT), lambda lanes, at, sums, counts: found.append(at[counts >= HIT] + 1))
        return np.sort(np.concatenate(found))


def groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, starts, ends) of runs of texts that are scanned together; NULL is the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        rows = max(1, int(np.searchsorted(offsets, offsets[first] + TOGETHER, side="right")) - 1 - first)
        rows = min(rows, len(column) - first)
        base = offsets[first]
        own = offsets[first : first + rows + 1] - base
        yield first, rows, data[base : base + own[-1]], own[:-1], own[1:]
        first += rows


def strings(parts: list[list[bytes]]) -> pa.Array:
    """A string column from each row's pieces."""
    whole = [b"".join(p) for p in parts]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in whole], dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer(offsets), pa.py_buffer(b"".join(whole))).cast(pa.string())


def draws(ident: Column) -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits of the digest of ``1:`` and the id (NULL: no digits)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, text: str = "text", ident: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The ``keep`` columns with ``n, form, prefix_chars, middle_chars, output``, one row for each document.

    Cuts and form follow from the id alone (see ``draws``), so reruns agree and
    rows that repeat an id and a text are cut alike.  NULL text counts as the
    empty text, which stays plain, as does a text that holds a sentinel; an id
    that is NULL draws as the empty string.  Texts of any length are scanned
    whole.  ``prefix_chars`` and ``middle_chars`` are NULL in plain rows.  Columns
    of ``docs`` that are not in ``keep`` do not reach the result, whatever their
    names; a ``keep`` column that has a result column's name is refused.  An
    empty table gives an empty one.
    """
    made = ["n", "form", "prefix_chars", "middle_chars", "output"]
    if clash := set(keep) & set(made):
        raise ValueError(f"columns {sorted(clash)} have the names of result columns; rename them first")
    automaton = Automaton(sentinels)
    p, s, m = automaton.sentinels
    kept = [F.col(f"`{k}`") for k in keep]
    rows = docs.select(*kept, F.col(f"`{text}`").cast("string").alias("__text"), *(h.alias(f"__h{k}") for k, h in enumerate(draws(F.col(f"`{ident}`")))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [batch.column(len(keep) + 1 + k).to_numpy() for k in range(4)]
            for first, many, data, starts, ends in groups(batch.column(len(keep))):
                h1, h2, h3, h4 = (h[first : first + many] for h in drawn)
                texts = Texts(automaton, data, starts, ends)
                n = texts.lengths()
                plain = (n == 0) | (texts.sentinels() > 0) | (h3 % 100 >= PLAIN_FROM)
                low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
                a, b = texts.cuts(low), texts.cuts(high)
                suffix_first = h4 % 100 < SPM_BELOW
                body = data.tobytes()
                parts = []
                for i in range(many):
                    at, c, d, to = starts[i], a[i], b[i], ends[i]
                    if plain[i]:
                        parts.append([body[at:to]])
                    elif suffix_first[i]:
                        parts.append([s, body[d:to], p, body[at:c], m, body[c:d]])
                    else:
                        parts.append([p, body[at:c], s, body[d:to], m, body[c:d]])
                form = np.where(plain, PLAIN, np.where(suffix_first, SPM, PSM))
                number = lambda x: pa.array(x.astype(np.int64), mask=plain)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, many) for k in range(len(keep))), pa.array(n.astype(np.int64)), pa.array(form.tolist(), pa.string()), number(low), number(high - low), strings(parts)], [*keep, *made])

    kinds = dict(docs.select(*kept).dtypes)
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keep) + "n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(cut, schema)


def restore(made: DataFrame, output: str = "output", form: str = "form", name: str = "restored", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``made`` with the texts that ``transform`` cut, rebuilt from output and form alone, in the column ``name`` (replaced if there).

    The same automaton finds the sentinels.  A NULL output, or one that does
    not hold its form's three sentinels in its order, restores to NULL.
    """
    automaton = Automaton(sentinels)
    orders = {PSM: (0, 1, 2), SPM: (1, 0, 2)}
    made = made.drop(name)
    columns = made.columns

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, outputs = batch.column(columns.index(form)).to_pylist(), batch.column(columns.index(output))
            for first, many, data, starts, ends in groups(outputs):
                texts = Texts(automaton, data, starts, ends)
                found, last = texts.ends_of_sentinels(), texts.hits[texts.upto]
                body, parts, none = data.tobytes(), [], []
                for i in range(many):
                    kind = forms[first + i]
                    parts.append([body[starts[i] : ends[i]]] if kind == PLAIN else pieces(body, starts[i], ends[i], found[last[i] : last[i + 1]], orders.get(kind), automaton.sentinels))
                    none.append(not parts[-1] or not outputs[first + i].is_valid)
                texts_out = pc.if_else(pa.array(none), pa.scalar(None, pa.string()), strings(parts))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, many) for c in batch.columns), texts_out], [*columns, name])

    return made.mapInArrow(rebuild, ", ".join(f"`{c}` {k}" for c, k in made.dtypes) + f", `{name}` string")


def pieces(body: bytes, start: int, end: int, found: np.ndarray, order: tuple[int, int, int] | None, sentinels: list[bytes]) -> list[bytes]:
    """Prefix, middle and suffix; empty if the sentinels are not those of the form."""
    if order is None or len(found) != 3:
        return []
    begins = [int(e) - len(sentinels[k]) for e, k in zip(found, order)]
    if begins[0] != start or any(body[b : int(e)] != sentinels[k] for b, e, k in zip(begins, found, order)):
        return []
    spans = {k: body[int(e) : to] for k, e, to in zip(order, found, [*begins[1:], end])}
    return [spans[0], spans[2], spans[1]]
