"""Personal data: fixed identifiers, and terms that the corpus shows to give an identifier away.

Identifiers (mail addresses, IP addresses, card and phone numbers) are the
protected entities.  All words of a text that holds one are candidate terms,
and how far a term t reveals an entity e is its pointwise mutual information
with e over documents, as a share of what there is to reveal, the information
content of e:

    log(n(t, e) N / (n(t) n(e))) / log(N / n(e))

which is 1 where every document with t holds e.  Terms at or above a threshold
that enough unlike texts support are spans too; in the rewritten text they
are removed at 1 and generalised below it, and identifiers become their kind.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.staging import stage

#: The kinds in their order and what each must match.
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a look-behind keeps long runs of digits from being tried at each of their places
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

TERM = re.compile(r"[^\W\d_][\w'-]{2,}")
#: Share of an entity's information above which a term discloses it; unlike texts that must agree.
DISCLOSURE = 0.8
SUPPORT = 3
#: Disclosing terms that a worker holds at once; longer lists are several steps of the one pass that marks them.
TERMS_AT_ONCE = 200_000
#: Bits, at most, of the filter that tells which words are counted (16 MB), and bits for each term; more terms let more other words pass, to the same counts.
MOST_BITS, BITS_EACH = 1 << 27, 16
#: Counts that a task gathers before it passes them on.
HELD = 400_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each ``@`` takes all of the run before it that no earlier match has taken."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed identifiers, by start, then kind."""
    found = []
    if "@" in text:
        found += [(s, 0, e) for s, e in mails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
        found.sort()
    return found


def candidates(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[str], list[str]]:
    """(entities, terms) of a text, each once; a term must stand somewhere free of all identifiers."""
    free = apart([(m.start(), 4, m.end()) for m in TERM.finditer(text)], spans)
    return sorted({f"{KINDS[k]}:{text[s:e]}" for s, k, e in spans}), sorted({text[s:e].lower() for s, _, e in free})


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def disclosing(docs: DataFrame, text: str, threshold: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(term, share): terms that reveal some identifier, with the largest share of it that they reveal.

    Terms are words of three characters or more that begin with a letter.  A
    share is estimated from at least ``support`` unlike texts that hold both,
    so nothing is said of an identifier that fewer texts hold.  A text costs as
    many pairs as it has such identifiers times such terms.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[], [], []]
            for body, name in zip(batch.column(0), batch.column(1)):
                body = body.as_py() or ""
                if spans := base_spans(body):
                    for column, value in zip(rows, (name, *candidates(body, spans))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.list_(pa.string())), pa.array(rows[2], pa.list_(pa.string()))], ["print", "entities", "terms"])

    found = docs.select(F.col(f"`{text}`"), F.xxhash64(F.col(f"`{text}`")).alias("print")).mapInArrow(read, "print long, entities array<string>, terms array<string>")
    # copies of a text count once for support and fully for co-occurrence
    unlike = stage(found.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.first("entities").alias("entities"), F.first("terms").alias("terms")), "private")
    held_by = unlike.select("print", "n", F.explode("entities").alias("entity"))
    # an entity of fewer texts has no term with enough of them, and a term of fewer texts no entity
    entities = held_by.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support).drop("texts")
    said = unlike.select("print", F.explode("terms").alias("term"))
    several = said.groupBy("term").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support).select("term")
    # a text's entities meet its terms where the text is: neither list is copied for the other, and a hot entity has its pairs summed before they move
    met = held_by.join(entities, "entity").join(said.join(several, "term", "left_semi"), "print")
    pairs = met.groupBy("entity", "n_e", "term").agg(F.count(F.lit(1)).alias("support"), F.sum("n").alias("both"))
    pairs = stage(pairs.where(F.col("support") >= support), "pairs")
    held = counts(docs, text, pairs.select("term").distinct())
    total = docs.count()
    n = F.lit(float(max(2, total)))
    share = F.log(F.col("both") * n / (F.col("n_t") * F.col("n_e"))) / F.log(n / F.least(F.col("n_e"), n - 1))
    known = pairs.join(held, "term").select("term", F.least(F.lit(1.0), share).alias("share")).where(F.col("share") >= threshold)
    return known.groupBy("term").agg(F.max("share").alias("share"))


def parts(terms: DataFrame, column: str, at_once: int, *more: str) -> Iterator[list]:
    """The rows in lists of about ``at_once``, so that a list of any length passes through the driver in bounded pieces."""
    total = terms.count()
    pieces = -(-total // at_once)
    for i in range(pieces):
        piece = terms if pieces == 1 else terms.where(F.pmod(F.xxhash64(column), F.lit(pieces)) == i)
        yield piece.select(column, *more).collect()


def counts(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(term, n_t): the documents that hold each of the terms, in one pass whatever their number.

    A filter of a bit for each term's hash keeps nearly all other words from
    being counted; those that pass by chance meet no term in the join.
    """
    n, size = terms.count(), 1024
    while size < BITS_EACH * n and size < MOST_BITS:
        size *= 2
    bit = F.crc32("term").bitwiseAND(F.lit(size - 1))
    words = terms.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    filled = np.zeros(size // 64, np.int64)
    for r in words.toLocalIterator():  # a filter of bounded size
        filled[r["at"]] = r["bits"]
    wanted = docs.sparkSession.sparkContext.broadcast(np.unpackbits(filled.view(np.uint8), bitorder="little").astype(bool))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        known: dict[str, bool] = {}
        bits = wanted.value

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])
            seen.clear()
            known.clear()
            return batch

        for batch in batches:
            for body in batch.column(0):
                for t in set(TERM.findall((body.as_py() or "").lower())):
                    if (counts := known.get(t)) is None:
                        counts = known[t] = bool(bits[zlib.crc32(t.encode()) & (size - 1)])
                    if counts:
                        seen[t] = seen.get(t, 0) + 1
                if len(known) > HELD:
                    yield out()
        yield out()

    found = docs.select(F.col(f"`{text}`")).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    return found.join(terms, "term", "left_semi")


def sanitise(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = DISCLOSURE, support: int = SUPPORT, rewrite: bool = True) -> DataFrame:
    """The ``keep`` columns with ``n_email, n_ip, n_card, n_phone, base, spans`` and, if asked for, ``sanitised``.

    ``base`` and ``spans`` list ``kind:start:end`` by start (code points, end
    exclusive), ``spans`` with the disclosing terms that overlap no identifier.
    NULL and empty texts have none and become ''.  Repeated rows each get a
    row; an empty table gives an empty one.
    """
    kinds = dict(docs.select(*(F.col(f"`{k}`") for k in keep)).dtypes)
    # counted, and then read in lists
    known = stage(disclosing(docs, text, threshold, support), "terms")
    found_type = "array<struct<s: int, e: int, full: boolean>>"
    rows = docs.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").alias("__text"), F.lit(None).cast(found_type).alias("__terms"))
    held = None
    for part in parts(known, "term", TERMS_AT_ONCE, "share"):
        if held is not None:  # one more list than a worker should hold at once
            rows = rows.mapInArrow(adding(held, len(keep)), rows.schema)
        held = docs.sparkSession.sparkContext.broadcast({r["term"]: r["share"] >= 1 - 1e-9 for r in part})

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = held.value if held is not None else {}
        for batch in batches:
            numbers: list[list[int]] = [[], [], [], []]
            base, spans, rewritten = [], [], []
            for body, terms in zip(batch.column(len(keep)), batch.column(len(keep) + 1)):
                body = body.as_py() or ""
                own = base_spans(body)
                for k in range(4):
                    numbers[k].append(sum(s[1] == k for s in own))
                terms = sorted((terms.as_py() or []) + matched(body, full), key=lambda t: t["s"])
                every = sorted(own + apart([(t["s"], 4, t["e"]) for t in terms], own))
                base.append(listed(own))
                spans.append(listed(every))
                if rewrite:
                    rewritten.append(rewritten_text(body, every, {t["s"] for t in terms if t["full"]}))
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(x, pa.int64()) for x in numbers] + [pa.array(base, pa.string()), pa.array(spans, pa.string())]
            names_out = [*keep, "n_email", "n_ip", "n_card", "n_phone", "base", "spans"]
            if rewrite:
                columns.append(pa.array(rewritten, pa.string()))
                names_out.append("sanitised")
            yield pa.RecordBatch.from_arrays(columns, names_out)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", n_email long, n_ip long, n_card long, n_phone long, base string, spans string" + ", sanitised string" * rewrite
    return rows.mapInArrow(mark, schema)


def matched(text: str, full: dict[str, bool]) -> list[dict]:
    """The places of the listed terms, and whether each reveals all of an identifier."""
    if not full or full.keys().isdisjoint(TERM.findall(text.lower())):
        return []
    return [{"s": m.start(), "e": m.end(), "full": full[w]} for m in TERM.finditer(text) if (w := m.group().lower()) in full]


def adding(held, at: int):
    """A pass that adds the places of one list of terms to the column after the text."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [(old.as_py() or []) + matched(body.as_py() or "", held.value) for body, old in zip(batch.column(at), batch.column(at + 1))]
            yield batch.set_column(at + 1, batch.schema.field(at + 1), pa.array(terms, batch.schema.field(at + 1).type))

    return add


def apart(terms: list[tuple[int, int, int]], own: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The terms that overlap no identifier; both lists are in order."""
    out, at, edge = [], 0, 0
    for start, kind, end in terms:
        while at < len(own) and own[at][0] < end:
            edge = max(edge, own[at][2])
            at += 1
        if start >= edge:
            out.append((start, kind, end))
    return out


def rewritten_text(text: str, spans: list[tuple[int, int, int]], full: set[int]) -> str:
    """Identifiers become their kind; terms are removed where they reveal all, else generalised to ``<TERM>``."""
    out, at = [], 0
    for start, kind, end in spans:
        if start < at:  # within what an earlier identifier has covered
            at = max(at, end)
            continue
        out.append(text[at:start])
        if kind < 4:
            out.append(f"<{KINDS[kind].upper()}>")
        elif start not in full:
            out.append("<TERM>")
        at = end
    return "".join(out) + text[at:]
