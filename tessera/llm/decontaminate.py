"""Benchmark decontamination as a prefix-filtered set join of documents with item-sized windows.

A benchmark item is cut into windows of consecutive words; a window is the set
of its short shingles with their places, and windows of equal words are one,
with the set of items that hold it.  One pass over the documents finds the
places of all shingles that any window holds: a hashed bitmap of the
benchmark's shingles answers for nearly all places at once, and an exact join
settles the rest.  Those places, and the corpus frequency of each shingle
counted from them, are all that the join reads.  Since a window must be
contained whole, one necessary token is enough of a prefix: its rarest shingle.
Places of that shingle that leave room for the window on both sides (position
and length bounds) are candidates, and a candidate counts when the document's
words there equal the window's; only documents with candidates are read again
for that.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.staging import stage

from .text import ascii_lower, let

WINDOW = 10
SHINGLE = 4
#: Everything else of ASCII parts words; characters beyond ASCII belong to them.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the bitmap for each benchmark shingle (about 1 place in 16 of those that match none passes it), and the largest bitmap (8 MB, a literal of the plan); benchmarks of over four million shingles let more places pass, to the same results.
BITS_EACH, MOST_BITS = 16, 1 << 26
#: Tables of at most this many windows' shingles (some 200 bytes each) are broadcast; larger ones are joined by shuffle.
MOST_BROADCAST = 100_000
#: Text hashes (16 bytes each), at most, that are broadcast to tell which documents are read again.
MOST_KEYS = 1_000_000


def item_words(text: Column) -> Column:
    """Words of a lower-cased text: runs of a-z, 0-9 and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def shingle_hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in range(length)))


def windows(items: DataFrame, text: str, ident: str, window: int) -> DataFrame:
    """(words, items): each window's words once, with the sorted ids (as strings) of the items that hold it.

    An item of fewer words than a window is one window.
    """
    split = items.select(F.col(f"`{ident}`").cast("string").alias("item"), item_words(F.col(f"`{text}`")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window))
    cut = split.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("words"))
    return cut.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def shingled(cut: DataFrame, shingle: int) -> DataFrame:
    """(words, held_by, at, token): each window with each of its shingles and the place of it; a window shorter than a shingle has one, of its first word."""
    room = F.size("words") - shingle
    placed = cut.select("words", "held_by", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), room))).alias("at"))
    token = F.when(F.size("words") >= shingle, shingle_hash(F.col("words"), F.col("at"), shingle)).otherwise(shingle_hash(F.col("words"), F.col("at"), 1))
    return placed.withColumn("token", token)


def bitmap(tokens: DataFrame, n: int) -> tuple[Column, int]:
    """A bitmap whose bit (token mod size) is set for every token, as a literal array of longs, and its size in bits."""
    size = 1024
    while size < BITS_EACH * n and size < MOST_BITS:
        size *= 2
    bit = tokens.select(F.pmod("token", F.lit(size)).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("w"))
    held = [0] * (size // 64)
    for r in words.collect():  # at most a row for each of the bitmap's longs
        held[r["i"]] = r["w"]
    return F.from_json(F.lit(json.dumps(held)), "array<bigint>"), size


def keyed(docs: DataFrame, text: str, ident: str) -> DataFrame:
    """(ident, print, chars, body): a hash and the length of the text tell apart texts under one id."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{ident}`").alias("ident"), F.xxhash64(body).alias("print"), F.length(body).alias("chars"), body.alias("body"))


def matches(docs: DataFrame, text: str, ident: str, tokens: DataFrame, shingle: int) -> DataFrame:
    """(ident, print, chars, n_words, hits): each document's places of what may be benchmark shingles."""
    known = tokens.select("token", "short").distinct()
    row = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("short"), F.lit(False)).alias("short")).first()
    bits, size = bitmap(known, row["n"])
    rows = keyed(docs, text, ident).withColumn("w", item_words(F.col("body")))
    last = lambda length: F.size("w") - length
    places = lambda length: F.when(last(length) >= 0, F.sequence(F.lit(0), last(length))).otherwise(F.array().cast("array<int>"))
    spot = lambda at, length: F.struct(at.alias("at"), shingle_hash(F.col("w"), at, length).alias("token"))
    bit = lambda s: F.pmod(s["token"], F.lit(size))
    is_set = lambda s: F.getbit(F.get(bits, F.shiftright(bit(s), 6).cast("int")), bit(s).bitwiseAND(F.lit(63)).cast("int")) == 1
    passing = lambda length: F.filter(F.transform(places(length), lambda i: spot(i, length)), is_set)
    found = F.concat(passing(shingle), passing(1)) if row["short"] else passing(shingle)
    return rows.select("ident", "print", "chars", F.size("w").cast("long").alias("n_words"), found.alias("hits"))


def contained(docs: DataFrame, items: DataFrame, text: str = "text", ident: str = "doc_id", item_text: str = "text", item_ident: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row for each document: ``ident, print, chars, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit when it lies in any occurrence of any item's window.  NULL and
    wordless texts have no words and no hits; items without words have no
    windows.  Rows that repeat an id and a text give one row each.  ``print``
    (a hash of the text) and ``chars`` tell apart texts under one id.
    """
    cut = stage(windows(items, item_text, item_ident, window).withColumn("held_by", F.xxhash64("items")), "windows")
    pieces = shingled(cut, shingle)
    tokens = pieces.select("token", (F.size("words") < shingle).alias("short"))
    found = stage(matches(docs, text, ident, tokens, shingle), "matches")
    spots = found.where(F.size("hits") > 0).select("ident", "print", "chars", "n_words", F.inline("hits"))
    known = tokens.select("token").distinct()
    bounded = F.broadcast if pieces.count() <= MOST_BROADCAST else (lambda df: df)  # counted, not guessed
    counts = spots.select("token").join(bounded(known), "token", "left_semi").groupBy("token").count()
    rare = Window.partitionBy("words").orderBy(F.coalesce("count", F.lit(0)), "at")
    # a shingle that no document holds makes its window the empty side of the join
    prefix = pieces.join(counts, "token", "left").withColumn("nth", F.row_number().over(rare)).where("nth = 1 AND count > 0")
    prefix = prefix.select("token", "held_by", "words", F.col("at").alias("offset"))
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.size("words") <= F.col("n_words"))
    key = ["ident", "print", "chars"]
    open_ = spots.join(bounded(prefix), "token").where(fits).select(*key, F.struct("held_by", start.alias("start"), "words").alias("c"))
    open_ = stage(open_.groupBy(*key).agg(F.collect_set("c").alias("open")), "candidates")
    again = keyed(docs, text, ident)
    if open_.count() <= MOST_KEYS:
        # texts that have no candidate stay where they are
        again = again.join(F.broadcast(open_.select("print").distinct()), "print", "left_semi")
    to_check = open_.withColumnsRenamed({k: f"o_{k}" for k in key})
    met = again.join(to_check, [F.col("ident").eqNullSafe(F.col("o_ident")), F.col("print") == F.col("o_print"), F.col("chars") == F.col("o_chars")])
    same = let(item_words(F.col("body")), lambda w: F.filter("open", lambda c: F.slice(w, c["start"] + 1, F.size(c["words"])) == c["words"]))
    hits = met.select(*key, F.inline(same)).select(*key, "held_by", "start", F.size("words").alias("length")).distinct()
    hits = stage(hits, "hits")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    end = lambda s: s["start"] + s["length"]
    more = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), end(s) - F.greatest(acc["end"], s["start"]))).cast("long").alias("n"), F.greatest(acc["end"], end(s)).alias("end"))
    covered = hits.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("s")).select(*key, F.aggregate("s", zero, more)["n"].alias("n_hit"))
    # sets of items come to a document once each, however many windows they share
    sets = cut.groupBy("held_by").agg(F.first("items").alias("items"))
    named = hits.select(*key, "held_by").distinct().join(sets, "held_by").groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    same_text = [covered["ident"].eqNullSafe(named["ident"]), covered["print"] == named["print"], covered["chars"] == named["chars"]]
    by_doc = covered.join(named, same_text).select(
        *(covered[k].alias(f"k_{k}") for k in key),
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    )
    on = F.col("ident").eqNullSafe(F.col("k_ident")) & (F.col("print") == F.col("k_print")) & (F.col("chars") == F.col("k_chars"))
    rows = found.select(*key, "n_words").join(by_doc, on, "left")
    return rows.select(
        *key,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", ident: str = "doc_id", **options) -> DataFrame:
    """``docs`` less the documents that hold a benchmark window; all their columns stay as they are, whatever their names.

    NULL and empty texts hold none and stay; of rows that repeat an id those
    go whose own text holds one; an empty benchmark lets all stay.
    """
    verdicts = contained(docs, items, text, ident, **options).where("contaminated")
    bad = verdicts.select(F.col("ident").alias("__ident"), F.col("print").alias("__print"), F.col("chars").alias("__chars"))
    # bound to their frames, since documents may have columns of these names
    body = F.coalesce(docs[f"`{text}`"], F.lit(""))
    on = docs[f"`{ident}`"].eqNullSafe(bad["__ident"]) & (F.xxhash64(body) == bad["__print"]) & (F.length(body) == bad["__chars"])
    return docs.join(bad, on, "left_anti")
