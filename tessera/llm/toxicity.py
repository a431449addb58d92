"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are lexicons and patterns: a seed lexicon, lexicons of words and of word
beginnings that labelled documents show to mark toxic ones (dealt into several
voters by hash, so that each errs on its own), and patterns of form.  Each
votes toxic, clean or nothing.  The label model takes votes as drawn, given the
unknown class, from each voter's own distribution; it estimates those and the
class's share by expectation maximisation over the counts of vote patterns of
all documents.  What votes still share given the class is their correlation,
and a voter's evidence counts by the inverse of how many copies of it the
others hold.  Documents with the model's posterior as their label then train a
logistic regression over the lexicons' entries and the patterns.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.staging import stage

from .text import ascii_lower, let, words

WORD = re.compile(r"[^\W\d_]+")
#: A seed lexicon of plain insults.
SEED = frozenset("idiot idiots moron morons stupid loser losers scum trash clown worthless pathetic disgusting imbecile filth vermin bastard bitch asshole".split())
#: Beginnings of words of these lengths are lexicon entries too, for inflected forms.
BEGINNINGS = (4, 5, 6)
#: Labelled documents, at most, that lexicons and classifier are fitted on: those with the least hash of their id.
MOST_LABELLED = 20_000
#: The voters that the learned lexicon's entries are dealt into.
PARTS = 3
#: Chance of a false entry among all that are tried.
FALSE_ENTRY = 0.001

SHOUTING = re.compile(r"[!?]{3,}")
AT_SOMEONE = re.compile(r"\b(?:you|your|tu|du|vous|usted)\b", re.I)
LINK = re.compile(r"https?://")


def fold(ident: Column, of: int) -> Column:
    """The contract's split: crc32 of the id as text."""
    return F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit(""))), F.lit(of))


#: Minimum hashes of a text, and how many must agree for two texts to count as near copies.
MINIMA, AGREEING = 8, 6


def least_shingles(text: Column, size: int = 5) -> Column:
    """The least hashes, under several hash functions, of a text's runs of ``size`` words; of the whole text where it has fewer."""
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(size))))
    least = lambda r: F.array(*(F.array_min(F.transform(r, lambda h: F.xxhash64(h, F.lit(i)))) for i in range(MINIMA)))
    return let(words(ascii_lower(text)), lambda w: let(F.when(F.size(w) < size, F.array(F.xxhash64(text))).otherwise(runs(w)), least))


def unlike(sample: DataFrame) -> DataFrame:
    """(text, toxic) of a sample, near copies once, with the label of the text that is kept.

    Texts that share one minimum hash meet; those that agree with the group's
    first text in most of the others are its copies, the rest stay.
    """
    signed = sample.withColumn("print", least_shingles(F.col("text")))
    # of equal texts with unlike labels the toxic one is kept
    order = F.struct("text", (-F.col("toxic")).alias("clean"))
    first = signed.groupBy(F.get("print", 0).alias("key")).agg(F.min_by(F.struct("text", "toxic", "print"), order).alias("first"))
    met = signed.join(first, F.get("print", 0) == F.col("key"))
    agree = F.aggregate(F.arrays_zip("print", F.col("first.print").alias("other")), F.lit(0), lambda n, x: n + (x["print"] == x["other"]).cast("int"))
    return first.select("first.text", "first.toxic").unionByName(met.where(agree < AGREEING).select("text", "toxic").distinct())


@dataclass
class Model:
    """Lexicon entries with their numbers, each voter's evidence, and the classifier's weights."""

    entries: dict[str, int] = field(default_factory=dict)
    evidence: list[dict[int, float]] = field(default_factory=list)
    prior: float = 0.5
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def score(self, text: str) -> float:
        z = self.weights[-1] + sum(self.weights[i] for i in features(text, self.entries))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def terms(text: str) -> set[str]:
    """The words of a text and, marked by ``*``, their beginnings."""
    found = words_of(text)
    return found.union(*({f"{w[:n]}*" for w in found if len(w) > n} for n in BEGINNINGS))


BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")


def capitals(text: str) -> bool:
    """Whether a text has more than 20 letters and over 60 % of them are capitals; ASCII is counted by bytes."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = int(np.count_nonzero(data - np.uint8(65) < 26))
    letters = upper + int(np.count_nonzero(data - np.uint8(97) < 26))
    if len(data) > len(text):
        rest = "".join(BEYOND_ASCII.findall(text))
        letters, upper = letters + sum(map(str.isalpha, rest)), upper + sum(map(str.isupper, rest))
    return letters > 20 and upper > 0.6 * letters


def patterns(text: str) -> list[bool]:
    return [bool(SHOUTING.search(text)), capitals(text), bool(AT_SOMEONE.search(text)), bool(LINK.search(text))]


N_PATTERNS = 4


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def entries_of(found: set[str], entries: dict[str, int]) -> list[int]:
    """Numbers of the lexicon entries among the words of a text."""
    hits = [entries[w] for w in found & entries.keys()]
    for n in BEGINNINGS:
        hits += [entries[p] for p in {f"{w[:n]}*" for w in found if len(w) > n} & entries.keys()]
    return hits


def features(text: str, entries: dict[str, int]) -> list[int]:
    """The classifier's features: entries, then patterns, then how many entries there are (up to 4)."""
    hits, base = entries_of(words_of(text), entries), len(entries)
    out = hits + [base + i for i, p in enumerate(patterns(text)) if p]
    return out + [base + N_PATTERNS + i for i in range(min(4, len(hits)))]


def votes(text: str, entries: dict[str, int]) -> list[int]:
    """1 toxic, -1 clean, 0 no vote, for each voter."""
    found = words_of(text)
    hits = entries_of(found, entries)
    parts = Counter(i % PARTS for i in hits)
    shouting, loud, at_someone, link = patterns(text)
    return [
        1 if found & SEED else -1,
        *(1 if parts[p] else -1 for p in range(PARTS)),
        1 if len(hits) > 1 else (-1 if not hits else 0),
        1 if shouting and found & SEED else 0,
        1 if at_someone and hits else 0,
        -1 if link and not hits else 0,
        -1 if loud and not hits else 0,
    ]


def find_entries(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, int]:
    """Terms too common in toxic documents for chance: the binomial tail over all terms tried, and nearly all toxic."""
    share = max(1e-6, toxic / max(1, toxic + clean))
    limit = math.log(FALSE_ENTRY / max(1, len(counts)))
    found = []
    for term, t, c in counts:
        n = t + c
        rate = t / n
        if t < 4 or rate < 0.85:
            continue
        # the exponent of the binomial tail (Chernoff)
        gain = n * (rate * math.log(rate / share) + ((1 - rate) * math.log((1 - rate) / (1 - share)) if rate < 1 else 0))
        if -gain < limit:
            found.append((-gain, term))
    chosen = sorted(t for _, t in found)
    return {t: i for i, t in enumerate(chosen)}


def label_model(patterns_seen: dict[tuple[int, ...], int], start: float, rounds: int = 200) -> tuple[list[dict[int, float]], float, np.ndarray]:
    """(log-odds of each voter's votes, the class's share, correlations given the class) from counts of vote patterns."""
    rows = np.array(list(patterns_seen), dtype=np.int64)
    n = np.array(list(patterns_seen.values()), dtype=float)
    if not len(rows):
        return [], start, np.zeros((0, 0))
    m = rows.shape[1]
    prior = min(0.5, max(0.001, start))
    # a voter is taken to be better than chance before the first round
    like = np.zeros((2, m, 3))
    like[1], like[0] = (0.15, 0.15, 0.7), (0.7, 0.15, 0.15)
    depth = np.ones(m)
    pick = np.arange(m)
    for turn in range(rounds):
        evidence = np.log(like[1, pick, rows + 1]) - np.log(like[0, pick, rows + 1])
        odds = math.log(prior / (1 - prior)) + (evidence / depth).sum(axis=1)
        post = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        old = prior
        prior = float(np.clip((n * post).sum() / n.sum(), 1e-4, 0.6))
        for y, w in ((1, n * post), (0, n * (1 - post))):
            for j in range(m):
                c = np.bincount(rows[:, j] + 1, weights=w, minlength=3) + (0.5, 0.5, 0.5)
                like[y, j] = c / c.sum()
        centred = rows - (post[:, None] * (like[1] @ (-1, 0, 1)) + (1 - post)[:, None] * (like[0] @ (-1, 0, 1)))
        cov = (centred * n[:, None]).T @ centred / n.sum()
        spread = np.sqrt(np.maximum(1e-9, np.diag(cov)))
        rho = np.clip(cov / spread[:, None] / spread[None, :], -1, 1)
        np.fill_diagonal(rho, 1.0)
        depth = np.clip(np.abs(rho), 0, 1).sum(axis=1) ** 0.5
        if turn > 5 and abs(prior - old) < 1e-9:
            break
    weight = [{v: float((np.log(like[1, j, v + 1]) - np.log(like[0, j, v + 1])) / depth[j]) for v in (-1, 0, 1)} for j in range(m)]
    return weight, prior, rho


def posterior(vote: list[int], evidence: list[dict[int, float]], prior: float) -> float:
    z = math.log(prior / (1 - prior)) + sum(e[v] for e, v in zip(evidence, vote))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(rows: list[list[int]], target: np.ndarray, width: int, rounds: int = 300) -> np.ndarray:
    """Weights (the last is the constant's) by gradient steps on soft labels, classes weighted alike, with a ridge."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.fromiter(itertools.chain.from_iterable(rows), np.int64, len(at))
    toxic = max(1e-9, target.sum())
    clean = max(1e-9, len(rows) - toxic)
    weigh = target * (0.5 / toxic) + (1 - target) * (0.5 / clean)
    w, square = np.zeros(width + 1), np.full(width + 1, 1e-8)
    for _ in range(rounds):
        z = w[-1] + np.bincount(at, weights=w[cols], minlength=len(rows))
        miss = weigh * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        grad = np.append(np.bincount(cols, weights=miss[at], minlength=width), miss.sum()) + 1e-5 * np.append(w[:-1], 0)
        square += grad * grad
        w -= 0.5 * grad / np.sqrt(square)
    return w


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", label: str = "toxic", folds: int = 3, held: int = 1, most: int = MOST_LABELLED) -> Model:
    """Fit on the labelled documents outside the held-out fold (at most ``most``) and on all documents' votes.

    NULL labels and ids are passed over; of several labels of an id the largest
    counts, and of several texts of an id the one with the least hash.  Near
    copies count once.  Without toxic labels the seed lexicon votes alone.
    """
    spark = docs.sparkSession
    given = labels.where(F.col(f"`{ident}`").isNotNull() & F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{ident}`").alias("__id")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("__toxic"))
    # the sample has a fixed size, whatever the corpus: 12 bytes for each of at most `most` rows
    chosen = given.where(fold(F.col("__id"), folds) != held).orderBy(F.xxhash64("__id"), "__id").limit(most)
    sample = docs.select(F.col(f"`{ident}`").alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text")).join(F.broadcast(chosen), "__id")
    sample = sample.groupBy("__id").agg(F.min(F.struct(F.xxhash64("__text"), F.col("__text").alias("text"), F.col("__toxic").alias("toxic"))).alias("kept")).select("kept.text", "kept.toxic")
    # lest one text's rare words pass for marks; three passes below read this
    once = stage(unlike(sample), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for body, y in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[y == 1].update(terms(body.as_py()))
                seen[y == 1][""] += 1
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][t] for t in names], pa.int64()), pa.array([seen[0][t] for t in names], pa.int64())], ["term", "toxic", "clean"])

    counted = once.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # terms of fewer than four toxic documents can be no entry; the sample's size bounds the rest
    rows = [tuple(r) for r in counted.where("toxic >= 4 OR term = ''").collect()]
    toxic, clean = next(((t, c) for term, t, c in rows if term == ""), (0, 0))
    tried = [r for r in rows if r[0]]
    model = Model(entries=find_entries(tried, toxic, clean))
    sent = spark.sparkContext.broadcast(model.entries)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(",".join(map(str, votes(body.as_py() or "", sent.value))) for body in batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    cast = docs.select(F.col(f"`{text}`")).mapInArrow(vote, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    seen = {tuple(map(int, r["pattern"].split(","))): r["n"] for r in cast}
    model.evidence, model.prior, model.correlations = label_model(seen, (toxic + 1) / (toxic + clean + 10))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [b.as_py() for b in batch.column(0)]
            kept = [features(b, sent.value) for b in bodies]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.list_(pa.int32())), pa.array([",".join(map(str, votes(b, sent.value))) for b in bodies])], ["f", "v"])

    # features and votes of the bounded sample, a few numbers for each document
    sampled = once.mapInArrow(train, "f array<int>, v string").collect()
    width = len(model.entries) + N_PATTERNS + 4
    if sampled and model.evidence:
        goal = np.array([posterior(list(map(int, r["v"].split(","))), model.evidence, model.prior) for r in sampled])
        model.weights = logistic([list(r["f"]) for r in sampled], goal, width)
    else:
        model.weights = np.zeros(width + 1)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, 0 to 1: higher, likelier toxic.

    NULL texts score as empty ones, repeated rows alike, texts of any length
    whole.  A column ``score`` of ``docs`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    # only the texts go to Python; the other columns stay where they are
    @F.arrow_udf("double")
    def judge(bodies: pa.Array) -> pa.Array:
        return pa.array([sent.value.score(body.as_py() or "") for body in bodies], pa.float64())

    return docs.withColumn("score", judge(F.col(f"`{text}`")))
