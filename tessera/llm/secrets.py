"""Secret scans: fixed patterns, and a battery of randomness tests on every key-like string.

Strings that could be keys (long runs of base64 letters) are read in the
smallest alphabet that spells them; a run that none spells, for it mixes both
kinds of base64, is tested in each kind's own runs.  Three tests ask whether its digits look
drawn at random: chi-squared uniformity over the alphabet, the number of runs
above and below its middle, and the correlation of neighbours.  Fisher's method
combines them.  A key passes such tests and prose fails them, so what has to be
controlled is prose that passes for want of length: within each alphabet and
length class the p-values of random strings are uniform, which tells from the
upper half how many strings are random, and the class's threshold is the
lowest at which the others are at most ``fdr`` of those that pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.staging import stage

from .text import find_all, let

#: The base kinds in their order, each a pattern and a test of what it matched.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Runs of a candidate that one kind of base64 spells: letters and digits with + and / or with - and _.
PIECES = (r"[A-Za-z0-9+/]{20,}={0,2}", r"[A-Za-z0-9_-]{20,}={0,2}")
#: Alphabets from the smallest; the order of letters is the order of values.
ALPHABETS = [
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base36l", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
#: Length classes start here; the p-value axis is cut into this many steps.
LENGTHS = (20, 28, 40, 64, 128, 512)
STEPS = 100
#: Distinct strings that a class borrows, in the proportions of its alphabet, which borrows as many from all; large classes hardly notice, small ones are shrunk to the rest.
BORROWED = 30


def base_spans(text: Column) -> Column:
    """(start, rank, kind, end) of the fixed patterns in a text that is not NULL."""
    kept = lambda hits, rank, test: F.transform(F.filter(hits, test), lambda h: F.struct(h["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), h["end"].alias("end")))
    return F.concat(
        kept(find_all(text, ASSIGN), 0, lambda h: F.length(F.regexp_extract(h["hit"], ASSIGN_VALUE, 1)) >= 8),
        kept(find_all(text, ACCESS), 1, lambda h: F.length(h["hit"]) >= 16),
        kept(find_all(text, HEX), 2, lambda h: F.length(h["hit"]) >= 32),
    )


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal (a classical rational approximation, error under 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = 0.3989422804014327 * F.exp(-a * a / 2) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def chi2_tail(x: Column, df: Column) -> Column:
    """P(chi-squared with ``df`` degrees > x), by Wilson and Hilferty's cube root."""
    v = 2 / (9 * df)
    return upper_tail((F.pow(x / df, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v))


def battery(token: Column) -> Column:
    """(alphabet, n, p) of a string; NULL where no alphabet spells it or it has no two unlike digits."""
    name, letters = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, alphabet in reversed(ALPHABETS):
        spelled = F.translate(token, alphabet, "") == ""
        name, letters = F.when(spelled, label).otherwise(name), F.when(spelled, alphabet).otherwise(letters)

    def tested(x: Column) -> Column:
        return let(F.transform(F.split(x["token"], ""), lambda c: F.instr(x["letters"], c) - 1).cast("array<double>"), lambda v: measured(x, v))

    def measured(x: Column, v: Column) -> Column:
        n, k = F.size(v).cast("double"), F.length(x["letters"]).cast("double")
        cells = F.greatest(F.lit(4.0), F.least(k, F.floor(n / 5).cast("double")))
        cell = lambda d: F.floor(d * cells / k)
        # a cell's expected share is the share of letters that fall into it
        letters_in = lambda c: F.ceil((c + 1) * k / cells) - F.ceil(c * k / cells)
        seen = lambda c: F.size(F.filter(v, lambda d: cell(d) == c)).cast("double")
        term = lambda c: F.pow(seen(c) - n * letters_in(c) / k, F.lit(2)) / (n * letters_in(c) / k)
        chi = F.aggregate(F.sequence(F.lit(0), (cells - 1).cast("int")), F.lit(0.0), lambda a, c: a + term(c))
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        high = F.size(F.filter(v, lambda d: d * 2 >= k)).cast("double")
        low = n - high
        runs = 1 + F.size(F.filter(pairs, lambda q: (q["a"] * 2 >= k) != (q["b"] * 2 >= k))).cast("double")
        mean_runs = 2 * high * low / n + 1
        spread = F.sqrt(F.greatest(F.lit(1e-9), (mean_runs - 1) * (mean_runs - 2) / (n - 1)))
        mean = F.aggregate(v, F.lit(0.0), lambda a, d: a + d) / n
        square = F.aggregate(v, F.lit(0.0), lambda a, d: a + (d - mean) * (d - mean))
        cross = F.aggregate(pairs, F.lit(0.0), lambda a, q: a + (q["a"] - mean) * (q["b"] - mean))
        floor = lambda p: F.greatest(F.lit(1e-12), p)
        p_chi = floor(chi2_tail(chi, cells - 1))
        p_runs = F.when((high == 0) | (low == 0), F.lit(1e-12)).otherwise(floor(2 * upper_tail(F.abs((runs - mean_runs) / spread))))
        p_cross = F.when(square == 0, F.lit(1e-12)).otherwise(floor(2 * upper_tail(F.abs((cross / F.greatest(F.lit(1e-9), square) + 1 / n) * F.sqrt(n)))))
        half = -(F.log(p_chi) + F.log(p_runs) + F.log(p_cross))
        return F.struct(x["name"].alias("alphabet"), n.cast("int").alias("n"), (F.exp(-half) * (1 + half + half * half / 2)).alias("p"))

    return F.when(letters.isNotNull(), let(F.struct(token.alias("token"), name.alias("name"), letters.alias("letters")), tested))


def pieces(hit: Column) -> Column:
    """The candidate alone where an alphabet can spell it; else its pieces of each kind (none is of both: its neighbours would end the run)."""
    at = lambda p: F.struct((hit["start"] + p["start"]).alias("start"), (hit["start"] + p["end"]).alias("end"), p["hit"].alias("hit"))
    cut = F.concat(*(F.transform(find_all(hit["hit"], p), at) for p in PIECES))
    return F.when(hit["hit"].rlike("[+/]") & hit["hit"].rlike("[_-]"), cut).otherwise(F.array(F.struct(hit["start"].alias("start"), hit["end"].alias("end"), hit["hit"].alias("hit"))))


def length_class(n: Column) -> Column:
    return sum((F.when(n >= edge, 1).otherwise(0) for edge in LENGTHS[1:]), F.lit(0))


def thresholds(counts: list[tuple[str, int, int, int]], fdr: float) -> dict[tuple[str, int], float]:
    """The p-value from which on strings of an alphabet and length class count as random.

    ``counts``: (alphabet, class, step of the p-value, distinct strings).  Of
    the strings at or above t, (1 - t) times the random ones are random, and
    twice the number above one half estimates those.
    """
    out = {}

    def histogram(same) -> list[float]:
        steps = [0.0] * STEPS
        for x in filter(same, counts):
            steps[x[2]] += x[3]
        return steps

    def shrunk(steps: list[float], towards: list[float]) -> list[float]:
        return [a + BORROWED * b / sum(towards) for a, b in zip(steps, towards)]

    every = histogram(lambda x: True)
    for a, c in sorted({(a, c) for a, c, _, _ in counts}):
        steps = shrunk(histogram(lambda x: x[:2] == (a, c)), shrunk(histogram(lambda x: x[0] == a), every))
        randoms = 2 * sum(steps[STEPS // 2 :])
        for at in range(1, STEPS):
            passed = sum(steps[at:])
            if passed and 1 - (1 - at / STEPS) * randoms / passed <= fdr:
                out[a, c] = at / STEPS
                break
    return out


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), fdr: float = 0.05) -> DataFrame:
    """The ``keep`` columns with ``base`` and ``random``: arrays of (start, rank, kind, end) in order.

    Positions count code points, ends are exclusive.  ``random`` holds the
    strings that the battery finds, where no base span overlaps them.  NULL and
    empty texts have none.  Repeated rows each get a row; a string that many
    rows repeat counts once in the statistics.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    apart = lambda h, spans: ~F.exists(spans, lambda s: (s["start"] < h["end"]) & (h["start"] < s["end"]))
    rows = docs.select(*(F.col(f"`{k}`") for k in keep), body.alias("__text")).withColumn("base", F.array_sort(base_spans(F.col("__text"))))
    judged = lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), F.xxhash64(h["hit"]).alias("print"), battery(F.rtrim(h["hit"], F.lit("="))).alias("test"))
    found = let(F.struct(F.flatten(F.transform(find_all(F.col("__text"), CANDIDATE), pieces)).alias("hits"), F.col("base").alias("base")), lambda x: F.filter(F.transform(F.filter(x["hits"], lambda h: apart(h, x["base"])), judged), lambda j: j["test"].isNotNull()))
    staged = stage(rows.select(*keep, "base", found.alias("candidates")), "secrets")
    step = F.least(F.lit(STEPS - 1), F.greatest(F.lit(0), F.floor(F.col("test.p") * STEPS))).cast("int")
    tests = staged.select(F.inline("candidates")).select("print", F.col("test.alphabet").alias("a"), length_class(F.col("test.n")).alias("c"), step.alias("s")).distinct()
    limits = thresholds([tuple(r) for r in tests.groupBy("a", "c", "s").count().collect()], fdr)
    limit = lambda j: F.coalesce(*[F.when((j["test"]["alphabet"] == a) & (length_class(j["test"]["n"]) == c), F.lit(t)) for (a, c), t in limits.items()], F.lit(2.0))
    random = F.transform(F.filter("candidates", lambda j: j["test"]["p"] >= limit(j)), lambda j: F.struct(j["start"].alias("start"), F.lit(3).alias("rank"), F.lit(KINDS[3]).alias("kind"), j["end"].alias("end")))
    return staged.select(*keep, "base", random.alias("random"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
