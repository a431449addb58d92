"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern in the notation of public filter lists: ``||`` anchors at
the start of the host or after one of its dots, ``|`` at the very start or end,
``*`` matches anything, ``^`` a separator or the end.  A literal run of letters
and digits that is closed off on both sides inside the pattern must occur as a
whole token in every URL that the pattern fits.  For each rule the token that
the fewest URLs hold is its index key; a URL's tokens fetch the rules keyed by
them, and only those run their regular expressions.  Rules without such a token
run on every URL, beside the index.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ascii_lower, constant_table

SEPARATORS = r"[^a-z0-9]+"
#: Up to this many rules ride in the plan as literals; longer lists are joined as a table.
INLINE_RULES = 256
#: Rule tables of at most this many rows (some hundred bytes each) are broadcast.
MOST_BROADCAST = 50_000


@dataclass(frozen=True)
class Rule:
    """``verdict`` for URLs that ``pattern`` fits; ``base`` rules outrank the others and are reported by name."""

    name: str
    verdict: str
    pattern: str
    base: bool = False

    @property
    def regex(self) -> str:
        body, out = self.pattern, ""
        if body.startswith("||"):
            out, body = r"^(?:[^/]*\.)?", body[2:]
        elif body.startswith("|"):
            out, body = "^", body[1:]
        end = ""
        if body.endswith("|"):
            body, end = body[:-1], r"\z"
        for piece in re.split(r"([*^])", body):
            out += {"*": r"[\s\S]*", "^": r"(?:[^A-Za-z0-9_.%-]|\z)"}.get(piece, re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", piece))
        return out + end

    @property
    def tokens(self) -> list[str]:
        """The literal tokens that a fitting URL must hold whole."""
        found = []
        text = re.sub(r"^\|{1,2}", "^", self.pattern)
        text = text[:-1] + "^" if text.endswith("|") else text
        for m in re.finditer(r"[A-Za-z0-9]+", text):
            before, after = text[: m.start()][-1:], text[m.end() :][:1]
            if before and before != "*" and after and after != "*":
                found.append(m.group().lower())
        return found


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path: after the first ``://`` up to ``/ ? #``, then up to ``? #``; both empty without one."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(whole, parts, 1)), F.regexp_extract(whole, parts, 2)


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the base rule that fits; else NULL) and ``verdict``.

    Among base rules that fit, the longest name wins; where none fits, ``block``
    wins among the other rules that fit, and ``default`` holds where no rule
    fits.  NULL URLs, URLs without ``://`` and empty ones have an empty host and
    path and get ``default``.  Repeated rows each get a row; input columns named
    ``host path rule verdict`` are replaced.  An empty table gives an empty one.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(f"`{url}`"))
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    place = F.concat("host", "path")
    tokens = F.array_distinct(F.split(ascii_lower(place), SEPARATORS))
    ranked = sorted(rules, key=lambda r: (not r.base, -len(r.name), r.verdict != "block", r.name))
    known = sorted({t for r in ranked for t in r.tokens})
    counts: dict[str, int] = {}
    if known:
        # one row per token of the rule list comes back, however many URLs there are
        vocabulary = constant_table(spark, [{"token": t} for t in known], "token string")
        bounded = F.broadcast(vocabulary) if len(known) <= MOST_BROADCAST else vocabulary
        met = rows.select(F.explode(tokens).alias("token")).join(bounded, "token", "left_semi")
        counts = {r["token"]: r["count"] for r in met.groupBy("token").count().collect()}
    keyed: dict[str, list[int]] = {}
    for i, r in enumerate(ranked):
        key = min(r.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        keyed.setdefault(key, []).append(i)
    if len(ranked) <= inline:
        best = _inline(ranked, keyed, tokens, place)
        rows = rows.withColumn("__best", best)
    else:
        rows = _joined(rows, ranked, keyed, tokens, place)
    return rows.withColumns({"rule": F.col("__best.rule"), "verdict": F.coalesce("__best.verdict", F.lit(default))}).drop("__best")


def _inline(ranked: list[Rule], keyed: dict[str, list[int]], tokens: Column, place: Column) -> Column:
    """The first rule that fits, with the index and the rules as literals of the plan."""
    if not ranked:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    rules = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(r.regex).alias("regex"), F.lit(r.name if r.base else None).cast("string").alias("rule"), F.lit(r.verdict).alias("verdict")) for i, r in enumerate(ranked)))
    index = F.create_map(*(x for t, ids in keyed.items() for x in (F.lit(t), F.array(*map(F.lit, ids))))).cast("map<string, array<int>>")
    fetched = F.flatten(F.filter(F.transform(F.array_append(F.filter(tokens, lambda t: t != ""), F.lit("")), lambda t: F.try_element_at(index, t)), lambda x: x.isNotNull()))
    fits = F.filter(F.array_sort(fetched), lambda i: F.rlike(place, F.get(rules, i)["regex"]))
    hit = F.get(rules, F.get(fits, 0))
    return F.when(F.size(fits) > 0, F.struct(hit["rule"].alias("rule"), hit["verdict"].alias("verdict")))


def _joined(rows: DataFrame, ranked: list[Rule], keyed: dict[str, list[int]], tokens: Column, place: Column) -> DataFrame:
    """The same for long rule lists: distinct places meet the rule table by token; the best fit comes back by place.

    Rules without a token are literals of the plan, so that no key is met by all places.
    """
    table = constant_table(
        rows.sparkSession,
        [{"token": t, "at": i, "regex": ranked[i].regex, "rule": ranked[i].name if ranked[i].base else None, "verdict": ranked[i].verdict} for t, ids in keyed.items() if t for i in ids],
        "token string, at int, regex string, rule string, verdict string",
    )
    table = F.broadcast(table) if len(ranked) <= MOST_BROADCAST else table
    places = rows.select(place.alias("__place")).distinct()
    probes = places.select("__place", F.explode(F.array_distinct(F.split(ascii_lower(F.col("__place")), SEPARATORS))).alias("token"))
    hits = probes.join(table, "token").where(F.rlike(F.col("__place"), F.col("regex"))).select("__place", "at", "rule", "verdict")
    if anywhere := keyed.get("", []):
        fit = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(ranked[i].regex).alias("regex"), F.lit(ranked[i].name if ranked[i].base else None).cast("string").alias("rule"), F.lit(ranked[i].verdict).alias("verdict")) for i in anywhere))
        first = F.get(F.filter(fit, lambda r: F.rlike(F.col("__place"), r["regex"])), F.lit(0))
        hits = hits.unionByName(places.withColumn("r", first).where(F.col("r").isNotNull()).select("__place", "r.at", "r.rule", "r.verdict"))
    best = hits.groupBy("__place").agg(F.min_by(F.struct("rule", "verdict"), "at").alias("__best"))
    return rows.withColumn("__place", place).join(best, "__place", "left").drop("__place")
