"""A finished run scored against what was planted: labels, copies and states, all from a few contingency tables.

Spots, segments and profiles are joined once.  What the scores need of them are
counts of label pairs and of (planted copies, state, decoded copies), a few
thousand rows at most whatever the size of the run; every index and share
follows from these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import decode, intervals, scoring
from tessera.operators.copies import match_labels
from tessera.operators.ranking import numbered
from tessera.staging import stage

#: Shares of agreeing bins at which fitted clones are merged, by the name of their scores.
AGREEMENTS = {"int_100": 1.0, "int_099": 0.99}
CLASSES = ("loh", "balanced_gain", "unbalanced_gain")


def at_truth(planted: DataFrame, fitted: DataFrame) -> DataFrame:
    """(spot, planted, fitted): fitted labels read at the planted spots; NULL where the run dropped one. Spots that were not planted take no part."""
    return planted.select("spot", F.col("clone").alias("planted")).join(fitted.select("spot", F.col("clone").alias("fitted")), "spot", "left")


def planted_rows(segments: DataFrame, bins: DataFrame) -> DataFrame:
    """(bin, segment): the segment (segment, chrom, start, end), both ends in it, that holds each planted bin (bin, chrom, position).

    Of several the last one counts, NULL is none; a run with a segment for each
    bin has them in the bins' order.
    """
    if segments.count() == bins.count():
        at = lambda df, key, name: numbered(df.select(key), key, name="__n").withColumnRenamed(key, name)
        return at(bins, "bin", "bin").join(at(segments, "segment", "segment"), "__n").select("bin", "segment")
    held = intervals.covering(bins, segments.withColumn("end", F.col("end") + 1), "chrom", "position", "start", "end").groupBy("bin").agg(F.max("segment").alias("segment"))
    return bins.select("bin").join(held, "bin", "left")


def matched(spots: DataFrame) -> list[tuple]:
    """(planted, fitted) clones, one to one, that share most spots; their counts, labels squared, are on the driver."""
    counts = scoring.contingency(spots, "planted", "fitted").collect()
    return sorted(match_labels({(r["planted"], r["fitted"]): r["n"] for r in counts}).items()) if counts else []


def clone_bins(pairs: list[tuple], segments: DataFrame, profile: DataFrame) -> DataFrame:
    """(segment, planted, fitted, t, ab, state): matched clones' segments, with the planted copies at the middle of each and the decoded ones.

    ``segments`` is (segment, chrom, start, end, clone, a, b, state), ``profile``
    (row, chrom, start, end, clone, a, b).  Copies are coded a * 1000 + b;
    segments whose middle no planted row holds are left out; of several rows
    the last one counts.
    """
    spark = segments.sparkSession
    kind = lambda df: dict(df.dtypes)["clone"]
    of = spark.createDataFrame(pairs, f"planted {kind(profile)}, fitted {kind(segments)}")  # some tens
    middle = F.floor((F.col("start") + F.col("end")) / 2).cast("long")
    own = segments.join(F.broadcast(of), F.col("clone") == F.col("fitted")).select("segment", "chrom", middle.alias("at"), "planted", "fitted", (F.col("a") * scoring.CODE + F.col("b")).alias("ab"), "state")
    rows = profile.select("row", "chrom", "start", "end").distinct()
    found = intervals.covering(own.select("chrom", "at").distinct(), rows, "chrom", "at", "start", "end").groupBy("chrom", "at").agg(F.max("row").alias("row"))
    truth = profile.select("row", F.col("clone").alias("planted"), (F.col("a") * scoring.CODE + F.col("b")).alias("t"))
    return own.join(found, ["chrom", "at"]).join(truth, ["row", "planted"]).select("segment", "planted", "fitted", "t", "ab", "state")


def rand_indices(counts: DataFrame) -> DataFrame:
    """(metric, value): the adjusted Rand index of each metric's counts (metric, l, r, n); 1 where both sides are trivial alike."""
    pairs = lambda x: x * (x - 1) / 2.0
    cells = counts.groupBy("metric", "l", "r").agg(F.sum("n").alias("n"))
    side = lambda key: cells.groupBy("metric", key).agg(F.sum("n").alias("k")).groupBy("metric").agg(F.sum(pairs(F.col("k"))).alias(f"s_{key}"))
    whole = cells.groupBy("metric").agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("s"))
    row = whole.join(side("l"), "metric").join(side("r"), "metric")
    expected = F.coalesce(F.try_divide(F.col("s_l") * F.col("s_r"), pairs(F.col("n"))), F.lit(0.0))
    half = (F.col("s_l") + F.col("s_r")) / 2
    return row.select("metric", F.when(half == expected, F.lit(1.0)).otherwise((F.col("s") - expected) / (half - expected)).alias("value"))


def _listed(counts: DataFrame, metrics: dict[str, tuple[Column, Column, Column | None]]) -> DataFrame:
    """Each metric's pairs of values, from one table of counts."""
    each = F.array(*(F.struct(F.lit(name).alias("metric"), left.cast("string").alias("l"), right.cast("string").alias("r"), (where if where is not None else F.lit(True)).alias("in")) for name, (left, right, where) in metrics.items()))
    return counts.select("n", F.explode(each).alias("m")).where("m.in").select("m.metric", "m.l", "m.r", "n")


def merged_clones(segments: DataFrame) -> DataFrame:
    """(fitted, int_100, int_099): what each fitted clone is merged into at each agreement of its copies."""
    profiles = stage(segments.select(F.col("clone").alias("fitted"), "segment", (F.col("a") * scoring.CODE + F.col("b")).alias("ab")), "profiles")
    out = None
    for name, share in AGREEMENTS.items():
        own = decode.named_clones(profiles, "fitted", "segment", "ab", share).withColumnRenamed("merged", name)
        out = own if out is None else out.join(own, "fitted")
    return out


def label_scores(spots: DataFrame, merged: DataFrame) -> DataFrame:
    """(metric, value): adjusted Rand indices of labels as fitted and as merged, numbers of clones, spots, and the share that the run kept."""
    counts = stage(spots.groupBy("planted", "fitted").agg(F.count(F.lit(1)).alias("n")).join(merged, "fitted", "left"), "labels")
    kept = counts.where("fitted IS NOT NULL AND planted IS NOT NULL")
    aris = rand_indices(_listed(kept, {"clone_ari": (F.col("planted"), F.col("fitted"), None)} | {f"clone_ari_{name}": (F.col("planted"), F.col(name), None) for name in AGREEMENTS}))
    sums = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("spots"), F.count_distinct("fitted").cast("double").alias("clones"), *(F.count_distinct(name).cast("double").alias(f"clones_{name}") for name in AGREEMENTS))
    whole = counts.agg(F.sum("n").alias("all"))
    sums = sums.join(whole, how="cross").withColumn("kept", F.try_divide("spots", "all")).drop("all")  # one row each
    return aris.unionByName(_long(sums))


def _long(row: DataFrame) -> DataFrame:
    """One row's columns as (metric, value)."""
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns))).alias("m")).select("m.*")


def copy_scores(bins: DataFrame) -> DataFrame:
    """(metric, value) of ``clone_bins``: indices of states and copies, with phases and without, whole and by planted class, and exact shares.

    A class's index is NULL where its planted copies take fewer than two values,
    and its share where it is not planted.
    """
    t, ab = F.col("t"), F.col("ab")
    counts = stage(bins.groupBy("t", "state", "ab").agg(F.count(F.lit(1)).alias("n")).withColumn("class", scoring.copy_class(t)), "copies")
    free = (scoring.phase_free(t), scoring.phase_free(ab))
    metrics = {"state_ari": (t, F.col("state"), None), "copy_ari": (t, ab, None), "copy_ari_pf": (*free, None)}
    for c in CLASSES:
        metrics |= {f"copy_ari_{c}": (t, ab, F.col("class") == c), f"copy_ari_{c}_pf": (*free, F.col("class") == c)}
    listed = _listed(counts, metrics)
    several = listed.groupBy("metric").agg(F.count_distinct("l").alias("k"))
    names = bins.sparkSession.createDataFrame([(m, "_ari_" in m and m != "copy_ari_pf") for m in metrics], "metric string, by_class boolean")
    value = F.when(~F.col("by_class") | (F.col("k") >= 2), F.col("value"))
    aris = names.join(rand_indices(listed), "metric", "left").join(several, "metric", "left").select("metric", value.alias("value"))
    same, either = t == ab, (t == ab) | (t == scoring.swapped(ab))
    share = lambda hit, where: F.try_divide(F.coalesce(F.sum(F.when(where & hit, F.col("n"))), F.lit(0)).cast("double"), F.sum(F.when(where, F.col("n"))))
    every, altered = F.lit(True), t != scoring.CODE + 1
    shares = {"exact": share(same, every), "exact_pf": share(either, every), "exact_altered": share(same, altered), "exact_altered_pf": share(either, altered), "exact_neutral": share(same, ~altered)}
    for c in CLASSES:
        shares |= {f"exact_{c}": share(same, F.coalesce(F.col("class") == c, F.lit(False))), f"exact_{c}_pf": share(either, F.coalesce(F.col("class") == c, F.lit(False)))}
    return aris.unionByName(_long(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("clone_bins"), *(v.alias(k) for k, v in shares.items()))))


def score_run(planted: DataFrame, fitted: DataFrame, segments: DataFrame, profile: DataFrame) -> DataFrame:
    """(metric, value): a run's labels and copies against the planted ones; see ``at_truth`` and ``clone_bins`` for the tables."""
    spots = stage(at_truth(planted, fitted), "spots")
    bins = clone_bins(matched(spots), segments, profile)
    return label_scores(spots, merged_clones(segments)).unionByName(copy_scores(bins))


def copy_confusion(bins: DataFrame, most_total: int = 6, digits: int = 4) -> DataFrame:
    """(planted, decoded, share): of each planted pair's clone-bins the share decoded to each pair, ``other`` beyond ``most_total``; planted pairs beyond it are left out."""
    total = lambda c: F.call_function("div", F.col(c), F.lit(scoring.CODE)) + F.col(c) % scoring.CODE
    name = lambda c: F.concat_ws(",", F.call_function("div", F.col(c), F.lit(scoring.CODE)).cast("string"), (F.col(c) % scoring.CODE).cast("string"))
    decoded = F.when(F.coalesce((F.col("ab") >= 0) & (total("ab") <= most_total), F.lit(False)), name("ab")).otherwise("other")
    counts = bins.where(total("t") <= most_total).groupBy(name("t").alias("planted"), decoded.alias("decoded")).agg(F.count(F.lit(1)).alias("n"))
    return scoring.confusion(counts, "planted", "decoded", digits=digits)


def state_scores(bins: DataFrame, planted_states: DataFrame, fitted_states: DataFrame, neutral: int = 0) -> DataFrame:
    """(metric, value): states of matched clones' bins against the planted ones, whose copies need not be whole.

    ``bins`` is (fitted, planted_state, state, a, b); ``planted_states`` is
    (state, mu, p), ``fitted_states`` (clone, state, mu, p).  States are matched
    one to one by the bins they share; errors are of each bin's rate and of its
    share folded at one half; decoded totals are held against twice the planted
    rate.  ``neutral`` is the planted state that altered bins are not in.
    """
    fold = lambda p: F.least(p, 1 - p)
    true = planted_states.select(F.col("state").alias("planted_state"), F.col("mu").alias("mu0"), F.col("p").alias("p0"))
    fit = fitted_states.select(F.col("clone").alias("fitted"), "state", F.col("mu").alias("mu1"), F.col("p").alias("p1"))
    met = bins.where("planted_state IS NOT NULL AND state IS NOT NULL").join(F.broadcast(true), "planted_state").join(F.broadcast(fit), ["fitted", "state"])  # parameters of states
    met = stage(met.select("planted_state", "state", F.abs(F.col("mu1") - F.col("mu0")).alias("mu_error"), F.abs(fold(F.col("p1")) - fold(F.col("p0"))).alias("baf_error"), (F.col("a") + F.col("b")).alias("total"), F.rint(2 * F.col("mu0")).alias("due"), (F.col("a") * scoring.CODE + F.col("b")).alias("ab")), "states")
    counts = stage(met.groupBy("planted_state", "state", "ab").agg(F.count(F.lit(1)).alias("n")), "state-counts")
    pair = {(r["planted_state"], r["state"]): r["n"] for r in counts.groupBy("planted_state", "state").agg(F.sum("n").alias("n")).collect()}
    held = sum(pair.get(x, 0) for x in match_labels(pair).items()) / sum(pair.values()) if pair else None
    off, altered = F.abs(F.col("total") - F.col("due")), F.col("planted_state") != neutral
    median = lambda c: F.percentile(c, F.lit(0.5))
    hit = F.when(F.col("total") == F.col("due"), 1.0).otherwise(0.0)
    sums = met.agg(
        F.lit(held).cast("double").alias("state_match"), median("mu_error").alias("mu_error_median"), F.avg("mu_error").alias("mu_error_mean"), median("baf_error").alias("baf_error_median"), F.avg(hit).alias("copy_exact"),
        median(off).alias("copy_error_median"), F.avg(F.when(altered, hit)).alias("copy_exact_altered"), median(F.when(altered, off)).alias("copy_error_altered_median"),
    )
    aris = rand_indices(_listed(counts, {"state_ari": (F.col("planted_state"), F.col("state"), None), "copy_ari": (F.col("planted_state"), F.col("ab"), None)}))
    return aris.unionByName(_long(sums))

