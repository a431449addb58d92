"""Filters and predicates of loading: spots, genes and labels that stay, names as they are printed, states that are allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import numbered

#: Genes and gene families whose counts are dominated by the tissue, as anchored patterns.
CANCER_GENES = ["^MT-", "^S100A6$", "^B2M$", "^HLA-B$", "^TPT1$", "^FTL$", "^FTH1$", "^RPL", "^RPS"]


def first_seen_codes(rows: DataFrame, name: str, order: str) -> DataFrame:
    """(name, code): names numbered from 0 in the order in which they first appear."""
    first = rows.groupBy(name).agg(F.min(order).alias("__first"))
    return numbered(first, "__first", name, name="code").select(name, "code")


def covered_spots(counts: DataFrame, alleles: DataFrame, least: float) -> DataFrame:
    """(spot): spots whose gene reads and whose allele reads both reach ``least``."""
    umi = counts.groupBy("spot").agg(F.sum("n").alias("umi")).where(F.col("umi") >= least)
    snp = alleles.groupBy("spot").agg(F.sum(F.col("a") + F.col("b")).alias("reads")).where(F.col("reads") >= least)
    return umi.join(snp, "spot").select("spot")


def named_like(name: Column, patterns: list[str] = CANCER_GENES) -> Column:
    """Whether a name fits any of the patterns."""
    return F.coalesce(name.rlike("|".join(patterns)), F.lit(False))


#: The parts of Roman numerals.
ROMAN = [(100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def roman(n: Column) -> Column:
    """A whole number from 1 as a Roman numeral."""
    parts = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(x).alias("x")) for v, x in ROMAN))
    times = lambda s, p: F.floor(s["left"] / p["v"]).cast("int")
    step = lambda s, p: F.struct(F.concat(s["text"], F.repeat(p["x"], times(s, p))).alias("text"), (s["left"] - times(s, p) * p["v"]).alias("left"))
    return F.aggregate(parts, F.struct(F.lit("").alias("text"), n.cast("int").alias("left")), step, lambda s: s["text"])


def clone_name(label: Column, with_normal: bool = False, most: int = 399) -> Column:
    """``clone 7`` or 7 as ``Clone VII``; -1 is ``WARN``, 0 is ``Clone 0`` or ``Normal``; NULL outside 0 to ``most``."""
    n = F.regexp_extract(label.cast("string"), r"(-?\d+)\s*$", 1).try_cast("int")
    zero = F.lit("Normal" if with_normal else "Clone 0")
    return F.when(n == -1, "WARN").when(n == 0, zero).when((n > 0) & (n <= most), F.concat(F.lit("Clone "), roman(n)))


def is_numeric(text: Column) -> Column:
    """Whether a text reads as a number."""
    return text.try_cast("double").isNotNull()


def admissible(state: Column, pieces: Column) -> Column:
    """Whether an event may set the copies ``state`` (a, b) over the lineage's ``pieces``, an array of such states.

    A haplotype that any piece has lost stays lost, and at least one piece
    changes; over no pieces nothing does.
    """
    kept = F.forall(pieces, lambda p: ((p["a"] > 0) | (state["a"] == 0)) & ((p["b"] > 0) | (state["b"] == 0)))
    return kept & F.exists(pieces, lambda p: (p["a"] != state["a"]) | (p["b"] != state["b"]))


def masked(df: DataFrame, mask: str, reads: str = "reads", error: str = "error", most_error: float = 0.1, top: float = 0.5) -> DataFrame:
    """Rows of a named mask: ``reads`` (has any), ``error`` (standard error at most so much) or ``top`` (reads in the upper share)."""
    if mask == "reads":
        return df.where(F.col(reads) > 0)
    if mask == "error":
        return df.where(F.col(error) <= most_error)
    if mask == "top":
        cut = df.agg(F.percentile(reads, F.lit(1 - top)).alias("__cut"))  # one row
        return df.join(F.broadcast(cut), how="cross").where(F.col(reads) >= F.col("__cut")).drop("__cut")
    raise ValueError(f"no mask {mask}")


def rank_one(cells: DataFrame, row: str, column: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """One row (exact, cells): whether the matrix is the product of its row and column sums over its total."""
    rows, columns = cells.groupBy(row).agg(F.sum(value).alias("r")), cells.groupBy(column).agg(F.sum(value).alias("c"))
    total = cells.agg(F.sum(value).alias("t"))  # one row
    met = cells.join(rows, row).join(columns, column).join(F.broadcast(total), how="cross")
    near = F.abs(F.col(value) - F.col("r") * F.col("c") / F.col("t")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col(value)))
    return met.agg(F.bool_and(near).alias("exact"), F.count(F.lit(1)).alias("cells"))


def shape_faults(segments: DataFrame, lengths: DataFrame, cells: DataFrame) -> DataFrame:
    """(fault): what breaks the shape contract of a count table: contig lengths against segments, and counts outside either."""
    known = segments.groupBy("contig").agg(F.count(F.lit(1)).alias("n")).join(lengths, "contig", "full")
    wrong = known.where(~F.col("n").eqNullSafe(F.col("length"))).select(F.concat(F.lit("length of contig "), F.col("contig").cast("string")).alias("fault"))
    outside = cells.join(segments, "segment", "left_anti").select(F.concat(F.lit("no segment "), F.col("segment").cast("string")).alias("fault")).distinct()
    negative = cells.where("umi < 0 OR total < 0 OR a < 0 OR a > total").select(F.concat(F.lit("counts of segment "), F.col("segment").cast("string")).alias("fault")).distinct()
    return wrong.unionByName(outside).unionByName(negative)


def valid_bins(cells: DataFrame) -> DataFrame:
    """(spot, n_depth, n_share): bins of each spot with a baseline, and with allele reads."""
    return cells.groupBy("spot").agg(F.count_if(F.col("base") > 0).alias("n_depth"), F.count_if(F.col("total") > 0).alias("n_share"))


def local_outliers(df: DataFrame, ident: str, value: str, k: int = 20, most: float = 1.5) -> DataFrame:
    """(ident, factor, outlier): local outlier factor on one axis, where a row's neighbours are rows beside it in order.

    The k nearest of a row on a line are among the k on either side, so windows
    of 2k + 1 rows hold them.  Ranges of values are tasks; each takes the 2k
    rows beyond its edges along, so that no task needs all rows.
    """
    ranked = numbered(df.select(ident, F.col(value).cast("double").alias("v")), "v", ident, name="at")
    size = 1 << 16
    own = ranked.withColumn("cell", F.floor(F.col("at") / size))
    # a factor needs the neighbours of its neighbours' neighbours
    halo = F.array_distinct(F.array(*(F.floor(F.greatest(F.lit(0), F.col("at") + s) / size) for s in (-3 * k, 0, 3 * k))))
    spread = ranked.withColumn("cell", F.explode(halo))

    def factors(part):
        import numpy as np
        import pandas as pd

        part = part.sort_values("at", kind="stable").reset_index(drop=True)
        v, n = part.v.to_numpy(), len(part)
        # the k nearest are a run of k + 1 rows that holds the row
        first = np.zeros(n, np.int64)
        for i in range(n):
            lo = max(0, i - k)
            best = lo
            for a in range(lo, min(i, n - k - 1) + 1):
                if max(v[i] - v[a], v[a + k] - v[i]) < max(v[i] - v[best], v[min(best + k, n - 1)] - v[i]):
                    best = a
            first[i] = best
        runs = [np.arange(f, min(f + k + 1, n)) for f in first]
        reach = np.array([np.abs(v[r] - v[i]).max() for i, r in enumerate(runs)])
        density = np.array([1 / max(1e-10, np.mean(np.maximum(reach[r[r != i]], np.abs(v[r[r != i]] - v[i])))) if len(r) > 1 else 1.0 for i, r in enumerate(runs)])
        factor = np.array([density[r[r != i]].mean() / density[i] if len(r) > 1 else 1.0 for i, r in enumerate(runs)])
        own = part["at"] // size == part["cell"]
        return pd.DataFrame({ident: part[ident], "factor": factor})[own]

    kind = dict(df.dtypes)[ident]
    found = spread.groupBy("cell").applyInPandas(factors, f"{ident} {kind}, factor double")
    return found.join(own.select(ident), ident).withColumn("outlier", F.col("factor") > most)


def dropped_counts(counts: DataFrame, outliers: DataFrame, gene: str = "gene", n: str = "n") -> DataFrame:
    """``counts`` with 0 for outlying genes, which stay in the table."""
    marked = counts.join(outliers.where("outlier").select(gene).withColumn("__out", F.lit(True)), gene, "left")
    return marked.withColumn(n, F.when(F.col("__out"), F.lit(0)).otherwise(F.col(n))).drop("__out")


def config_warnings(config: dict) -> list[str]:
    """What in a configuration contradicts itself; a negative threshold is refused."""
    out = []
    for section, values in config.items():
        for key, x in (values.items() if isinstance(values, dict) else ()):
            if key.startswith("min_") and isinstance(x, (int, float)) and x < 0:
                raise ValueError(f"{section}.{key} is negative")
            if key.startswith("min_") and (y := values.get("max_" + key[4:])) is not None and x > y:
                out.append(f"{section}.{key} is above {section}.max_{key[4:]}")
    return out


def window_crop(spots: DataFrame, x: str, y: str, box: tuple[float, float, float, float], *tables: DataFrame) -> list[DataFrame]:
    """Spots inside a box (from x, to x, from y, to y), and each further table with only their rows."""
    inside = spots.where(F.col(x).between(box[0], box[1]) & F.col(y).between(box[2], box[3]))
    return [inside, *(t.join(inside.select("spot"), "spot", "left_semi") for t in tables)]


def nearest_row(first: DataFrame, second: DataFrame, ident: str, other: str, width: float) -> DataFrame:
    """(ident, other, distance): the row of ``second`` nearest in (x, y) to each of ``first``, ties to the smaller.

    Both are in cells of ``width``; rings of cells widen for those that are not
    settled, that is, whose nearest is farther than the rings reach.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    a = first.select(ident, "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    b = second.select(other, F.col("x").alias("x2"), F.col("y").alias("y2"), cell("x").alias("cx"), cell("y").alias("cy"))
    extent = a.select("cx", "cy").unionByName(b.select("cx", "cy")).agg(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy")).first()
    widest = int(max(extent[0] or 0, extent[1] or 0)) + 1
    out, left, ring = None, a, 1
    while True:
        side = F.sequence(F.lit(-ring), F.lit(ring))
        probes = left.withColumn("dx", F.explode(side)).withColumn("dy", F.explode(side))
        probes = probes.withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")}).select(ident, "x", "y", "cx", "cy")
        met = probes.join(b, ["cx", "cy"]).withColumn("distance", F.sqrt(F.pow(F.col("x") - F.col("x2"), F.lit(2)) + F.pow(F.col("y") - F.col("y2"), F.lit(2))))
        best = met.groupBy(ident).agg(F.min(F.struct("distance", other)).alias("b")).select(ident, f"b.{other}", "b.distance")
        last = ring > widest
        settled = best if last else best.where(F.col("distance") <= ring * width)
        out = settled if out is None else out.unionByName(settled)
        if last:
            return out
        left = left.join(settled.select(ident), ident, "left_anti")
        if left.isEmpty():
            return out
        ring *= 4


def positions(values: DataFrame, vocabulary: DataFrame, value: str, at: str) -> DataFrame:
    """``values`` with ``at``, where each is in the vocabulary (value, at), and ``known``; the first place counts where it is there twice."""
    first = vocabulary.groupBy(value).agg(F.min(at).alias(at))
    return values.join(first, value, "left").withColumn("known", F.col(at).isNotNull())
