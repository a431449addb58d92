"""Half-open intervals on contigs: point, overlap and exclusion joins, merging, cutting and interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(start: Column, end: Column, width: int) -> Column:
    """The grid cells of ``width`` that a half-open interval touches."""
    div = lambda x: F.floor(x / width).cast("long")
    return F.sequence(div(start), F.greatest(div(start), div(end - 1)))


def overlap_join(points: DataFrame, ranges: DataFrame, contig: str, first: str, last: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs whose half-open intervals overlap, by equality of contig and grid cell.

    A pair that shares several cells is kept in the first they share, so there
    is nothing to deduplicate.  ``width`` should be near the ranges' length.
    """
    a = points.withColumn("__cell", F.explode(cells(F.col(first), F.col(last), width)))
    b = ranges.withColumn("__cell", F.explode(cells(F.col(start), F.col(end), width)))
    met = a.join(b, [contig, "__cell"])
    both = (F.col(first) < F.col(end)) & (F.col(start) < F.col(last))
    here = F.col("__cell") == F.floor(F.greatest(F.col(first), F.col(start)) / width).cast("long")
    return met.where(both & here).drop("__cell")


def length_class(start: Column, end: Column) -> Column:
    """The least power of four that is at least an interval's length, as its exponent."""
    return F.ceil(F.log2(F.greatest(F.lit(1), end - start).cast("double")) / 2 - 1e-9).cast("int")


def covering(points: DataFrame, ranges: DataFrame, contig: str, at: str, start: str, end: str) -> DataFrame:
    """Pairs of points with the ranges that hold them (start <= at < end).

    Each range lies in at most two cells of its own length class, and a point
    looks into its cell of every class that there is, so neither long nor short
    ranges multiply rows.
    """
    width = lambda c: F.pow(F.lit(4.0), c)
    cell = lambda x, c: F.floor(x / width(c)).cast("long")
    classed = ranges.where(F.col(end) > F.col(start)).withColumn("__class", length_class(F.col(start), F.col(end)))
    # a number for each power of four, some thirty at most
    classes = sorted(r[0] for r in classed.select("__class").distinct().collect())
    if not classes:
        classes = [0]
    a = points.withColumn("__class", F.explode(F.array(*map(F.lit, classes)))).withColumn("__cell", cell(F.col(at), F.col("__class")))
    own = F.sequence(cell(F.col(start), F.col("__class")), cell(F.col(end) - 1, F.col("__class")))
    b = classed.withColumn("__cell", F.explode(own))
    return a.join(b, [contig, "__class", "__cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__class", "__cell")


def places(points: DataFrame, contig: str, at: str) -> DataFrame:
    """The distinct places of points: what holds for a place holds for all points there."""
    return points.select(contig, at).distinct()


def nearest_start(points: DataFrame, ranges: DataFrame, key: str, contig: str, at: str, start: str, end: str, ident: str) -> DataFrame:
    """(key, ident): for each point the covering range that starts last, ties to the larger id; points in none are left out."""
    found = covering(places(points, contig, at), ranges, contig, at, start, end).groupBy(contig, at).agg(F.max_by(ident, F.struct(start, ident)).alias(ident))
    return points.join(found, [contig, at]).select(key, ident)


def outside(points: DataFrame, ranges: DataFrame, contig: str, at: str, start: str, end: str) -> DataFrame:
    """The points that no range holds."""
    inside = covering(places(points, contig, at), ranges.select(contig, start, end).distinct(), contig, at, start, end).select(contig, at).distinct()
    return points.join(inside, [contig, at], "left_anti").select(*points.columns)


def most_overlap(items: DataFrame, ranges: DataFrame, key: str, contig: str, first: str, last: str, start: str, end: str, ident: str, width: int) -> DataFrame:
    """(key, ident, overlap): the range that overlaps each item most, ties to the smaller id; items that overlap none are left out.

    Items keep their rows, whether or not their keys repeat: places are looked up once each.
    """
    place = [contig, first, last]
    pairs = overlap_join(items.select(*place).distinct(), ranges, contig, first, last, start, end, width)
    shared = (F.least(F.col(last), F.col(end)) - F.greatest(F.col(first), F.col(start))).alias("overlap")
    best = pairs.select(*place, ident, shared).groupBy(*place).agg(F.max_by(ident, F.struct(F.col("overlap"), -F.col(ident))).alias(ident), F.max("overlap").alias("overlap"))
    return items.join(best, place).select(key, ident, "overlap")


def merged(ranges: DataFrame, contig: str, start: str, end: str) -> DataFrame:
    """(contig, block, start, end, n): overlapping intervals joined; ones that only touch stay apart."""
    order = Window.partitionBy(contig).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.withColumn("__new", F.when(before.isNull() | (F.col(start) >= before), 1).otherwise(0))
    blocks = opened.withColumn("block", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return blocks.groupBy(contig, "block").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"))


def elementary(ranges: DataFrame, contig: str, start: str, end: str) -> DataFrame:
    """(contig, start, end): the pieces between neighbouring edges of a contig's intervals."""
    edges = ranges.select(contig, F.explode(F.array(start, end)).alias("edge")).distinct()
    after = F.lead("edge").over(Window.partitionBy(contig).orderBy("edge"))
    return edges.select(contig, F.col("edge").alias(start), after.alias(end)).where(F.col(end).isNotNull())


def last_event(points: DataFrame, events: DataFrame, key: str, contig: str, at: str, start: str, end: str, order: str, state: str, default) -> DataFrame:
    """(key, state): the state of the last covering event, or ``default`` where none covers."""
    found = covering(places(points, contig, at), events, contig, at, start, end).groupBy(contig, at).agg(F.max_by(state, order).alias(state))
    return points.select(key, contig, at).join(found, [contig, at], "left").select(key, F.coalesce(F.col(state), F.lit(default)).alias(state))


def interpolate(points: DataFrame, markers: DataFrame, contig: str, at: str, pos: str, value: str) -> DataFrame:
    """``points`` with ``value``: linear between the markers around, from (0, 0) before the first, the last one's after it.

    Contigs without markers have NULL.  Each marker, and the origin of each
    contig, brings its successor along, so one ordered pass over both tables
    looks back only.
    """
    here = markers.select(F.col(contig), F.col(pos).cast("double").alias("__pos"), F.struct(F.col(pos).cast("double").alias("p"), F.col(value).cast("double").alias("v")).alias("__m"))
    origin = markers.select(contig).distinct().select(contig, F.lit(float("-inf")).alias("__pos"), F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("v")).alias("__m"))
    after = F.lead("__m").over(Window.partitionBy(contig).orderBy("__pos"))
    known = here.unionByName(origin).withColumn("__m", F.struct("__m.*", after.alias("next")))
    kind = dict(known.dtypes)["__m"]
    a = points.withColumns({"__pos": F.col(at).cast("double"), "__m": F.lit(None).cast(kind)})
    both = a.unionByName(known, allowMissingColumns=True).withColumn("__point", F.col("__m").isNull())
    order = Window.partitionBy(contig).orderBy("__pos", F.col("__point"))
    back = F.last("__m", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__back", back).where("__point")
    p0, v0 = F.col("__back.p"), F.col("__back.v")
    line = v0 + (F.col("__pos") - p0) * F.try_divide(F.col("__back.next.v") - v0, F.col("__back.next.p") - p0)
    return found.withColumn(value, F.coalesce(line, v0)).drop("__pos", "__m", "__point", "__back")


def runs(df: DataFrame, group: str, order: list[str], state: str) -> DataFrame:
    """(group, run, state, first, last, n): run-length encoding of a state in order; positions count from 0."""
    along = Window.partitionBy(group).orderBy(*order)
    changed = F.when(F.col(state).eqNullSafe(F.lag(state).over(along)) & (F.row_number().over(along) > 1), 0).otherwise(1)
    marked = df.select(group, state, (F.row_number().over(along) - 1).cast("long").alias("at"), changed.alias("__new"), *order)
    numbered = marked.withColumn("run", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(group, "run", state).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
