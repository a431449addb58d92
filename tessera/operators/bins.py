"""From genes and sites to blocks and bins: the table of both, its blocks, their counts and the bins that meet floors.

Tables are long: ``genes`` (chr, start, end, gene), ``sites`` (chr, pos, snp),
``counts`` (spot, gene, n) and ``alleles`` (spot, snp, a, b); a pair that is
absent counts 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import intervals, ordered
from tessera.operators.chunks import Fold, labelled
from tessera.operators.ranking import numbered


def gene_site_table(genes: DataFrame, sites: DataFrame, reach: int | None = None) -> DataFrame:
    """(chr, start, end, gene, snp): every gene, and every site with the gene that covers it and starts last.

    Ties go to the larger gene; sites in no gene are left out.  With ``reach``,
    the gene must be among that many rows before the site in the order of
    positions, genes before sites where they start alike.
    """
    if reach is None:
        found = intervals.nearest_start(sites, genes, "snp", "chr", "pos", "start", "end", "gene")
        placed = sites.join(found, "snp")
    else:
        both = genes.select("chr", F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("gene").alias("id")).unionByName(sites.select("chr", F.col("pos").alias("at"), F.lit(1).alias("kind"), F.col("snp").alias("id")))
        ranked = both.withColumn("row", F.row_number().over(Window.partitionBy("chr").orderBy("at", "kind", "id")))
        row = lambda kind, name: ranked.where(F.col("kind") == kind).select(F.col("id").alias(name), F.col("row").alias(f"row_{name}"))
        pairs = intervals.covering(sites, genes, "chr", "pos", "start", "end").join(row(0, "gene"), "gene").join(row(1, "snp"), "snp")
        best = pairs.where(F.col("row_snp") - F.col("row_gene") <= reach).groupBy("snp").agg(F.max_by("gene", F.struct("start", "gene")).alias("gene"))
        placed = sites.join(best, "snp")
    none = F.lit(None).cast(dict(sites.dtypes)["snp"])
    rows = placed.select("chr", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "gene", "snp")
    return genes.select("chr", "start", "end", "gene", none.alias("snp")).unionByName(rows)


def initial_blocks(table: DataFrame, site_umi: DataFrame, least: float) -> DataFrame:
    """``table`` with ``block``: genes that overlap are one interval, and intervals join until their sites hold ``least`` reads.

    ``site_umi`` is (snp, umi).  Blocks do not cross contigs; a last block short
    of the floor joins the one before.  Numbers run over the whole genome.
    """
    whole = intervals.merged(table.where("snp IS NULL").select("chr", "start", "end"), "chr", "start", "end").select("chr", F.col("block").alias("interval"), F.col("start").alias("opens"))
    # an interval reaches up to where the next one opens
    until = F.lead("opens", 1).over(Window.partitionBy("chr").orderBy("opens"))
    spans = whole.withColumn("until", F.coalesce(until, F.lit(1 << 40)))
    held = intervals.covering(intervals.places(table, "chr", "start"), spans, "chr", "start", "opens", "until").select("chr", "start", "interval")
    rows = table.join(held, ["chr", "start"])
    sums = rows.join(site_umi, "snp", "left").groupBy("chr", "interval").agg(F.sum(F.coalesce("umi", F.lit(0))).alias("umi"))
    packed = ordered.pack(sums, "chr", ["interval"], "umi", least, "own")
    named = numbered(packed.select("chr", "own").distinct(), "chr", "own", name="block")
    return rows.join(packed.select("chr", "interval", "own"), ["chr", "interval"]).join(named, ["chr", "own"]).drop("interval", "own")


def known_blocks(table: DataFrame, ranges: DataFrame, ident: str) -> DataFrame:
    """``table`` with ``block``: the given range (chr, from, to, ident) that overlaps a row most, ties to the smaller; -1 in none."""
    rows = table.withColumn("row", F.xxhash64("chr", "start", "gene", "snp"))
    found = intervals.most_overlap(rows, ranges.withColumnsRenamed({"from": "__from", "to": "__to"}), "row", "chr", "start", "end", "__from", "__to", ident, 100_000)
    return rows.join(found.select("row", F.col(ident).alias("block")), "row", "left").withColumn("block", F.coalesce("block", F.lit(-1))).drop("row")


def block_counts(table: DataFrame, counts: DataFrame, alleles: DataFrame, key: str = "block", genes_of_sites: bool = False, phase: DataFrame | None = None) -> DataFrame:
    """(key, spot, umi, a, total): reads of a block's genes, each gene once, and of its sites' alleles.

    With ``genes_of_sites`` the genes of site rows count as the block's too, so
    that a gene in two blocks counts in both.  ``phase`` (old key, phase, new
    key) flips the alleles of blocks whose phase is 0 and sums by the new key.
    """
    rows = table if phase is None else table.join(phase, key).withColumn("__of", F.col(key)).drop(key).withColumnRenamed("bin", key)
    own = rows if genes_of_sites else rows.where("snp IS NULL")
    genes = own.select(key, "gene").where("gene IS NOT NULL").distinct().join(counts, "gene").select(key, "spot", F.col("n").alias("umi"), F.lit(0).alias("a"), F.lit(0).alias("total"))
    flipped = F.col("a") if phase is None else F.when(F.col("phase") == 1, F.col("a")).otherwise(F.col("b"))
    sites = rows.where("snp IS NOT NULL").join(alleles, "snp").select(key, "spot", F.lit(0).alias("umi"), flipped.alias("a"), (F.col("a") + F.col("b")).alias("total"))
    return genes.unionByName(sites).groupBy(key, "spot").agg(*(F.sum(c).cast("long").alias(c) for c in ("umi", "a", "total")))


def block_summary(table: DataFrame, counts: DataFrame, alleles: DataFrame, normal: DataFrame, key: str = "block") -> DataFrame:
    """One row a block: its contig, ends, genes and sites, and its reads of genes, of sites and of genes in ``normal`` spots."""
    shape = table.groupBy(key).agg(
        F.min("chr").alias("chr"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.count_distinct("gene").alias("n_genes"),
        F.count_distinct("snp").alias("n_snps"),
    )
    marked = block_counts(table, counts, alleles, key).join(normal.select("spot").distinct().withColumn("normal", F.lit(True)), "spot", "left")
    sums = marked.groupBy(key).agg(F.sum("umi").alias("umi"), F.sum("total").alias("snp_umi"), F.sum(F.when(F.col("normal"), F.col("umi")).otherwise(0)).alias("normal_umi"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("umi", "snp_umi", "normal_umi")}
    return shape.join(sums, key, "left").withColumns(zero)


def binned(table: DataFrame, key: str = "bin") -> DataFrame:
    """One row a bin: contig, first start, last end, sorted genes and sites, and how many sites; rows without a bin are left out."""
    return table.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min("chr").alias("chr"),
        F.min("start").alias("start"),
        F.max_by("end", F.struct("start", "end")).alias("end"),
        F.sort_array(F.collect_set("gene")).alias("genes"),
        F.sort_array(F.collect_set("snp")).alias("snps"),
        F.count_distinct("snp").alias("n_snps"),
    )


class Bins(Fold):
    """Left to right, a bin closes once all its sums reach their floors.

    Where it is then also too long, it closes without its last block, which may
    leave it below a floor.  A last bin that misses a floor joins the one before.
    """

    def __init__(self, floors: tuple[float, ...], longest: float):
        self.floors, self.longest, self.at = floors, longest, 0
        self.rows: list[tuple[float, ...]] = []  # of the open bin: length, then what the floors are on
        self.over = False

    def _sums(self) -> list[float]:
        return [sum(x) for x in zip(*self.rows)]

    def _closed(self, n: int) -> list[int]:
        self.rows, self.at = self.rows[n:], self.at + 1
        return [self.at - 1] * n

    def _met(self, sums: list[float]) -> bool:
        return all(s >= f for s, f in zip(sums[1:], self.floors))

    def feed(self, *values: np.ndarray) -> list[int]:
        out: list[int] = []
        for row in zip(*(v.tolist() for v in values)):
            # what follows the last row shows that it was not the group's last
            while self.rows and self._met(sums := self._sums()):
                out += self._closed(max(1, len(self.rows) - 1) if sums[0] >= self.longest else len(self.rows))
            self.rows.append(row)
        return out

    def end(self) -> list[int]:
        n = len(self.rows)
        if not n:
            return []
        short = self.at > 0 and not self._met(self._sums())
        return [self.at - 1 if short else self.at] * n


def bin_ranges(blocks: DataFrame, floors: dict[str, float], longest: float, cuts: DataFrame | None = None, key: str = "block") -> DataFrame:
    """(block, bin): blocks joined to bins between breakpoints, numbered over the genome.

    ``blocks`` has (block, start, end) and a column for each floor.  A block
    longer than ``longest`` stands alone, and ``cuts`` (block) begin anew.
    """
    long = (F.col("end") - F.col("start")) > longest
    along = Window.orderBy(key)
    marked = blocks.withColumn("__length", F.col("end") - F.col("start")).withColumn("__long", long)
    if cuts is not None:
        marked = marked.join(cuts.select(key).distinct().withColumn("__cut", F.lit(True)), key, "left")
    else:
        marked = marked.withColumn("__cut", F.lit(None).cast("boolean"))
    # blocks are summaries of the genome, not of its rows: one ordered pass over them
    opens = F.col("__long") | F.coalesce("__cut", F.lit(False)) | F.coalesce(F.lag("__long").over(along), F.lit(False))
    marked = marked.withColumn("__opens", opens.cast("int")).withColumn("__stretch", F.sum("__opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    names = list(floors)
    fold = lambda: Bins(tuple(floors.values()), longest)
    own = labelled(marked, "__stretch", [key], ["__length", *names], fold, "__own")
    named = numbered(own.select("__stretch", "__own").distinct(), "__stretch", "__own", name="bin")
    return own.join(named, ["__stretch", "__own"]).select(key, "bin")


def floor_bins(blocks: DataFrame, least_length: float, least_weight: float, weight: str, contig: str = "chr", key: str = "bin") -> DataFrame:
    """(bin, merged): bins joined within a contig until length and weight reach their floors, numbered over the genome."""
    sized = blocks.withColumn("__length", F.col("end") - F.col("start"))
    own = ordered.floored(sized, contig, [key], "__length", weight, least_length, least_weight, "__own")
    named = numbered(own.select(contig, "__own").distinct(), contig, "__own", name="merged")
    return own.join(named, [contig, "__own"]).select(key, "merged")


def short_segments(segments: DataFrame, contig: str, length: str, weight: str, least_length: float, least_weight: float) -> DataFrame:
    """Segments under either floor that are not their contig's only one."""
    n = F.count(F.lit(1)).over(Window.partitionBy(contig))
    return segments.withColumn("__n", n).where(((F.col(length) < least_length) | (F.col(weight) < least_weight)) & (F.col("__n") > 1)).drop("__n")


def phased_rows(table: DataFrame, phases: DataFrame, key: str = "block") -> DataFrame:
    """``table`` with ``phase``: site rows have their block's, gene rows NULL."""
    return table.join(phases.select(key, F.col("phase").alias("__phase")), key, "left").withColumn("phase", F.when(F.col("snp").isNotNull(), F.col("__phase"))).drop("__phase")


def site_switches(segments: DataFrame, contig: str, order: str, from_cm: str, to_cm: str, nu: float, shift: float, least: float, ends: bool = False, name: str = "log_switch") -> DataFrame:
    """Adds the log-probability that the phase flips between a segment's end and the next one's start, on Haldane's law.

    At most log 1/2 after the shift; a contig's last segment has the floor's,
    or log 1/2 with ``ends``.
    """
    gap = F.lead(from_cm).over(Window.partitionBy(contig).orderBy(order)) - F.col(to_cm)
    p = F.greatest((1 - F.exp(-2 * nu * gap)) / 2, F.lit(least))
    last = F.lit(0.5) if ends else F.lit(least)
    law: Column = ordered.log_switch(F.when(gap.isNull(), last).otherwise(p), shift)
    return segments.withColumn(name, F.when(gap.isNull(), F.ln(F.lit(0.5))).otherwise(law) if ends else law)
