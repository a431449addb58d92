"""Column expressions on text that several operators share; all run inside the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The whitespace that separates words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay, unlike ``lower``."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The runs of non-blank characters, in order; NULL and blank texts give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def read(spark, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """A table of the data folder, with the named columns only if any are named."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names an operator is about to use for its own."""
    return df.drop(*names)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def constant_table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table held in the plan as a literal, parsed by the JVM."""
    import json

    text = json.dumps(rows)
    pieces = F.from_json(F.lit(text), F.lit(f"array<struct<{schema_fields(schema)}>>"))
    return spark.range(1).select(F.inline(pieces))


def schema_fields(schema: str) -> str:
    """``a long, b string`` as the fields of a struct type."""
    return ", ".join(f"{name}: {kind}" for name, kind in (field.split() for field in schema.split(",")))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body (or a loop in it) refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums_before(lengths: Column, chunk: int = 256) -> Column:
    """For each element of an array of longs the sum of those before it; by chunks, so that time stays near linear."""
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<bigint>")
    grow = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    fold = lambda part, first: F.aggregate(part, F.struct(first.alias("at"), none.alias("out")), grow)["out"]
    piece = lambda xs, c: F.slice(xs, c * chunk + 1, chunk)

    def whole(xs: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / chunk).cast("int"))
        sums = F.transform(chunks, lambda c: F.aggregate(piece(xs, c), zero, lambda a, n: a + n))
        return let(fold(sums, zero), lambda starts: F.flatten(F.transform(chunks, lambda c: fold(piece(xs, c), F.get(starts, c)))))

    return let(lengths, lambda xs: F.when(F.size(xs) == 0, none).otherwise(whole(xs)))


def find_all(text: Column, regex: str) -> Column:
    """All leftmost non-overlapping matches as structs (start, end, hit); positions in code points, end exclusive.

    The pieces between matches and the matches themselves, in turn, spell the
    text, so running lengths give the positions.
    """
    none = F.array().cast("array<struct<start: bigint, end: bigint, hit: string>>")
    long = lambda s: F.length(s).cast("long")

    def placed(hits: Column) -> Column:
        return let(
            F.arrays_zip(hits.alias("hit"), F.slice(F.split(text, regex, -1), F.lit(1), F.size(hits)).alias("gap")),
            lambda z: F.zip_with(
                z,
                sums_before(F.transform(z, lambda x: long(x["hit"]) + long(x["gap"]))),
                lambda x, at: F.struct((at + long(x["gap"])).alias("start"), (at + long(x["gap"]) + long(x["hit"])).alias("end"), x["hit"].alias("hit")),
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda hits: F.when(F.size(hits) == 0, none).otherwise(placed(hits)))
