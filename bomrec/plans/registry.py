"""Registry of named queries: a Spark callable and, where SQL can say it, the equivalent check."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomrec.operators import reader
from bomrec.operators.reader import READ_ATTRIBUTES
from bomrec.plans import lens
from bomrec.plans.lines import repeated_rows_to_lines, rows_to_lines, spread, text_totals_to_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(key: str, check: str | None = None):
    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if check is not None:
            CHECKS[key] = check
        return fn

    return register


# The same plans feed many queries; building them once per session keeps registration cheap.


@lru_cache(maxsize=8)
def part_rows(spark: SparkSession, sf: str) -> DataFrame:
    return spread(lens.frame(spark, sf, lens.PART_ROWS))


@lru_cache(maxsize=8)
def part_read(spark: SparkSession, sf: str) -> DataFrame:
    return reader.read_with_tables(part_rows(spark, sf))


@lru_cache(maxsize=8)
def part_lines(spark: SparkSession, sf: str) -> DataFrame:
    return rows_to_lines(part_rows(spark, sf))


@lru_cache(maxsize=8)
def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines at order grain: the texts repeat, so each distinct text is read once."""
    return repeated_rows_to_lines(lens.frame(spark, sf, lens.ORDER_ROWS), keys=("row_ref", "file_no"))


@lru_cache(maxsize=8)
def text_totals(spark: SparkSession, sf: str) -> DataFrame:
    return text_totals_to_lines(lens.frame(spark, sf, lens.ORDER_ROWS))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded answers for the part rows, some of them wrong on purpose.

    They put a set's bare quality number in the measure field, invent a quality, quote an element
    that is not in the row, claim counts the row does not state and call some rows out of family.
    """
    p = lens.frame(spark, sf, lens.PIECES)
    k = F.col("p_partkey")

    def cell(value) -> Column:
        return F.struct(value.cast("string").alias("value"), F.lit(None).cast("string").alias("evidence"))

    blank = F.lit(None).cast("string")
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    second = F.when(F.col("set_kind") == 2, "tuercas").otherwise("NUT")

    def element(evidence, name, guess, role, count, **values):
        return F.struct(
            evidence.alias("evidence"), name.alias("detected_name"), guess.alias("normalized_name"),
            F.lit(role).alias("role"), count.cast("int").alias("multiplicity"),
            *[cell(values.get(a, blank)).alias(a) for a in READ_ATTRIBUTES],
        )

    first = element(
        F.col("noun"), F.when(k % 31 == 0, blank).otherwise(F.col("noun")), blank, "principal", F.lit(1),
        quality=F.when(k % 9 == 0, "ZZ 77").otherwise(text("quality")), measure=text("measure"), standard=text("std"),
        length=text("len"), material=text("mat"),
    )
    other = element(
        F.when(k % 10 == 1, "ECROU").otherwise(second), second, F.lit("TUERCA"), "secondary",
        F.when(k % 3 == 0, 5).otherwise(2),
        measure=F.when(F.col("set_kind") == 2, F.lit("10")).when(F.col("set_kind") == 1, F.lit("8")),
        finish=text("fin"),
    )
    elements = F.when(F.col("set_kind") < 3, F.array(first, other)).otherwise(F.array(first))
    return p.select(
        k.cast("string").alias("row_ref"),
        ((k % 6 == 0) | F.col("noun").isin("Brida")).alias("out_of_family"),
        F.lit("not ours").alias("out_of_family_reason"),
        F.when(k % 97 == 0, F.lit("timeout")).alias("error"),
        F.when((k % 6 == 0) | F.col("noun").isin("Brida", "Válvula"), F.filter(elements, lambda e: F.lit(False)))
        .otherwise(elements)
        .alias("elements"),
    )


@lru_cache(maxsize=8)
def answered_read(spark: SparkSession, sf: str) -> DataFrame:
    return reader.read_with_responses(lens.frame(spark, sf, lens.PART_ROWS), answers(spark, sf))


@lru_cache(maxsize=8)
def answered_lines(spark: SparkSession, sf: str) -> DataFrame:
    return rows_to_lines(lens.frame(spark, sf, lens.PART_ROWS), responses=answers(spark, sf))


def joined(column: str) -> Column:
    return F.array_join(column, "|")


def codes(column: str = "reasons") -> Column:
    return F.array_join(F.transform(column, lambda r: r["code"]), "|")


def values_sql(rows: list[tuple], columns: str) -> str:
    """Inline table for checks; literals come from the closed tables."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({columns}))"
