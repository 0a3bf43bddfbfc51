"""End-to-end plan: rows to scored lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomrec.operators import reader, score, validate
from bomrec.operators.catalog import Vocabulary


def spread(rows: DataFrame) -> DataFrame:
    """Give a CPU-bound plan at least one task per core.

    Only a scan that yields fewer splits than the cluster has cores, such as one small file, is
    redistributed; a large table keeps its splits and is not shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def described(rows: DataFrame) -> DataFrame:
    """A row without a text reads as one with an empty text, so that it yields a line as well."""
    return rows.withColumn("source_text", F.coalesce("source_text", F.lit("")))


def rows_to_lines(
    rows: DataFrame,
    vocabulary: Vocabulary | None = None,
    policies: dict[str, str] | None = None,
    keys: tuple[str, ...] = ("row_ref",),
    trace: bool = True,
    responses: DataFrame | None = None,
) -> DataFrame:
    """Read, normalise, validate and score rows (keys, source_text, quantity).

    With the table-only reader the whole plan is one narrow stage; recorded answers add the single
    equi-join that brings them to their rows.
    """
    rows = described(rows)
    if responses is None:
        read = reader.read_with_tables(rows, vocabulary, trace=trace)
    else:
        read = reader.read_with_responses(rows, responses, vocabulary, key=keys[0])
    return score.scored(validate.lines(read, vocabulary, policies, keys))


def repeated_rows_to_lines(
    rows: DataFrame,
    vocabulary: Vocabulary | None = None,
    policies: dict[str, str] | None = None,
    keys: tuple[str, ...] = ("row_ref",),
) -> DataFrame:
    """``rows_to_lines`` for inputs that repeat texts, such as many revisions of one file.

    Every attribute and reason depends only on the text and on whether a quantity is stated, so each
    distinct pair is read once (map-side distinct) and joined back by an equi-join that adaptive
    execution broadcasts when small and splits when one text dominates.
    """
    rows = described(rows)
    stated = F.col("quantity").isNotNull()
    texts = rows.select("source_text", stated.alias("has_quantity")).distinct()
    # Reading is CPU-bound and its input small, so adaptive coalescing by bytes would starve it.
    texts = texts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    unit = texts.withColumn("quantity", F.when(F.col("has_quantity"), F.lit(1.0)))
    read = rows_to_lines(unit, vocabulary, policies, keys=("source_text", "has_quantity"), trace=True)
    read = read.withColumnRenamed("quantity", "per_unit")
    out = rows.withColumn("has_quantity", stated).join(read, ["source_text", "has_quantity"])
    suffix = F.substring_index("line_id", ".", -1)
    return out.select(
        *keys,
        F.concat(F.col(keys[0]).cast("string"), F.lit("."), suffix).alias("line_id"),
        *[c for c in read.columns if c not in ("source_text", "has_quantity", "line_id", "per_unit")],
        (F.col("quantity") * F.col("per_unit")).alias("quantity"),
    )


def text_totals_to_lines(rows: DataFrame, dims: tuple[str, ...] = ()) -> DataFrame:
    """Lines of distinct texts with how many rows carry them and their total quantity.

    For reports that need no row identity: rows collapse map-side to one record per text (and
    dimension) before anything is read, so neither rows nor lines are ever shuffled or joined.
    """
    rows = described(rows)
    stated = F.col("quantity").isNotNull()
    totals = rows.groupBy("source_text", stated.alias("has_quantity"), *dims).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("quantity").alias("row_quantity")
    )
    totals = totals.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    unit = totals.withColumn("quantity", F.when(F.col("has_quantity"), F.lit(1.0)))
    lines = rows_to_lines(unit, keys=("source_text", "n_rows", "row_quantity", *dims), trace=False)
    return lines.withColumn("quantity", F.col("quantity") * F.col("row_quantity"))
