"""Buyer-facing derivations over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bomrec.functions import closed_tables as T
from bomrec.operators import score

STRONG = ("exact_catalog", "table_normalized", "extracted")


def split_distribution(lines: DataFrame, key: str = "row_ref") -> DataFrame:
    """Rows per number of lines."""
    per_row = lines.groupBy(key).agg(F.count(F.lit(1)).alias("elements"))
    return per_row.groupBy("elements").agg(F.count(F.lit(1)).alias("n_rows"))


def reason_counts(lines: DataFrame) -> DataFrame:
    """Reasons over lines that are not resolved, most frequent first."""
    return (
        lines.filter(score.queue() != "resuelta")
        .select(F.explode("reasons").alias("r"))
        .groupBy(F.col("r.code").alias("code"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "code")
    )


def weakest_provenance() -> Column:
    """The weakest provenance of a line; not_applicable is ignored, exact_catalog is the floor."""
    floor = T.PROVENANCE_ORDER.index("exact_catalog")

    def rank(a: str) -> Column:
        case = F.lit(0)
        for n, p in reversed(list(enumerate(T.PROVENANCE_ORDER))):
            case = F.when(F.col(f"{a}_prov") == p, n).otherwise(case)
        return case

    worst = F.greatest(F.lit(floor), *[rank(a) for a in T.ATTRIBUTES])
    return F.get(F.array(*[F.lit(p) for p in T.PROVENANCE_ORDER]), worst)


def resolved_by_weakest(lines: DataFrame) -> DataFrame:
    """Resolved lines per weakest provenance, empty buckets included, strong to weak."""
    counts = (
        lines.filter(score.queue() == "resuelta")
        .groupBy(weakest_provenance().alias("provenance"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = lines.sparkSession.createDataFrame(
        [(p, n) for n, p in enumerate(T.PROVENANCE_ORDER)], "provenance string, pos int"
    )
    return order.join(counts, "provenance", "left").select(
        "pos", "provenance", F.coalesce("n", F.lit(0)).alias("n")
    ).orderBy("pos")


def weakest_attributes(lines: DataFrame) -> DataFrame:
    """Which attributes carry the weakest provenance of resolved lines, strong ones skipped."""
    worst = lines.filter(score.queue() == "resuelta").withColumn("worst", weakest_provenance())
    cells = F.array(
        *[F.struct(F.lit(a).alias("attribute"), F.col(f"{a}_prov").alias("provenance")) for a in T.ATTRIBUTES]
    )
    return (
        worst.filter(~F.col("worst").isin(*STRONG))
        .select("worst", F.inline(cells))
        .filter("provenance = worst")
        .groupBy("attribute", "provenance")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def family() -> Column:
    return F.coalesce("name", F.lit("SIN CLASIFICAR"))


def by_family(lines: DataFrame) -> DataFrame:
    """Size of each family; the members stay as rows sorted by ``family_order``."""
    return lines.groupBy(family().alias("family")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("status") == "RESUELTA").alias("resolved")
    ).orderBy("family")


def family_order(lines: DataFrame) -> DataFrame:
    """Lines in family order, then row, then position; a range-partitioned sort."""
    return lines.withColumn("family", family()).orderBy("family", "row_ref", "position")


def by_row(lines: DataFrame, key: str = "row_ref") -> DataFrame:
    """One record per row with its line ids in order; a row has as many lines as elements."""
    return lines.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("position", "line_id"))).alias("l")
    ).select(key, F.size("l").alias("n_lines"), F.array_join("l.line_id", ",").alias("line_ids"))


def search(lines: DataFrame, text: str | None = None, reason: str | None = None) -> DataFrame:
    """Case-insensitive substring over ids and values, and a reason filter."""
    found = lines
    if text:
        fields = [F.col("line_id"), F.col("row_ref"), *[F.col(a) for a in T.ATTRIBUTES]]
        haystack = F.upper(F.concat_ws("\u001f", *[c.cast("string") for c in fields]))
        found = found.filter(F.contains(haystack, F.upper(F.lit(text))))
    if reason:
        found = found.filter(F.exists("reasons", lambda r: r["code"] == reason))
    return found


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """L4: one page of ordered rows."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def write_ranked(rows: DataFrame, order: list, path: str) -> None:
    """L4: rows in order as ranges, with how many rows stand before each range.

    The sort is by ranges anyway; each range becomes a folder and one row of the index, so that any page is
    read from the ranges that it touches and nothing is counted off to get there.
    """
    spark = rows.sparkSession
    ranged = rows.orderBy(*order).withColumns({"range_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()})
    ranged.write.mode("overwrite").partitionBy("range_").parquet(f"{path}/rows")
    rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")  # a table without rows has no ranges
    shape = spark.read.parquet(f"{path}/shape").withColumns({"range_": F.lit(0), "at_": F.lit(0).cast("long")}).schema
    sizes = spark.read.schema(shape).parquet(f"{path}/rows").groupBy("range_").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).write.mode("overwrite").parquet(f"{path}/ranges")


def ranked_page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """L4: a page of rows that ``write_ranked`` wrote; a negative number counts from the last page back.

    A page beyond the last is the last, as one before the first is the first.
    """
    index = spark.read.parquet(f"{path}/ranges")
    total = index.agg(F.max(F.col("start") + F.col("n"))).first()[0] or 0
    pages = max(1, -(-total // size))
    number = max(0, min(pages + number if number < 0 else number, pages - 1))
    low, high = number * size, (number + 1) * size
    # No more ranges than rows of the page.
    touched = index.where((F.col("start") < high) & (F.col("start") + F.col("n") > low)).collect()
    if not touched:
        return spark.read.parquet(f"{path}/shape")
    rows = spark.read.parquet(f"{path}/rows").where(F.col("range_").isin([r["range_"] for r in touched]))
    starts = F.create_map(*[x for r in touched for x in (F.lit(r["range_"]), F.lit(r["start"]))])
    rank = starts[F.col("range_")] + F.row_number().over(Window.partitionBy("range_").orderBy("at_")) - 1
    found = rows.withColumn("rank_", rank).where((F.col("rank_") >= low) & (F.col("rank_") < high))
    return found.orderBy("rank_").drop("range_", "at_", "rank_")


def quotation_rows(lines: DataFrame) -> DataFrame:
    """The columns of the request-for-quotation export, in family order."""
    text = [F.coalesce(a, F.lit("")).alias(a) for a in T.ATTRIBUTES]
    return lines.orderBy(F.coalesce("name", F.lit("")), "row_ref", "position").select(
        F.coalesce("name", F.lit("")).alias("familia"),
        F.col("line_id").alias("linea_id"), F.col("row_ref").alias("fila_origen"),
        F.col("quantity").alias("cantidad"), F.col("quantity_prov").alias("unidad_cantidad"),
        *text,
        F.col("status").alias("estado"),
        F.array_join(F.transform("reasons", lambda r: r["code"]), " / ").alias("motivos"),
    )
