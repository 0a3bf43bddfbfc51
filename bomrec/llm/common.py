"""Shared pieces: durable intermediate tables, ranks without hot tasks, fresh column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bomrec.session import shared_folder as shared_dir


def kept(df: DataFrame) -> DataFrame:
    """Cut lineage: the rows are written to the shared folder once, and read from there after."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """As ``kept``, as compressed Parquet, for rows that hold texts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bomrec-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def document_table(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def seeded_order(key: Column, seed: int) -> Column:
    """A shuffle key in 0 .. 2^60-1 that depends on the id and the seed alone. A null id counts as ''."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def before_bucket(counts: DataFrame, group: list[str], bucket: str, amount: str, out: str, total: str) -> DataFrame:
    """Per (group, bucket): the amount in lower buckets of the group, and the amount in the whole group.

    ``counts`` has one row for each group and bucket, so the windows see summaries, never the rows.
    """
    within = Window.partitionBy(*group)
    below = within.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *group, bucket, F.coalesce(F.sum(amount).over(below), F.lit(0)).alias(out), F.sum(amount).over(within).alias(total)
    )
