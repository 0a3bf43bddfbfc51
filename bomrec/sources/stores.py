"""Append-only stores for runs, revision snapshots, export registers and file history."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomrec.operators import panel, revisions


def save_run(header: DataFrame, metrics: DataFrame, lines: DataFrame, path: str, run_id: str) -> None:
    """Append a run so that readers see all of it or nothing.

    Each attempt writes its parts under an id of its own; the commit marker goes last and names the
    attempt. Saving a run again leaves the parts that the old marker names untouched until the new one
    stands, so no reader meets half a run.
    """
    attempt = uuid.uuid4().hex
    for name, part in (("metrics", metrics), ("lines", lines), ("header", header)):
        part.drop("run_id").write.parquet(f"{path}/{name}/run_id={run_id}/attempt={attempt}")
    header.select(F.lit(run_id).alias("committed_run"), F.lit(attempt).alias("attempt")).limit(1).write.mode("overwrite").parquet(
        f"{path}/commits/run={run_id}"
    )


def load_runs(spark: SparkSession, path: str, part: str) -> DataFrame:
    """A part of every committed run."""
    commits = spark.read.parquet(f"{path}/commits").select(F.col("committed_run").alias("run_id"), "attempt")
    rows = spark.read.option("basePath", f"{path}/{part}").parquet(f"{path}/{part}/*")
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("run_id", "attempt")})
    return rows.join(commits, ["run_id", "attempt"], "left_semi").drop("attempt")


def save_snapshot(lines: DataFrame, path: str) -> None:
    """Upsert the (project, revision) partitions present in the input, leaving the others."""
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "project", "revision"
    ).parquet(path)


def load_snapshot(spark: SparkSession, path: str, project: str, revision: str) -> DataFrame:
    """One revision; the filter prunes partitions."""
    return spark.read.parquet(path).filter((F.col("project") == project) & (F.col("revision") == revision))


def revisions_by_time(snapshots: DataFrame) -> DataFrame:
    """Revisions of every project, newest first."""
    return (
        snapshots.groupBy("project", "revision")
        .agg(F.max("saved_at").alias("saved_at"), F.count(F.lit(1)).alias("n_lines"))
        .orderBy("project", F.desc("saved_at"), "revision")
    )


def register_exports(lines: DataFrame, spark: SparkSession, path: str, exists: bool) -> DataFrame:
    """Append the resolved fingerprints that are not registered yet and return them."""
    keys = ("project", "revision", "fingerprint")
    register = spark.read.parquet(path) if exists else lines.select(*keys).limit(0)
    new = revisions.exportable(lines, register, keys)
    new.write.mode("append").parquet(path)
    return new


def write_quotation(lines: DataFrame, path: str) -> None:
    """Semicolon CSV in family order; quotes are doubled."""
    panel.quotation_rows(lines).write.mode("overwrite").csv(path, sep=";", header=True, quote='"', escape='"')


def file_history(lines: DataFrame, usage: DataFrame) -> DataFrame:
    """Summary per processed file, newest first; the cost of an unpriced file is null.

    ``lines`` (file, status) and ``usage`` (file, processed_at, priced, cost_eur).
    """
    counts = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("status") == "RESUELTA").alias("resolved")
    )
    return (
        counts.join(usage, "file", "left")
        .select("file", "n_lines", "resolved", "processed_at", F.when(F.col("priced"), F.col("cost_eur")).alias("cost_eur"))
        .orderBy(F.desc("processed_at"), "file")
    )
