"""Confidence, routing, queues and reviewer verdicts over lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomrec.functions import closed_tables as T
from bomrec.functions import text as X
from bomrec.operators.validate import line_status, reason

CRITIC_BAND = 0.9


def provenance_score(provenance: Column) -> Column:
    return X.lookup(T.PROVENANCE_SCORE, provenance)


def confidence() -> Column:
    """The weakest score among the values produced; absences do not count."""
    return F.coalesce(F.least(*[provenance_score(F.col(f"{a}_prov")) for a in T.ATTRIBUTES]), F.lit(0.0))


def route(status: Column, score: Column, min_provenance: str = "inferred", band: float = CRITIC_BAND) -> Column:
    """Review, critic or resolve."""
    floor = T.PROVENANCE_SCORE.get(min_provenance, T.PROVENANCE_SCORE["inferred"])
    return (
        F.when((status == "REVISION_MANUAL") | (score < floor), "review")
        .when(score < band, "critic")
        .otherwise("resolve")
    )


def scored(lines: DataFrame, min_provenance: str = "inferred", band: float = CRITIC_BAND) -> DataFrame:
    """Confidence and routing; a resolved line routed to review says so in its reasons."""
    out = lines.withColumn("confidence", confidence()).withColumn(
        "routing", route(F.col("status"), F.col("confidence"), min_provenance, band)
    )
    low = (F.col("status") == "RESUELTA") & (F.col("routing") == "review")
    return out.withColumn(
        "reasons", F.when(low, F.array_append("reasons", reason("LOW_CONFIDENCE"))).otherwise(F.col("reasons"))
    ).withColumn("status", line_status(F.col("reasons")))


def queue() -> Column:
    """Resuelta, fuera-familia or revision."""
    return (
        F.when(F.col("status") == "RESUELTA", "resuelta")
        .when(F.exists("reasons", lambda r: r["kind"] == "OUT_OF_SCOPE"), "fuera-familia")
        .otherwise("revision")
    )


def effective_queue(lines: DataFrame, validated: DataFrame, reopened: DataFrame, key: str = "line_id") -> DataFrame:
    """P10: the human overlay. Out-of-family stays; a reopened line beats a validated one."""
    yes = F.lit(True)
    return (
        lines.join(validated.select(key).distinct().withColumn("is_validated", yes), key, "left")
        .join(reopened.select(key).distinct().withColumn("is_reopened", yes), key, "left")
        .withColumn("base_queue", queue())
        .withColumn(
            "queue",
            F.when(F.col("base_queue") == "fuera-familia", "fuera-familia")
            .when(F.col("is_reopened"), "revision")
            .when(F.col("is_validated"), "resuelta")
            .otherwise(F.col("base_queue")),
        )
        .drop("is_validated", "is_reopened")
    )


def in_scope(lines: DataFrame) -> DataFrame:
    """Everything but out-of-family lines."""
    return lines.filter(queue() != "fuera-familia")


def is_marked(provenance: Column | str) -> Column:
    """Provenances that need a visible mark."""
    return X.col(provenance).isin(*T.MARKED_PROVENANCE)


def is_weak(provenance: Column | str) -> Column:
    """Provenances a person should see at a glance."""
    return X.col(provenance).isin(*T.WEAK_PROVENANCE)


def review_eligible(routing: str, n_elements: Column, n_unverifiable: Column, blocked: Column) -> Column:
    """Which rows the reviewer looks at (off, all or multi_element)."""
    if routing == "off":
        return F.lit(False)
    if routing == "all":
        return ~blocked & (n_elements > 0)
    return ~blocked & ((n_elements > 1) | (n_unverifiable > 0))


def may_dispute(attribute: Column) -> Column:
    """A verdict may dispute the quantity, or a value the reader itself placed."""
    placed = reduce(
        lambda acc, a: acc.when(attribute == a, F.col(f"{a}_prov").isin("extracted", "extracted_uncatalogued")),
        T.ATTRIBUTES,
        F.when(attribute == "quantity", F.lit(True)),
    )
    return F.coalesce(placed, F.lit(False))


def apply_verdicts(lines: DataFrame, verdicts: DataFrame, key: str = "line_id") -> DataFrame:
    """A disagreeing verdict downgrades a resolved line and never promotes one.

    ``verdicts`` (line_id, agrees, attribute); the last verdict of a line wins by ``seq``.
    """
    last = verdicts.groupBy(key).agg(F.max_by(F.struct("agrees", "attribute"), "seq").alias("verdict"))
    joined = lines.join(last, key, "left")
    attribute = F.col("verdict.attribute")
    down = F.coalesce(
        ~F.col("verdict.agrees") & (F.col("status") == "RESUELTA") & may_dispute(attribute), F.lit(False)
    )
    disagreement = reason("CRITIC_DISAGREES").withField(
        "attribute", F.when(attribute.isin(*T.ATTRIBUTES), attribute)
    )
    return (
        joined.withColumn("downgraded", down)
        .withColumn(
            "reasons",
            F.when(F.col("downgraded"), F.array_append("reasons", disagreement)).otherwise(F.col("reasons")),
        )
        .withColumn("status", line_status(F.col("reasons")))
        .drop("verdict")
    )


def reviewer_summary(rows: DataFrame) -> DataFrame:
    """Eligible, run, downgraded, failed and missing; a failed review is not a pass.

    ``rows`` (eligible, ran, failure, n_downgraded, n_missing), one per source row.
    """
    return rows.agg(
        F.count_if("eligible").alias("eligible"),
        F.count_if(F.col("eligible") & F.col("ran")).alias("ran"),
        F.coalesce(F.sum("n_downgraded"), F.lit(0)).alias("downgraded"),
        F.count_if(F.col("eligible") & F.col("failure").isNotNull()).alias("failures"),
        F.count_if(F.col("n_missing") > 0).alias("rows_with_missing"),
        F.coalesce(F.sum("n_missing"), F.lit(0)).alias("missing_elements"),
    )
