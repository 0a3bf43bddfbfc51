"""Content identity, revision diff and the export annotations around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomrec.functions import closed_tables as T
from bomrec.functions import text as X


def fingerprint_of(columns: dict[str, str] | None = None) -> Column:
    """folded attributes in fixed order joined by the unit separator; quantity excluded."""
    columns = columns or {a: a for a in T.ATTRIBUTES}
    return X.collapse_key(*[X.fold(columns[a]) for a in T.ATTRIBUTES])


def project_id(file: Column | str) -> Column:
    """file name without its extension."""
    return F.regexp_replace(X.col(file), "\\.[^.]+$", "")


def diff(previous: DataFrame, current: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Delta per fingerprint: unchanged, qty_changed, added, removed or ambiguous.

    Each revision collapses to one record per fingerprint before the join, with partial aggregation
    on the map side, so a fingerprint that covers a third of a revision still shuffles one record per
    task. Added and removed fingerprints keep their line count in ``n_previous``/``n_current``.
    """

    def side(lines: DataFrame, tag: str) -> DataFrame:
        return lines.groupBy(key).agg(
            F.count(F.lit(1)).alias(f"n_{tag}"), F.min(F.struct("line_id", "quantity")).alias(tag)
        )

    j = side(previous, "previous").join(side(current, "current"), key, "full")
    one_to_one = (F.col("n_previous") == 1) & (F.col("n_current") == 1)
    same_quantity = F.col("previous.quantity").eqNullSafe(F.col("current.quantity"))
    kind = (
        F.when(F.col("n_previous").isNull(), "added")
        .when(F.col("n_current").isNull(), "removed")
        .when(one_to_one & same_quantity, "unchanged")
        .when(one_to_one, "qty_changed")
        .otherwise("ambiguous")
    )
    single = F.when(one_to_one, True)
    return j.select(
        key, kind.alias("kind"),
        F.coalesce("n_previous", F.lit(0)).alias("n_previous"),
        F.coalesce("n_current", F.lit(0)).alias("n_current"),
        F.when(single, F.col("previous.line_id")).alias("previous_line"),
        F.when(single, F.col("current.line_id")).alias("current_line"),
        F.when(single, F.col("previous.quantity")).alias("from_quantity"),
        F.when(single, F.col("current.quantity")).alias("to_quantity"),
    )


def diff_lines(delta: DataFrame, previous: DataFrame, current: DataFrame, key: str = "fingerprint") -> DataFrame:
    """The member lines of added, removed and ambiguous deltas, one per record."""
    kinds = delta.filter(F.col("kind").isin("added", "removed", "ambiguous")).select(key, "kind")

    def members(lines: DataFrame, side: str) -> DataFrame:
        return lines.join(kinds, key).select(key, "kind", F.lit(side).alias("side"), "line_id", "quantity")

    return members(previous, "previous").unionByName(members(current, "current"))


def summary(delta: DataFrame) -> DataFrame:
    """Deltas per kind; additions and removals count lines, the rest count fingerprints."""
    size = F.when(F.col("kind") == "added", F.col("n_current")).when(
        F.col("kind") == "removed", F.col("n_previous")
    ).otherwise(F.lit(1))
    return delta.groupBy("kind").agg(F.sum(size).alias("n"))


def with_exported(delta: DataFrame, previous: DataFrame, exported: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Flag paired deltas whose previous line was resolved and already sent for quotation."""
    resolved = previous.filter("status = 'RESUELTA'").select(F.col("line_id").alias("previous_line")).distinct()
    sent = exported.select(key).distinct()
    marked = resolved.select(F.col("previous_line").alias("paired_line"), F.lit(True).alias("was_resolved"))
    paired = F.coalesce("previous_line", X.unmatched_key(key))
    return (
        delta.withColumn("paired_line", paired).join(marked, "paired_line", "left").drop("paired_line")
        .join(sent.withColumn("sent", F.lit(True)), key, "left")
        .withColumn(
            "rfq_exported",
            F.col("kind").isin("unchanged", "qty_changed")
            & F.coalesce("was_resolved", F.lit(False))
            & F.coalesce("sent", F.lit(False)),
        )
        .drop("was_resolved", "sent")
    )


def exportable(lines: DataFrame, register: DataFrame, keys: tuple[str, ...] = ("project", "revision", "fingerprint")) -> DataFrame:
    """Resolved lines not yet in the export register; insert-if-absent without an update."""
    wanted = lines.filter("status = 'RESUELTA'").select(*keys).distinct()
    return wanted.join(register.select(*keys), list(keys), "left_anti")
