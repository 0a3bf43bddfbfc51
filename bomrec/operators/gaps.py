"""Values nobody decided about: unplaced evidence, unknown values, uncovered derivations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomrec.functions import text as X
from bomrec.operators import detect as D
from bomrec.operators import normalize as N
from bomrec.operators import validate
from bomrec.operators.catalog import Vocabulary

# A row whose lines all carry one of these is already reported through its own reason.
REPORTED = ("OUT_OF_FAMILY", "EMPTY_DESCRIPTION", "PROCESSING_FAILED")


def _gap(kind: str, attribute: str, value: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(attribute).alias("attribute"), value.alias("value")
    )


def line_gaps(lines: DataFrame, vocabulary: Vocabulary) -> Column:
    """J26/J27/J28 for one line as an array of gaps."""
    quality = N.resolve_quality(F.col("quality_raw"), vocabulary)
    finish = N.resolve_finish(F.col("finish_raw"), vocabulary)
    unknown_quality = (quality["source"] == "ambiguous") | (
        (quality["source"] == "out") & ~D.is_known_grade("quality_raw")
    )
    unknown_finish = F.col("finish").isNull() & finish["kind"].isin("unknown", "ambiguous")
    derivation = N.derive_material(F.col("quality_raw"), quality["group"], vocabulary)
    uncovered = F.col("material").isNull() & (derivation["outcome"] == "uncovered")
    return F.array_compact(
        F.array(
            F.when(unknown_quality, _gap("UNKNOWN_VALUE", "quality", F.col("quality_raw"))),
            F.when(unknown_finish, _gap("UNKNOWN_VALUE", "finish", F.col("finish_raw"))),
            F.when(uncovered, _gap("UNCOVERED_DERIVATION", "material", F.col("quality_raw"))),
        )
    )


DETECTED = ("name_values", "standard_values", "finish_values")


def _detected(v: Vocabulary) -> list[Column]:
    """Distinct values a row's own text states, per scanned attribute."""
    return [
        D.distinct_names(F.col("names"), v).alias("name_values"),
        D.distinct_standards(F.col("standards"), v).alias("standard_values"),
        D.distinct_finishes(F.col("finishes"), v).alias("finish_values"),
    ]


def _row_summary(lines: DataFrame, v: Vocabulary, key: str, kept: tuple[str, ...] = ()) -> DataFrame:
    """What a row's lines carry; a row has as many lines as elements, so the record is small."""

    def carried(attribute: str) -> Column:
        values = F.flatten(F.collect_list(F.array_compact(F.array(F.col(attribute), F.col(f"{attribute}_raw")))))
        return F.transform(values, lambda x: F.upper(x)).alias(f"carried_{attribute}")

    tagged = lines.withColumns(
        {
            "reported": F.exists("reasons", lambda r: r["code"].isin(*REPORTED)),
            "unscoped": F.exists("reasons", lambda r: r["code"] == "FINISH_SCOPE_UNSTATED"),
            "own_gaps": line_gaps(lines, v),
        }
    )
    return tagged.groupBy(key).agg(
        carried("name"), carried("standard"), carried("finish"),
        F.bool_and("reported").alias("skip"),
        F.bool_or("unscoped").alias("unscoped"),
        F.flatten(F.collect_list("own_gaps")).alias("own_gaps"),
        *[F.first(c).alias(c) for c in kept],
    )


def _gaps(found: DataFrame, key: str) -> DataFrame:
    def unplaced(attribute: str) -> Column:
        missing = F.filter(
            f"{attribute}_values", lambda x: ~F.array_contains(F.col(f"carried_{attribute}"), F.upper(x))
        )
        return F.transform(missing, lambda x: _gap("UNPLACED_EVIDENCE", attribute, x))

    finish = F.filter(unplaced("finish"), lambda x: ~F.col("unscoped"))
    return found.filter("not skip").select(
        key, F.inline(F.concat(unplaced("name"), unplaced("standard"), finish, "own_gaps"))
    )


def detect_gaps(
    rows: DataFrame, lines: DataFrame, vocabulary: Vocabulary | None = None,
    key: str = "row_ref", text: str = "source_text",
) -> DataFrame:
    """Every gap (key, kind, attribute, value) of stored lines against their rows.

    The lines' summary meets the row's own detections in a single equi-join on the row key.
    """
    v = vocabulary or Vocabulary.closed()
    hits = D.with_hits(rows.select(key, text), text, v).select(key, *_detected(v))
    return _gaps(hits.join(_row_summary(lines, v, key), key), key)


def gaps_of_read(read: DataFrame, vocabulary: Vocabulary | None = None, key: str = "row_ref") -> DataFrame:
    """U2/J14 for rows just read: the detections travel with the lines, so nothing is scanned twice
    and the only shuffle is the one that brings a row's lines together."""
    v = vocabulary or Vocabulary.closed()
    lines = validate.lines(read.select("*", *_detected(v)), v, keys=(key, *DETECTED))
    return _gaps(_row_summary(lines, v, key, DETECTED), key)


def backlog(gaps: DataFrame, key: str = "row_ref") -> DataFrame:
    """A1: the decisions owed, one per (kind, attribute, value ignoring case), widest first.

    Only counts are aggregated; ``backlog_rows`` lists the rows, so no group has to fit in memory.
    """
    return (
        gaps.groupBy("kind", "attribute", F.upper("value").alias("value_key"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min_by("value", key).alias("value"))
        .orderBy(F.desc("n_rows"), "kind", "attribute", "value_key")
    )


def backlog_rows(gaps: DataFrame, key: str = "row_ref") -> DataFrame:
    """A1: the rows behind each decision, one per record."""
    return gaps.select("kind", "attribute", F.upper("value").alias("value_key"), key)


def gap_summary(gaps: DataFrame, rows: DataFrame, key: str = "row_ref") -> DataFrame:
    """Gaps, rows with a gap and their share. Per-row pre-aggregation keeps hot rows cheap."""
    per_row = gaps.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    return (
        per_row.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("gaps"), F.count(F.lit(1)).alias("rows_with_gap"))
        .join(total, F.lit(True))
        .select(
            "gaps", "rows_with_gap", "n_rows",
            F.round(F.try_divide(100.0 * F.col("rows_with_gap"), F.col("n_rows")), 6).alias("pct_rows"),
        )
    )


def needs_quality() -> Column:
    """The line's quality is written but in no catalogue."""
    return F.coalesce((F.trim("quality_raw") != "") & (F.col("quality_rule") == "quality:out_of_catalog"), F.lit(False))


def needs_material() -> Column:
    """A quality is written, no material follows, and nobody declared it underivable."""
    undecided = F.coalesce(F.col("material_rule") != "P-3:no-derivable", F.lit(True))
    return F.coalesce((F.trim("quality_raw") != "") & F.col("material").isNull() & undecided, F.lit(False))


def needs_finish() -> Column:
    """A finish is written that no entry maps."""
    return F.coalesce(
        (F.trim("finish_raw") != "") & F.col("finish").isNull() & (F.col("finish_rule") == "finish:unmapped"),
        F.lit(False),
    )


def line_decisions(lines: DataFrame, gaps: DataFrame, key: str = "row_ref") -> DataFrame:
    """Decisions a line can close, quality before material before finish.

    A decision blocks when the backlog owes it for this row and value or a reason hangs on the
    attribute. ``gaps`` is matched on (row, attribute, trigger text), all equi-keys.
    """
    quality, finish = F.col("quality_raw"), F.col("finish_raw")

    def has_reason(attribute: str) -> Column:
        return F.exists("reasons", lambda r: F.coalesce(r["attribute"] == attribute, F.lit(False)))

    def ask(rank: int, attribute: str, trigger: Column, need: Column, matchable: Column) -> Column:
        return F.struct(
            F.lit(rank).alias("rank"), F.lit(attribute).alias("attribute"), F.trim(trigger).alias("value"),
            need.alias("needs"), matchable.alias("matchable"), has_reason(attribute).alias("has_reason"),
        )

    asks = F.array(
        ask(0, "quality", quality, needs_quality(), F.lit(True)),
        ask(1, "material", quality, needs_material(), F.col("material").isNull()),
        ask(2, "finish", finish, needs_finish(), F.col("finish").isNull()),
    )
    owed = (
        gaps.filter(F.col("kind").isin("UNKNOWN_VALUE", "UNCOVERED_DERIVATION"))
        .select(key, "attribute", X.compare_key("value").alias("trigger"))
        .distinct()
        .withColumn("owed", F.lit(True))
    )
    asked = lines.select(key, "line_id", F.inline(asks)).filter("value <> ''")
    return (
        asked.withColumn("trigger", F.when(F.col("matchable"), X.compare_key("value")))
        .join(owed, [key, "attribute", "trigger"], "left")
        .filter(F.col("needs") | F.col("owed"))
        .select(
            key, "line_id", "rank", "attribute", "value",
            (F.coalesce("owed", F.lit(False)) | F.col("has_reason")).alias("blocking"),
        )
    )
