"""Evaluation of lines against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomrec.functions import closed_tables as T
from bomrec.functions import text as X

# Gold lines: row_ref, gold_id, position, status, reasons array<string>, and per graded cell
# <cell>, <cell>_prov, <cell>_cert (C certain, P policy). System lines: row_ref, line_id, position,
# status, reasons array<string>, and per graded cell <cell>, <cell>_prov.


def align(gold: DataFrame, system: DataFrame) -> DataFrame:
    """One record per gold/system pair, with structs ``g`` and ``s``.

    Rows with equal counts pair by position. Otherwise the k-th gold line of a name meets the k-th
    system line of that name. Counts and ranks come from windows over one row's lines, and the join
    is a plain full outer equi-join because the two modes share one composite key.
    """

    def ranked(lines: DataFrame, tag: str) -> DataFrame:
        row = Window.partitionBy("row_ref")
        name = Window.partitionBy("row_ref", "name_key")
        return lines.select(
            "row_ref",
            "position",
            F.coalesce(X.compare_key("name"), F.lit("")).alias("name_key"),
            F.struct(*lines.columns).alias(tag),
        ).select(
            "row_ref", "name_key", tag,
            F.row_number().over(row.orderBy("position")).alias("pos"),
            F.row_number().over(name.orderBy("position")).alias("k"),
            F.count(F.lit(1)).over(row).alias(f"n_{tag}"),
        )

    g, s = ranked(gold, "g"), ranked(system, "s")
    counts = (
        g.select("row_ref", "n_g").distinct()
        .join(s.select("row_ref", "n_s").distinct(), "row_ref", "full")
        .select("row_ref", (F.col("n_g").eqNullSafe(F.col("n_s"))).alias("by_position"))
    )

    def keyed(side: DataFrame, tag: str) -> DataFrame:
        by_position = F.col("by_position")
        return side.join(counts, "row_ref").select(
            "row_ref", tag,
            F.when(~by_position, F.col("name_key")).otherwise(F.lit("*")).alias("pair_name"),
            F.when(by_position, F.col("pos")).otherwise(F.col("k")).alias("pair_k"),
        )

    return keyed(g, "g").join(keyed(s, "s"), ["row_ref", "pair_name", "pair_k"], "full").drop("pair_name", "pair_k")


def graded(pairs: DataFrame) -> DataFrame:
    """One record per pair: alignment, status agreement, graded cells and reason differences."""
    both = F.col("g").isNotNull() & F.col("s").isNotNull()

    def cell(name: str) -> Column:
        expected, got = F.col(f"g.{name}"), F.col(f"s.{name}")
        if name == "quantity":
            expected, got = X.number_text(expected), X.number_text(got)
        return F.struct(
            F.lit(name).alias("attribute"), F.col(f"g.{name}_cert").alias("certainty"),
            expected.alias("expected"), got.alias("got"), X.same(expected, got).alias("ok"),
            F.col(f"g.{name}_prov").alias("expected_prov"), F.col(f"s.{name}_prov").alias("got_prov"),
        )

    cells = F.when(both, F.array(*[cell(c) for c in T.GRADED_CELLS]))
    no_reasons = F.array().cast("array<string>")
    gold_reasons = F.coalesce("g.reasons", no_reasons)
    system_reasons = F.coalesce("s.reasons", no_reasons)
    return (
        pairs.select(
            "row_ref",
            F.col("g.gold_id").alias("gold_id"), F.col("s.line_id").alias("line_id"),
            both.alias("aligned"),
            F.col("g.status").alias("gold_status"), F.col("s.status").alias("system_status"),
            cells.alias("cells"),
            F.array_except(gold_reasons, system_reasons).alias("missing_reasons"),
            F.array_except(system_reasons, gold_reasons).alias("extra_reasons"),
            F.array_contains(gold_reasons, "OUT_OF_FAMILY").alias("gold_out"),
            F.array_contains(system_reasons, "OUT_OF_FAMILY").alias("system_out"),
        )
        .withColumn(
            "certain_ok",
            F.col("aligned") & F.forall("cells", lambda c: (c["certainty"] != "C") | c["ok"]),
        )
        .withColumn("certain_ok", F.coalesce("certain_ok", F.lit(False)))
    )


def split_fidelity(gold: DataFrame, system: DataFrame) -> DataFrame:
    """A2: share of rows whose line counts agree; null when there are no rows."""
    counts = gold.groupBy("row_ref").agg(F.count(F.lit(1)).alias("g")).join(
        system.groupBy("row_ref").agg(F.count(F.lit(1)).alias("s")), "row_ref", "full"
    )
    return counts.agg(
        F.count_if(F.col("g") == F.col("s")).alias("ok"), F.count(F.lit(1)).alias("total")
    ).withColumn("pct", F.round(F.try_divide(100.0 * F.col("ok"), F.col("total")), 6))


def _pct(num: Column, den: Column, empty: float) -> Column:
    return F.round(F.when(den == 0, F.lit(empty)).otherwise(F.try_divide(100.0 * num, den)), 6)




def line_metrics(lines: DataFrame) -> DataFrame:
    """A3-A7, A9, A10 in one aggregation over graded lines: one wide record."""
    aligned = F.col("aligned")
    resolved = aligned & (F.col("system_status") == "RESUELTA")
    in_scope = aligned & ~F.col("gold_out")
    review = in_scope & (F.col("system_status") == "REVISION_MANUAL")

    def traced(ok_only: bool) -> Column:
        def graded_cell(c: Column) -> Column:
            base = (c["certainty"] == "C") & c["ok"]
            return base & c["expected_prov"].eqNullSafe(c["got_prov"]) if ok_only else base

        return F.coalesce(F.sum(F.when(aligned, F.size(F.filter("cells", graded_cell)))), F.lit(0))

    exact = aligned & (F.size("missing_reasons") == 0) & (F.size("extra_reasons") == 0)
    return lines.agg(
        F.count_if(resolved & ~F.col("certain_ok")).alias("silent_bad"),
        F.count_if(resolved).alias("silent_total"),
        F.count_if(in_scope & (F.col("system_status") == "RESUELTA") & F.col("certain_ok")).alias("useful_ok"),
        (F.count_if(F.col("gold_id").isNotNull()) - F.count_if("gold_out")).alias("useful_total"),
        F.count_if(review & (F.col("gold_status") == "RESUELTA")).alias("noise_bad"),
        F.count_if(review).alias("noise_total"),
        F.count_if(aligned & (F.col("gold_status") == F.col("system_status"))).alias("status_ok"),
        F.count_if(aligned).alias("aligned_total"),
        traced(True).alias("trace_ok"),
        traced(False).alias("trace_total"),
        F.count_if(exact).alias("reason_ok"),
        F.count_if("gold_out").alias("out_gold"),
        F.count_if(F.col("gold_out") & F.col("system_out")).alias("out_detected"),
        F.count_if(F.col("system_out") & ~F.col("gold_out")).alias("out_false"),
    )


def metric_rows(wide: DataFrame) -> DataFrame:
    """(scope, name, value, num, den) of the global metrics."""

    def row(name: str, num: str, den: str, empty: float) -> Column:
        return F.struct(
            F.lit("global").alias("scope"), F.lit(name).alias("name"),
            _pct(F.col(num), F.col(den), empty).alias("value"),
            F.col(num).cast("long").alias("num"), F.col(den).cast("long").alias("den"),
        )

    return wide.select(
        F.inline(
            F.array(
                row("silent_error_rate", "silent_bad", "silent_total", 0.0),
                row("useful_autonomy", "useful_ok", "useful_total", 0.0),
                row("queue_noise", "noise_bad", "noise_total", 0.0),
                row("status_agreement", "status_ok", "aligned_total", 0.0),
                row("trace_fidelity", "trace_ok", "trace_total", 100.0),
                row("reason_agreement", "reason_ok", "aligned_total", 0.0),
                row("out_of_scope_detected", "out_detected", "out_gold", 100.0),
            )
        )
    )


def attribute_accuracy(lines: DataFrame) -> DataFrame:
    """Correct certain and policy cells per attribute; 100 % when there are none."""
    cells = lines.filter("aligned").select(F.inline("cells"))
    certain, policy = F.col("certainty") == "C", F.col("certainty") == "P"
    return cells.groupBy("attribute").agg(
        F.count_if(certain & F.col("ok")).alias("ok_c"), F.count_if(certain).alias("total_c"),
        F.count_if(policy & F.col("ok")).alias("ok_p"), F.count_if(policy).alias("total_p"),
    ).withColumn("pct_c", _pct(F.col("ok_c"), F.col("total_c"), 100.0))


def metrics(gold: DataFrame, system: DataFrame) -> DataFrame:
    """Every metric of a run in long form, attribute scopes included."""
    lines = graded(align(gold, system))
    split = split_fidelity(gold, system).select(
        F.lit("global").alias("scope"), F.lit("split_fidelity").alias("name"), F.col("pct").alias("value"),
        F.col("ok").alias("num"), F.col("total").alias("den"),
    )
    accuracy = attribute_accuracy(lines)
    certain = accuracy.select(
        F.lit("attribute").alias("scope"), F.col("attribute").alias("name"), F.col("pct_c").alias("value"),
        F.col("ok_c").alias("num"), F.col("total_c").alias("den"),
    )
    policy = accuracy.filter("total_p > 0").select(
        F.lit("attribute_policy").alias("scope"), F.col("attribute").alias("name"),
        _pct(F.col("ok_p"), F.col("total_p"), 100.0).alias("value"),
        F.col("ok_p").alias("num"), F.col("total_p").alias("den"),
    )
    return split.unionByName(metric_rows(line_metrics(lines))).unionByName(certain).unionByName(policy)


def silent_errors(lines: DataFrame) -> DataFrame:
    """A3: the resolved lines that carry a wrong certain cell."""
    return lines.filter(F.col("aligned") & (F.col("system_status") == "RESUELTA") & ~F.col("certain_ok")).select(
        "row_ref", "line_id"
    )


def trace_mismatches(lines: DataFrame) -> DataFrame:
    """Certain cells with the right value but another provenance."""
    return (
        lines.filter("aligned")
        .select("line_id", F.inline("cells"))
        .filter(F.col("ok") & (F.col("certainty") == "C") & ~F.col("expected_prov").eqNullSafe(F.col("got_prov")))
        .select("line_id", "attribute", "expected_prov", "got_prov")
    )


def reason_differences(lines: DataFrame) -> DataFrame:
    """Missing and extra reason codes of every pair, one per record."""
    sides = F.array(
        F.struct(F.lit("missing").alias("side"), F.col("missing_reasons").alias("codes")),
        F.struct(F.lit("extra").alias("side"), F.col("extra_reasons").alias("codes")),
    )
    return lines.select("row_ref", "gold_id", "line_id", F.inline(sides)).select(
        "row_ref", "gold_id", "line_id", "side", F.explode("codes").alias("code")
    )


def out_of_scope_lines(lines: DataFrame) -> DataFrame:
    """A10: missed and falsely declared out-of-family lines."""
    return lines.filter(F.col("gold_out") != F.col("system_out")).select(
        "row_ref", F.when(F.col("gold_out"), "missed").otherwise("false_positive").alias("outcome"),
        F.when(F.col("gold_out"), F.col("gold_id")).otherwise(F.col("line_id")).alias("id"),
    )


def without_unsupported_cells(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Re-grade lines of files that cannot supply a quantity; ``files`` (file, has_quantity)."""
    kept = F.filter("cells", lambda c: F.col("has_quantity") | (c["attribute"] != "quantity"))
    return (
        lines.join(files, "file", "left")
        .withColumn("cells", kept)
        .withColumn(
            "certain_ok",
            F.coalesce(F.col("aligned") & F.forall("cells", lambda c: (c["certainty"] != "C") | c["ok"]), F.lit(False)),
        )
    )


def reviewer_quality(degraded: DataFrame, errors: DataFrame, key: str = "line_id") -> DataFrame:
    """Recall and precision of a reviewer: what it degraded against the silent errors."""
    sides = degraded.select(key).distinct().withColumn("d", F.lit(True)).join(
        errors.select(key).distinct().withColumn("e", F.lit(True)), key, "full"
    )
    return sides.agg(
        F.count_if(F.col("d") & F.col("e")).alias("hits"),
        F.count_if(F.col("d") & F.col("e").isNull()).alias("false_positives"),
        F.count_if(F.col("e") & F.col("d").isNull()).alias("missed"),
    ).select(
        "*",
        F.round(F.try_divide(100.0 * F.col("hits"), F.col("hits") + F.col("missed")), 6).alias("recall"),
        F.round(F.try_divide(100.0 * F.col("hits"), F.col("hits") + F.col("false_positives")), 6).alias("precision"),
    )


def gold_statistics(gold: DataFrame) -> DataFrame:
    """(statistic, key, n): statuses, reasons, lines per row, policy cells per attribute."""
    status = gold.groupBy(F.col("status").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    reasons = gold.select(F.explode("reasons").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    per_row = gold.groupBy("row_ref").agg(F.count(F.lit(1)).alias("lines"))
    split = per_row.groupBy(F.col("lines").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    policy = gold.agg(*[F.count_if(F.col(f"{c}_cert") == "P").alias(c) for c in T.GRADED_CELLS])
    policy = policy.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in T.GRADED_CELLS]))
    )
    parts = {"status": status, "reason": reasons, "lines_per_row": split, "policy_cells": policy}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("statistic"), "key", "n")
        out = part if out is None else out.unionByName(part)
    return out


def trap_results(lines: DataFrame, expectations: DataFrame) -> DataFrame:
    """One verdict per expectation row.

    ``expectations``: id, gate and nullable split, name, quality, quality_group, finish, has_finish,
    standard, status, reasons array<string>, none_resolved, no_resolved_quality. The principal is the
    line at the lowest position; everything else is an aggregate over the row's lines.
    """
    codes = F.transform("reasons", lambda r: r["code"])
    first = F.struct(
        "name", "quality", "quality_group", "finish", "standard", "status", codes.alias("codes")
    )
    per_row = lines.groupBy("row_ref").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(first, "position").alias("p"),
        F.count_if(F.col("status") == "RESUELTA").alias("resolved"),
        F.collect_set(F.when(F.col("status") == "RESUELTA", X.compare_key("quality"))).alias("resolved_qualities"),
    )
    e = expectations.withColumnsRenamed({c: f"x_{c}" for c in expectations.columns if c != "id"})
    j = e.join(per_row, F.col("id") == F.col("row_ref"), "left")
    n = F.coalesce("n", F.lit(0))

    def unless(expected: str, check: Column) -> Column:
        return F.col(expected).isNull() | F.coalesce(check, F.lit(False))

    ok = (
        unless("x_split", n == F.col("x_split"))
        & unless("x_name", F.col("p.name") == F.col("x_name"))
        & unless("x_quality", X.same("p.quality", "x_quality"))
        & unless("x_quality_group", F.col("p.quality_group") == F.col("x_quality_group"))
        & (~F.coalesce("x_has_finish", F.lit(False)) | X.same("p.finish", "x_finish"))
        & unless("x_standard", X.same("p.standard", "x_standard"))
        & unless("x_status", F.col("p.status") == F.col("x_status"))
        & unless("x_reasons", F.size(F.array_except(F.col("x_reasons"), F.col("p.codes"))) == 0)
        & (~F.coalesce("x_none_resolved", F.lit(False)) | (F.coalesce("resolved", F.lit(0)) == 0))
        & unless(
            "x_no_resolved_quality",
            ~F.array_contains(F.coalesce("resolved_qualities", F.array().cast("array<string>")), X.compare_key("x_no_resolved_quality")),
        )
    )
    return j.select("id", F.col("x_gate").alias("gate"), ok.alias("ok"))


def trap_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("gate").agg(F.count_if("ok").alias("ok"), F.count(F.lit(1)).alias("total"))
