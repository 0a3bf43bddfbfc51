"""Stored runs: comparison, fingerprints, leaderboards, stability and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomrec.functions import closed_tables as T
from bomrec.operators import validate


def direction(name: Column, base: Column, candidate: Column) -> Column:
    """improved, regressed or unchanged, knowing which metrics should go down."""
    lower = name.isin(*T.LOWER_IS_BETTER)
    better = F.when(lower, candidate < base).otherwise(candidate > base)
    return F.when(base == candidate, "unchanged").when(better, "improved").otherwise("regressed")


def compare_metrics(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Metrics present on both sides; a one-sided or unknown value is omitted, never zero."""
    b = base.filter("value is not null").select("scope", "name", F.col("value").alias("base"))
    c = candidate.filter("value is not null").select("scope", "name", F.col("value").alias("candidate"))
    return b.join(c, ["scope", "name"]).select(
        "scope", "name", "base", "candidate",
        F.round(F.col("candidate") - F.col("base"), 6).alias("delta"),
        direction(F.col("name"), F.col("base"), F.col("candidate")).alias("direction"),
    )


def compare_lines(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """What changed per gold line: split_changed, fixed, regressed or status_changed.

    Both sides are graded lines with row_ref, gold_id, aligned, system_status, certain_ok.
    """

    def side(lines: DataFrame, tag: str) -> DataFrame:
        good = F.col("aligned") & (F.col("system_status") == "RESUELTA") & F.col("certain_ok")
        return lines.filter("gold_id is not null").select(
            "row_ref", "gold_id",
            F.struct("aligned", F.col("system_status").alias("status"), F.coalesce(good, F.lit(False)).alias("good")).alias(tag),
        )

    b, c = F.col("b"), F.col("c")
    change = (
        F.when(b.isNull() | c.isNull() | (b["aligned"] != c["aligned"]), "split_changed")
        .when(~b["good"] & c["good"], "fixed")
        .when(b["good"] & ~c["good"], "regressed")
        .when(~b["status"].eqNullSafe(c["status"]), "status_changed")
    )
    return (
        side(base, "b").join(side(candidate, "c"), ["row_ref", "gold_id"], "full")
        .select("row_ref", "gold_id", change.alias("change"))
        .filter("change is not null")
    )


def incompatibilities(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Runs are comparable when dataset and policy fingerprints agree; lists what does not.

    One header record each (run_id, dataset_fingerprint, policy_fingerprint).
    """
    b = base.select(F.struct("run_id", "dataset_fingerprint", "policy_fingerprint").alias("b"))
    c = candidate.select(F.struct("run_id", "dataset_fingerprint", "policy_fingerprint").alias("c"))
    return b.join(c, F.lit(True)).select(
        F.col("b.run_id").alias("base_run"), F.col("c.run_id").alias("candidate_run"),
        F.array_compact(
            F.array(
                F.when(F.col("b.dataset_fingerprint") != F.col("c.dataset_fingerprint"), "dataset"),
                F.when(F.col("b.policy_fingerprint") != F.col("c.policy_fingerprint"), "policy"),
            )
        ).alias("differs"),
    )


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """order-independent content fingerprint of any number of rows.

    Rows are hashed where they are and the hashes folded with commutative sums, so nothing is sorted
    or collected; the row count and two independent sums make accidental agreement implausible.
    """
    content = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    digest = F.sha2(content, 256)

    def part(start: int) -> Column:
        return F.conv(F.substring(digest, start, 14), 16, 10).cast("decimal(38,0)")

    return rows.select(part(1).alias("a"), part(15).alias("b")).agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("n")
    ).select(F.sha2(F.concat_ws(":", "a", "b", "n"), 256).alias("fingerprint"))


def policy_fingerprint(settings: dict[str, str] | None = None) -> Column:
    return F.sha2(F.to_json(validate.policy_struct(settings)), 256)


def latest(rows: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """L1: newest first; Spark plans order + limit as a top-n per partition, not a full sort."""
    return rows.orderBy(F.desc(by), F.desc(tie)).limit(n)


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run, as one record."""
    newest = F.max_by(F.struct(*runs.columns), F.struct("created_at", "run_id")).alias("r")
    return runs.agg(newest).select("r.*")


def row_order(ref: str = "row_ref") -> list[Column]:
    """L2: numeric references first by value, then by text; a non-numeric one counts as zero."""
    return [F.coalesce(F.col(ref).try_cast("double"), F.lit(0.0)), F.col(ref)]


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost per tier; the cost of a tier without prices is null, never zero.

    ``usage`` (tier, n_rows, input, cached, output) and ``prices`` (tier, p_in, p_cached, p_out) in
    currency per million tokens.
    """
    sums = usage.groupBy("tier").agg(*[F.sum(c).alias(c) for c in ("n_rows", "input", "cached", "output")])
    cost = (
        (F.col("input") - F.col("cached")) * F.col("p_in")
        + F.col("cached") * F.col("p_cached")
        + F.col("output") * F.col("p_out")
    ) / 1e6
    per_row = F.try_divide(F.col("cost"), F.col("n_rows"))
    return sums.join(prices, "tier", "left").withColumn("cost", cost).select(
        "tier", "n_rows", "input", "cached", "output",
        F.round("cost", 4).alias("cost"),
        F.round(F.try_divide(F.col("input") + F.col("output"), F.col("n_rows")), 6).alias("tokens_per_row"),
        F.round(per_row, 9).alias("cost_per_row"),
        F.round(project_cost(per_row), 3).alias("project_cost"),
    )


def project_cost(cost_per_row: Column, rows_per_file: int = 20_000, revisions: int = 25) -> Column:
    """cost of a whole project from the cost of one row."""
    return cost_per_row * rows_per_file * revisions


def leaderboard(metrics: DataFrame) -> DataFrame:
    """One record per model, least silent error first, then most autonomy.

    ``metrics`` (model, name, value) in long form, scope already global.
    """
    names = ["split_fidelity", "silent_error_rate", "useful_autonomy", "queue_noise"]
    wide = metrics.groupBy("model").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    return wide.orderBy(F.asc("silent_error_rate"), F.desc("useful_autonomy"), "model")


def repetitions(measures: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, minimum and maximum per configuration."""
    return measures.groupBy(*keys).agg(
        F.count(value).alias("runs"), F.round(F.avg(value), 6).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def split_stability(passes: DataFrame, expected: DataFrame) -> DataFrame:
    """Does a row split the same way on every pass, and how often as expected?

    ``passes`` (row_ref, pass_no, n_elements, failed); failed passes do not count. Every row is listed:
    one without a pass that worked is unstable, one without an expectation has no hits. ``counts`` has
    the elements of each pass in order, null where it failed.
    """
    n = F.when(~F.col("failed"), F.col("n_elements"))
    stats = passes.join(expected, "row_ref", "left").groupBy("row_ref").agg(
        F.min(n).alias("low"), F.max(n).alias("high"), F.count(n).alias("passes"), F.count_if(n == F.col("expected")).alias("hits"),
        F.array_sort(F.collect_list(F.struct("pass_no", n.alias("n")))).alias("by_pass"),
    )
    stable = F.coalesce(F.col("low") == F.col("high"), F.lit(False))
    return stats.select("row_ref", "passes", "hits", stable.alias("stable"), F.transform("by_pass", lambda p: p["n"]).alias("counts"))


def split_discrepancies(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows whose number of lines differs between two runs."""
    a = first.groupBy("row_ref").agg(F.count(F.lit(1)).alias("n_first"))
    b = second.groupBy("row_ref").agg(F.count(F.lit(1)).alias("n_second"))
    return (
        a.join(b, "row_ref", "full")
        .select("row_ref", F.coalesce("n_first", F.lit(0)).alias("n_first"), F.coalesce("n_second", F.lit(0)).alias("n_second"))
        .filter("n_first <> n_second")
    )


def policy_sensitivity(read: DataFrame, variants: dict[str, dict[str, str]], keys: tuple[str, ...] = ("row_ref",)) -> DataFrame:
    """Resolved lines per policy variant. The read happens once; variants fan out afterwards."""
    lines = validate.lines(validate.with_policies(read, variants), keys=keys)
    return lines.groupBy("variant").agg(
        F.count_if(F.col("status") == "RESUELTA").alias("resolved"), F.count(F.lit(1)).alias("lines")
    )


def measurement_validity(rows: DataFrame) -> DataFrame:
    """A run with any reader failure is not a valid measurement. ``rows`` (run_id, error)."""
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("error").alias("failed"),
        (F.count("error") == 0).alias("valid"),
    )


def reader_failures(rows: DataFrame) -> DataFrame:
    """The failing rows and their kinds, one per record."""
    return rows.filter("error is not null").select("run_id", "row_ref", F.col("error").alias("kind"))


def rejected_measures(lines: DataFrame) -> DataFrame:
    """Lines where a bare number was rejected as measure, with what took its place."""
    return lines.filter(F.array_contains("policies_applied", "P-10")).select(
        "row_ref", "line_id",
        F.array_contains("policies_applied", "P-11").alias("recovered_quality"),
        F.when(F.array_contains("policies_applied", "P-11"), F.col("quality")).alias("quality"),
        "measure", "measure_prov",
    )
