"""Correction timing, procurement lifecycle and the KPI dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomrec.functions import closed_tables as T


def correction_pairs(events: DataFrame) -> DataFrame:
    """Durations of corrections. A saved event pairs with the started event right before it.

    ``events`` (session_id, line_id, ts, seq, event_type); a saved event without a start before it is
    dropped and a later start replaces an earlier one. The look-back runs inside each day of a
    (session, line) and crosses days through one summary record per day, so a key that holds much of
    the log is spread over its days.
    """
    key = ["session_id", "line_id"]
    moves = events.filter(F.col("event_type").isin("started", "saved")).select(
        *key, F.to_date("ts").alias("day"), F.struct("ts", "seq", "event_type").alias("e")
    )
    last = moves.groupBy(*key, "day").agg(F.max("e").alias("last"))
    earlier = last.select(*key, "day", F.lag("last").over(Window.partitionBy(*key).orderBy("day")).alias("earlier"))
    in_day = Window.partitionBy(*key, "day").orderBy("e")
    looked = moves.withColumn("before", F.lag("e").over(in_day)).join(earlier, [*key, "day"])
    before = F.coalesce("before", "earlier")
    return (
        looked.select(*key, "e", before.alias("before"))
        .filter("e.event_type = 'saved' and before.event_type = 'started'")
        .select(
            *key, F.col("before.ts").alias("started_at"), F.col("e.ts").alias("saved_at"),
            (F.unix_micros("e.ts") - F.unix_micros("before.ts")).alias("micros"),
        )
        .withColumn("seconds", F.col("micros") / 1e6)
    )


def nearest_rank(values: DataFrame, value: str, shares: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact nearest-rank percentiles of a non-negative bigint column, one column per share.

    Equal values are counted first. Running counts are then taken at three widths, each window
    covering a bounded number of buckets, so no task ever orders the whole column. With ``by``, whose
    columns are never null, one record for each group.
    """
    counts = values.groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumns({"b1": F.shiftright("v", 30), "b2": F.shiftright("v", 15)})

    def before(keys: list[str], order: str) -> Window:
        return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def offsets(keys: list[str], bucket: str, name: str) -> DataFrame:
        sums = counts.groupBy(*keys, bucket).agg(F.sum("n").alias("n"))
        return sums.select(*keys, bucket, F.coalesce(F.sum("n").over(before(keys, bucket)), F.lit(0)).alias(name))

    inner = F.coalesce(F.sum("n").over(before([*by, "b2"], "v")), F.lit(0)) + F.col("n")
    ranked = (
        counts.withColumn("upto", inner)
        .join(offsets([*by, "b1"], "b2", "o2"), [*by, "b1", "b2"])
        .join(offsets([*by], "b1", "o1"), [*by, "b1"])
        .select(*by, "v", (F.col("upto") + F.col("o1") + F.col("o2")).alias("rank"))
    )
    total = counts.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    wanted = {f"p{round(s * 100)}": s for s in shares}
    return ranked.join(total, [*by] if by else F.lit(True)).groupBy(*by).agg(
        *[
            F.min(F.when(F.col("rank") >= F.greatest(F.ceil(F.col("total") * s), F.lit(1)), F.col("v"))).alias(name)
            for name, s in wanted.items()
        ]
    )


def correction_timing(pairs: DataFrame) -> DataFrame:
    """Sample size, nearest-rank p50 and p90 seconds, and how many met the target."""
    valid = pairs.filter("micros >= 0")
    counts = valid.agg(
        F.count(F.lit(1)).alias("sample"),
        F.count_if(F.col("seconds") <= T.CORRECTION_TARGET_SECONDS).alias("within_target"),
    )
    ranks = nearest_rank(valid, "micros", (0.5, 0.9))
    return counts.join(ranks, F.lit(True)).select(
        "sample", F.round(F.col("p50") / 1e6, 6).alias("p50_seconds"),
        F.round(F.col("p90") / 1e6, 6).alias("p90_seconds"), "within_target",
    )


def first_arrivals(events: DataFrame) -> DataFrame:
    """T1 in batch: the first arrival of each (project, revision, flow, type) by ``seq`` is kept."""
    keys = ("project_id", "revision_id", "flow_id", "event_type")
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("e")).select(*keys, "e.*")


def milestone_counts(milestones: DataFrame) -> DataFrame:
    return milestones.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stage_durations(milestones: DataFrame) -> DataFrame:
    """Microseconds per flow and stage; one conditional aggregation per flow, negatives dropped."""
    at = [F.max(F.when(F.col("event_type") == t, F.col("ts"))).alias(t) for t in T.LIFECYCLE_EVENTS]
    flows = milestones.groupBy("project_id", "revision_id", "flow_id").agg(*at)
    stages = F.array(
        *[
            F.struct(F.lit(stage).alias("stage"), (F.unix_micros(F.col(end)) - F.unix_micros(F.col(start))).alias("micros"))
            for stage, (start, end) in T.LIFECYCLE_STAGES.items()
        ]
    )
    return flows.select("project_id", "revision_id", "flow_id", F.inline(stages)).filter("micros >= 0")


def lifecycle_kpi(milestones: DataFrame) -> DataFrame:
    """Sample size and nearest-rank p50/p90 hours per stage, over all milestones."""
    durations = stage_durations(milestones)
    sample = durations.groupBy("stage").agg(F.count(F.lit(1)).alias("sample"))
    hours = [F.round(F.col(p) / 3_600_000_000, 6).alias(f"{p}_hours") for p in ("p50", "p90")]
    return sample.join(nearest_rank(durations, "micros", (0.5, 0.9), by=("stage",)), "stage").select("stage", "sample", *hours)


def entry_id_from_rule(rule: Column) -> Column:
    """vocabulary entry behind an attribute rule, or null."""

    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(rule, pattern, 1), F.lit(""))

    return F.coalesce(
        found("^(?:P-3|P-12):(.+)$"), found("^(?:name|quality):alias:(.+?)->"), found("^standard:alias:(.+)$")
    )


def rule_uses(lines: DataFrame) -> DataFrame:
    """Entry ids used by the lines' attribute rules with how often."""
    rules = F.array(*[F.col(f"{a}_rule") for a in T.ATTRIBUTES])
    return (
        lines.select(F.explode(rules).alias("rule"))
        .select(entry_id_from_rule(F.col("rule")).alias("entry_id"))
        .filter("entry_id is not null")
        .groupBy("entry_id")
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def reuse_count(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """How many attributes reuse a promoted or added entry."""
    uses = rule_uses(lines).join(entries.select("entry_id").distinct(), "entry_id", "left_semi")
    return uses.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("reuse_count"))


def reusable_entries(promoted: DataFrame, events: DataFrame) -> DataFrame:
    """Promoted entries and vocabulary events, each id once."""
    return promoted.select("entry_id").unionByName(events.select("entry_id")).filter("entry_id is not null").distinct()


def dashboard(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Headline figures of every run (run_id, n_rows, cost_eur, latency_ms, prices_configured).

    ``metrics`` (run_id, scope, name, value) is pivoted by one conditional aggregation.
    """
    names = ("silent_error_rate", "useful_autonomy", "split_fidelity", "queue_noise")
    wide = metrics.filter("scope = 'global'").groupBy("run_id").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]
    )
    priced = F.col("prices_configured") & (F.col("cost_eur") > 0) & (F.col("n_rows") > 0)
    per_row = F.when(priced, F.col("cost_eur") / F.col("n_rows"))
    minutes = F.when(
        (F.col("n_rows") > 0) & (F.col("latency_ms") > 0), F.col("latency_ms") / F.col("n_rows") * 1000 / 60000
    )
    return runs.join(wide, "run_id", "left").select(
        "run_id", *names,
        F.round(per_row, 9).alias("cost_per_row"),
        F.round(per_row * T.PROJECT_ROWS_READ, 6).alias("project_cost"),
        F.round(minutes, 6).alias("minutes_per_thousand"),
        F.round(minutes / 8, 6).alias("minutes_at_8"),
        F.round(T.MANUAL_PROJECT_HOURS * F.col("useful_autonomy") / 100, 6).alias("hours_saved"),
    )
