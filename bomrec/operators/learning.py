"""Corrections, suggestions and the guards in front of the vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomrec.functions import closed_tables as T
from bomrec.functions import text as X
from bomrec.operators import catalog as C
from bomrec.operators import detect as D
from bomrec.operators import normalize as N
from bomrec.operators.catalog import Vocabulary

CORRECTION_MOVES = {"PENDING": ("APPROVED", "REJECTED"), "APPROVED": ("REJECTED", "PROMOTED")}
SUGGESTION_MOVES = {"SHOWN": ("ACCEPTED", "REJECTED"), "ACCEPTED": ("VALIDATED",)}


def promotion_class(attribute: Column, in_conflict: Column) -> Column:
    """what kind of decision a correction leads to."""
    return (
        F.when(in_conflict, "policy_decision")
        .when(attribute.isin("measure", "length"), "not_promotable")
        .when(attribute == "quantity", "gold_proposal")
        .when(attribute.isin("name", "material", "quality", "standard", "finish"), "vocab_alias")
        .otherwise("not_promotable")
    )


# -- status machines ---------------------------------------------------------------------------


def _allowed(previous: Column, action: Column, moves: dict[str, tuple[str, ...]], initial: str) -> Column:
    ok = previous.isNull() & (action == initial)
    for source, targets in moves.items():
        ok = ok | ((previous == source) & action.isin(*targets))
    return F.coalesce(ok, F.lit(False))


def transitions(events: DataFrame, moves: dict[str, tuple[str, ...]], initial: str, key: str = "id") -> DataFrame:
    """Every event with the action before it and whether that move is allowed."""
    w = Window.partitionBy(key).orderBy("seq")
    before = F.lag("action").over(w)
    return events.withColumn("previous", before).withColumn(
        "valid", _allowed(F.col("previous"), F.col("action"), moves, initial)
    )


def applied_transitions(events: DataFrame, moves: dict[str, tuple[str, ...]], initial: str, key: str = "id") -> DataFrame:
    """What a machine that refuses other moves makes of the events (key, seq, action).

    A refused move leaves the status as it is, so the first allowed move after the last applied one counts.
    Machines have no cycles: one join and one combinable minimum for each step of their longest way, whatever
    the number of events of a key.

    Returns (key, status, moves, refused): the last status, null if the initial one never came, the applied
    actions in order, and how many events were refused.
    """

    def depth(status: str) -> int:
        return max((1 + depth(t) for t in moves.get(status, ())), default=0)

    first = F.when(F.col("action") == initial, F.col("seq"))
    state = events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("at")).select(
        key, "n", "at", F.when(F.col("at").isNotNull(), F.lit(initial)).alias("status"),
        F.when(F.col("at").isNotNull(), F.array(F.lit(initial))).otherwise(F.array().cast("array<string>")).alias("moves"),
    )
    allowed = F.lit(False)
    for source, targets in moves.items():
        allowed = allowed | ((F.col("status") == source) & F.col("action").isin(*targets))
    for _ in range(depth(initial)):
        open_ = state.where(F.col("status").isin(*moves)).select(key, "status", F.col("at").alias("after"))
        step = events.join(open_, key).where((F.col("seq") > F.col("after")) & allowed).groupBy(key).agg(
            F.min(F.struct("seq", "action")).alias("step")
        )
        state = state.join(step, key, "left").select(
            key, "n", F.coalesce("step.seq", "at").alias("at"), F.coalesce("step.action", "status").alias("status"),
            F.when(F.col("step").isNull(), F.col("moves")).otherwise(F.concat("moves", F.array("step.action"))).alias("moves"),
        )
    return state.select(key, "status", "moves", (F.col("n") - F.size("moves")).alias("refused"))


def current_status(events: DataFrame, key: str = "id") -> DataFrame:
    """Status of each item as the projection of its event log."""
    return events.groupBy(key).agg(F.max_by("action", "seq").alias("status"))


def valid_verifications(suggestions: DataFrame) -> DataFrame:
    """Only an approved suggestion may carry a verdict."""
    return suggestions.withColumn(
        "valid", F.col("verified").isNull() | F.col("status").isin("ACCEPTED", "VALIDATED")
    )


# -- corrections -------------------------------------------------------------------------------


def correction_intake(corrections: DataFrame, rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Accept a correction with literal evidence, a rationale and a known run; else say why not."""
    known = runs.select("run_id").distinct().withColumn("known_run", F.lit(True))
    j = corrections.join(rows.select("row_ref", "source_text"), "row_ref", "left").join(known, "run_id", "left")

    def blank(c: str) -> Column:
        return F.coalesce(F.trim(c) == "", F.lit(True))

    return j.withColumn(
        "rejection",
        F.when(blank("evidence"), "missing_evidence")
        .when(blank("rationale"), "missing_rationale")
        .when(~F.coalesce(X.evidence_matches("source_text", "evidence"), F.lit(False)), "evidence_not_in_row")
        .when(F.col("run_id").isNotNull() & F.col("known_run").isNull(), "unknown_run"),
    ).drop("known_run", "source_text")


def value_conflicts(corrections: DataFrame) -> DataFrame:
    """Cells with two different live corrections, null and blank being the same value."""
    active = corrections.filter(F.col("status").isin("PENDING", "APPROVED"))
    return (
        active.groupBy("row_ref", "attribute", "evidence")
        .agg(
            F.count_distinct(F.coalesce(F.trim("value"), F.lit(""))).alias("n_values"),
            F.count(F.lit(1)).alias("n_corrections"),
        )
        .filter("n_values > 1")
    )


def conflicting_corrections(corrections: DataFrame) -> DataFrame:
    """The corrections taking part in a conflict, one per record."""
    keys = ["row_ref", "attribute", "evidence"]
    return corrections.filter(F.col("status").isin("PENDING", "APPROVED")).join(
        value_conflicts(corrections).select(*keys), keys, "left_semi"
    )


def correction_kpi(corrections: DataFrame) -> DataFrame:
    """Counts per status, conflicts and their rate; the verified fields are constant."""
    counts = corrections.agg(
        *[F.count_if(F.col("status") == s.upper()).alias(s) for s in ("pending", "approved", "promoted", "rejected")]
    )
    conflicts = value_conflicts(corrections).agg(F.count(F.lit(1)).alias("conflicts"))
    decided = F.col("conflicts") + F.col("approved") + F.col("rejected") + F.col("promoted")
    return counts.join(conflicts, F.lit(True)).select(
        "*",
        F.round(F.try_divide(F.col("conflicts").cast("double"), decided), 6).alias("conflict_rate"),
        F.lit(0).cast("long").alias("promoted_verified"),
        F.lit(0).cast("long").alias("promoted_wrong"),
        F.lit(None).cast("double").alias("silent_error_rate"),
    )


def promotions(corrections: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Vocabulary ``add`` events of approved corrections, or the reason there is none."""
    v = vocabulary or Vocabulary.closed()
    client = Vocabulary(
        names=tuple(a for a in Vocabulary.closed().names),
        materials=v.materials, finishes=v.finishes,
    )
    conflicts = value_conflicts(corrections).select("row_ref", "attribute", "evidence").withColumn("clash", F.lit(True))
    alias, target, attribute = F.trim("evidence"), F.trim(F.coalesce("value", F.lit(""))), F.col("attribute")
    names = {k: a.value for k, a in Vocabulary.exact(client.names).items()}
    groups = client.group_by_value()
    is_none = F.lower(target).isin("not_a_finish", "no-acabado")
    key, goal = X.fold(alias), X.fold(target)
    std_alias, std_target = D.resolve_standard(alias, client), D.resolve_standard(target, client)
    in_client = (
        F.when(attribute == "name", X.lookup(names, key).isNotNull())
        .when(attribute == "quality", X.lookup(groups, key).isNotNull())
        .when(attribute == "standard", std_alias.isNotNull())
        .otherwise(F.lit(False))
    )
    value = (
        F.when(attribute == "name", X.lookup(names, goal))
        .when(attribute == "quality", F.when(X.lookup(groups, goal).isNotNull(), target))
        .when(attribute == "standard", std_target["normalized"])
        .when(attribute == "material", F.when(target.isin("AC", "INOX"), target))
        .when(attribute == "finish", F.when(is_none, F.lit("not_a_finish")).otherwise(F.nullif(goal, F.lit(""))))
    )
    kind = (
        F.when((attribute == "finish") & is_none, "not_a_finish")
        .when(attribute == "material", "pattern")
        .otherwise("alias")
    )
    entry_alias = F.when(attribute == "material", X.exact_pattern(alias)).otherwise(alias)
    judged = corrections.join(conflicts, ["row_ref", "attribute", "evidence"], "left").withColumns(
        {
            "class": promotion_class(attribute, F.coalesce("clash", F.lit(False))),
            "in_client": in_client, "target_value": value, "entry_kind": kind, "entry_alias": entry_alias,
        }
    )
    refusal = (
        F.when(F.col("status") != "APPROVED", "not_approved")
        .when(F.col("class") != "vocab_alias", F.col("class"))
        .when(F.coalesce(alias == "", F.lit(True)), "missing_alias")
        .when(F.col("in_client"), "alias_in_client_layer")
        .when(F.col("target_value").isNull(), "invalid_target")
    )
    return judged.select(
        "id", "row_ref", "attribute", refusal.alias("refusal"),
        F.when(refusal.isNull(), F.lit("add")).alias("action"),
        F.when(refusal.isNull(), F.col("entry_kind")).alias("kind"),
        F.when(refusal.isNull(), F.col("entry_alias")).alias("alias"),
        F.when(refusal.isNull() & (F.col("entry_kind") != "not_a_finish"), F.col("target_value")).alias("value"),
    )


# -- suggestions -------------------------------------------------------------------------------


def suggestion_intake(suggestions: DataFrame, rows: DataFrame) -> DataFrame:
    """A suggestion must propose a value for finish or material and point at literal row text."""
    j = suggestions.join(rows.select("row_ref", "source_text"), "row_ref", "left")
    return j.withColumn(
        "rejection",
        F.when(~F.col("attribute").isin("finish", "material"), "attribute_out_of_scope")
        .when(F.coalesce(F.trim("value") == "", F.lit(True)), "missing_value")
        .when(F.coalesce(F.trim("match") == "", F.lit(True)), "missing_match")
        .when(~F.col("origin").isin("closed_table", "row_evidence"), "invalid_origin")
        .when(~F.coalesce(X.evidence_matches("source_text", "match"), F.lit(False)), "match_not_in_row"),
    ).drop("source_text")


def suggestion_kpi(suggestions: DataFrame) -> DataFrame:
    """The funnel overall (attribute null) and per attribute, by one GROUPING SETS pass."""
    approved = F.col("status").isin("ACCEPTED", "VALIDATED")
    verified = approved & F.col("verified").isNotNull()
    counts = suggestions.rollup("attribute").agg(
        F.count(F.lit(1)).alias("shown"),
        F.count_if(F.col("status") == "SHOWN").alias("pending"),
        F.count_if(approved).alias("accepted"),
        F.count_if(F.col("status") == "VALIDATED").alias("validated"),
        F.count_if(F.col("status") == "REJECTED").alias("rejected"),
        F.count_if(verified).alias("verified"),
        F.count_if(verified & (F.col("verified") == "wrong")).alias("wrong"),
    )

    def rate(num: str, den: Column) -> Column:
        return F.round(F.try_divide(F.col(num).cast("double"), den), 6)

    return counts.select(
        "*",
        rate("accepted", F.col("accepted") + F.col("rejected")).alias("acceptance_rate"),
        rate("wrong", F.col("verified")).alias("silent_error_rate"),
    )


# -- vocabulary write guards -------------------------------------------------------------------


def duplicate_ids(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """G1: candidates whose id was ever used, retired entries included."""
    return candidates.join(entries.select("id").distinct(), "id", "left_semi")


def outcome_key(kind: Column, value: Column) -> Column:
    return F.when(kind == "not_a_finish", F.lit("not_a_finish")).otherwise(F.concat(F.lit("alias:"), value))


def ambiguity_clashes(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """Candidates whose trigger already leads a live entry somewhere else.

    Live triggers collapse to their smallest and largest outcome first, so a popular trigger joins
    once and no candidate/entry pairs are produced.
    """
    live = (
        C.live(entries)
        .groupBy("attribute", X.fold("alias").alias("trigger"))
        .agg(
            F.min(outcome_key(F.col("kind"), F.col("value"))).alias("low"),
            F.max(outcome_key(F.col("kind"), F.col("value"))).alias("high"),
            F.min("id").alias("clash_id"),
        )
    )
    mine = outcome_key(F.col("kind"), F.col("value"))
    return (
        candidates.withColumn("trigger", X.fold("alias"))
        .join(live, ["attribute", "trigger"])
        .filter((F.col("low") != mine) | (F.col("high") != mine))
        .drop("low", "high", "trigger")
    )


def layer_one_conflicts(candidates: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Quality candidates the closed catalogue already decides, as contradiction or redundancy."""
    v = vocabulary or Vocabulary.closed()
    q = N.resolve_quality(F.col("alias"), v)
    return (
        candidates.withColumn("catalog_group", F.when(q["source"] == "catalog", q["group"]))
        .filter("catalog_group is not null")
        .withColumn("finding", F.when(F.col("catalog_group") == F.col("value"), "redundant").otherwise("contradiction"))
    )


def short_aliases(candidates: DataFrame) -> DataFrame:
    """Aliases under three characters need an explicit confirmation."""
    return candidates.filter(F.length(F.trim("alias")) < 3)


def structural_errors(candidates: DataFrame) -> DataFrame:
    """Entries that may not exist at all, with the rule they break."""
    no_value = F.coalesce(F.trim("value") == "", F.lit(True))
    return candidates.withColumn(
        "error",
        F.when(F.coalesce(F.trim("alias") == "", F.lit(True)), "missing_alias")
        .when((F.col("attribute") == "finish") & (F.col("kind") == "alias") & no_value, "alias_without_finish")
        .when((F.col("attribute") == "finish") & (F.col("kind") == "not_a_finish") & ~no_value, "not_a_finish_with_value")
        .when((F.col("attribute") == "quality_group") & ~F.coalesce(C.is_known_group("value"), F.lit(False)), "unknown_group")
        .when((F.col("attribute") == "material") & ~F.coalesce(F.col("value").isin("AC", "INOX"), F.lit(False)), "unknown_material"),
    ).filter("error is not null")


def finish_regressions(samples: DataFrame, column: str, live: Vocabulary, after: Vocabulary) -> DataFrame:
    """Samples whose finish reading changes once the candidates are added."""

    def reading(v: Vocabulary) -> Column:
        r = N.resolve_finish(F.col(column), v)
        return F.concat_ws("|", r["kind"], r["finish"], r["entry_id"])

    return (
        samples.select(column).distinct()
        .select(column, reading(live).alias("before"), reading(after).alias("after"))
        .filter("before <> after")
    )


def quality_regressions(samples: DataFrame, column: str, live: Vocabulary, after: Vocabulary) -> DataFrame:
    """Samples whose quality reading changes once the candidates are added."""

    def reading(v: Vocabulary) -> Column:
        r = N.resolve_quality(F.col(column), v)
        return F.concat_ws("|", r["source"], r["group"], r["entry_id"])

    return (
        samples.select(column).distinct()
        .select(column, reading(live).alias("before"), reading(after).alias("after"))
        .filter("before <> after")
    )


def uncovered_declarations(declarations: DataFrame, derivations: DataFrame) -> DataFrame:
    """A not-derivable declaration needs a reason, and warns while a live entry still derives it.

    ``declarations`` and ``derivations`` (kind, alias) match on the same trigger.
    """
    alive = derivations.select("kind", "alias").distinct().withColumn("derives", F.lit(True))
    return declarations.join(alive, ["kind", "alias"], "left").withColumn(
        "finding",
        F.when(F.coalesce(F.trim("why") == "", F.lit(True)), "missing_reason").when(F.col("derives"), "still_derives"),
    ).drop("derives")


def preview(texts: DataFrame, column: str, vocabulary: Vocabulary | None = None) -> DataFrame:
    """What a text resolves to today under every attribute, one record per attribute."""
    v = vocabulary or Vocabulary.closed()
    text = F.trim(column)
    names = {k: a.value for k, a in Vocabulary.exact(v.names).items()}
    resolved = texts.select(
        column,
        N.resolve_finish(text, v).alias("f"), N.resolve_quality(text, v).alias("q"),
        D.resolve_standard(text, v).alias("s"), X.lookup(names, X.fold(text)).alias("n"),
    ).withColumn("m", N.derive_material(text, F.col("q.group"), v))

    def answer(attribute: str, known: Column, value: Column) -> Column:
        return F.struct(
            F.lit(attribute).alias("attribute"), F.coalesce(known, F.lit(False)).alias("known"),
            value.cast("string").alias("value"),
        )

    return resolved.select(
        column,
        F.inline(
            F.array(
                answer("finish", F.col("f.kind").isin("known", "not_a_finish"), F.col("f.finish")),
                answer("material", F.col("m.outcome").isin("derived", "deliberate"), F.col("m.material")),
                answer("name", F.col("n").isNotNull(), F.col("n")),
                answer(
                    "quality", F.col("q.source").isin("catalog", "vocab"),
                    F.when(F.col("q.source") == "catalog", N.canonical_quality(F.col("q.group"))).when(
                        F.col("q.source") == "vocab", F.col("q.group")
                    ),
                ),
                answer("standard", F.col("s").isNotNull(), F.col("s.normalized")),
            )
        ),
    )


def fixture_check(fixtures: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Does the expected action (known, not_a_finish, ambiguous, unknown) of each text hold?"""
    v = vocabulary or Vocabulary.closed()
    r = N.resolve_finish(F.col("text"), v)
    return fixtures.select("id", "text", "expected", r["kind"].alias("actual")).withColumn(
        "ok", F.col("expected") == F.col("actual")
    )


# -- propagation to lines ----------------------------------------------------------------------


def propagate(lines: DataFrame, patches: DataFrame, attribute: str, trigger: str) -> DataFrame:
    """Fill a missing attribute of every line whose trigger text a new entry decides.

    ``patches`` (match, value, provenance), one per match. The line leaves review when nothing else
    holds it. Lines that wait for nothing get keys that no entry has, spread by line, so that they do
    not meet under one null key.
    """
    table = patches.groupBy(X.compare_key("match").alias("needle")).agg(
        F.min_by(F.struct("value", "provenance"), "match").alias("patch")
    )
    mine = F.coalesce(F.when(F.col(attribute).isNull(), X.compare_key(trigger)), X.unmatched_key("line_id"))
    hit = F.col("patch").isNotNull()
    others = F.filter("reasons", lambda r: ~F.coalesce(r["attribute"] == attribute, F.lit(False)))
    return (
        lines.withColumn("needle", mine)
        .join(table, "needle", "left")
        .withColumns(
            {
                attribute: F.coalesce(attribute, "patch.value"),
                f"{attribute}_prov": F.coalesce("patch.provenance", f"{attribute}_prov"),
                "reasons": F.when(hit, others).otherwise(F.col("reasons")),
            }
        )
        .withColumn("status", F.when(F.size("reasons") == 0, "RESUELTA").otherwise(F.col("status")))
        .drop("needle", "patch")
    )


def overlay_corrections(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """Human values over single cells, marked as corrected.

    ``corrections`` (line_id, attribute, value, seq) become one map per line, so a line joins once.
    """
    latest = corrections.groupBy("line_id", "attribute").agg(F.max_by("value", "seq").alias("value"))
    maps = latest.groupBy("line_id").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "value"))).alias("fix"))
    j = lines.join(maps, "line_id", "left")
    changes = {}
    for a in T.ATTRIBUTES:
        fixed = F.coalesce(F.map_contains_key("fix", a), F.lit(False))
        changes[a] = F.when(fixed, F.col("fix")[a]).otherwise(F.col(a))
        changes[f"{a}_prov"] = F.when(fixed, "human_corrected").otherwise(F.col(f"{a}_prov"))
    return j.withColumns(changes).drop("fix")
