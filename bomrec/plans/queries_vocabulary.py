"""Queries over vocabularies, corrections, suggestions and their guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from bomrec.functions import closed_tables as T
from bomrec.operators import catalog, learning, normalize
from bomrec.operators.catalog import Vocabulary
from bomrec.plans import lens
from bomrec.plans.registry import part_lines, query, values_sql

ENTRIES = lens.ENTRIES_SQL
V = Vocabulary.closed()


def _n():
    return F.count(F.lit(1)).alias("n")


def _entries(spark, sf):
    return catalog.current_entries(lens.frame(spark, sf, lens.VOCABULARY_LOG))


@query("W3_current_entries", f"SELECT id, attribute, alias, kind, value, source, decided_at, retired_at FROM ({ENTRIES}) AS e")
def _(spark, sf):
    return _entries(spark, sf)


@query("U7_L5_live_entries", f"SELECT id, alias FROM ({ENTRIES}) AS e WHERE retired_at IS NULL ORDER BY decided_at, id")
def _(spark, sf):
    return catalog.in_decision_order(catalog.live(_entries(spark, sf))).select("id", "alias")


@query("U7_retired_entries", f"SELECT id, retired_at FROM ({ENTRIES}) AS e WHERE retired_at IS NOT NULL")
def _(spark, sf):
    return catalog.retired(_entries(spark, sf)).select("id", "retired_at")


@query(
    "U4_finish_catalog",
    f"SELECT CAST(pos AS INT) AS pos, finish FROM {values_sql([(n, f) for n, f in enumerate(T.FINISH_CATALOG)], 'pos, finish')} AS c UNION ALL "
    f"SELECT DISTINCT 7, value FROM ({ENTRIES}) AS e WHERE retired_at IS NULL AND kind = 'alias' AND value IS NOT NULL AND value NOT IN ("
    + ", ".join(f"'{f}'" for f in T.FINISH_CATALOG) + ")",
)
def _(spark, sf):
    return catalog.finish_catalog(_entries(spark, sf))


@query("A24_alias_audit", f"SELECT attribute, CAST(count(*) FILTER (source = 'client') AS BIGINT) AS client, CAST(count(*) FILTER (source = 'added') AS BIGINT) AS added FROM ({ENTRIES}) AS e GROUP BY attribute")
def _(spark, sf):
    return catalog.alias_audit(_entries(spark, sf))


_CLOSED_ROWS = (
    [("name", t, v) for v, (c, a) in T.NAME_ALIASES.items() for t in (*c, *a)]
    + [("finish", t, v) for v, (_, c, a) in T.FINISH_ALIASES.items() for t in (*c, *a)]
    + [("standard", d, i) for d, i in T.STANDARD_EQUIVALENCES.items()]
    + [("quality", q, g) for g, m in T.QUALITY_GROUPS.items() for q in m]
    + [("material", t, v) for v, (c, a) in T.MATERIAL_ALIASES.items() for t in (*c, *a)]
    + [("material", value, m) for _, _, value, m in T.MATERIAL_DERIVATIONS]
)


@query(
    "U1_unified_vocabulary",
    f"SELECT attribute, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT value) AS BIGINT) AS n_values FROM (SELECT attribute, alias, value FROM {values_sql(_CLOSED_ROWS, 'attribute, alias, value')} AS c UNION ALL SELECT attribute, alias, value FROM ({ENTRIES}) AS e WHERE retired_at IS NULL) AS u GROUP BY attribute",
)
def _(spark, sf):
    closed = catalog.vocabulary_frame(spark).select("attribute", "alias", "value")
    added = catalog.live(_entries(spark, sf)).select("attribute", "alias", "value")
    return closed.unionByName(added).groupBy("attribute").agg(_n(), F.count_distinct("value").alias("n_values"))


_GROUP_ENTRIES = "SELECT 'q' || CAST(p_partkey AS STRING) AS id, p_name || ' ' || CAST(p_partkey AS STRING) AS alias, CASE WHEN p_partkey % 3 = 0 THEN 'G1' ELSE 'V-' || p_type END AS value, CAST(NULL AS STRING) AS retired_at FROM {part}"


@query(
    "A37_quality_groups",
    f"SELECT group_id, false AS own, CAST(count(*) AS BIGINT) AS n_members FROM {values_sql([(g, q) for g, m in T.QUALITY_GROUPS.items() for q in m], 'group_id, member')} AS c GROUP BY group_id "
    f"UNION ALL SELECT value, true, CAST(count(*) AS BIGINT) FROM ({lens.sql(_GROUP_ENTRIES)}) AS e WHERE value LIKE 'V-%' GROUP BY value",
)
def _(spark, sf):
    members = catalog.quality_groups(lens.frame(spark, sf, _GROUP_ENTRIES))
    return members.groupBy("group_id", "own").agg(F.count(F.lit(1)).alias("n_members"))


@query(
    "A26_catalogue_coverage",
    lens.expected(
        f"SELECT kind, CAST(count(o.v) AS BIGINT) AS exercised, CAST(count(*) AS BIGINT) AS defined FROM (SELECT 'name' AS kind, value AS v0 FROM {values_sql([(n, ) for n in T.NAME_ALIASES], 'value')} AS a UNION ALL SELECT 'finish', value FROM {values_sql([(f, ) for f in T.FINISH_CATALOG], 'value')} AS b UNION ALL SELECT 'quality_group', value FROM {values_sql([(g, ) for g in T.QUALITY_GROUPS], 'value')} AS c) AS d "
        "LEFT JOIN (SELECT DISTINCT 'name' AS k, name AS v FROM lines UNION SELECT DISTINCT 'finish', finish FROM lines UNION SELECT DISTINCT 'quality_group', quality_group FROM lines) AS o ON o.k = d.kind AND o.v = d.v0 GROUP BY kind"
    ),
)
def _(spark, sf):
    values = [("name", n) for n in T.NAME_ALIASES] + [("finish", f) for f in T.FINISH_CATALOG] + [("quality_group", g) for g in T.QUALITY_GROUPS]
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("name", "finish", "quality_group")])
    observed = part_lines(spark, sf).select(F.inline(cells)).filter("value is not null")
    return catalog.catalogue_coverage(spark.createDataFrame(values, "kind string, value string"), observed)


@query(
    "J2_exact_alias",
    f"SELECT noun, v.value, CAST(count(*) AS BIGINT) AS n FROM ({lens.sql(lens.PIECES)}) AS p LEFT JOIN {values_sql([(t, v) for v, (c, a) in T.NAME_ALIASES.items() for t in (*c, *a)], 'alias, value')} AS v ON v.alias = upper(strip_accents(noun)) GROUP BY noun, v.value",
)
def _(spark, sf):
    from bomrec.operators import detect

    nouns = lens.frame(spark, sf, lens.PIECES).groupBy("noun").agg(_n())
    names = catalog.vocabulary_frame(spark).filter("attribute = 'name'")
    return detect.exact_alias(nouns, "noun", names).select("noun", "value", "n")


_FINISH_TEXTS = """
SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'zincado' WHEN 1 THEN 'hot dip galv electrolitico' WHEN 2 THEN 'Black / ZN'
  WHEN 3 THEN o_orderpriority WHEN 4 THEN 'acabado  pavonada mate' ELSE 'GALVANIZED' END AS raw FROM {orders}
"""


@query(
    "J4_finish_resolution",
    f"SELECT k, CASE k % 6 WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'unknown' ELSE 'known' END AS kind, CASE k % 6 WHEN 0 THEN 'CINCADO' WHEN 1 THEN 'CINCADO' WHEN 4 THEN 'PAVONADO' WHEN 5 THEN 'GALVANIZADO EN CALIENTE' END AS finish FROM ({lens.sql(_FINISH_TEXTS)}) AS t",
)
def _(spark, sf):
    t = lens.frame(spark, sf, _FINISH_TEXTS).withColumn("r", normalize.resolve_finish(F.col("raw"), V))
    return t.select("k", "r.kind", "r.finish")


@query(
    "J27_unknown_finish",
    f"SELECT upper(raw) AS value_key, CAST(count(*) AS BIGINT) AS n FROM ({lens.sql(_FINISH_TEXTS)}) AS t WHERE k % 6 IN (2, 3) GROUP BY 1",
)
def _(spark, sf):
    t = lens.frame(spark, sf, _FINISH_TEXTS).withColumn("r", normalize.resolve_finish(F.col("raw"), V))
    return t.filter(F.col("r.kind").isin("unknown", "ambiguous")).groupBy(F.upper("raw").alias("value_key")).agg(_n())


@query(
    "J30_fixture_check",
    f"SELECT k AS id, raw AS text, CASE k % 6 WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'unknown' ELSE 'known' END AS actual, CASE WHEN k % 7 = 0 THEN 'unknown' ELSE 'known' END AS expected, CASE k % 6 WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'unknown' ELSE 'known' END = CASE WHEN k % 7 = 0 THEN 'unknown' ELSE 'known' END AS ok FROM ({lens.sql(_FINISH_TEXTS)}) AS t",
)
def _(spark, sf):
    f = lens.frame(spark, sf, _FINISH_TEXTS)
    return learning.fixture_check(
        f.select(F.col("k").alias("id"), F.col("raw").alias("text"), F.when(F.col("k") % 7 == 0, "unknown").otherwise("known").alias("expected")), V
    )


# -- corrections and suggestions ------------------------------------------------------------------

_C, _S = lens.sql(lens.CORRECTIONS), lens.sql(lens.SUGGESTIONS)
_CONFLICT = f"conflict AS (SELECT row_ref, attribute, evidence, count(*) AS n, count(DISTINCT coalesce(trim(value), '')) AS v FROM ({_C}) AS c WHERE status IN ('PENDING', 'APPROVED') GROUP BY 1, 2, 3 HAVING count(DISTINCT coalesce(trim(value), '')) > 1)"


@query("A14_value_conflicts", f"WITH {_CONFLICT} SELECT row_ref, attribute, evidence, CAST(v AS BIGINT) AS n_values, CAST(n AS BIGINT) AS n_corrections FROM conflict")
def _(spark, sf):
    return learning.value_conflicts(lens.frame(spark, sf, lens.CORRECTIONS))


@query("A14_conflicting_corrections", f"WITH {_CONFLICT} SELECT id, status FROM ({_C}) AS c JOIN conflict USING (row_ref, attribute, evidence) WHERE status IN ('PENDING', 'APPROVED')")
def _(spark, sf):
    return learning.conflicting_corrections(lens.frame(spark, sf, lens.CORRECTIONS)).select("id", "status")


@query(
    "A13_correction_kpi",
    f"WITH {_CONFLICT}, k AS (SELECT " + ", ".join(f"count(*) FILTER (status = '{s.upper()}') AS {s}" for s in ("pending", "approved", "promoted", "rejected"))
    + f", (SELECT count(*) FROM conflict) AS conflicts FROM ({_C}) AS c) SELECT CAST(pending AS BIGINT) AS pending, CAST(approved AS BIGINT) AS approved, CAST(promoted AS BIGINT) AS promoted, CAST(rejected AS BIGINT) AS rejected, CAST(conflicts AS BIGINT) AS conflicts, round(CAST(conflicts AS DOUBLE) / (conflicts + approved + rejected + promoted), 6) AS conflict_rate, CAST(0 AS BIGINT) AS promoted_verified, CAST(0 AS BIGINT) AS promoted_wrong, CAST(NULL AS DOUBLE) AS silent_error_rate FROM k",
)
def _(spark, sf):
    return learning.correction_kpi(lens.frame(spark, sf, lens.CORRECTIONS))


@query("W9_correction_status", f"SELECT id, arg_max(action, seq) AS status FROM ({lens.sql(lens.STATUS_EVENTS)}) AS e GROUP BY id")
def _(spark, sf):
    return learning.current_status(lens.frame(spark, sf, lens.STATUS_EVENTS))


@query(
    "G11_transitions",
    f"SELECT id, seq, action, previous, CASE WHEN previous IS NULL THEN action = 'PENDING' ELSE (previous = 'PENDING' AND action IN ('APPROVED', 'REJECTED')) OR (previous = 'APPROVED' AND action IN ('REJECTED', 'PROMOTED')) END AS valid FROM (SELECT *, lag(action) OVER (PARTITION BY id ORDER BY seq) AS previous FROM ({lens.sql(lens.STATUS_EVENTS)}) AS e) AS x",
)
def _(spark, sf):
    return learning.transitions(lens.frame(spark, sf, lens.STATUS_EVENTS), learning.CORRECTION_MOVES, "PENDING")


# Moves of every suggestion, many of which its status does not allow: some accepted twice, validated too early or
# rejected after they were accepted, and some never shown.
_MOVES = (
    "SELECT o_orderkey AS id, 1 AS seq, CASE WHEN o_orderkey % 13 = 0 THEN 'ACCEPTED' WHEN o_orderkey % 4 = 1 THEN 'VALIDATED' ELSE 'SHOWN' END AS action FROM {orders} "
    "UNION ALL SELECT o_orderkey, 2, CASE o_orderkey % 3 WHEN 0 THEN 'SHOWN' WHEN 1 THEN 'ACCEPTED' ELSE 'REJECTED' END FROM {orders} WHERE o_orderkey % 26 <> 0 "
    "UNION ALL SELECT o_orderkey, 3, CASE o_orderkey % 5 WHEN 0 THEN 'VALIDATED' WHEN 1 THEN 'REJECTED' ELSE 'ACCEPTED' END FROM {orders} "
    "UNION ALL SELECT o_orderkey, 4, 'VALIDATED' FROM {orders} WHERE o_orderkey % 2 = 0"
)


@query(
    "G11_suggestion_moves",
    lens.sql(
        f"WITH e AS ({_MOVES}), s0 AS (SELECT id, min(seq) AS at FROM e WHERE action = 'SHOWN' GROUP BY id), "
        "s1 AS (SELECT e.id, min(seq) AS at, arg_min(action, seq) AS action FROM e JOIN s0 ON s0.id = e.id AND e.seq > s0.at WHERE action IN ('ACCEPTED', 'REJECTED') GROUP BY e.id), "
        "s2 AS (SELECT e.id, min(seq) AS at FROM e JOIN s1 ON s1.id = e.id AND e.seq > s1.at AND s1.action = 'ACCEPTED' WHERE e.action = 'VALIDATED' GROUP BY e.id), "
        "n AS (SELECT id, count(*) AS n FROM e GROUP BY id) "
        "SELECT n.id, CASE WHEN s2.id IS NOT NULL THEN 'VALIDATED' WHEN s1.id IS NOT NULL THEN s1.action WHEN s0.id IS NOT NULL THEN 'SHOWN' END AS status, "
        "concat_ws('>', CASE WHEN s0.id IS NOT NULL THEN 'SHOWN' END, s1.action, CASE WHEN s2.id IS NOT NULL THEN 'VALIDATED' END) AS moves, "
        "CAST(n - (s0.id IS NOT NULL)::INT - (s1.id IS NOT NULL)::INT - (s2.id IS NOT NULL)::INT AS BIGINT) AS refused "
        "FROM n LEFT JOIN s0 ON s0.id = n.id LEFT JOIN s1 ON s1.id = n.id LEFT JOIN s2 ON s2.id = n.id"
    ),
)
def _(spark, sf):
    applied = learning.applied_transitions(lens.frame(spark, sf, _MOVES), learning.SUGGESTION_MOVES, "SHOWN")
    return applied.select("id", "status", F.array_join("moves", ">").alias("moves"), "refused")


@query("G11_suggestion_verification", f"SELECT status, verified IS NULL OR status IN ('ACCEPTED', 'VALIDATED') AS valid, CAST(count(*) AS BIGINT) AS n FROM ({_S}) AS s GROUP BY 1, 2")
def _(spark, sf):
    return learning.valid_verifications(lens.frame(spark, sf, lens.SUGGESTIONS)).groupBy("status", "valid").agg(_n())


@query("F22_promotion_class", f"SELECT attribute, id % 4 = 0 AS conflict, CASE WHEN id % 4 = 0 THEN 'policy_decision' WHEN attribute IN ('measure', 'length') THEN 'not_promotable' WHEN attribute = 'quantity' THEN 'gold_proposal' ELSE 'vocab_alias' END AS class, CAST(count(*) AS BIGINT) AS n FROM ({_C}) AS c GROUP BY 1, 2, 3")
def _(spark, sf):
    c = lens.frame(spark, sf, lens.CORRECTIONS).withColumn("conflict", F.col("id") % 4 == 0)
    return c.groupBy("attribute", "conflict", learning.promotion_class(F.col("attribute"), F.col("conflict")).alias("class")).agg(_n())


@query(
    "G10_correction_intake",
    f"SELECT id, CASE WHEN trim(evidence) = '' THEN 'missing_evidence' WHEN trim(rationale) = '' THEN 'missing_rationale' WHEN r.row_ref IS NULL OR NOT contains(upper(source_text), upper(trim(evidence))) THEN 'evidence_not_in_row' WHEN run_id = 'run-9' THEN 'unknown_run' END AS rejection "
    f"FROM (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 'customer#0' ELSE evidence END AS evidence) FROM ({_C}) AS c0) AS c LEFT JOIN ({lens.sql(lens.CUSTOMER_ROWS)}) AS r ON r.row_ref = c.row_ref",
)
def _(spark, sf):
    c = lens.frame(spark, sf, lens.CORRECTIONS).withColumn(
        "evidence", F.when(F.col("id") % 3 == 0, "customer#0").otherwise(F.col("evidence"))
    )
    known = lens.frame(spark, sf, "SELECT DISTINCT 'run-' || CAST(n_nationkey % 5 AS STRING) AS run_id FROM {nation}")
    return learning.correction_intake(c, lens.frame(spark, sf, lens.CUSTOMER_ROWS), known).select("id", "rejection")


@query(
    "G12_suggestion_intake",
    f"SELECT id, CASE WHEN attribute = 'quality' THEN 'attribute_out_of_scope' WHEN trim(value) = '' THEN 'missing_value' WHEN trim(match) = '' THEN 'missing_match' WHEN origin = 'model' THEN 'invalid_origin' WHEN r.row_ref IS NULL OR NOT contains(upper(source_text), upper(match)) THEN 'match_not_in_row' END AS rejection FROM ({_S}) AS s LEFT JOIN ({lens.sql(lens.CUSTOMER_ROWS)}) AS r ON r.row_ref = s.row_ref",
)
def _(spark, sf):
    return learning.suggestion_intake(lens.frame(spark, sf, lens.SUGGESTIONS), lens.frame(spark, sf, lens.CUSTOMER_ROWS)).select("id", "rejection")


_FUNNEL = "count(*) AS shown, count(*) FILTER (status = 'SHOWN') AS pending, count(*) FILTER (status IN ('ACCEPTED', 'VALIDATED')) AS accepted, count(*) FILTER (status = 'VALIDATED') AS validated, count(*) FILTER (status = 'REJECTED') AS rejected, count(*) FILTER (status IN ('ACCEPTED', 'VALIDATED') AND verified IS NOT NULL) AS verified, count(*) FILTER (status IN ('ACCEPTED', 'VALIDATED') AND verified = 'wrong') AS wrong"


@query(
    "A12_suggestion_kpi",
    "SELECT attribute, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("shown", "pending", "accepted", "validated", "rejected", "verified", "wrong"))
    + f", round(CAST(accepted AS DOUBLE) / nullif(accepted + rejected, 0), 6) AS acceptance_rate, round(CAST(wrong AS DOUBLE) / nullif(verified, 0), 6) AS silent_error_rate FROM (SELECT attribute, {_FUNNEL} FROM ({_S}) AS s GROUP BY GROUPING SETS ((), (attribute))) AS f",
)
def _(spark, sf):
    return learning.suggestion_kpi(lens.frame(spark, sf, lens.SUGGESTIONS))


_CLIENT_NAMES = values_sql([(t, v) for v, (c, a) in T.NAME_ALIASES.items() for t in (*c, *a)], "alias, value")


@query(
    "G13_promotions",
    f"""WITH {_CONFLICT}, x AS (SELECT c.*, trim(c.evidence) AS al, trim(coalesce(c.value, '')) AS tg, k.v IS NOT NULL AS clash FROM ({_C}) AS c LEFT JOIN conflict AS k USING (row_ref, attribute, evidence)),
y AS (SELECT *, CASE WHEN clash THEN 'policy_decision' WHEN attribute IN ('measure', 'length') THEN 'not_promotable' WHEN attribute = 'quantity' THEN 'gold_proposal' ELSE 'vocab_alias' END AS cls,
  CASE attribute WHEN 'name' THEN al = 'BOLT' WHEN 'quality' THEN al = '8.8' WHEN 'standard' THEN al = 'DIN 933' ELSE false END AS client,
  CASE attribute WHEN 'name' THEN CASE WHEN tg = 'TORNILLO' THEN 'TORNILLO' END WHEN 'quality' THEN CASE WHEN tg = '10.9' THEN tg END WHEN 'standard' THEN CASE WHEN tg = 'ISO 4014' THEN tg END WHEN 'material' THEN CASE WHEN tg = 'AC' THEN tg END
    WHEN 'finish' THEN CASE WHEN tg = 'no-acabado' THEN 'not_a_finish' ELSE nullif(upper(tg), '') END END AS target FROM x),
z AS (SELECT *, CASE WHEN status <> 'APPROVED' THEN 'not_approved' WHEN cls <> 'vocab_alias' THEN cls WHEN al = '' THEN 'missing_alias' WHEN client THEN 'alias_in_client_layer' WHEN target IS NULL THEN 'invalid_target' END AS refusal FROM y)
SELECT id, row_ref, attribute, refusal, CASE WHEN refusal IS NULL THEN 'add' END AS action, CASE WHEN refusal IS NULL THEN CASE WHEN attribute = 'finish' AND tg = 'no-acabado' THEN 'not_a_finish' WHEN attribute = 'material' THEN 'pattern' ELSE 'alias' END END AS kind,
  CASE WHEN refusal IS NULL THEN CASE WHEN attribute = 'material' THEN '^' || replace(upper(al), '.', '\\.') || '$' ELSE al END END AS alias, CASE WHEN refusal IS NULL AND target <> 'not_a_finish' THEN target END AS value FROM z""",
)
def _(spark, sf):
    return learning.promotions(lens.frame(spark, sf, lens.CORRECTIONS), V)


# -- write guards ------------------------------------------------------------------------------------

_CAND = lens.sql(lens.CANDIDATES)


def _candidates(spark, sf):
    return lens.frame(spark, sf, lens.CANDIDATES)


@query("G1_duplicate_ids", f"SELECT id, alias FROM ({_CAND}) AS c WHERE id IN (SELECT id FROM ({ENTRIES}) AS e)")
def _(spark, sf):
    return learning.duplicate_ids(_candidates(spark, sf), _entries(spark, sf)).select("id", "alias")


_KEY = "CASE WHEN {0}.kind = 'not_a_finish' THEN 'not_a_finish' ELSE 'alias:' || {0}.value END"


@query(
    "G2_ambiguity_clashes",
    f"SELECT c.id, min(e.id) AS clash_id FROM ({_CAND}) AS c JOIN ({ENTRIES}) AS e ON e.attribute = c.attribute AND upper(trim(e.alias)) = upper(trim(c.alias)) WHERE e.retired_at IS NULL GROUP BY c.id, c.kind, c.value HAVING bool_or({_KEY.format('e')} <> {_KEY.format('c')})",
)
def _(spark, sf):
    return learning.ambiguity_clashes(_candidates(spark, sf), _entries(spark, sf)).select("id", "clash_id")


@query("G3_layer_one_conflicts", f"SELECT id, 'G3' AS catalog_group, CASE WHEN value = 'G3' THEN 'redundant' ELSE 'contradiction' END AS finding FROM ({_CAND}) AS c WHERE alias = 'A4-70'")
def _(spark, sf):
    found = learning.layer_one_conflicts(_candidates(spark, sf), V)
    return found.select("id", "catalog_group", "finding")


@query("G4_short_aliases", f"SELECT id FROM ({_CAND}) AS c WHERE length(trim(alias)) < 3")
def _(spark, sf):
    return learning.short_aliases(_candidates(spark, sf)).select("id")


@query(
    "G8_structural_errors",
    f"SELECT id, error FROM (SELECT id, CASE WHEN trim(alias) = '' THEN 'missing_alias' WHEN attribute = 'finish' AND kind = 'alias' AND coalesce(trim(value), '') = '' THEN 'alias_without_finish' WHEN attribute = 'finish' AND kind = 'not_a_finish' AND coalesce(trim(value), '') <> '' THEN 'not_a_finish_with_value' WHEN attribute = 'quality_group' AND coalesce(value, '') NOT IN ('G3', 'V-X1') THEN 'unknown_group' WHEN attribute = 'material' AND coalesce(value, '') <> 'AC' THEN 'unknown_material' END AS error FROM ({_CAND}) AS c) AS x WHERE error IS NOT NULL",
)
def _(spark, sf):
    return learning.structural_errors(_candidates(spark, sf)).select("id", "error")


@query(
    "G5_finish_regression",
    f"SELECT raw, 'known|PAVONADO|seed-pavonado-pavonada' AS before, 'ambiguous' AS after FROM ({lens.sql(_FINISH_TEXTS)}) AS t WHERE k % 6 = 4 GROUP BY raw UNION ALL "
    f"SELECT raw, 'unknown', 'known|MATE|new-low' FROM ({lens.sql(_FINISH_TEXTS)}) AS t WHERE raw = '5-LOW' GROUP BY raw",
)
def _(spark, sf):
    new = lens.frame(
        spark, sf,
        "SELECT DISTINCT 'finish' AS attribute, CASE WHEN r_regionkey % 2 = 0 THEN 'new-mate' ELSE 'new-low' END AS id, CASE WHEN r_regionkey % 2 = 0 THEN 'MATE' ELSE '5-LOW' END AS alias, 'alias' AS kind, 'MATE' AS value, 'added' AS source, '2027-01-01' AS decided_at FROM {region}",
    )
    return learning.finish_regressions(lens.frame(spark, sf, _FINISH_TEXTS), "raw", V, V.with_entries(new))


@query(
    "G5_quality_regression",
    lens.sql("SELECT 'GR ' || CAST(p_size AS VARCHAR) AS raw, 'out' AS before, 'vocab|V-R|r' || CAST(p_size AS VARCHAR) AS after FROM {part} WHERE p_size < 5 GROUP BY p_size"),
)
def _(spark, sf):
    new = lens.frame(spark, sf, "SELECT 'quality_group' AS attribute, 'r' || CAST(r_regionkey AS STRING) AS id, 'gr ' || CAST(r_regionkey AS STRING) AS alias, 'alias' AS kind, 'V-R' AS value, 'added' AS source, '2027-01-01' AS decided_at FROM {region}")
    samples = lens.frame(spark, sf, "SELECT 'GR ' || CAST(p_size AS STRING) AS raw FROM {part}")
    return learning.quality_regressions(samples, "raw", V, V.with_entries(new))


_DECL = "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'group' ELSE 'pattern' END AS kind, CASE WHEN c_custkey % 2 = 0 THEN 'G' || CAST(c_custkey % 14 + 1 AS STRING) ELSE '^GR ' || CAST(c_custkey AS STRING) || '$' END AS alias, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE 'hardness' END AS why FROM {customer}"


@query("G6_uncovered_declarations", f"SELECT c_custkey, CASE WHEN trim(why) = '' THEN 'missing_reason' WHEN alias IN ('G1', 'G2', 'G3', 'G4', 'G5', 'G6', 'G7', 'G8', 'G9') THEN 'still_derives' END AS finding FROM ({lens.sql(_DECL)}) AS d")
def _(spark, sf):
    derivations = spark.createDataFrame([(k, v) for _, k, v, _m in T.MATERIAL_DERIVATIONS], "kind string, alias string")
    return learning.uncovered_declarations(lens.frame(spark, sf, _DECL), derivations).select("c_custkey", "finding")


_TAKEN = "SELECT 's-' || CAST(p_partkey % 50 AS STRING) AS id, CASE WHEN p_partkey % 50 < 25 THEN 'x' END AS retired_at FROM {part} UNION ALL SELECT 's-' || CAST(p_partkey % 50 AS STRING) || '-' || CAST(p_partkey % 3 + 2 AS STRING), 'x' FROM {part} WHERE p_partkey % 50 < 10 AND p_partkey % 3 < 2"


@query(
    "G7_id_allocation",
    lens.sql("WITH t AS (" + _TAKEN + ") SELECT w AS wanted_id, CASE WHEN n < 25 THEN w || '-' || CAST(CASE WHEN (w || '-2') NOT IN (SELECT id FROM t) THEN 2 WHEN (w || '-3') NOT IN (SELECT id FROM t) THEN 3 ELSE 4 END AS VARCHAR) ELSE w END AS allocated_id FROM (SELECT DISTINCT c_custkey % 60 AS n, 's-' || CAST(c_custkey % 60 AS VARCHAR) AS w FROM {customer}) AS c"),
)
def _(spark, sf):
    wanted = lens.frame(spark, sf, "SELECT DISTINCT 's-' || CAST(c_custkey % 60 AS STRING) AS id FROM {customer}")
    return catalog.allocate_ids(wanted, lens.frame(spark, sf, _TAKEN))


_PREVIEW = f"SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN noun WHEN p_partkey % 4 = 1 THEN std WHEN p_partkey % 4 = 2 THEN quality ELSE fin END AS t FROM ({lens.PIECES}) AS p"


@query(
    "G9_preview",
    f"SELECT t, 'quality' AS attribute, t IN ('8.8', 'A4-70', '10', '200HV', '304', '12.9') AS known, CASE t WHEN '8.8' THEN '8.8' WHEN 'A4-70' THEN 'A4' WHEN '10' THEN '10' WHEN '200HV' THEN '200HV' WHEN '304' THEN 'A2' WHEN '12.9' THEN '12.9' END AS value FROM ({lens.sql(_PREVIEW)}) AS x UNION ALL "
    f"SELECT t, 'standard', t IN ('DIN 933', 'DIN 125 A', 'ASTM A193', 'ISO 4014'), CASE t WHEN 'DIN 933' THEN 'ISO 4017' WHEN 'DIN 125 A' THEN 'ISO 7089' WHEN 'ASTM A193' THEN t WHEN 'ISO 4014' THEN t END FROM ({lens.sql(_PREVIEW)}) AS x UNION ALL "
    f"SELECT t, 'name', v.value IS NOT NULL, v.value FROM ({lens.sql(_PREVIEW)}) AS x LEFT JOIN {_CLIENT_NAMES} AS v ON v.alias = upper(strip_accents(t)) UNION ALL "
    f"SELECT t, 'finish', t IN ('zincado', 'HDG', 'Black', 'géomet'), CASE t WHEN 'zincado' THEN 'CINCADO' WHEN 'HDG' THEN 'GALVANIZADO EN CALIENTE' WHEN 'Black' THEN 'PAVONADO' WHEN 'géomet' THEN 'GEOMET' END FROM ({lens.sql(_PREVIEW)}) AS x UNION ALL "
    f"SELECT t, 'material', t IN ('8.8', 'A4-70', '10', 'GR B7', '200HV', '304', '12.9'), CASE WHEN t IN ('8.8', '10', 'GR B7', '12.9') THEN 'AC' WHEN t IN ('A4-70', '304') THEN 'INOX' END FROM ({lens.sql(_PREVIEW)}) AS x",
)
def _(spark, sf):
    return learning.preview(lens.frame(spark, sf, _PREVIEW), "t", V)


# -- propagation to lines ------------------------------------------------------------------------------


@query(
    "P14_propagation",
    lens.expected(
        "SELECT line_id, CASE WHEN material IS NULL AND quality = 'GR 99' THEN 'AC' ELSE material END AS material, CASE WHEN material IS NULL AND quality = 'GR 99' THEN 'derived' ELSE material_prov END AS material_prov, "
        "CASE WHEN material IS NULL AND quality = 'GR 99' AND reasons = 'UNMAPPED_VALUE' THEN 'RESUELTA' ELSE status END AS status FROM lines"
    ),
)
def _(spark, sf):
    patches = lens.frame(spark, sf, "SELECT DISTINCT 'gr  99' AS match, 'AC' AS value, 'derived' AS provenance FROM {part}")
    return learning.propagate(part_lines(spark, sf), patches, "material", "quality_raw").select("line_id", "material", "material_prov", "status")


_FIXES = "SELECT CAST(p_partkey AS STRING) || '.1' AS line_id, CASE p_partkey % 3 WHEN 0 THEN 'finish' WHEN 1 THEN 'length' ELSE 'quality' END AS attribute, p_brand AS value, 1 AS seq FROM {part} UNION ALL SELECT CAST(p_partkey AS STRING) || '.1', 'finish', p_type, 2 FROM {part} WHERE p_partkey % 2 = 0"


@query(
    "P15_correction_overlay",
    lens.expected(
        "SELECT line_id, CASE WHEN position = 1 AND k % 2 = 0 THEN p_type WHEN position = 1 AND k % 3 = 0 THEN p_brand ELSE finish END AS finish, CASE WHEN position = 1 AND (k % 2 = 0 OR k % 3 = 0) THEN 'human_corrected' ELSE finish_prov END AS finish_prov, "
        "CASE WHEN position = 1 AND k % 3 = 1 THEN p_brand ELSE length END AS length, CASE WHEN position = 1 AND k % 3 = 2 THEN p_brand ELSE quality END AS quality FROM (SELECT lines.*, p_partkey AS k, p_type, p_brand FROM lines JOIN part ON CAST(p_partkey AS VARCHAR) = row_ref) AS l"
    ),
)
def _(spark, sf):
    return learning.overlay_corrections(part_lines(spark, sf), lens.frame(spark, sf, _FIXES)).select("line_id", "finish", "finish_prov", "length", "quality")


