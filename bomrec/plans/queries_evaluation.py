"""Queries over gold labels, stored runs, revisions and KPI events."""

from __future__ import annotations

from pyspark.sql import functions as F

from bomrec.functions import closed_tables as T
from bomrec.functions import text as X
from bomrec.operators import evaluate, kpi, revisions, runs
from bomrec.plans import lens
from bomrec.plans.registry import part_lines, query, values_sql



def _with_reasons(df):
    reasons = F.when(F.col("reason_text") == "", X.strings([])).otherwise(F.split("reason_text", "\\|"))
    return df.withColumn("reasons", reasons).drop("reason_text")


def _gold(spark, sf):
    return _with_reasons(lens.frame(spark, sf, lens.GOLD))


def _system(spark, sf, text=lens.SYSTEM_A):
    return _with_reasons(lens.frame(spark, sf, text))


def _graded(spark, sf, text=lens.SYSTEM_A):
    return evaluate.graded(evaluate.align(_gold(spark, sf), _system(spark, sf, text)))


# -- check side: alignment and grading in SQL ---------------------------------------------------

_KEY = "nullif(nullif(upper(strip_accents(trim({}))), ''), '—')"
_CELLS = list(T.GRADED_CELLS)


def _pairs(system: str, n: str = "") -> str:
    g, s = lens.sql(lens.GOLD), lens.sql(system)
    return f"""
g{n} AS (SELECT *, count(*) OVER (PARTITION BY row_ref) AS n, row_number() OVER (PARTITION BY row_ref ORDER BY position) AS p,
  row_number() OVER (PARTITION BY row_ref, {_KEY.format('name')} ORDER BY position) AS k FROM ({g}) AS gg),
s{n} AS (SELECT *, count(*) OVER (PARTITION BY row_ref) AS n, row_number() OVER (PARTITION BY row_ref ORDER BY position) AS p,
  row_number() OVER (PARTITION BY row_ref, {_KEY.format('name')} ORDER BY position) AS k FROM ({s}) AS ss),
pairs{n} AS (SELECT g AS g, s AS s FROM g{n} AS g FULL JOIN s{n} AS s ON g.row_ref = s.row_ref AND
  ((g.n = s.n AND g.p = s.p) OR (g.n <> s.n AND {_KEY.format('g.name')} IS NOT DISTINCT FROM {_KEY.format('s.name')} AND g.k = s.k))),
graded{n} AS (SELECT coalesce(g.row_ref, s.row_ref) AS row_ref, g.gold_id AS gold_id, s.line_id AS line_id, s.file AS file,
  g.row_ref IS NOT NULL AND s.row_ref IS NOT NULL AS aligned, g.status AS gold_status, s.status AS system_status,
  coalesce(g.reason_text, '') AS gr, coalesce(s.reason_text, '') AS sr,
  coalesce(g.reason_text = 'OUT_OF_FAMILY', false) AS gold_out, coalesce(s.reason_text = 'OUT_OF_FAMILY', false) AS system_out,
  {", ".join(f"{_same(c)} AS {c}_ok, g.{c}_cert AS {c}_cert, g.{c}_prov AS {c}_gp, s.{c}_prov AS {c}_sp" for c in _CELLS)}
  FROM pairs{n}),
scored{n} AS (SELECT *, aligned AND {" AND ".join(f"({c}_cert <> 'C' OR {c}_ok)" for c in _CELLS)} AS certain_ok FROM graded{n})"""


def _same(c: str) -> str:
    if c == "quantity":
        return "g.quantity IS NOT DISTINCT FROM s.quantity"
    return f"{_KEY.format('g.' + c)} IS NOT DISTINCT FROM {_KEY.format('s.' + c)}"


def _scored(select: str, system: str = lens.SYSTEM_A) -> str:
    return f"WITH {_pairs(system)} {select}"


@query("J16_W5_alignment", _scored("SELECT row_ref, gold_id, line_id, aligned FROM scored"))
def _(spark, sf):
    return _graded(spark, sf).select("row_ref", "gold_id", "line_id", "aligned")


@query("A2_split_fidelity", f"SELECT CAST(count(*) FILTER (g = s) AS BIGINT) AS ok, CAST(count(*) AS BIGINT) AS total, round(100.0 * count(*) FILTER (g = s) / count(*), 6) AS pct FROM (SELECT row_ref, count(*) AS g FROM ({lens.sql(lens.GOLD)}) AS a GROUP BY row_ref) AS x FULL JOIN (SELECT row_ref, count(*) AS s FROM ({lens.sql(lens.SYSTEM_A)}) AS b GROUP BY row_ref) AS y USING (row_ref)")
def _(spark, sf):
    return evaluate.split_fidelity(_gold(spark, sf), _system(spark, sf))


_TRACE = " + ".join(f"CAST({c}_cert = 'C' AND {c}_ok AS INT)" for c in _CELLS)
_TRACE_OK = " + ".join(f"CAST({c}_cert = 'C' AND {c}_ok AND {c}_gp = {c}_sp AS INT)" for c in _CELLS)
_SET = "list_sort(list_filter(string_split({}, '|'), lambda r: r <> ''))"
_WIDE = f"""wide AS (SELECT
  count(*) FILTER (aligned AND system_status = 'RESUELTA' AND NOT certain_ok) AS silent_bad,
  count(*) FILTER (aligned AND system_status = 'RESUELTA') AS silent_total,
  count(*) FILTER (aligned AND NOT gold_out AND system_status = 'RESUELTA' AND certain_ok) AS useful_ok,
  count(gold_id) - count(*) FILTER (gold_out) AS useful_total,
  count(*) FILTER (aligned AND NOT gold_out AND system_status = 'REVISION_MANUAL' AND gold_status = 'RESUELTA') AS noise_bad,
  count(*) FILTER (aligned AND NOT gold_out AND system_status = 'REVISION_MANUAL') AS noise_total,
  count(*) FILTER (aligned AND gold_status = system_status) AS status_ok, count(*) FILTER (aligned) AS aligned_total,
  coalesce(sum({_TRACE_OK}) FILTER (aligned), 0) AS trace_ok, coalesce(sum({_TRACE}) FILTER (aligned), 0) AS trace_total,
  count(*) FILTER (aligned AND {_SET.format('gr')} = {_SET.format('sr')}) AS reason_ok,
  count(*) FILTER (gold_out) AS out_gold, count(*) FILTER (gold_out AND system_out) AS out_detected FROM scored)"""


def _metric(name: str, num: str, den: str, empty: float) -> str:
    return f"SELECT 'global' AS scope, '{name}' AS name, round(CASE WHEN {den} = 0 THEN {empty} ELSE 100.0 * {num} / {den} END, 6) AS value, CAST({num} AS BIGINT) AS num, CAST({den} AS BIGINT) AS den FROM wide"


_GLOBAL = " UNION ALL ".join(
    _metric(*m)
    for m in (
        ("silent_error_rate", "silent_bad", "silent_total", 0.0), ("useful_autonomy", "useful_ok", "useful_total", 0.0),
        ("queue_noise", "noise_bad", "noise_total", 0.0), ("status_agreement", "status_ok", "aligned_total", 0.0),
        ("trace_fidelity", "trace_ok", "trace_total", 100.0), ("reason_agreement", "reason_ok", "aligned_total", 0.0),
        ("out_of_scope_detected", "out_detected", "out_gold", 100.0),
    )
)


@query("A3_A4_A5_A6_A7_A9_A10_metrics", f"WITH {_pairs(lens.SYSTEM_A)}, {_WIDE} {_GLOBAL}")
def _(spark, sf):
    return evaluate.metric_rows(evaluate.line_metrics(_graded(spark, sf)))


_ACC = " UNION ALL ".join(
    f"SELECT '{c}' AS attribute, CAST(count(*) FILTER ({c}_cert = 'C' AND {c}_ok) AS BIGINT) AS ok_c, CAST(count(*) FILTER ({c}_cert = 'C') AS BIGINT) AS total_c, "
    f"CAST(count(*) FILTER ({c}_cert = 'P' AND {c}_ok) AS BIGINT) AS ok_p, CAST(count(*) FILTER ({c}_cert = 'P') AS BIGINT) AS total_p FROM scored WHERE aligned"
    for c in _CELLS
)
_PCT_C = "round(CASE WHEN total_c = 0 THEN 100.0 ELSE 100.0 * ok_c / total_c END, 6)"


@query("A8_attribute_accuracy", _scored(f"SELECT *, {_PCT_C} AS pct_c FROM ({_ACC}) AS a"))
def _(spark, sf):
    return evaluate.attribute_accuracy(_graded(spark, sf))


@query(
    "A11_metric_rows",
    f"WITH {_pairs(lens.SYSTEM_A)}, {_WIDE}, acc AS ({_ACC}) {_GLOBAL} UNION ALL SELECT 'global', 'split_fidelity', round(100.0 * count(*) FILTER (gn = sn) / count(*), 6), CAST(count(*) FILTER (gn = sn) AS BIGINT), CAST(count(*) AS BIGINT) "
    "FROM (SELECT row_ref, count(*) AS gn FROM g GROUP BY row_ref) AS x FULL JOIN (SELECT row_ref, count(*) AS sn FROM s GROUP BY row_ref) AS y USING (row_ref) "
    f"UNION ALL SELECT 'attribute', attribute, {_PCT_C}, ok_c, total_c FROM acc UNION ALL SELECT 'attribute_policy', attribute, round(100.0 * ok_p / total_p, 6), ok_p, total_p FROM acc WHERE total_p > 0",
)
def _(spark, sf):
    return evaluate.metrics(_gold(spark, sf), _system(spark, sf))


@query("A3_silent_errors", _scored("SELECT row_ref, line_id FROM scored WHERE aligned AND system_status = 'RESUELTA' AND NOT certain_ok"))
def _(spark, sf):
    return evaluate.silent_errors(_graded(spark, sf))


@query("A7_trace_mismatches", _scored(" UNION ALL ".join(f"SELECT line_id, '{c}' AS attribute, {c}_gp AS expected_prov, {c}_sp AS got_prov FROM scored WHERE aligned AND {c}_cert = 'C' AND {c}_ok AND {c}_gp <> {c}_sp" for c in _CELLS)))
def _(spark, sf):
    return evaluate.trace_mismatches(_graded(spark, sf))


@query(
    "U3_reason_differences",
    _scored(
        "SELECT row_ref, gold_id, line_id, 'missing' AS side, code FROM (SELECT *, unnest(string_split(gr, '|')) AS code FROM scored) AS a WHERE code <> '' AND NOT list_contains(string_split(sr, '|'), code) "
        "UNION ALL SELECT row_ref, gold_id, line_id, 'extra', code FROM (SELECT *, unnest(string_split(sr, '|')) AS code FROM scored) AS a WHERE code <> '' AND NOT list_contains(string_split(gr, '|'), code)"
    ),
)
def _(spark, sf):
    return evaluate.reason_differences(_graded(spark, sf))


@query("A10_out_of_scope_lines", _scored("SELECT row_ref, CASE WHEN gold_out THEN 'missed' ELSE 'false_positive' END AS outcome, CASE WHEN gold_out THEN gold_id ELSE line_id END AS id FROM scored WHERE gold_out <> system_out"))
def _(spark, sf):
    return evaluate.out_of_scope_lines(_graded(spark, sf))


@query(
    "A40_regrade_without_quantity",
    _scored(
        "SELECT file, CAST(count(*) FILTER (aligned AND system_status = 'RESUELTA' AND NOT (certain_ok OR (file IN ('f0', 'f3', 'f6', 'f9') AND "
        + " AND ".join(f"({c}_cert <> 'C' OR {c}_ok)" for c in _CELLS if c != "quantity")
        + "))) AS BIGINT) AS silent FROM scored WHERE file IS NOT NULL GROUP BY file"
    ),
)
def _(spark, sf):
    system = _system(spark, sf)
    files = system.select("file", (F.substring("file", 2, 1).cast("int") % 3 != 0).alias("has_quantity")).distinct()
    lines = _graded(spark, sf).join(system.select("line_id", "file"), "line_id")
    regraded = evaluate.without_unsupported_cells(lines, files)
    return regraded.groupBy("file").agg(
        F.count_if(F.col("aligned") & (F.col("system_status") == "RESUELTA") & ~F.col("certain_ok")).alias("silent")
    )


@query(
    "A33_reviewer_quality",
    _scored(
        "SELECT CAST(count(*) FILTER (d AND e) AS BIGINT) AS hits, CAST(count(*) FILTER (d AND NOT e) AS BIGINT) AS false_positives, CAST(count(*) FILTER (e AND NOT d) AS BIGINT) AS missed, "
        "round(100.0 * count(*) FILTER (d AND e) / count(*) FILTER (e), 6) AS recall, round(100.0 * count(*) FILTER (d AND e) / count(*) FILTER (d), 6) AS precision "
        "FROM (SELECT line_id, TRY_CAST(row_ref AS BIGINT) % 17 < 3 AS d, aligned AND system_status = 'RESUELTA' AND NOT certain_ok AS e FROM scored WHERE line_id IS NOT NULL) AS x"
    ),
)
def _(spark, sf):
    degraded = _system(spark, sf).filter("cast(row_ref AS bigint) % 17 < 3").select("line_id")
    return evaluate.reviewer_quality(degraded, evaluate.silent_errors(_graded(spark, sf)))


@query(
    "A35_gold_statistics",
    f"WITH g AS ({lens.sql(lens.GOLD)}) SELECT 'status' AS statistic, status AS key, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY status UNION ALL SELECT 'reason', code, CAST(count(*) AS BIGINT) FROM (SELECT unnest(string_split(reason_text, '|')) AS code FROM g WHERE reason_text <> '') AS r GROUP BY code "
    "UNION ALL SELECT 'lines_per_row', CAST(n AS VARCHAR), CAST(count(*) AS BIGINT) FROM (SELECT row_ref, count(*) AS n FROM g GROUP BY row_ref) AS x GROUP BY n UNION ALL "
    + " UNION ALL ".join(f"SELECT 'policy_cells', '{c}', CAST(count(*) FILTER ({c}_cert = 'P') AS BIGINT) FROM g" for c in _CELLS),
)
def _(spark, sf):
    return evaluate.gold_statistics(_gold(spark, sf))


_EXPECT = """
SELECT CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 3 = 0 THEN 'hole' ELSE 'must' END AS gate,
  CASE WHEN p_partkey % 2 = 0 THEN 2 END AS split, CASE WHEN p_partkey % 4 = 0 THEN 'TORNILLO' END AS name,
  CASE WHEN p_partkey % 5 = 0 THEN 'a4-70' END AS quality, CASE WHEN p_partkey % 7 = 0 THEN 'REVISION_MANUAL' END AS status,
  p_partkey % 9 = 0 AS none_resolved, CASE WHEN p_partkey % 10 = 0 THEN '8' END AS no_resolved_quality,
  CASE WHEN p_partkey % 6 = 1 THEN 'ISO 4017' END AS standard, p_partkey % 8 = 1 AS has_finish,
  CASE WHEN p_partkey % 13 = 1 THEN 'G3' END AS quality_group, CASE WHEN p_partkey % 12 = 1 THEN 'LENGTH_MISSING' END AS reason
FROM {part}
"""


@query(
    "A36_trap_results",
    lens.expected(
        f"SELECT e.id, e.gate, (e.split IS NULL OR e.split = a.n) AND (e.name IS NULL OR coalesce(e.name = p.name, false)) AND (e.quality IS NULL OR coalesce(upper(e.quality) = p.quality, false)) AND (e.status IS NULL OR e.status = p.status) "
        f"AND (NOT e.none_resolved OR a.r = 0) AND (e.no_resolved_quality IS NULL OR a.r8 = 0) AND (e.standard IS NULL OR coalesce(e.standard = p.standard, false)) AND (NOT e.has_finish OR p.finish IS NULL) AND (e.quality_group IS NULL OR coalesce(e.quality_group = p.quality_group, false)) "
        f"AND (e.reason IS NULL OR list_contains(string_split(p.reasons, '|'), e.reason)) AS ok FROM ({lens.sql(_EXPECT)}) AS e JOIN (SELECT * FROM lines WHERE position < 2) AS p ON p.row_ref = e.id "
        "JOIN (SELECT row_ref, count(*) AS n, count(*) FILTER (status = 'RESUELTA') AS r, count(*) FILTER (status = 'RESUELTA' AND quality = '8') AS r8 FROM lines GROUP BY row_ref) AS a ON a.row_ref = e.id"
    ),
)
def _(spark, sf):
    e = lens.frame(spark, sf, _EXPECT)
    e = e.withColumn("reasons", F.when(F.col("reason").isNotNull(), F.array("reason"))).drop("reason")
    e = e.withColumn("finish", F.lit(None).cast("string"))
    return evaluate.trap_results(part_lines(spark, sf), e)


# -- runs -----------------------------------------------------------------------------------------

_METRIC_LENS = """
SELECT 'model-' || CAST(l_suppkey % 8 AS STRING) AS model, 'run-' || CAST(l_suppkey % 8 AS STRING) AS run_id, 'global' AS scope,
  CASE l_linenumber % 4 WHEN 0 THEN 'silent_error_rate' WHEN 1 THEN 'useful_autonomy' WHEN 2 THEN 'split_fidelity' ELSE 'queue_noise' END AS name,
  CAST(max(l_partkey) % 100 AS DOUBLE) AS value FROM {lineitem} GROUP BY 1, 2, 3, 4
"""
# Two runs over all lines: they differ in values, and each has a metric that the other lacks.
_RUN_METRICS = "SELECT 'global' AS scope, CASE WHEN l_partkey % 40 = {skip} THEN 'own' || CAST({skip} AS STRING) WHEN l_partkey % 5 = 0 THEN 'silent_error_rate' WHEN l_partkey % 5 = 1 THEN 'cost_eur' WHEN l_partkey % 5 = 2 THEN 'latency_ms' ELSE 'm' || CAST(l_partkey % 40 AS STRING) END AS name, CASE WHEN min(l_partkey) % 11 = 3 THEN NULL ELSE max(CASE WHEN l_suppkey % 3 = {skip} THEN l_suppkey % 45 ELSE l_suppkey % (48 + l_partkey % 2 * {skip}) END) * 1.0 END AS value FROM {{lineitem}} GROUP BY 1, 2"
_BASE_M, _CAND_M = _RUN_METRICS.format(skip=1), _RUN_METRICS.format(skip=2)


@query(
    "J17_F23_compare_metrics",
    f"SELECT b.scope, b.name, CAST(b.value AS DOUBLE) AS base, CAST(c.value AS DOUBLE) AS candidate, CAST(c.value - b.value AS DOUBLE) AS delta, CASE WHEN b.value = c.value THEN 'unchanged' WHEN (b.name IN ('silent_error_rate', 'queue_noise', 'cost_eur', 'latency_ms')) = (c.value < b.value) THEN 'improved' ELSE 'regressed' END AS direction "
    f"FROM ({lens.sql(_BASE_M)}) AS b JOIN ({lens.sql(_CAND_M)}) AS c ON b.scope = c.scope AND b.name = c.name WHERE b.value IS NOT NULL AND c.value IS NOT NULL",
)
def _(spark, sf):
    both = [lens.frame(spark, sf, t).withColumn("value", F.col("value").cast("double")) for t in (_BASE_M, _CAND_M)]
    return runs.compare_metrics(*both)


@query(
    "J18_compare_lines",
    f"WITH {_pairs(lens.SYSTEM_A, 'a')}, {_pairs(lens.SYSTEM_B, 'b')}, d AS (SELECT coalesce(a.row_ref, b.row_ref) AS row_ref, coalesce(a.gold_id, b.gold_id) AS gold_id, CASE WHEN a.gold_id IS NULL OR b.gold_id IS NULL OR a.aligned <> b.aligned THEN 'split_changed' "
    "WHEN b.good AND NOT a.good THEN 'fixed' WHEN a.good AND NOT b.good THEN 'regressed' WHEN a.system_status IS DISTINCT FROM b.system_status THEN 'status_changed' END AS change "
    "FROM (SELECT *, coalesce(aligned AND system_status = 'RESUELTA' AND certain_ok, false) AS good FROM scoreda WHERE gold_id IS NOT NULL) AS a FULL JOIN (SELECT *, coalesce(aligned AND system_status = 'RESUELTA' AND certain_ok, false) AS good FROM scoredb WHERE gold_id IS NOT NULL) AS b ON a.row_ref = b.row_ref AND a.gold_id = b.gold_id) "
    "SELECT * FROM d WHERE change IS NOT NULL",
)
def _(spark, sf):
    return runs.compare_lines(_graded(spark, sf), _graded(spark, sf, lens.SYSTEM_B))


def _header(spark, sf, text, run, policies):
    data = runs.fingerprint(lens.frame(spark, sf, text), ["row_ref", "name", "quantity"])
    return data.select(F.lit(run).alias("run_id"), F.col("fingerprint").alias("dataset_fingerprint"), runs.policy_fingerprint(policies).alias("policy_fingerprint"))


@query("G14_F26_comparability", "SELECT 'run-a' AS base_run, 'run-b' AS candidate_run, 'dataset|policy' AS differs, count(*) > 0 AS has_data FROM part UNION ALL SELECT 'run-a', 'run-c', '', count(*) > 0 FROM part")
def _(spark, sf):
    gold = "SELECT row_ref, name, quantity FROM (" + lens.GOLD + ") AS g"
    shuffled = gold + " ORDER BY quantity DESC, row_ref"
    a = _header(spark, sf, gold, "run-a", {})
    b = _header(spark, sf, gold + " WHERE row_ref <> '1'", "run-b", {"missing_standard": "resolve"})
    c = _header(spark, sf, shuffled, "run-c", {})
    out = runs.incompatibilities(a, b).unionByName(runs.incompatibilities(a, c))
    return out.select("base_run", "candidate_run", F.array_join("differs", "|").alias("differs"), F.lit(True).alias("has_data"))


_RUNS = "SELECT 'run-' || CAST(s_suppkey AS STRING) AS run_id, s_acctbal AS created_at, s_nationkey AS n_rows, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE abs(s_acctbal) END AS cost_eur, CAST(s_suppkey * 1000 AS DOUBLE) AS latency_ms, s_suppkey % 3 <> 0 AS prices_configured FROM {supplier}"


@query("L1_latest_runs", f"SELECT run_id, created_at FROM ({lens.sql(_RUNS)}) AS r ORDER BY created_at DESC, run_id DESC LIMIT 20")
def _(spark, sf):
    return runs.latest(lens.frame(spark, sf, _RUNS), "created_at", 20, "run_id").select("run_id", "created_at")


@query("W8_latest_run", f"SELECT run_id, created_at FROM ({lens.sql(_RUNS)}) AS r ORDER BY created_at DESC, run_id DESC LIMIT 1")
def _(spark, sf):
    return runs.latest_run(lens.frame(spark, sf, _RUNS)).select("run_id", "created_at")


_USAGE = "SELECT CASE l_linenumber % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'cheap' ELSE 'critic' END AS tier, CAST(1 AS BIGINT) AS n_rows, CAST(l_quantity * 100 AS BIGINT) AS input, CAST(l_quantity * 10 AS BIGINT) AS cached, l_partkey AS output FROM {lineitem}"
_PRICES = [("main", 1.25, 0.125, 10.0), ("cheap", 0.25, 0.025, 2.0)]


@query(
    "A28_F25_usage_cost",
    f"SELECT u.tier, CAST(u.n_rows AS BIGINT) AS n_rows, CAST(input AS BIGINT) AS input, CAST(cached AS BIGINT) AS cached, CAST(output AS BIGINT) AS output, round(((input - cached) * p_in + cached * p_cached + output * p_out) / 1e6, 4) AS cost, round(CAST(input + output AS DOUBLE) / u.n_rows, 6) AS tokens_per_row, "
    "round(((input - cached) * p_in + cached * p_cached + output * p_out) / 1e6 / u.n_rows, 9) AS cost_per_row, round(((input - cached) * p_in + cached * p_cached + output * p_out) / 1e6 / u.n_rows * 20000 * 25, 3) AS project_cost "
    f"FROM (SELECT tier, CAST(sum(n_rows) AS DOUBLE) AS n_rows, CAST(sum(input) AS DOUBLE) AS input, CAST(sum(cached) AS DOUBLE) AS cached, CAST(sum(output) AS DOUBLE) AS output FROM ({lens.sql(_USAGE)}) AS x GROUP BY tier) AS u LEFT JOIN (SELECT tier, CAST(p_in AS DOUBLE) AS p_in, CAST(p_cached AS DOUBLE) AS p_cached, CAST(p_out AS DOUBLE) AS p_out FROM {values_sql(_PRICES, 'tier, p_in, p_cached, p_out')} AS v) AS p ON p.tier = u.tier",
)
def _(spark, sf):
    prices = spark.createDataFrame(_PRICES, "tier string, p_in double, p_cached double, p_out double")
    return runs.usage_cost(lens.frame(spark, sf, _USAGE), prices)


@query("A29_leaderboard", f"SELECT model, " + ", ".join(f"max(value) FILTER (name = '{n}') AS {n}" for n in ("split_fidelity", "silent_error_rate", "useful_autonomy", "queue_noise")) + f" FROM ({lens.sql(_METRIC_LENS)}) AS m GROUP BY model")
def _(spark, sf):
    return runs.leaderboard(lens.frame(spark, sf, _METRIC_LENS))


@query("A30_repetitions", lens.sql("SELECT l_suppkey, l_linenumber, CAST(count(l_quantity) AS BIGINT) AS runs, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS min, max(l_quantity) AS max FROM {lineitem} GROUP BY l_suppkey, l_linenumber"))
def _(spark, sf):
    return runs.repetitions(lens.frame(spark, sf, "SELECT l_suppkey, l_linenumber, l_quantity FROM {lineitem}"), ["l_suppkey", "l_linenumber"], "l_quantity")


_PASSES = "SELECT CAST(l_orderkey AS STRING) AS row_ref, l_suppkey AS pass_no, l_linenumber % 2 + 1 AS n_elements, l_returnflag = 'R' AS failed FROM {lineitem}"
_EXPECTED_N = "SELECT CAST(o_orderkey AS STRING) AS row_ref, CAST(o_orderkey % 2 + 1 AS INT) AS expected FROM {orders}"


@query("A31_split_stability", f"SELECT p.row_ref, CAST(count(*) FILTER (NOT failed) AS BIGINT) AS passes, CAST(count(*) FILTER (NOT failed AND n_elements = expected) AS BIGINT) AS hits, coalesce(min(n_elements) FILTER (NOT failed) = max(n_elements) FILTER (NOT failed), false) AS stable FROM ({lens.sql(_PASSES)}) AS p LEFT JOIN ({lens.sql(_EXPECTED_N)}) AS e ON e.row_ref = p.row_ref GROUP BY p.row_ref")
def _(spark, sf):
    return runs.split_stability(lens.frame(spark, sf, _PASSES), lens.frame(spark, sf, _EXPECTED_N)).drop("counts")


@query("A32_split_discrepancies", f"SELECT row_ref, CAST(coalesce(a, 0) AS BIGINT) AS n_first, CAST(coalesce(b, 0) AS BIGINT) AS n_second FROM (SELECT row_ref, count(*) AS a FROM ({lens.sql(lens.SYSTEM_A)}) AS x GROUP BY row_ref) AS x FULL JOIN (SELECT row_ref, count(*) AS b FROM ({lens.sql(lens.SYSTEM_B)}) AS y GROUP BY row_ref) AS y USING (row_ref) WHERE coalesce(a, 0) <> coalesce(b, 0)")
def _(spark, sf):
    return runs.split_discrepancies(lens.frame(spark, sf, lens.SYSTEM_A), lens.frame(spark, sf, lens.SYSTEM_B))


_ERRORS = "SELECT 'run-' || CAST(user_id % 10 AS STRING) AS run_id, CAST(event_id AS STRING) AS row_ref, CASE WHEN event_type = 'error' AND user_id % 10 < 4 THEN 'timeout' END AS error FROM {events}"


@query("A41_measurement_validity", f"SELECT run_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(error) AS BIGINT) AS failed, count(error) = 0 AS valid FROM ({lens.sql(_ERRORS)}) AS e GROUP BY run_id")
def _(spark, sf):
    return runs.measurement_validity(lens.frame(spark, sf, _ERRORS))


@query("A41_reader_failures", f"SELECT run_id, row_ref, error AS kind FROM ({lens.sql(_ERRORS)}) AS e WHERE error IS NOT NULL")
def _(spark, sf):
    return runs.reader_failures(lens.frame(spark, sf, _ERRORS))


# -- revisions --------------------------------------------------------------------------------------


def _revision(spark, sf, text):
    return lens.frame(spark, sf, text).withColumn("fingerprint", revisions.fingerprint_of())


_FP = "concat_ws(chr(31), upper(name), upper(material), upper(quality), measure, '', standard, finish)"
_DIFF = f"""
a AS (SELECT {_FP} AS fingerprint, count(*) AS n, min(line_id) AS line_id, min(quantity) AS q, min(status) AS st FROM ({lens.sql(lens.REVISION_A)}) AS x GROUP BY 1),
b AS (SELECT {_FP} AS fingerprint, count(*) AS n, min(line_id) AS line_id, min(quantity) AS q FROM ({lens.sql(lens.REVISION_B)}) AS x GROUP BY 1),
d AS (SELECT coalesce(a.fingerprint, b.fingerprint) AS fp, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n = 1 AND b.n = 1 AND a.q = b.q THEN 'unchanged' WHEN a.n = 1 AND b.n = 1 THEN 'qty_changed' ELSE 'ambiguous' END AS kind,
  CAST(coalesce(a.n, 0) AS BIGINT) AS n_previous, CAST(coalesce(b.n, 0) AS BIGINT) AS n_current, CASE WHEN a.n = 1 AND b.n = 1 THEN a.line_id END AS previous_line, CASE WHEN a.n = 1 AND b.n = 1 THEN b.line_id END AS current_line,
  CASE WHEN a.n = 1 AND b.n = 1 THEN a.q END AS from_quantity, CASE WHEN a.n = 1 AND b.n = 1 THEN b.q END AS to_quantity, a.st FROM a FULL JOIN b ON a.fingerprint = b.fingerprint)
"""


def _delta(spark, sf):
    return revisions.diff(_revision(spark, sf, lens.REVISION_A), _revision(spark, sf, lens.REVISION_B))


@query("J19_F13_revision_diff", f"WITH {_DIFF} SELECT md5(fp) AS fingerprint, kind, n_previous, n_current, previous_line, current_line, from_quantity, to_quantity FROM d")
def revision_diff(spark, sf):
    return _delta(spark, sf).withColumn("fingerprint", F.md5("fingerprint"))


@query("J19_diff_members", f"WITH {_DIFF} SELECT kind, side, line_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT kind, 'previous' AS side, x.line_id FROM d JOIN (SELECT *, {_FP} AS fingerprint FROM ({lens.sql(lens.REVISION_A)}) AS r) AS x ON x.fingerprint = d.fp WHERE kind IN ('added', 'removed', 'ambiguous') UNION ALL SELECT kind, 'current', x.line_id FROM d JOIN (SELECT *, {_FP} AS fingerprint FROM ({lens.sql(lens.REVISION_B)}) AS r) AS x ON x.fingerprint = d.fp WHERE kind IN ('added', 'removed', 'ambiguous')) AS m GROUP BY kind, side, line_id")
def _(spark, sf):
    a, b = _revision(spark, sf, lens.REVISION_A), _revision(spark, sf, lens.REVISION_B)
    return revisions.diff_lines(revisions.diff(a, b), a, b).groupBy("kind", "side", "line_id").agg(F.count(F.lit(1)).alias("n"))


@query("A18_diff_summary", f"WITH {_DIFF} SELECT kind, CAST(sum(CASE kind WHEN 'added' THEN n_current WHEN 'removed' THEN n_previous ELSE 1 END) AS BIGINT) AS n FROM d GROUP BY kind")
def diff_summary(spark, sf):
    return revisions.summary(_delta(spark, sf))


@query("J20_exported_annotation", f"WITH {_DIFF} SELECT kind, kind IN ('unchanged', 'qty_changed') AND coalesce(st = 'RESUELTA', false) AND split_part(fp, chr(31), 4) IN ('1', '2', '3', '4', '5', '6', '7', '8', '9') AS rfq_exported, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY 1, 2")
def _(spark, sf):
    a = _revision(spark, sf, lens.REVISION_A)
    exported = a.filter("measure in ('1', '2', '3', '4', '5', '6', '7', '8', '9')").select("fingerprint")
    return revisions.with_exported(_delta(spark, sf), a, exported).groupBy("kind", "rfq_exported").agg(F.count(F.lit(1)).alias("n"))


@query("S19_export_register", f"SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT {_FP} AS fingerprint FROM ({lens.sql(lens.REVISION_A)}) AS r WHERE status = 'RESUELTA' EXCEPT SELECT {_FP} FROM ({lens.sql(lens.REVISION_B)}) AS r) AS x")
def _(spark, sf):
    tag = lambda df, r: df.select("fingerprint", "status", F.lit("p").alias("project"), F.lit("r").alias("revision"))
    a, b = tag(_revision(spark, sf, lens.REVISION_A), 1), tag(_revision(spark, sf, lens.REVISION_B), 2)
    return revisions.exportable(a, b).agg(F.count(F.lit(1)).alias("n"))


@query("F21_project_ids", lens.sql("SELECT c_custkey, c_name || '.v2' AS project FROM {customer}"))
def _(spark, sf):
    return lens.frame(spark, sf, "SELECT c_custkey, c_name || '.v2.xlsx' AS f FROM {customer}").select("c_custkey", revisions.project_id("f").alias("project"))


@query("S18_revisions_by_time", lens.sql("SELECT CAST(l_suppkey AS VARCHAR) AS project, CAST(year(l_shipdate) AS VARCHAR) AS revision, max(l_shipdate) AS saved_at, CAST(count(*) AS BIGINT) AS n_lines FROM {lineitem} GROUP BY 1, 2"))
def _(spark, sf):
    from bomrec.sources import stores

    s = lens.frame(spark, sf, "SELECT CAST(l_suppkey AS STRING) AS project, CAST(year(l_shipdate) AS STRING) AS revision, l_shipdate AS saved_at FROM {lineitem}")
    return stores.revisions_by_time(s)


@query("S20_file_history", lens.sql("SELECT o_custkey AS file, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS resolved, max(c_nationkey) AS processed_at, CASE WHEN o_custkey % 4 <> 0 THEN max(c_acctbal) END AS cost_eur FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY o_custkey"))
def _(spark, sf):
    from bomrec.sources import stores

    lines = lens.frame(spark, sf, "SELECT o_custkey AS file, CASE WHEN o_orderstatus = 'F' THEN 'RESUELTA' ELSE 'REVISION_MANUAL' END AS status FROM {orders}")
    usage = lens.frame(spark, sf, "SELECT c_custkey AS file, c_nationkey AS processed_at, c_custkey % 4 <> 0 AS priced, c_acctbal AS cost_eur FROM {customer}")
    return stores.file_history(lines, usage)


# -- KPIs ---------------------------------------------------------------------------------------------

_PAIRED = f"paired AS (SELECT session_id, line_id, b4_ts AS started_at, ts AS saved_at, epoch_us(ts) / 1e6 - epoch_us(b4_ts) / 1e6 AS seconds FROM (SELECT *, lag(event_type) OVER w AS b4, lag(ts) OVER w AS b4_ts FROM ({lens.sql(lens.CORRECTION_EVENTS)}) AS e WHERE event_type <> 'other' WINDOW w AS (PARTITION BY session_id, line_id ORDER BY ts, seq)) AS x WHERE event_type = 'saved' AND b4 = 'started')"


@query("W4_correction_pairs", f"WITH {_PAIRED} SELECT session_id, line_id, round(seconds, 3) AS seconds FROM paired")
def _(spark, sf):
    return kpi.correction_pairs(lens.frame(spark, sf, lens.CORRECTION_EVENTS)).select("session_id", "line_id", F.round("seconds", 3).alias("seconds"))


@query("A15_correction_timing", f"WITH {_PAIRED} SELECT CAST(count(*) AS BIGINT) AS sample, round(quantile_disc(seconds, 0.5), 6) AS p50_seconds, round(quantile_disc(seconds, 0.9), 6) AS p90_seconds, CAST(count(*) FILTER (seconds <= 90) AS BIGINT) AS within_target FROM paired")
def _(spark, sf):
    return kpi.correction_timing(kpi.correction_pairs(lens.frame(spark, sf, lens.CORRECTION_EVENTS)))


_FIRST = f"first_ AS (SELECT project_id, revision_id, flow_id, event_type, arg_min(ts, seq) AS ts, min(seq) AS seq FROM ({lens.sql(lens.MILESTONES)}) AS m GROUP BY 1, 2, 3, 4)"


def _milestones(spark, sf):
    return kpi.first_arrivals(lens.frame(spark, sf, lens.MILESTONES))


@query("T1_first_arrivals", f"WITH {_FIRST} SELECT project_id, revision_id, flow_id, event_type, seq FROM first_")
def _(spark, sf):
    return _milestones(spark, sf).select("project_id", "revision_id", "flow_id", "event_type", "seq")


@query("A16_milestone_counts", f"WITH {_FIRST} SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM first_ GROUP BY event_type")
def _(spark, sf):
    return kpi.milestone_counts(_milestones(spark, sf))


_STAGES = " UNION ALL ".join(
    f"SELECT '{s}' AS stage, epoch_us(b.ts) / 1e6 / 3600 - epoch_us(a.ts) / 1e6 / 3600 AS hours FROM first_ AS a JOIN first_ AS b USING (project_id, revision_id, flow_id) WHERE a.event_type = '{x}' AND b.event_type = '{y}' AND b.ts >= a.ts"
    for s, (x, y) in T.LIFECYCLE_STAGES.items()
)


@query("A16_lifecycle_kpi", f"WITH {_FIRST} SELECT stage, CAST(count(*) AS BIGINT) AS sample, round(quantile_disc(hours, 0.5), 4) AS p50_hours, round(quantile_disc(hours, 0.9), 4) AS p90_hours FROM ({_STAGES}) AS d GROUP BY stage")
def lifecycle(spark, sf):
    k = kpi.lifecycle_kpi(_milestones(spark, sf))
    return k.select("stage", "sample", F.round("p50_hours", 4).alias("p50_hours"), F.round("p90_hours", 4).alias("p90_hours"))


@query("A17_dashboard", f"SELECT r.run_id, " + ", ".join(f"max(value) FILTER (name = '{n}') AS {n}" for n in ("silent_error_rate", "useful_autonomy", "split_fidelity", "queue_noise")) + ", CASE WHEN prices_configured AND cost_eur > 0 AND n_rows > 0 THEN round(cost_eur / n_rows, 9) END AS cost_per_row, CASE WHEN prices_configured AND cost_eur > 0 AND n_rows > 0 THEN round(cost_eur / n_rows * 500000, 6) END AS project_cost, CASE WHEN n_rows > 0 AND latency_ms > 0 THEN round(latency_ms / n_rows / 60, 6) END AS minutes_per_thousand, CASE WHEN n_rows > 0 AND latency_ms > 0 THEN round(latency_ms / n_rows / 60 / 8, 6) END AS minutes_at_8, round(2500 * max(value) FILTER (name = 'useful_autonomy') / 100, 6) AS hours_saved " + f"FROM ({lens.sql(_RUNS)}) AS r LEFT JOIN ({lens.sql(_METRIC_LENS)}) AS m ON m.run_id = r.run_id GROUP BY r.run_id, prices_configured, cost_eur, n_rows, latency_ms")
def _(spark, sf):
    return kpi.dashboard(lens.frame(spark, sf, _RUNS), lens.frame(spark, sf, _METRIC_LENS))


_RULE_USES = " UNION ALL ".join(f"SELECT {r} AS rule FROM lines" for r in ("material_rule", "quality_rule", "standard_rule", "finish_rule"))


@query("J23_F20_rule_uses", lens.expected(f"SELECT substr(rule, 5) AS entry_id, CAST(count(*) AS BIGINT) AS uses FROM ({_RULE_USES}) AS r WHERE rule LIKE 'P-3:%' GROUP BY 1"))
def _(spark, sf):
    return kpi.rule_uses(part_lines(spark, sf))


@query("J23_U6_reuse_count", lens.expected(f"SELECT CAST(count(*) AS BIGINT) AS reuse_count FROM ({_RULE_USES}) AS r WHERE rule IN ('P-3:inox-a2', 'P-3:inox-a4')"))
def _(spark, sf):
    ids = lens.frame(spark, sf, "SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'inox-a2' WHEN 1 THEN 'inox-a4' ELSE NULL END AS entry_id FROM {part}")
    return kpi.reuse_count(part_lines(spark, sf), kpi.reusable_entries(ids, ids))
