"""Deterministic views of the given tables in the shapes the operators read.

Every lens is one SELECT in SQL that Spark and DuckDB both accept, with table names in braces, so a
query and its check start from the same rows. ``frame`` runs it on Spark; ``sql`` renders it as text.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def tables_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)) & set(TABLES))


def frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The lens over the parquet tables of a scale-factor directory."""
    return _frame(spark, sf_dir, text)


@lru_cache(maxsize=256)
def _frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(text)})


def over(events: DataFrame, text: str) -> DataFrame:
    """The lens over a frame of events, which may be a stream."""
    return events.sparkSession.sql(text, events=events)


def sql(text: str) -> str:
    return text.format(**{t: t for t in TABLES})


PIECES = """
SELECT p_partkey, p_size, p_brand, p_type, p_name,
  CASE split_part(p_name, ' ', 2)
    WHEN 'bolt' THEN 'Hex Bolt' WHEN 'gear' THEN 'Tuerca' WHEN 'ring' THEN 'Washer'
    WHEN 'rod' THEN 'Threaded Rod' WHEN 'widget' THEN 'Tornillo' WHEN 'gizmo' THEN 'Brida'
    WHEN 'plate' THEN CASE WHEN p_partkey % 2 = 0 THEN 'Stud Bolt' ELSE 'Espárrago' END
    ELSE 'Válvula' END AS noun,
  CASE p_partkey % 5 WHEN 0 THEN 'DIN 933' WHEN 1 THEN 'DIN 125 A' WHEN 2 THEN 'ASTM A193'
    WHEN 3 THEN 'ISO 4014' ELSE '' END AS std,
  CASE p_partkey % 7 WHEN 0 THEN 'M16x60' WHEN 1 THEN '7/8" X 130' WHEN 2 THEN 'M12'
    WHEN 3 THEN '1-1/2"' WHEN 4 THEN 'M20 x 1000' WHEN 5 THEN '' ELSE '3/4" X 5000' END AS measure,
  CASE p_size % 9 WHEN 0 THEN '8.8' WHEN 1 THEN 'A4-70' WHEN 2 THEN '10' WHEN 3 THEN 'GR B7'
    WHEN 4 THEN '200HV' WHEN 5 THEN '304' WHEN 6 THEN 'GR 99' WHEN 7 THEN '12.9' ELSE '' END AS quality,
  CASE WHEN p_partkey % 11 = 0 THEN '40 mm' ELSE '' END AS len,
  CASE WHEN p_partkey % 13 = 0 THEN 'acero' ELSE '' END AS mat,
  CASE p_partkey % 8 WHEN 0 THEN 'zincado' WHEN 1 THEN 'HDG' WHEN 2 THEN 'Black' WHEN 3 THEN 'géomet'
    ELSE '' END AS fin,
  CASE WHEN split_part(p_name, ' ', 2) IN ('bolt', 'rod', 'widget', 'plate') THEN p_partkey % 4 ELSE 3 END AS set_kind
FROM {part}
"""

# One described row per part: noun, then its values, then the second element of a set, then a finish.
_TEXT = """
  noun || CASE WHEN std <> '' THEN ' ' || std ELSE '' END
  || CASE WHEN measure <> '' THEN ', ' || measure ELSE '' END
  || CASE WHEN quality <> '' THEN ', ' || quality ELSE '' END
  || CASE WHEN len <> '' THEN ', ' || len ELSE '' END
  || CASE WHEN mat <> '' THEN ', ' || mat ELSE '' END
  || CASE set_kind WHEN 0 THEN ' with NUT' WHEN 1 THEN ' W/2 HEX. NUT DIN 934 8'
       WHEN 2 THEN ' con 2 tuercas DIN 934, 10' ELSE '' END
  || CASE WHEN fin <> '' THEN ', ' || fin ELSE '' END
"""
PART_ROWS = f"""
SELECT CAST(p_partkey AS STRING) AS row_ref, {_TEXT} AS source_text,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS quantity
FROM ({PIECES}) AS pieces
"""
# The same texts at the grain of order lines: heavy repetition of few texts, as in real revisions.
ORDER_ROWS = f"""
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
    || '-' || CAST(l_suppkey AS STRING) AS row_ref,
  {_TEXT} AS source_text, l_quantity AS quantity, l_suppkey AS file_no, l_shipdate AS shipped
FROM {{lineitem}} JOIN ({PIECES}) AS pieces ON l_partkey = p_partkey
"""

# Expected lines of PART_ROWS, computed from the pieces instead of the text (check side only).
EXPECTED = f"""
WITH pieces AS ({PIECES}),
b AS (
  SELECT *, CAST(p_partkey AS VARCHAR) AS row_ref,
    CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS qty,
    CASE noun WHEN 'Hex Bolt' THEN 'TORNILLO' WHEN 'Tornillo' THEN 'TORNILLO' WHEN 'Tuerca' THEN 'TUERCA'
      WHEN 'Washer' THEN 'ARANDELA' WHEN 'Threaded Rod' THEN 'VARILLA ROSCADA'
      WHEN 'Stud Bolt' THEN 'ESPARRAGO' WHEN 'Espárrago' THEN 'ESPARRAGO' END AS name,
    CASE measure WHEN 'M16x60' THEN 'M16' WHEN '7/8" X 130' THEN '7/8"' WHEN 'M12' THEN 'M12'
      WHEN '1-1/2"' THEN '1-1/2"' WHEN 'M20 x 1000' THEN 'M20' WHEN '3/4" X 5000' THEN '3/4"' END AS m,
    CASE upper(fin) WHEN 'ZINCADO' THEN 'CINCADO' WHEN 'HDG' THEN 'GALVANIZADO EN CALIENTE'
      WHEN 'BLACK' THEN 'PAVONADO' WHEN '' THEN NULL ELSE 'GEOMET' END AS f,
    CASE upper(fin) WHEN 'ZINCADO' THEN 'ZINCADO' WHEN 'HDG' THEN 'HDG'
      WHEN 'BLACK' THEN 'BLACK' WHEN '' THEN NULL ELSE 'GEOMET' END AS fa,
    set_kind < 3 AS has_set
  FROM pieces),
e1 AS (
  SELECT b.*, 1 AS position, name IN ('TUERCA', 'ARANDELA') AS exempt,
    CASE quality WHEN '8.8' THEN 'G5' WHEN 'A4-70' THEN 'G3' WHEN '10' THEN 'G9' WHEN '200HV' THEN 'G13'
      WHEN '304' THEN 'G1' WHEN '12.9' THEN 'G7' END AS grp,
    CASE WHEN len <> '' THEN '40 mm' WHEN measure = 'M16x60' THEN '60 mm' WHEN measure = '7/8" X 130' THEN '130 mm'
      WHEN measure = 'M20 x 1000' THEN '1000 mm' END AS l0,
    CASE WHEN len <> '' THEN 'stated' WHEN measure IN ('M16x60', 'M20 x 1000') THEN 'designation'
      WHEN measure = '7/8" X 130' THEN 'plausibility' END AS basis,
    len = '' AND measure = '3/4" X 5000' AS implausible
  FROM b WHERE name IS NOT NULL),
p1 AS (
  SELECT row_ref, position, 'principal' AS role, 1 AS multiplicity, name,
    CASE WHEN mat <> '' THEN 'AC' WHEN grp IN ('G5', 'G7', 'G9') OR quality = 'GR B7' THEN 'AC'
      WHEN grp IN ('G1', 'G3') THEN 'INOX' END AS material,
    CASE WHEN mat <> '' THEN 'extracted' WHEN grp IN ('G1', 'G3', 'G5', 'G7', 'G9') OR quality = 'GR B7' THEN 'derived'
      ELSE 'absent' END AS material_prov,
    CASE WHEN mat <> '' THEN 'material:ACERO->AC' WHEN grp = 'G5' THEN 'P-3:ac-clase-8-8' WHEN grp = 'G7' THEN 'P-3:ac-clase-12-9'
      WHEN grp = 'G9' THEN 'P-3:ac-tuerca-10' WHEN grp = 'G1' THEN 'P-3:inox-a2' WHEN grp = 'G3' THEN 'P-3:inox-a4'
      WHEN quality = 'GR B7' THEN 'P-3:ac-astm-b7' WHEN grp = 'G13' THEN 'P-3:no-derivable' END AS material_rule,
    nullif(quality, '') AS quality, grp AS quality_group,
    CASE WHEN grp IS NOT NULL THEN 'table_normalized' WHEN quality <> '' THEN 'extracted_uncatalogued' ELSE 'absent' END AS quality_prov,
    CASE WHEN grp IS NOT NULL THEN 'quality:' || grp WHEN quality <> '' THEN 'quality:out_of_catalog' END AS quality_rule,
    m AS measure, CASE WHEN m IS NULL THEN 'absent' ELSE 'extracted' END AS measure_prov,
    CASE WHEN exempt THEN 'N/A' ELSE l0 END AS length,
    CASE WHEN exempt THEN 'not_applicable' WHEN basis = 'plausibility' THEN 'inferred' WHEN l0 IS NOT NULL THEN 'extracted'
      ELSE 'absent' END AS length_prov,
    CASE std WHEN 'DIN 933' THEN 'ISO 4017' WHEN 'DIN 125 A' THEN 'ISO 7089' WHEN '' THEN NULL ELSE std END AS standard,
    CASE WHEN std LIKE 'DIN%' THEN 'table_normalized' WHEN std <> '' THEN 'extracted' ELSE 'absent' END AS standard_prov,
    CASE std WHEN 'DIN 933' THEN 'DIN933->ISO4017' WHEN 'DIN 125 A' THEN 'DIN125A->ISO7089'
      WHEN 'ASTM A193' THEN 'standard:ASTM:preserved' WHEN 'ISO 4014' THEN 'standard:ISO:preserved' END AS standard_rule,
    CASE WHEN NOT has_set THEN f END AS finish,
    CASE WHEN NOT has_set AND f IS NOT NULL THEN 'table_normalized' ELSE 'absent' END AS finish_prov,
    CASE WHEN f IS NULL THEN NULL WHEN has_set THEN 'P-1:scope_unstated' ELSE 'finish:' || fa || '->' || f END AS finish_rule,
    qty AS quantity, CASE WHEN qty IS NULL THEN 'absent' ELSE 'extracted' END AS quantity_prov,
    concat_ws('|', CASE WHEN m IS NULL THEN 'MEASURE_MISSING' END,
      CASE WHEN NOT exempt AND l0 IS NULL AND NOT implausible THEN 'LENGTH_MISSING' END,
      CASE WHEN NOT exempt AND implausible THEN 'LENGTH_UNIT_IMPLAUSIBLE' END,
      CASE WHEN NOT exempt AND basis = 'stated' AND m LIKE '%"' THEN 'UNIT_MISMATCH' END,
      CASE WHEN quality = '' THEN 'QUALITY_MISSING' END,
      CASE WHEN (grp = 'G9' AND name <> 'TUERCA') OR (grp IN ('G5', 'G7') AND name = 'TUERCA') THEN 'QUALITY_TYPE_INCOHERENCE' END,
      CASE WHEN std = '' THEN 'STANDARD_MISSING' END,
      CASE WHEN mat = '' AND quality = 'GR 99' THEN 'UNMAPPED_VALUE' END,
      CASE WHEN has_set AND f IS NOT NULL THEN 'FINISH_SCOPE_UNSTATED' END,
      CASE WHEN qty IS NULL THEN 'QUANTITY_NOT_STATED' END) AS reasons,
    concat_ws('|', CASE WHEN has_set AND f IS NOT NULL THEN 'P-1' END,
      CASE WHEN mat = '' AND quality = 'GR 99' THEN 'P-13' END,
      CASE WHEN mat = '' AND quality NOT IN ('', 'GR 99') THEN 'P-3' END,
      CASE WHEN NOT exempt AND (implausible OR basis = 'plausibility') THEN 'P-4' END,
      CASE WHEN std = '' THEN 'P-5' END,
      CASE WHEN (grp = 'G9' AND name <> 'TUERCA') OR (grp IN ('G5', 'G7') AND name = 'TUERCA') THEN 'P-6' END) AS policies
  FROM e1),
p2 AS (
  SELECT row_ref, 2 AS position, 'secondary' AS role, CASE WHEN set_kind = 0 THEN 1 ELSE 2 END AS multiplicity,
    'TUERCA' AS name, CASE WHEN set_kind > 0 THEN 'AC' END AS material,
    CASE WHEN set_kind > 0 THEN 'derived' ELSE 'absent' END AS material_prov,
    CASE set_kind WHEN 1 THEN 'P-3:ac-tuerca-8' WHEN 2 THEN 'P-3:ac-tuerca-10' END AS material_rule,
    CASE set_kind WHEN 1 THEN '8' WHEN 2 THEN '10' END AS quality,
    CASE set_kind WHEN 1 THEN 'G8' WHEN 2 THEN 'G9' END AS quality_group,
    CASE WHEN set_kind > 0 THEN 'table_normalized' ELSE 'absent' END AS quality_prov,
    CASE set_kind WHEN 1 THEN 'quality:G8' WHEN 2 THEN 'quality:G9' END AS quality_rule,
    m AS measure, CASE WHEN m IS NULL THEN 'absent' ELSE 'extrapolated' END AS measure_prov,
    'N/A' AS length, 'not_applicable' AS length_prov,
    CASE WHEN set_kind > 0 THEN 'ISO 4032' END AS standard,
    CASE WHEN set_kind > 0 THEN 'table_normalized' ELSE 'absent' END AS standard_prov,
    CASE WHEN set_kind > 0 THEN 'DIN934->ISO4032' END AS standard_rule,
    f AS finish, CASE WHEN f IS NULL THEN 'absent' ELSE 'table_normalized' END AS finish_prov,
    'finish:' || fa || '->' || f AS finish_rule,
    qty * CASE WHEN set_kind = 0 THEN 1 ELSE 2 END AS quantity,
    CASE WHEN qty IS NULL THEN 'absent' WHEN set_kind = 0 THEN 'inferred' ELSE 'extracted' END AS quantity_prov,
    concat_ws('|', CASE WHEN m IS NULL THEN 'MEASURE_MISSING' END, CASE WHEN set_kind = 0 THEN 'QUALITY_MISSING' END,
      CASE WHEN set_kind = 0 THEN 'STANDARD_MISSING' END, CASE WHEN qty IS NULL THEN 'QUANTITY_NOT_STATED' END) AS reasons,
    concat_ws('|', CASE WHEN set_kind = 0 AND qty IS NOT NULL THEN 'P-2' END, CASE WHEN set_kind > 0 THEN 'P-3' END,
      CASE WHEN set_kind = 0 THEN 'P-5' END) AS policies
  FROM b WHERE name IS NOT NULL AND has_set),
p0 AS (
  SELECT row_ref, 0 AS position, NULL AS role, 1 AS multiplicity, NULL AS name, NULL AS material, 'absent' AS material_prov,
    NULL AS material_rule, NULL AS quality, NULL AS quality_group, 'absent' AS quality_prov, NULL AS quality_rule,
    NULL AS measure, 'absent' AS measure_prov, NULL AS length, 'absent' AS length_prov, NULL AS standard,
    'absent' AS standard_prov, NULL AS standard_rule, NULL AS finish, 'absent' AS finish_prov, NULL AS finish_rule,
    qty AS quantity, CASE WHEN qty IS NULL THEN 'absent' ELSE 'extracted' END AS quantity_prov,
    'NO_ELEMENTS_EXTRACTED' AS reasons, '' AS policies
  FROM b WHERE name IS NULL),
u AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p0),
lines AS (
  SELECT *, row_ref || '.' || CASE WHEN position = 0 THEN 'N' ELSE CAST(position AS VARCHAR) END AS line_id,
    CASE WHEN name IS NULL THEN 'absent' ELSE 'table_normalized' END AS name_prov,
    CASE WHEN reasons = '' THEN 'RESUELTA' ELSE 'REVISION_MANUAL' END AS status
  FROM u)
"""


def expected(select: str, ctes: str = "") -> str:
    """Check SQL over the expected lines of PART_ROWS."""
    return sql(EXPECTED) + (", " + ctes if ctes else "") + "\n" + select


# Two revisions of the same bill: order lines shipped in odd and in even years.
def _revision(parity: int) -> str:
    return f"""
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
    || '-' || CAST(l_suppkey AS STRING) AS line_id,
  p_name AS name, p_type AS material, p_brand AS quality, CAST(p_size AS STRING) AS measure,
  CAST(NULL AS STRING) AS length, CAST(l_suppkey AS STRING) AS standard, CAST(l_linenumber AS STRING) AS finish,
  l_quantity AS quantity, CASE WHEN l_returnflag = 'R' THEN 'REVISION_MANUAL' ELSE 'RESUELTA' END AS status
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey
WHERE year(l_shipdate) % 2 = {parity}
"""


REVISION_A, REVISION_B = _revision(1), _revision(0)

# Events as procurement milestones and correction events.
MILESTONES = """
SELECT CAST(user_id % 10 AS STRING) AS project_id, CAST(user_id AS STRING) AS revision_id,
  CAST(CAST(ts AS DATE) AS STRING) AS flow_id,
  CASE event_type WHEN 'signup' THEN 'revision_opened' WHEN 'view' THEN 'review_closed' WHEN 'click' THEN 'rfq_sent'
    WHEN 'purchase' THEN 'order_placed' ELSE CASE WHEN event_id % 2 = 0 THEN 'supplier_confirmed' ELSE 'delivered' END
  END AS event_type,
  CAST(ts AS TIMESTAMP) AS ts, event_id AS seq
FROM {events}
"""
CORRECTION_EVENTS = """
SELECT CAST(user_id AS STRING) AS session_id, CAST(user_id % 7 AS STRING) AS line_id, CAST(ts AS TIMESTAMP) AS ts,
  event_id AS seq, CASE event_type WHEN 'click' THEN 'started' WHEN 'purchase' THEN 'saved' ELSE 'other' END AS event_type
FROM {events}
"""

# Orders as human corrections and as vocabulary suggestions.
CORRECTIONS = """
SELECT o_orderkey AS id, CAST(o_custkey AS STRING) AS row_ref,
  CASE o_orderkey % 8 WHEN 0 THEN 'name' WHEN 1 THEN 'material' WHEN 2 THEN 'quality' WHEN 3 THEN 'measure'
    WHEN 4 THEN 'length' WHEN 5 THEN 'standard' WHEN 6 THEN 'finish' ELSE 'quantity' END AS attribute,
  CASE o_orderkey % 11 WHEN 0 THEN 'PERNO' WHEN 1 THEN 'BOLT' WHEN 2 THEN 'GR 660' WHEN 3 THEN '8.8'
    WHEN 4 THEN 'NF E25' WHEN 5 THEN 'DIN 933' WHEN 6 THEN 'tropical' WHEN 7 THEN ' ' ELSE 'CL 8' END AS evidence,
  CASE o_orderkey % 7 WHEN 0 THEN 'TORNILLO' WHEN 1 THEN 'AC' WHEN 2 THEN '10.9' WHEN 3 THEN 'ISO 4014'
    WHEN 4 THEN 'Cincado' WHEN 5 THEN 'no-acabado' ELSE NULL END AS value,
  CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE 'motivo' END AS rationale,
  CASE o_orderkey % 5 WHEN 0 THEN 'run-0' WHEN 1 THEN 'run-9' ELSE NULL END AS run_id,
  CASE WHEN o_orderstatus = 'F' THEN 'APPROVED' WHEN o_orderstatus = 'O' THEN 'PENDING'
    WHEN o_orderpriority = '5-LOW' THEN 'PROMOTED' ELSE 'REJECTED' END AS status
FROM {orders}
"""
SUGGESTIONS = """
SELECT o_orderkey AS id, CAST(o_custkey AS STRING) AS row_ref,
  CASE o_orderkey % 3 WHEN 0 THEN 'finish' WHEN 1 THEN 'material' ELSE 'quality' END AS attribute,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'SHOWN' WHEN '2-HIGH' THEN 'ACCEPTED' WHEN '3-MEDIUM' THEN 'VALIDATED'
    WHEN '5-LOW' THEN 'REJECTED' ELSE 'SHOWN' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN 'wrong' WHEN o_orderkey % 4 = 1 THEN 'correct' ELSE NULL END AS verified,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'CINCADO' END AS value,
  CASE WHEN o_orderkey % 17 = 0 THEN ' ' WHEN o_orderkey % 2 = 0 THEN 'customer#' ELSE 'zz' END AS match,
  CASE o_orderkey % 5 WHEN 0 THEN 'closed_table' WHEN 1 THEN 'model' ELSE 'row_evidence' END AS origin
FROM {orders}
"""
CUSTOMER_ROWS = "SELECT CAST(c_custkey AS STRING) AS row_ref, c_name AS source_text FROM {customer}"
# Status events of every correction: a first event, then one or two moves, some of them not allowed.
STATUS_EVENTS = """
SELECT o_orderkey AS id, 1 AS seq, CASE WHEN o_orderkey % 23 = 0 THEN 'APPROVED' ELSE 'PENDING' END AS action FROM {orders}
UNION ALL SELECT o_orderkey AS id, 2 AS seq, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'REJECTED'
  ELSE 'PROMOTED' END AS action FROM {orders} WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey AS id, 3 AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'PROMOTED' ELSE 'REJECTED' END AS action
  FROM {orders} WHERE o_orderkey % 5 = 0
"""
# A vocabulary change log out of parts: adds, replayed adds and retirements.
VOCABULARY_LOG = """
SELECT 'add' AS action, 'e-' || CAST(p_partkey AS STRING) AS id, '2026-01-01' AS at, p_partkey * 4 AS seq,
  'finish' AS attribute, p_name || ' ' || CAST(p_partkey % 200 AS STRING) AS alias,
  CASE WHEN p_partkey % 10 = 0 THEN 'not_a_finish' ELSE 'alias' END AS kind,
  CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'CINCADO' ELSE upper(p_type) END AS value,
  CASE WHEN p_partkey % 2 = 0 THEN 'client' ELSE 'added' END AS source FROM {part}
UNION ALL SELECT 'add', 'e-' || CAST(p_partkey AS STRING), '2026-01-01', p_partkey * 4 + 1, 'finish',
  p_name || ' ' || CAST(p_partkey % 200 AS STRING), CASE WHEN p_partkey % 10 = 0 THEN 'not_a_finish' ELSE 'alias' END,
  CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'CINCADO' ELSE upper(p_type) END,
  CASE WHEN p_partkey % 2 = 0 THEN 'client' ELSE 'added' END FROM {part} WHERE p_partkey % 5 = 0
UNION ALL SELECT 'retire', 'e-' || CAST(p_partkey AS STRING), '2026-02-01', p_partkey * 4 + 2, 'finish', NULL, NULL, NULL,
  NULL FROM {part} WHERE p_partkey % 4 = 0
"""
ENTRIES_SQL = """
SELECT 'e-' || CAST(p_partkey AS VARCHAR) AS id, 'finish' AS attribute,
  p_name || ' ' || CAST(p_partkey % 200 AS VARCHAR) AS alias,
  CASE WHEN p_partkey % 10 = 0 THEN 'not_a_finish' ELSE 'alias' END AS kind,
  CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'CINCADO' ELSE upper(p_type) END AS value,
  CASE WHEN p_partkey % 2 = 0 THEN 'client' ELSE 'added' END AS source, '2026-01-01' AS decided_at,
  CASE WHEN p_partkey % 4 = 0 THEN '2026-02-01' END AS retired_at FROM part
"""
# Candidate entries a buyer proposes, one per customer.
CANDIDATES = """
SELECT 'e-' || CAST(c_custkey * 3 AS STRING) AS id,
  CASE c_custkey % 4 WHEN 0 THEN 'quality_group' WHEN 1 THEN 'material' ELSE 'finish' END AS attribute,
  CASE c_custkey % 6 WHEN 0 THEN 'ZN' WHEN 1 THEN 'hot ring ' || CAST(c_custkey % 200 AS STRING) WHEN 2 THEN ' '
    WHEN 3 THEN 'A4-70' WHEN 4 THEN 'red plate ' || CAST(c_custkey % 200 AS STRING) ELSE c_mktsegment END AS alias,
  CASE WHEN c_custkey % 5 = 0 THEN 'not_a_finish' ELSE 'alias' END AS kind,
  CASE c_custkey % 7 WHEN 0 THEN 'CINCADO' WHEN 1 THEN 'G3' WHEN 2 THEN 'V-X1' WHEN 3 THEN NULL WHEN 4 THEN 'AC'
    WHEN 5 THEN 'G99' ELSE 'PROMO' END AS value
FROM {customer}
"""


# Gold labels and two system runs for every part, one or two lines per row.
def _labels(wrong: int, extra: int) -> str:
    """System lines; ``wrong`` and ``extra`` are the moduli of wrong cells and surplus lines."""
    return f"""
SELECT row_ref, row_ref || '.' || CAST(position AS STRING) AS line_id, position,
  CASE WHEN n % 23 = 0 AND position = 1 THEN 'ARANDELA' ELSE name END AS name, 'extracted' AS name_prov,
  material, CASE WHEN n % 6 = 0 THEN 'inferred' ELSE 'derived' END AS material_prov,
  CASE WHEN n % {wrong} = 0 THEN 'WRONG' ELSE lower(quality) END AS quality, 'extracted' AS quality_prov,
  measure, CASE WHEN n % 4 = 0 THEN 'extrapolated' ELSE 'extracted' END AS measure_prov,
  CAST(NULL AS STRING) AS length, 'absent' AS length_prov, standard, 'extracted' AS standard_prov,
  CASE WHEN n % 9 = 0 THEN '—' ELSE NULL END AS finish, 'absent' AS finish_prov,
  CASE WHEN n % 29 = 0 THEN quantity + 1 ELSE quantity END AS quantity, 'extracted' AS quantity_prov,
  CASE WHEN n % 5 = 0 OR n % 14 = 0 THEN 'REVISION_MANUAL' ELSE 'RESUELTA' END AS status,
  CASE WHEN n % 14 = 0 THEN 'OUT_OF_FAMILY' WHEN n % 5 = 0 THEN 'LENGTH_MISSING|MEASURE_MISSING' ELSE '' END AS reason_text,
  'f' || CAST(n % 10 AS STRING) AS file
FROM ({_LABEL_BASE}) AS base
WHERE position = 1 OR (n % {extra} <> 0)
"""


_LABEL_BASE = """
SELECT p_partkey AS n, CAST(p_partkey AS STRING) AS row_ref, 1 AS position, split_part(p_name, ' ', 2) AS name, p_type AS material,
  p_brand AS quality, CAST(p_size AS STRING) AS measure, 'ISO ' || CAST(p_size AS STRING) AS standard,
  CAST(p_size AS DOUBLE) AS quantity FROM {part}
UNION ALL
SELECT p_partkey AS n, CAST(p_partkey AS STRING) AS row_ref, 2 AS position, 'TUERCA' AS name, p_type AS material,
  p_brand AS quality, CAST(p_size AS STRING) AS measure, 'ISO 4032' AS standard,
  CAST(p_size AS DOUBLE) * 2 AS quantity FROM {part} WHERE p_partkey % 3 = 0
"""
GOLD = f"""
SELECT row_ref, row_ref || '.g' || CAST(position AS STRING) AS gold_id, position,
  name, 'extracted' AS name_prov, 'C' AS name_cert, material, 'derived' AS material_prov, 'P' AS material_cert,
  quality, 'extracted' AS quality_prov, 'C' AS quality_cert,
  measure, CASE WHEN position = 2 THEN 'extrapolated' ELSE 'extracted' END AS measure_prov, 'C' AS measure_cert,
  CAST(NULL AS STRING) AS length, 'absent' AS length_prov, 'C' AS length_cert,
  standard, 'extracted' AS standard_prov, 'C' AS standard_cert,
  CAST(NULL AS STRING) AS finish, 'absent' AS finish_prov, CASE WHEN n % 2 = 0 THEN 'C' ELSE 'P' END AS finish_cert,
  quantity, CASE WHEN n % 8 = 0 THEN 'inferred' ELSE 'extracted' END AS quantity_prov, CASE WHEN position = 2 THEN 'P' ELSE 'C' END AS quantity_cert,
  CASE WHEN n % 10 = 0 OR n % 21 = 0 THEN 'REVISION_MANUAL' ELSE 'RESUELTA' END AS status,
  CASE WHEN n % 21 = 0 THEN 'OUT_OF_FAMILY' WHEN n % 10 = 0 THEN 'MEASURE_MISSING|LENGTH_MISSING' ELSE '' END AS reason_text
FROM ({_LABEL_BASE}) AS base
"""
SYSTEM_A, SYSTEM_B = _labels(17, 12), _labels(13, 15)
