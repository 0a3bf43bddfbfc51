"""Queries over rows, detections and lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bomrec.functions import closed_tables as T
from bomrec.functions import measure as M
from bomrec.functions import text as X
from bomrec.operators import catalog, detect, gaps, normalize, panel, reader, runs, score, validate
from bomrec.operators.catalog import Vocabulary
from bomrec.plans import lens
from bomrec.plans.lens import expected
from bomrec.plans.lines import spread
from bomrec.plans.registry import CHECKS, answered_lines, answered_read, codes, joined, order_lines, part_lines, part_read, part_rows, query, text_totals, values_sql
from bomrec.session import shared_folder

V = Vocabulary.closed()
PIECES_SQL = lens.sql(lens.PIECES)
ROWS_SQL = lens.sql(lens.PART_ROWS)

# -- whole lines ------------------------------------------------------------------------------

_VALUES = ["name", "material", "quality", "measure", "length", "standard", "finish"]
_PROV = [f"{a}_prov" for a in _VALUES]
_RULES = ["material_rule", "quality_rule", "standard_rule", "finish_rule"]
_LINE = ["row_ref", "line_id", "role", "multiplicity", "status", *_VALUES, *_PROV, *_RULES, "quantity",
         "quantity_prov", "quality_group"]


@query("F27_F15_lines", expected(f"SELECT {', '.join(_LINE)}, reasons, policies FROM lines"))
def _(spark, sf):
    return part_lines(spark, sf).select(*_LINE, codes().alias("reasons"), joined("policies_applied").alias("policies"))


# At order grain every quantity is stated, so the reason about a missing one is dropped.
_STATED = """stated AS (SELECT * REPLACE (
  array_to_string(list_filter(string_split(reasons, '|'), lambda r: r <> 'QUANTITY_NOT_STATED' AND r <> ''), '|') AS reasons)
  FROM lines),
orders_lines AS (SELECT s.*, CASE WHEN s.reasons = '' THEN 'RESUELTA' ELSE 'REVISION_MANUAL' END AS st, l_quantity, l_suppkey
  FROM stated AS s JOIN lineitem ON CAST(l_partkey AS VARCHAR) = s.row_ref)"""


@query(
    "F16_status_by_family",
    expected(
        "SELECT name AS family, st AS status, CAST(count(*) AS BIGINT) AS n_lines, "
        "CAST(sum(l_quantity * multiplicity) AS DOUBLE) AS quantity FROM orders_lines GROUP BY name, st",
        _STATED,
    ),
)
def status_by_family(spark, sf):
    return text_totals(spark, sf).groupBy(F.col("name").alias("family"), "status").agg(
        F.sum("n_rows").alias("n_lines"), F.sum("quantity").alias("quantity")
    )


@query(
    "P8_routing_at_order_grain",
    expected(
        "SELECT l_suppkey AS file_no, CAST(count(*) AS BIGINT) AS n_lines, "
        "CAST(count(*) FILTER (st = 'RESUELTA') AS BIGINT) AS resolved FROM orders_lines GROUP BY l_suppkey",
        _STATED,
    ),
)
def _(spark, sf):
    return order_lines(spark, sf).groupBy("file_no").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("routing") != "review").alias("resolved")
    )


@query("W1_line_ids", expected("SELECT row_ref, CAST(position AS INT) AS position, line_id FROM lines"))
def _(spark, sf):
    return part_lines(spark, sf).select("row_ref", "position", "line_id")


@query("W2_roles", expected("SELECT role, name, CAST(count(*) AS BIGINT) AS n FROM lines GROUP BY role, name"))
def _(spark, sf):
    return part_lines(spark, sf).groupBy("role", "name").agg(F.count(F.lit(1)).alias("n"))


@query("P2_no_elements", expected("SELECT row_ref, line_id, reasons FROM lines WHERE position = 0"))
def _(spark, sf):
    return part_lines(spark, sf).filter("position = 0").select("row_ref", "line_id", codes().alias("reasons"))


@query(
    "J11_W7_measure_donor",
    expected("SELECT line_id, measure, measure_prov FROM lines WHERE position = 2"),
)
def _(spark, sf):
    return part_lines(spark, sf).filter("position = 2").select("line_id", "measure", "measure_prov")


@query(
    "J12_finish_scope",
    expected("SELECT line_id, finish, finish_rule FROM lines WHERE policies LIKE '%P-1' OR policies LIKE '%P-1|%'"),
)
def _(spark, sf):
    return part_lines(spark, sf).filter(F.array_contains("policies_applied", "P-1")).select("line_id", "finish", "finish_rule")


@query(
    "F14_quantity",
    expected("SELECT line_id, CAST(multiplicity AS INT) AS multiplicity, quantity, quantity_prov FROM lines"),
)
def _(spark, sf):
    return part_lines(spark, sf).select("line_id", "multiplicity", "quantity", "quantity_prov")


@query("F7_lengths", expected("SELECT line_id, length, length_prov FROM lines"))
def _(spark, sf):
    return part_lines(spark, sf).select("line_id", "length", "length_prov")


@query(
    "F9_coherence",
    expected("SELECT line_id, name, quality_group FROM lines WHERE policies LIKE '%P-6%'"),
)
def _(spark, sf):
    lines = part_lines(spark, sf)
    return lines.filter(normalize.incoherence(F.col("quality_group"), F.col("name")).isNotNull()).select(
        "line_id", "name", "quality_group"
    )


_SCORE = "CASE {} WHEN 'extracted' THEN 0.95 WHEN 'table_normalized' THEN 0.95 WHEN 'extracted_uncatalogued' THEN 0.8 WHEN 'extrapolated' THEN 0.7 WHEN 'derived' THEN 0.55 WHEN 'inferred' THEN 0.45 END"
_CONFIDENCE = "coalesce(least(" + ", ".join(_SCORE.format(p) for p in _PROV) + "), 0.0)"


@query(
    "A23_P8_confidence",
    expected(
        f"SELECT line_id, CAST({_CONFIDENCE} AS DOUBLE) AS confidence, CASE WHEN status <> 'RESUELTA' THEN 'review' "
        f"WHEN {_CONFIDENCE} < 0.9 THEN 'critic' ELSE 'resolve' END AS routing FROM lines"
    ),
)
def _(spark, sf):
    return part_lines(spark, sf).select("line_id", "confidence", "routing")


@query(
    "P8_stricter_floor",
    expected(
        f"SELECT line_id, CASE WHEN status = 'RESUELTA' AND {_CONFIDENCE} < 0.7 THEN 'REVISION_MANUAL' ELSE status END AS status, "
        f"reasons || CASE WHEN status = 'RESUELTA' AND {_CONFIDENCE} < 0.7 THEN 'LOW_CONFIDENCE' ELSE '' END AS reasons FROM lines"
    ),
)
def _(spark, sf):
    lines = validate.lines(part_read(spark, sf))
    return score.scored(lines, min_provenance="extrapolated").select("line_id", "status", codes().alias("reasons"))


@query("P9_queue", expected("SELECT CASE WHEN status = 'RESUELTA' THEN 'resuelta' ELSE 'revision' END AS queue, CAST(count(*) AS BIGINT) AS n FROM lines GROUP BY 1"))
def _(spark, sf):
    return part_lines(spark, sf).groupBy(score.queue().alias("queue")).agg(F.count(F.lit(1)).alias("n"))


_OVERLAY = "row_ref IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE {})"


@query(
    "P10_effective_queue",
    expected(
        "SELECT line_id, CASE WHEN " + _OVERLAY.format("p_size % 4 = 0") + " THEN 'revision' WHEN "
        + _OVERLAY.format("p_size % 2 = 0") + " THEN 'resuelta' WHEN status = 'RESUELTA' THEN 'resuelta' ELSE 'revision' END AS queue FROM lines"
    ),
)
def _(spark, sf):
    lines = part_lines(spark, sf)
    parts = lens.frame(spark, sf, "SELECT CAST(p_partkey AS STRING) AS row_ref, p_size FROM {part}")
    return score.effective_queue(
        lines, parts.filter("p_size % 2 = 0"), parts.filter("p_size % 4 = 0"), key="row_ref"
    ).select("line_id", "queue")


@query("P12_search", expected("SELECT line_id FROM lines WHERE (line_id LIKE '%77%' OR measure LIKE '%77%' OR standard LIKE '%77%') AND reasons LIKE '%LENGTH_MISSING%'"))
def _(spark, sf):
    return panel.search(part_lines(spark, sf), "77", "LENGTH_MISSING").select("line_id")


@query(
    "P13_vocabulary_needs",
    expected(
        "SELECT line_id, coalesce(quality_rule = 'quality:out_of_catalog', false) AS quality, "
        "coalesce(quality IS NOT NULL AND material IS NULL AND coalesce(material_rule, '') <> 'P-3:no-derivable', false) AS material, "
        "false AS finish FROM lines"
    ),
)
def _(spark, sf):
    return part_lines(spark, sf).select(
        "line_id", gaps.needs_quality().alias("quality"), gaps.needs_material().alias("material"), gaps.needs_finish().alias("finish")
    )


_UNPIVOT = " UNION ALL ".join(f"SELECT '{a}' AS attribute, {a}_prov AS p FROM lines" for a in _VALUES)


@query(
    "P16_marks",
    expected(
        f"SELECT attribute, CAST(count(*) FILTER (p IN ('extrapolated', 'derived', 'inferred', 'extracted_uncatalogued')) AS BIGINT) AS marked, "
        f"CAST(count(*) FILTER (p IN ('derived', 'inferred', 'extracted_uncatalogued')) AS BIGINT) AS weak FROM ({_UNPIVOT}) AS u GROUP BY attribute"
    ),
)
def _(spark, sf):
    cells = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"{a}_prov").alias("p")) for a in _VALUES])
    return part_lines(spark, sf).select(F.inline(cells)).groupBy("attribute").agg(
        F.count_if(score.is_marked("p")).alias("marked"), F.count_if(score.is_weak("p")).alias("weak")
    )


@query("A19_split_distribution", expected("SELECT CAST(elements AS BIGINT) AS elements, CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT row_ref, count(*) AS elements FROM lines GROUP BY row_ref) AS r GROUP BY elements"))
def _(spark, sf):
    return panel.split_distribution(part_lines(spark, sf))


@query("A20_L3_reason_counts", expected("SELECT code, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(reasons, '|')) AS code FROM lines WHERE reasons <> '') AS r GROUP BY code"))
def _(spark, sf):
    return panel.reason_counts(part_lines(spark, sf))


_RANK = "CASE {} WHEN 'table_normalized' THEN 2 WHEN 'extracted' THEN 3 WHEN 'extracted_uncatalogued' THEN 4 WHEN 'extrapolated' THEN 5 WHEN 'derived' THEN 6 WHEN 'inferred' THEN 7 WHEN 'absent' THEN 8 ELSE 1 END"
_WORST = "greatest(1, " + ", ".join(_RANK.format(p) for p in _PROV) + ")"
_ORDER = values_sql([(n, p) for n, p in enumerate(T.PROVENANCE_ORDER)], "pos, provenance")


@query(
    "A21_weakest_provenance",
    expected(
        f"SELECT CAST(o.pos AS INT) AS pos, o.provenance, CAST(count(w.worst) AS BIGINT) AS n FROM {_ORDER} AS o LEFT JOIN "
        f"(SELECT {_WORST} AS worst FROM lines WHERE status = 'RESUELTA') AS w ON w.worst = o.pos GROUP BY o.pos, o.provenance"
    ),
)
def _(spark, sf):
    return panel.resolved_by_weakest(part_lines(spark, sf))


_ATTR_WORST = " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, {a}_prov AS provenance FROM lines WHERE status = 'RESUELTA' AND {_RANK.format(a + '_prov')} = {_WORST} AND {_WORST} > 3"
    for a in _VALUES
)


@query("A22_weakest_attributes", expected(f"SELECT attribute, provenance, CAST(count(*) AS BIGINT) AS n FROM ({_ATTR_WORST}) AS u GROUP BY attribute, provenance"))
def _(spark, sf):
    return panel.weakest_attributes(part_lines(spark, sf))


@query("A39_by_family", expected("SELECT coalesce(name, 'SIN CLASIFICAR') AS family, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (status = 'RESUELTA') AS BIGINT) AS resolved FROM lines GROUP BY 1"))
def _(spark, sf):
    return panel.by_family(part_lines(spark, sf))


@query("A39_by_row", expected("SELECT row_ref, CAST(count(*) AS INT) AS n_lines, string_agg(line_id, ',' ORDER BY position) AS line_ids FROM lines GROUP BY row_ref"))
def _(spark, sf):
    return panel.by_row(part_lines(spark, sf))


@query("L4_page", expected("SELECT row_ref, line_id FROM lines ORDER BY TRY_CAST(row_ref AS DOUBLE), row_ref, position LIMIT 50 OFFSET 100"))
def _(spark, sf):
    order = [*runs.row_order(), F.col("position")]
    return panel.page(part_lines(spark, sf).select("row_ref", "line_id", "position"), order, 2, 50).drop("position")


_SHIPPED = "SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM {lineitem}"
_SHIPPED_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


@query(
    "L4_last_page",
    lens.sql(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY {', '.join(_SHIPPED_ORDER)}) AS k, count(*) OVER () AS n FROM ({_SHIPPED}) AS x) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM r WHERE (k - 1) // 50 = (n - 1) // 50"),
)
def _(spark, sf):
    path = f"{shared_folder(spark)}/bomrec-pages-{uuid.uuid4().hex}"
    panel.write_ranked(lens.frame(spark, sf, _SHIPPED), _SHIPPED_ORDER, path)
    return panel.ranked_page(spark, path, -1, 50).drop("l_shipdate")


_REFS = "SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'x' || CAST(c_nationkey AS STRING) ELSE CAST(c_custkey % 500 AS STRING) END AS ref FROM {customer}"


@query("L2_row_order", f"SELECT ref, coalesce(TRY_CAST(ref AS DOUBLE), 0.0) AS number FROM ({lens.sql(_REFS)}) AS r ORDER BY 2, 1")
def _(spark, sf):
    number, ref = runs.row_order("ref")
    return lens.frame(spark, sf, _REFS).select("ref", number.alias("number")).orderBy("number", "ref")


@query("S16_quotation_rows", expected("SELECT coalesce(name, '') AS familia, line_id AS linea_id, row_ref AS fila_origen, quantity AS cantidad, quantity_prov AS unidad_cantidad, " + ", ".join(f"coalesce({a}, '') AS {a}" for a in _VALUES) + ", status AS estado, replace(reasons, '|', ' / ') AS motivos FROM lines"))
def _(spark, sf):
    return panel.quotation_rows(part_lines(spark, sf))


# -- detection ---------------------------------------------------------------------------------

_FOLD = "trim(regexp_replace(upper(strip_accents(source_text)), '\\s+', ' ', 'g'))"
_HITROWS = f"(SELECT *, {_FOLD} AS t FROM ({ROWS_SQL}) AS r JOIN ({PIECES_SQL}) AS p ON CAST(p_partkey AS VARCHAR) = row_ref)"


def _hits(spark, sf, column):
    return part_read(spark, sf).select("row_ref", F.inline(column)).select("row_ref", "text", "start", "end")


def _at(select_rows: list[tuple[str, str]]) -> str:
    """Check for a detector: (text expression, condition) pairs located by plain search."""
    parts = [
        f"SELECT row_ref, {text} AS text, CAST(strpos(t, {text}) - 1 AS INT) AS start, "
        f"CAST(strpos(t, {text}) - 1 + length({text}) AS INT) AS \"end\" FROM {_HITROWS} AS h WHERE {cond}"
        for text, cond in select_rows
    ]
    return " UNION ALL ".join(parts)


@query("J3_names", _at([("upper(strip_accents(noun))", "noun NOT IN ('Brida', 'Válvula')"), ("'NUT'", "set_kind IN (0, 1)"), ("'TUERCAS'", "set_kind = 2")]))
def _(spark, sf):
    return _hits(spark, sf, "names")


@query("J4_finish_hits", _at([("upper(strip_accents(fin))", "fin <> ''")]))
def _(spark, sf):
    return _hits(spark, sf, "finishes")


@query("J5_materials", _at([("'ACERO'", "mat <> ''")]))
def _(spark, sf):
    return _hits(spark, sf, "materials")


# A single letter after a DIN number reads as its suffix, so the W of `DIN 933 W/2` belongs to the hit.
_STD = "std || CASE WHEN std = 'DIN 933' AND measure = '' AND quality = '' AND len = '' AND mat = '' AND set_kind = 1 THEN ' W' ELSE '' END"


@query("J6_standards", _at([(f"({_STD})", "std <> ''"), ("'DIN 934'", "set_kind IN (1, 2)")]))
def _(spark, sf):
    return _hits(spark, sf, "standards")


@query("F11_measures", _at([("upper(measure)", "measure <> ''")]))
def _(spark, sf):
    return _hits(spark, sf, "measures")


@query("F11_lengths", _at([("'40 MM'", "len <> ''")]))
def _(spark, sf):
    return _hits(spark, sf, "lengths")


@query(
    "F10_qualities",
    f"SELECT row_ref, text, CAST(count(*) AS BIGINT) AS n FROM (SELECT row_ref, quality AS text FROM {_HITROWS} AS h WHERE quality <> '' "
    f"UNION ALL SELECT row_ref, CASE set_kind WHEN 1 THEN '8' ELSE '10' END FROM {_HITROWS} AS h WHERE set_kind IN (1, 2)) AS q GROUP BY row_ref, text",
)
def _(spark, sf):
    return _hits(spark, sf, "qualities").groupBy("row_ref", "text").agg(F.count(F.lit(1)).alias("n"))


@query(
    "J10_ownership",
    f"SELECT row_ref, 0 AS position, nullif({_STD}, '') AS standard_raw, nullif(quality, '') AS quality_raw, "
    f"CASE WHEN set_kind = 3 THEN nullif(upper(strip_accents(fin)), '') END AS finish_raw FROM {_HITROWS} AS h WHERE noun NOT IN ('Brida', 'Válvula') "
    f"UNION ALL SELECT row_ref, 1, CASE WHEN set_kind > 0 THEN 'DIN 934' END, CASE set_kind WHEN 1 THEN '8' WHEN 2 THEN '10' END, "
    f"nullif(upper(strip_accents(fin)), '') FROM {_HITROWS} AS h WHERE set_kind < 3 AND noun NOT IN ('Brida', 'Válvula')",
)
def _(spark, sf):
    return part_read(spark, sf).select("row_ref", F.posexplode("elements").alias("position", "e")).select(
        "row_ref", "position", "e.standard_raw", "e.quality_raw", "e.finish_raw"
    )


@query(
    "F8_multiplicity",
    f"SELECT row_ref, CASE WHEN set_kind = 0 THEN 1 ELSE 2 END AS multiplicity, set_kind > 0 AS stated, "
    f"CASE set_kind WHEN 1 THEN '2 HEX.' WHEN 2 THEN '2' END AS count_evidence FROM {_HITROWS} AS h WHERE set_kind < 3 AND noun NOT IN ('Brida', 'Válvula')",
)
def _(spark, sf):
    return part_read(spark, sf).select("row_ref", F.posexplode("elements").alias("position", "e")).filter("position = 1").select(
        "row_ref", "e.multiplicity", "e.stated", "e.count_evidence"
    )


@query("P5_tier", f"SELECT CASE WHEN set_kind < 3 AND noun NOT IN ('Brida', 'Válvula') AND noun <> 'Tuerca' THEN 'main' ELSE 'cheap' END AS tier, CAST(count(*) AS BIGINT) AS n FROM ({PIECES_SQL}) AS p GROUP BY 1")
def _(spark, sf):
    return part_read(spark, sf).groupBy(detect.reader_tier(F.col("names"), V).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "A25_detection_coverage",
    "SELECT attribute, CAST(covered AS BIGINT) AS covered, CAST(total AS BIGINT) AS total, round(100.0 * covered / total, 6) AS pct FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS attribute, count(*) FILTER ({c}) AS covered, count(*) AS total FROM ({PIECES_SQL}) AS p"
        for a, c in (
            ("name", "noun NOT IN ('Brida', 'Válvula')"), ("standard", "std <> '' OR set_kind IN (1, 2)"),
            ("finish", "fin <> ''"), ("quality", "quality <> '' OR set_kind IN (1, 2)"),
        )
    )
    + ") AS c",
)
def _(spark, sf):
    return detect.detection_coverage(part_read(spark, sf))


@query("A25_rows_without_name", f"SELECT row_ref FROM {_HITROWS} AS h WHERE noun IN ('Brida', 'Válvula')")
def _(spark, sf):
    return detect.undetected_rows(part_read(spark, sf), "row_ref", "names")


_ALIASES = {k: a.value for k, a in Vocabulary.scanned(V.names).items()}
# Doubling every separator lets neighbouring matches share none of them.
_SPREAD = "regexp_replace(upper(strip_accents(replace({}, 'ß', 'ss'))), '([^A-Z0-9])', '\\1\\1', 'g')"


def _scan_check(table: str, key: str, text: str) -> str:
    words = "|".join(w.replace(" ", "  ") for w in sorted(_ALIASES, key=len, reverse=True))
    pairs = values_sql(sorted(_ALIASES.items()), "alias, value")
    return (
        f"SELECT {key}, v.value AS name, CAST(count(*) AS BIGINT) AS n FROM (SELECT {key}, replace(unnest(regexp_extract_all("
        f"{_SPREAD.format(text)}, '(?:^|[^A-Z0-9])({words})(?:$|[^A-Z0-9])', 1)), '  ', ' ') AS alias FROM {table}) AS h "
        f"JOIN {pairs} AS v ON v.alias = h.alias GROUP BY {key}, v.value"
    )


# Prose holds no catalogue names, so each text is followed by some.
_NAMED = "{t} || CASE {k} % 5 WHEN 0 THEN ' hex bolt, tuercas' WHEN 1 THEN '; STUD BOLT/Nut' WHEN 2 THEN ' Arandela (washer)' WHEN 3 THEN ' bolt-nut espárrago' ELSE '' END"


@query("J1_alias_scan_documents", _scan_check("documents", "doc_id", f"({_NAMED.format(t='text', k='doc_id')})"))
def _(spark, sf):
    docs = spread(lens.frame(spark, sf, f"SELECT doc_id, {_NAMED.format(t='text', k='doc_id')} AS text FROM {{documents}}"))
    hits = docs.select("doc_id", X.fold("text").alias("folded")).select("doc_id", detect.name_hits(F.col("folded"), V).alias("h"))
    return hits.select("doc_id", F.explode("h.text").alias("alias")).groupBy(
        "doc_id", detect.name_value(F.col("alias"), V).alias("name")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("J1_alias_scan_pages", _scan_check("pages", "page_id", f"({_NAMED.format(t='html', k='page_id')})"))
def _(spark, sf):
    pages = spread(lens.frame(spark, sf, f"SELECT page_id, {_NAMED.format(t='html', k='page_id')} AS html FROM {{pages}}"))
    hits = pages.select("page_id", X.fold("html").alias("folded")).select("page_id", detect.name_hits(F.col("folded"), V).alias("h"))
    return hits.select("page_id", F.explode("h.text").alias("alias")).groupBy(
        "page_id", detect.name_value(F.col("alias"), V).alias("name")
    ).agg(F.count(F.lit(1)).alias("n"))


# Aliases are all phrases of one to five words of the benchmark, with their marks and accents; single words of
# seven letters and more. They overlap, and there are more of them than an inline pattern takes.
_FOLD = "trim(regexp_replace(upper(strip_accents(replace({}, 'ß', 'ss'))), '\\s+', ' ', 'g'))"
_JOINED = lens.sql(
    "WITH b AS (SELECT item_id, string_split(text, ' ') AS w FROM {benchmark}), p AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM b), "
    "phrases AS (SELECT array_to_string(w[i:i + k - 1], ' ') AS alias, item_id * 1000000 + i * 5 + k AS ord FROM p, (VALUES (1), (2), (3), (4), (5)) AS ks(k) "
    "WHERE i + k - 1 <= len(w) AND (k > 1 OR length(w[i]) >= 7)), "
    f"needles AS (SELECT {_FOLD.format('alias')} AS needle, min(ord) AS ord FROM phrases GROUP BY 1), "
    "al AS (SELECT needle, ord, regexp_extract(needle, '^[^A-Z0-9]*') AS lead, regexp_extract(needle, '[^A-Z0-9]*$') AS tail, "
    "regexp_replace(regexp_replace(needle, '^[^A-Z0-9]+', ''), '[^A-Z0-9]+$', '') AS core, len(regexp_extract_all(needle, '[A-Z0-9]+')) AS k "
    "FROM needles WHERE regexp_matches(needle, '[A-Z0-9]')), "
    f"d AS (SELECT doc_id, f, regexp_extract_all(f, '[A-Z0-9]+[^A-Z0-9]*') AS u, regexp_extract(f, '^[^A-Z0-9]*') AS before FROM (SELECT doc_id, {_FOLD.format('text')} AS f FROM {{documents}}) AS x), "
    "e AS (SELECT doc_id, u, before, unnest(u) AS unit, unnest(range(1, len(u) + 1)) AS i FROM d), "
    "o AS (SELECT *, length(before) + coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e), "
    "c AS (SELECT doc_id, i, k, start, array_to_string(u[i:i + k - 2], '') || regexp_extract(u[i + k - 1], '^[A-Z0-9]+') AS core, len(u) AS n, "
    "CASE WHEN i = 1 THEN before ELSE regexp_extract(u[i - 1], '[^A-Z0-9]*$') END AS gap, regexp_extract(u[i + k - 1], '[^A-Z0-9]*$') AS after "
    "FROM o, (SELECT DISTINCT k FROM al) AS ks WHERE i + k - 1 <= len(u)), "
    "found AS (SELECT doc_id, needle, ord, start - length(lead) AS s, start + length(core) + length(tail) AS t FROM c JOIN al USING (k, core) "
    "WHERE ends_with(gap, lead) AND (lead = '' OR i = 1 OR length(gap) > length(lead)) AND starts_with(after, tail) AND (tail = '' OR i + k - 1 = n OR length(after) > length(tail))), "
    "opened AS (SELECT *, CASE WHEN coalesce(max(t) OVER (PARTITION BY doc_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= s THEN 1 ELSE 0 END AS opens FROM found), "
    "clusters AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM opened), "
    "lists AS (SELECT doc_id, list([{{'s': s, 't': t, 'needle': needle}}] ORDER BY s - t, ord, s) AS l FROM clusters GROUP BY doc_id, cluster), "
    "claimed AS (SELECT doc_id, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s < x[1].t AND x[1].s < y.t)) > 0 THEN a ELSE list_concat(a, x) END)) AS h FROM lists) "
)


@query(
    "J1_alias_join_documents",
    _JOINED + "SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT h.needle) AS BIGINT) AS n_aliases, CAST(sum(h.s) AS BIGINT) AS starts, CAST(sum(h.t - h.s) AS BIGINT) AS characters FROM claimed GROUP BY doc_id",
)
def _(spark, sf):
    docs = spread(lens.frame(spark, sf, "SELECT doc_id, text FROM {documents}"))
    # By text once, or the count of distinct aliases would send all of them twice.
    found = detect.find_aliases_join(docs, "doc_id", "text", _phrases(spark, sf)).repartition("doc_id")
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(X.fold("alias")).alias("n_aliases"), F.sum("start").cast("long").alias("starts"),
        F.sum(F.col("end") - F.col("start")).cast("long").alias("characters"),
    )


def _phrases(spark, sf):
    words = spread(lens.frame(spark, sf, "SELECT item_id, split(text, ' ') AS w FROM {benchmark}"))
    at = words.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    ranks = F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4, 5)])).alias("k")
    phrases = at.select("item_id", "w", "i", ranks).where((F.col("i") + F.col("k") - 1 <= F.size("w")) & ((F.col("k") > 1) | (F.length(F.get("w", F.col("i") - 1)) >= 7)))
    return phrases.select(F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("alias"), (F.col("item_id") * 1000000 + F.col("i") * 5 + F.col("k")).alias("ord")).withColumn("value", F.col("alias"))


@query(
    "P1_empty_description",
    lens.sql(
        "SELECT page_id FROM (SELECT conv_id * 1000 + turn AS page_id, CASE WHEN turn % 2 = 0 THEN substr(text, 1, 9) WHEN turn % 5 = 0 THEN 'nut ' || substr(text, 1, 3) ELSE text END AS text FROM {conversations}) AS c WHERE "
        "length(regexp_replace(text, '[^A-Za-zÀ-ÿ]', '', 'g')) < 8 AND NOT regexp_matches(upper(strip_accents(text)), "
        "'(^|[^A-Z0-9])(" + "|".join(sorted(_ALIASES)) + ")($|[^A-Z0-9])') AND NOT regexp_matches(upper(strip_accents(text)), '\\b(DIN|EN|ISO)\\s*[0-9]+\\b')"
    ),
)
def _(spark, sf):
    turns = lens.frame(spark, sf, "SELECT conv_id * 1000 + turn AS page_id, CASE WHEN turn % 2 = 0 THEN substr(text, 1, 9) WHEN turn % 5 = 0 THEN 'nut ' || substr(text, 1, 3) ELSE text END AS text FROM {conversations}")
    folded = turns.withColumn("folded", X.fold("text"))
    hits = folded.select("page_id", "text", detect.name_hits(F.col("folded"), V).alias("n"), detect.standard_hits(F.col("folded"), V).alias("s"))
    return hits.filter(detect.is_empty_description(F.col("text"), F.col("n"), F.col("s"))).select("page_id")


# -- value functions -----------------------------------------------------------------------------

_EQUIV = values_sql(sorted(T.STANDARD_EQUIVALENCES.items()), "din, iso")


@query(
    "J7_standard_equivalence",
    lens.sql(
        "SELECT k, raw, coalesce(a.iso, b.iso, bare) AS normalized, CASE WHEN coalesce(a.iso, b.iso) IS NULL THEN 'DIN' WHEN coalesce(a.iso, b.iso) LIKE 'EN%' THEN 'EN' ELSE 'ISO' END AS family, "
        "coalesce(a.iso, b.iso) IS NOT NULL AS mapped FROM (SELECT *, 'DIN ' || n AS bare, CASE WHEN sfx = '' THEN 'DIN ' || n ELSE 'DIN ' || n || ' ' || sfx END AS full_ FROM "
        "(SELECT p_partkey AS k, CAST(CASE WHEN p_partkey % 5 = 0 THEN 125 WHEN p_partkey % 5 = 1 THEN 7981 ELSE p_partkey % 1000 + 1 END AS VARCHAR) AS n, CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C-H' ELSE '' END AS sfx, "
        "'din' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' END || CAST(CASE WHEN p_partkey % 5 = 0 THEN 125 WHEN p_partkey % 5 = 1 THEN 7981 ELSE p_partkey % 1000 + 1 END AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN ' A' WHEN 1 THEN ' C - H' ELSE '' END AS raw FROM {part}) AS x) AS y "
        f"LEFT JOIN {_EQUIV} AS a ON a.din = full_ LEFT JOIN {_EQUIV} AS b ON b.din = bare AND a.din IS NULL"
    ),
)
def _(spark, sf):
    raw = lens.frame(
        spark, sf,
        "SELECT p_partkey AS k, 'din' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' END || CAST(CASE WHEN p_partkey % 5 = 0 THEN 125 WHEN p_partkey % 5 = 1 THEN 7981 ELSE p_partkey % 1000 + 1 END AS STRING) || CASE p_partkey % 4 WHEN 0 THEN ' A' WHEN 1 THEN ' C - H' ELSE '' END AS raw FROM {part}",
    )
    return normalize.standard_columns(raw, "raw", V).drop("rule")


_GROUPS = values_sql([(v, g) for g, m in T.QUALITY_GROUPS.items() for v in m], "value, group_id")
_ENTRY_LENS = """
SELECT 'q-' || CAST(p_partkey AS STRING) AS id, 'GR ' || CAST(p_partkey % 150 AS STRING) AS alias,
  CASE WHEN p_partkey % 150 < 40 THEN 'G5' WHEN p_partkey % 300 < 150 THEN 'V-A' ELSE 'V-B' END AS group_id
FROM {part}
"""
_QUALITY_VALUES = """
SELECT l_orderkey % 400 AS k, CASE l_partkey % 3 WHEN 0 THEN 'gr  ' || CAST(l_orderkey % 400 AS STRING)
  WHEN 1 THEN 'Grade ' || CAST(l_orderkey % 9 AS STRING) ELSE 'A2-' || CAST(l_orderkey % 100 AS STRING) END AS raw FROM {lineitem}
"""


@query(
    "J8_quality_layers",
    f"SELECT raw, source, group_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT raw, CASE WHEN c.group_id IS NOT NULL THEN 'catalog' WHEN e.n = 1 THEN 'vocab' WHEN e.n > 1 THEN 'ambiguous' ELSE 'out' END AS source, "
    f"CASE WHEN c.group_id IS NOT NULL THEN c.group_id WHEN e.n = 1 THEN e.g END AS group_id FROM ({lens.sql(_QUALITY_VALUES)}) AS q "
    f"LEFT JOIN {_GROUPS} AS c ON c.value = regexp_replace(upper(raw), '\\s+', ' ', 'g') "
    f"LEFT JOIN (SELECT alias, count(DISTINCT group_id) AS n, min(group_id) AS g FROM ({lens.sql(_ENTRY_LENS)}) AS z GROUP BY alias) AS e ON e.alias = regexp_replace(upper(raw), '\\s+', ' ', 'g')) AS r GROUP BY raw, source, group_id",
)
def _(spark, sf):
    values = lens.frame(spark, sf, _QUALITY_VALUES).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    groups = spark.createDataFrame([(v, g) for g, m in T.QUALITY_GROUPS.items() for v in m], "value string, group_id string")
    return normalize.resolve_qualities(values, "raw", groups, lens.frame(spark, sf, _ENTRY_LENS)).select("raw", "source", "group_id", "n")


@query(
    "J24_equivalent_qualities",
    f"WITH d AS (SELECT DISTINCT raw FROM ({lens.sql(_QUALITY_VALUES)}) AS q), g AS (SELECT raw, group_id FROM d LEFT JOIN {_GROUPS} AS c ON c.value = regexp_replace(upper(raw), '\\s+', ' ', 'g')) "
    "SELECT raw, group_id, CASE WHEN group_id IS NOT NULL THEN CAST(count(*) OVER (PARTITION BY group_id) AS BIGINT) END AS n_equivalent FROM g",
)
def _(spark, sf):
    groups = spark.createDataFrame([(v, g) for g, m in T.QUALITY_GROUPS.items() for v in m], "value string, group_id string")
    return normalize.equivalent_qualities(lens.frame(spark, sf, _QUALITY_VALUES), "raw", groups)


@query(
    "J9_material_derivation",
    f"SELECT raw, CASE WHEN g IN ('G10', 'G11', 'G12', 'G13', 'G14') THEN 'deliberate' WHEN g IS NOT NULL OR regexp_matches(raw, '^(GR\\.?\\s*)?(B7M?|2HM?|B16)$|^45H$') THEN 'derived' ELSE 'uncovered' END AS outcome, "
    f"CASE WHEN g IN ('G1', 'G2', 'G3', 'G4') THEN 'INOX' WHEN g IN ('G5', 'G6', 'G7', 'G8', 'G9') OR regexp_matches(raw, '^(GR\\.?\\s*)?(B7M?|2HM?|B16)$|^45H$') THEN 'AC' END AS material "
    f"FROM (SELECT DISTINCT raw, c.group_id AS g FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'GR B' || CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size * 20 AS VARCHAR) || 'HV' WHEN 2 THEN 'A' || CAST(p_size % 6 AS VARCHAR) ELSE CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 8 = 3 THEN 'H' ELSE '' END END AS raw FROM part) AS q LEFT JOIN {_GROUPS} AS c ON c.value = raw) AS r",
)
def _(spark, sf):
    raw = lens.frame(
        spark, sf,
        "SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'GR B' || CAST(p_size AS STRING) WHEN 1 THEN CAST(p_size * 20 AS STRING) || 'HV' WHEN 2 THEN 'A' || CAST(p_size % 6 AS STRING) ELSE CAST(p_size AS STRING) || CASE WHEN p_partkey % 8 = 3 THEN 'H' ELSE '' END END AS raw FROM {part}",
    )
    q = raw.withColumn("q", normalize.resolve_quality(F.col("raw"), V))
    return q.withColumn("d", normalize.derive_material(F.col("raw"), F.col("q.group"), V)).select("raw", "d.outcome", "d.material")


# A pattern for every order, some of them deliberate gaps or with a second material, against the qualities of all lines.
_PATTERNS = (
    "SELECT 'd' || CAST(o_orderkey AS STRING) AS id, '^(GR\\\\.?\\\\s*)?Q' || CAST(o_orderkey AS STRING) || '(M|H)?$' AS value, CASE o_orderkey % 3 WHEN 0 THEN 'AC' WHEN 1 THEN 'INOX' ELSE 'LATON' END AS material FROM {orders} "
    "UNION ALL SELECT 'e' || CAST(o_orderkey AS STRING), 'q' || CAST(o_orderkey AS STRING) || 'H+$', 'INOX' FROM {orders} WHERE o_orderkey % 7 = 0"
)
_QUALITIES = "SELECT DISTINCT CASE l_linenumber % 3 WHEN 0 THEN 'GR. ' WHEN 1 THEN 'gr' ELSE '' END || 'Q' || CAST(l_partkey AS STRING) || CASE l_suppkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'H' WHEN 2 THEN 'X' ELSE '' END AS raw, CASE WHEN l_partkey % 10 = 0 THEN 'V-' || CAST(l_suppkey % 3 AS STRING) END AS grp, l_partkey AS n, l_suppkey % 4 AS k FROM {lineitem}"


@query(
    "J9_pattern_tables",
    lens.sql(
        f"WITH q AS ({_QUALITIES.replace('STRING', 'VARCHAR')}), m AS ("
        "SELECT q.*, CASE n % 3 WHEN 0 THEN 'AC' WHEN 1 THEN 'INOX' ELSE 'LATON' END AS material, 'd' || CAST(n AS VARCHAR) AS id FROM q WHERE k <> 2 AND n IN (SELECT o_orderkey FROM {orders}) "
        "UNION ALL SELECT q.*, 'INOX', 'e' || CAST(n AS VARCHAR) FROM q WHERE k = 1 AND n % 7 = 0 AND n IN (SELECT o_orderkey FROM {orders}) "
        "UNION ALL SELECT q.*, 'AC', 'g1' FROM q WHERE grp = 'V-1'), "
        "f AS (SELECT raw, grp, min(material) AS lo, max(material) AS hi, min(id) AS id FROM m GROUP BY raw, grp) "
        "SELECT q.raw, q.grp, CASE WHEN k <> 2 AND n % 11 = 0 THEN 'deliberate' WHEN lo IS NULL THEN 'uncovered' WHEN lo = hi THEN 'derived' ELSE 'ambiguous' END AS outcome, "
        "CASE WHEN lo = hi AND NOT (k <> 2 AND n % 11 = 0) THEN lo END AS material, CASE WHEN lo = hi AND NOT (k <> 2 AND n % 11 = 0) THEN 'P-3:' || id END AS rule FROM q LEFT JOIN f ON f.raw = q.raw AND f.grp IS NOT DISTINCT FROM q.grp"
    ),
)
def _(spark, sf):
    entries = lens.frame(spark, sf, _PATTERNS).select("id", F.lit("pattern").alias("kind"), "value", "material", F.lit("2026-01-01").alias("decided_at"))
    own = spark.createDataFrame([("g1", "group", "V-1", "AC", "2026-01-01")], entries.schema)
    gaps = lens.frame(spark, sf, "SELECT DISTINCT 'pattern' AS kind, 'Q' || CAST(l_partkey AS STRING) || '[MH]?$' AS value FROM {lineitem} WHERE l_partkey % 11 = 0")
    qualities = lens.frame(spark, sf, _QUALITIES).withColumnRenamed("grp", "group")
    return normalize.derive_material_join(qualities, entries.unionByName(own), gaps).withColumnRenamed("group", "grp")


@query(
    "F4_F5_measures",
    lens.sql(
        "SELECT k, raw, system, round(mm, 6) AS nominal_mm, canonical, len AS length_raw, bare FROM ("
        "SELECT p_partkey AS k, 'M' || CAST(p_size AS VARCHAR) || ',5 x ' || CAST(p_partkey % 90 + 1 AS VARCHAR) AS raw, 'metric' AS system, p_size + 0.5 AS mm, 'M' || CAST(p_size AS VARCHAR) || '.5' AS canonical, CAST(p_partkey % 90 + 1 AS VARCHAR) AS len, false AS bare FROM {part} WHERE p_partkey % 4 = 0 "
        "UNION ALL SELECT p_partkey, CAST(p_size AS VARCHAR) || ' ' || CAST(p_partkey % 7 + 1 AS VARCHAR) || '/8\"', 'imperial', (p_size + (p_partkey % 7 + 1) / 8.0) * 25.4, CAST(p_size AS VARCHAR) || '-' || CASE p_partkey % 7 WHEN 0 THEN '1/8' WHEN 1 THEN '1/4' WHEN 2 THEN '3/8' WHEN 3 THEN '1/2' WHEN 4 THEN '5/8' WHEN 5 THEN '3/4' ELSE '7/8' END || '\"', NULL, false FROM {part} WHERE p_partkey % 4 = 1 "
        "UNION ALL SELECT p_partkey, CAST(p_size AS VARCHAR) || '\" X ' || CAST(p_partkey % 90 AS VARCHAR) || ' LG', 'imperial', p_size * 25.4, CAST(p_size AS VARCHAR) || '\"', CAST(p_partkey % 90 AS VARCHAR), false FROM {part} WHERE p_partkey % 4 = 2 "
        "UNION ALL SELECT p_partkey, CAST(p_size AS VARCHAR) || '.8x25', 'metric', p_size + 0.8, CAST(p_size AS VARCHAR) || '.8', '25', true FROM {part} WHERE p_partkey % 4 = 3) AS m"
    ),
)
def _(spark, sf):
    raw = lens.frame(
        spark, sf,
        "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'M' || CAST(p_size AS STRING) || ',5 x ' || CAST(p_partkey % 90 + 1 AS STRING) WHEN 1 THEN CAST(p_size AS STRING) || ' ' || CAST(p_partkey % 7 + 1 AS STRING) || '/8\"' WHEN 2 THEN CAST(p_size AS STRING) || '\" X ' || CAST(p_partkey % 90 AS STRING) || ' LG' ELSE CAST(p_size AS STRING) || '.8x25' END AS raw FROM {part}",
    )
    return raw.withColumn("m", M.parse_measure(F.col("raw"))).select("k", "raw", "m.system", F.round("m.nominal_mm", 6).alias("nominal_mm"), "m.canonical", "m.length_raw", "m.bare")


_MM_OK = "(n / mm BETWEEN 0.4 AND 60)"
_IN_OK = "(n / mm * 25.4 BETWEEN 0.4 AND 60)"


@query(
    "F6_length_units",
    lens.sql(
        f"SELECT k, CASE WHEN metric THEN 'mm' WHEN {_MM_OK} AND NOT {_IN_OK} THEN 'mm' WHEN {_IN_OK} AND NOT {_MM_OK} THEN 'inch' END AS unit, "
        f"CASE WHEN metric THEN 'designation' WHEN {_MM_OK} <> {_IN_OK} THEN 'plausibility' END AS basis FROM "
        "(SELECT l_orderkey * 8 + l_linenumber AS k, l_quantity * (l_partkey % 30 + 1) AS n, (l_partkey % 5 + 1) * 12.7 AS mm, l_suppkey % 2 = 0 AS metric FROM {lineitem}) AS x"
    ),
)
def _(spark, sf):
    x = lens.frame(spark, sf, "SELECT l_orderkey * 8 + l_linenumber AS k, CAST(CAST(l_quantity * (l_partkey % 30 + 1) AS BIGINT) AS STRING) AS raw, CAST((l_partkey % 5 + 1) * 12.7 AS DOUBLE) AS mm, CASE WHEN l_suppkey % 2 = 0 THEN 'metric' ELSE 'imperial' END AS system FROM {lineitem}")
    return x.withColumn("r", M.resolve_length(F.col("raw"), F.col("system"), F.col("mm"))).select("k", "r.unit", "r.basis")


@query("F1_fold", lens.sql("SELECT doc_id, md5(trim(regexp_replace(upper(strip_accents(replace(text, 'ß', 'ss'))), '\\s+', ' ', 'g'))) AS folded FROM {documents}"))
def _(spark, sf):
    return lens.frame(spark, sf, "SELECT doc_id, text FROM {documents}").select("doc_id", F.md5(X.fold("text")).alias("folded"))


# Evidence is words two to five of every benchmark item, spaced otherwise than in the texts.
_EVIDENCE = "split_part(text, ' ', 2) || '  ' || split_part(text, ' ', 3) || ' \t' || split_part(text, ' ', 4) || '  ' || lower(split_part(text, ' ', 5))"


@query("F2_evidence", lens.sql(f"SELECT doc_id, item_id FROM (SELECT doc_id, upper(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM {{documents}}) AS d JOIN (SELECT item_id, upper(trim(regexp_replace({_EVIDENCE}, '\\s+', ' ', 'g'))) AS e FROM {{benchmark}}) AS b ON contains(t, e)"))
def _(spark, sf):
    docs = spread(lens.frame(spark, sf, "SELECT doc_id, text FROM {documents}"))
    evidence = lens.frame(spark, sf, f"SELECT item_id AS evidence_id, {_EVIDENCE} AS evidence FROM {{benchmark}}")
    return reader.find_evidence_join(docs, "doc_id", "text", evidence).select("doc_id", F.col("evidence_id").alias("item_id"))


@query("F3_compare", lens.sql("SELECT p_partkey, nullif(nullif(upper(CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN '—' ELSE p_name END), '—'), '') AS key FROM {part} WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, NULL FROM {part} WHERE p_partkey % 5 = 0"))
def _(spark, sf):
    raw = lens.frame(spark, sf, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN '—' ELSE p_name END AS raw FROM {part}")
    return raw.select("p_partkey", X.compare_key("raw").alias("key"))


@query("F17_slugs", lens.sql("SELECT c_custkey, 'finish-' || substr(regexp_replace(lower(c_name || '/' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), 1, 40) AS entry_id, 'V-' || upper(substr(regexp_replace(lower(c_name || '/' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), 1, 32)) AS group_id FROM {customer}"))
def _(spark, sf):
    raw = lens.frame(spark, sf, "SELECT c_custkey, c_name || '/' || c_mktsegment AS t FROM {customer}")
    return raw.select("c_custkey", X.entry_id("finish", "t").alias("entry_id"), X.own_group_id("t").alias("group_id"))


@query("F18_exact_patterns", lens.sql("SELECT c_custkey, '^' || upper(replace(c_name, '#', '\\.')) || '$' AS pattern FROM {customer}"))
def _(spark, sf):
    raw = lens.frame(spark, sf, "SELECT c_custkey, replace(c_name, '#', '.') AS t FROM {customer}")
    return raw.select("c_custkey", X.exact_pattern("t").alias("pattern"))


@query("F24_unescape", lens.sql("SELECT c_custkey, replace(c_name, '#', '\"') || chr(10) || c_mktsegment AS t FROM {customer}"))
def _(spark, sf):
    raw = lens.frame(spark, sf, "SELECT c_custkey, replace(c_name, '#', '~\"') || '~n' || c_mktsegment AS t FROM {customer}")
    return raw.select("c_custkey", X.unescape_jsonish(F.replace("t", F.lit("~"), F.lit("\\"))).alias("t"))


@query("F12_known_grades", lens.sql("SELECT p_partkey FROM {part} WHERE p_size IN (4, 7, 8) OR (p_size = 16 AND p_partkey % 2 = 0)"))
def _(spark, sf):
    raw = lens.frame(spark, sf, "SELECT p_partkey, CASE WHEN p_size = 16 AND p_partkey % 2 = 0 THEN 'gr. b16' ELSE 'GR ' || CAST(p_size AS STRING) END AS raw FROM {part}")
    return raw.filter(detect.is_known_grade("raw")).select("p_partkey")


@query("F19_group_shape", lens.sql("SELECT g, g IN ('G1','G2','G3','G4','G5','G6','G7','G8','G9','G10','G11','G12','G13','G14') OR g LIKE 'V-_%' AS known FROM (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'V-' || substr(p_brand, 7) WHEN 1 THEN 'V-' ELSE 'G' || CAST(p_size AS VARCHAR) END AS g FROM {part}) AS x"))
def _(spark, sf):
    g = lens.frame(spark, sf, "SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'V-' || substr(p_brand, 7) WHEN 1 THEN 'V-' ELSE 'G' || CAST(p_size AS STRING) END AS g FROM {part}")
    return g.select("g", catalog.is_known_group("g").alias("known"))


# -- gaps ---------------------------------------------------------------------------------------

_GAPS = """gaps AS (
  SELECT row_ref, 'UNCOVERED_DERIVATION' AS kind, 'material' AS attribute, quality AS value FROM lines
  WHERE quality = 'GR 99' AND material IS NULL
  UNION ALL SELECT row_ref, 'UNKNOWN_VALUE', 'quality', quality FROM lines WHERE quality = 'GR 99'
  UNION ALL SELECT b.row_ref, 'UNPLACED_EVIDENCE', 'standard',
    CASE std WHEN 'DIN 933' THEN 'ISO 4017' WHEN 'DIN 125 A' THEN 'ISO 7089' ELSE std END
  FROM b WHERE name IS NULL AND std <> ''
  UNION ALL SELECT b.row_ref, 'UNPLACED_EVIDENCE', 'finish', f FROM b WHERE name IS NULL AND f IS NOT NULL)"""


def _part_gaps(spark, sf):
    return gaps.gaps_of_read(part_read(spark, sf), V)


@query("U2_J14_J26_J28_gaps", expected("SELECT row_ref, kind, attribute, value FROM gaps", _GAPS))
def _(spark, sf):
    return _part_gaps(spark, sf)


@query("J14_gaps_of_stored_lines", expected("SELECT attribute, value, CAST(count(*) AS BIGINT) AS n FROM gaps GROUP BY attribute, value", _GAPS))
def _(spark, sf):
    found = gaps.detect_gaps(part_rows(spark, sf), part_lines(spark, sf), V)
    return found.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))


@query("A1_L3_backlog", expected("SELECT kind, attribute, upper(value) AS value_key, CAST(count(*) AS BIGINT) AS n_rows, min(value) AS value FROM gaps GROUP BY kind, attribute, upper(value)", _GAPS))
def _(spark, sf):
    return gaps.backlog(_part_gaps(spark, sf))


@query("A27_gap_summary", expected("SELECT CAST(count(*) AS BIGINT) AS gaps, CAST(count(DISTINCT row_ref) AS BIGINT) AS rows_with_gap, (SELECT CAST(count(*) AS BIGINT) FROM part) AS n_rows, round(100.0 * count(DISTINCT row_ref) / (SELECT count(*) FROM part), 6) AS pct_rows FROM gaps", _GAPS))
def _(spark, sf):
    return gaps.gap_summary(_part_gaps(spark, sf), lens.frame(spark, sf, lens.PART_ROWS))


@query(
    "J21_line_decisions",
    expected(
        "SELECT row_ref, line_id, 0 AS rank, 'quality' AS attribute, quality AS value, quality = 'GR 99' AS blocking FROM lines WHERE quality_rule = 'quality:out_of_catalog' "
        "OR quality = 'GR 99' UNION ALL SELECT row_ref, line_id, 1, 'material', quality, true FROM lines WHERE quality = 'GR 99' AND material IS NULL "
    ).replace("quality = 'GR 99' AS blocking", "quality = 'GR 99' AS blocking"),
)
def _(spark, sf):
    return gaps.line_decisions(part_lines(spark, sf), _part_gaps(spark, sf))


@query("U5_distinct_detections", f"SELECT row_ref, CAST(CASE WHEN noun IN ('Brida', 'Válvula') THEN 0 WHEN set_kind < 3 THEN 2 ELSE 1 END AS INT) AS names, CAST(CASE WHEN std = '' THEN 0 ELSE 1 END + CASE WHEN set_kind IN (1, 2) THEN 1 ELSE 0 END AS INT) AS standards, CAST(CASE WHEN fin = '' THEN 0 ELSE 1 END AS INT) AS finishes FROM {_HITROWS} AS h")
def _(spark, sf):
    return part_read(spark, sf).select(
        "row_ref", F.size(detect.distinct_names(F.col("names"), V)).alias("names"),
        F.size(detect.distinct_standards(F.col("standards"), V)).alias("standards"),
        F.size(detect.distinct_finishes(F.col("finishes"), V)).alias("finishes"),
    )


# -- recorded answers -----------------------------------------------------------------------------

_ANS = f"(SELECT *, CAST(p_partkey AS VARCHAR) AS row_ref, p_partkey AS k, noun IN ('Brida', 'Válvula') AS foreign_, p_partkey % 6 = 0 OR noun = 'Brida' AS claimed_out FROM ({PIECES_SQL}) AS p)"


@query(
    "J22_F28_P4_unverifiable",
    f"SELECT row_ref, noun AS element, 'quality' AS attribute, 'ZZ 77' AS evidence FROM {_ANS} AS a WHERE NOT foreign_ AND k % 6 <> 0 AND k % 9 = 0 AND k % 31 <> 0 "
    f"UNION ALL SELECT row_ref, CASE WHEN set_kind = 2 THEN 'tuercas' ELSE 'NUT' END, '(element)', 'ECROU' FROM {_ANS} AS a WHERE NOT foreign_ AND k % 6 <> 0 AND set_kind < 3 AND k % 10 = 1 "
    f"UNION ALL SELECT row_ref, '(unreadable)', '(element without evidence)', '' FROM {_ANS} AS a WHERE NOT foreign_ AND k % 6 <> 0 AND k % 31 = 0 "
    f"UNION ALL SELECT row_ref, '(row)', '(out of family contradicted by the table)', CASE noun WHEN 'Hex Bolt' THEN 'TORNILLO' WHEN 'Tornillo' THEN 'TORNILLO' WHEN 'Tuerca' THEN 'TUERCA' WHEN 'Washer' THEN 'ARANDELA' WHEN 'Threaded Rod' THEN 'VARILLA ROSCADA' ELSE 'ESPARRAGO' END FROM {_ANS} AS a WHERE NOT foreign_ AND claimed_out",
)
def _(spark, sf):
    return reader.unverifiable_values(answered_read(spark, sf))


@query(
    "J29_rejected_counts",
    f"SELECT row_ref, CAST(CASE WHEN k % 31 = 0 THEN 0 ELSE 1 END AS INT) AS position, CASE WHEN set_kind = 2 THEN 'tuercas' ELSE 'NUT' END AS element, CAST(CASE WHEN k % 3 = 0 THEN 5 ELSE 2 END AS INT) AS claimed, "
    f"CAST(CASE WHEN set_kind = 0 THEN 1 ELSE 2 END AS INT) AS row_count, CASE set_kind WHEN 1 THEN '2 HEX.' WHEN 2 THEN '2' END AS evidence, CASE WHEN set_kind = 0 THEN 'not_in_description' ELSE 'row_says_other' END AS reason "
    f"FROM {_ANS} AS a WHERE NOT foreign_ AND k % 6 <> 0 AND set_kind < 3 AND k % 10 <> 1 AND (set_kind = 0 OR k % 3 = 0)",
)
def _(spark, sf):
    return reader.rejected_counts(answered_read(spark, sf))


@query(
    "P3_P4_special_lines",
    f"SELECT row_ref, row_ref || '.' || kind AS line_id, CASE kind WHEN 'X' THEN 'OUT_OF_FAMILY' WHEN 'E' THEN 'PROCESSING_FAILED' WHEN '0' THEN 'EMPTY_DESCRIPTION' ELSE 'NO_ELEMENTS_EXTRACTED' END AS reasons FROM ("
    f"SELECT a.row_ref, CASE WHEN foreign_ AND std = '' AND length(regexp_replace(source_text, '[^A-Za-zÀ-ÿ]', '', 'g')) < 8 THEN '0' WHEN foreign_ AND claimed_out THEN 'X' WHEN k % 97 = 0 THEN 'E' "
    f"WHEN foreign_ OR k % 6 = 0 OR (k % 31 = 0 AND (set_kind = 3 OR k % 10 = 1)) THEN 'N' END AS kind FROM {_ANS} AS a JOIN ({ROWS_SQL}) AS r ON r.row_ref = a.row_ref) AS s WHERE kind IS NOT NULL",
)
def _(spark, sf):
    return answered_lines(spark, sf).filter("position = 0").select("row_ref", "line_id", codes().alias("reasons"))


@query(
    "J13_A43_rejected_measures",
    f"SELECT row_ref, row_ref || '.2' AS line_id, true AS recovered_quality, CASE set_kind WHEN 1 THEN '8' ELSE '10' END AS quality, "
    f"CASE measure WHEN 'M16x60' THEN 'M16' WHEN '7/8\" X 130' THEN '7/8\"' WHEN 'M20 x 1000' THEN 'M20' WHEN '3/4\" X 5000' THEN '3/4\"' ELSE measure END AS measure, 'extrapolated' AS measure_prov "
    f"FROM {_ANS} AS a WHERE NOT foreign_ AND k % 6 <> 0 AND set_kind IN (1, 2) AND measure <> '' AND k % 10 <> 1 AND k % 31 <> 0 AND k % 97 <> 0",
)
def _(spark, sf):
    return runs.rejected_measures(answered_lines(spark, sf))


_SPECIAL = CHECKS["P3_P4_special_lines"]
_LOST = CHECKS["J22_F28_P4_unverifiable"]


@query(
    "A38_reader_diagnostics",
    f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (set_kind < 3 AND NOT foreign_) AS BIGINT) AS tier_main, "
    f"CAST(count(*) FILTER (set_kind = 3 OR foreign_) - (SELECT count(*) FROM ({_SPECIAL}) AS e WHERE reasons = 'EMPTY_DESCRIPTION') AS BIGINT) AS tier_cheap, "
    f"(SELECT count(*) FROM ({_SPECIAL}) AS e WHERE reasons = 'EMPTY_DESCRIPTION') AS tier_none, CAST(0 AS BIGINT) AS escalated, (SELECT count(*) FROM ({_LOST}) AS l) AS unverifiable, "
    f"(SELECT count(*) FROM ({CHECKS['J29_rejected_counts']}) AS r) AS rejected_counts, (SELECT count(*) FROM ({_SPECIAL}) AS x WHERE reasons = 'OUT_OF_FAMILY') AS out_of_family_rows FROM {_ANS} AS a",
)
def _(spark, sf):
    return reader.reader_diagnostics(answered_read(spark, sf))


@query(
    "P6_review_eligible",
    f"SELECT row_ref, false AS off, free AND n > 0 AS \"all\", free AND (n > 1 OR lost) AS multi_element FROM (SELECT row_ref, k % 97 <> 0 AND row_ref NOT IN (SELECT row_ref FROM ({_SPECIAL}) AS x WHERE reasons IN ('OUT_OF_FAMILY', 'EMPTY_DESCRIPTION')) AS free, "
    f"row_ref IN (SELECT row_ref FROM ({_LOST}) AS l) AS lost, CASE WHEN foreign_ OR k % 6 = 0 THEN 0 ELSE CASE WHEN k % 31 = 0 THEN 0 ELSE 1 END + CASE WHEN set_kind < 3 AND k % 10 <> 1 THEN 1 ELSE 0 END END AS n FROM {_ANS} AS a) AS b",
)
def _(spark, sf):
    read = answered_read(spark, sf)
    blocked = F.col("read_error").isNotNull() | F.col("skipped") | F.col("out_of_family")
    return read.select(
        "row_ref",
        *[
            score.review_eligible(r, F.size("elements"), F.size("unverifiable"), blocked).alias(r)
            for r in ("off", "all", "multi_element")
        ],
    )


@query(
    "P11_in_scope",
    f"SELECT row_ref FROM {_ANS} AS a WHERE row_ref NOT IN (SELECT row_ref FROM ({_SPECIAL}) AS x WHERE reasons = 'OUT_OF_FAMILY')",
)
def _(spark, sf):
    return score.in_scope(answered_lines(spark, sf)).select("row_ref").distinct()


_VERDICTS = "SELECT CAST(p_partkey AS STRING) || '.1' AS line_id, p_size % 3 = 0 AS agrees, CASE p_size % 4 WHEN 0 THEN 'quantity' WHEN 1 THEN 'measure' WHEN 2 THEN 'quality' ELSE 'name' END AS attribute, p_partkey AS seq FROM {part}"


@query(
    "J15_P7_verdicts",
    expected(
        "SELECT l.line_id, coalesce(d.down, false) AS downgraded, CASE WHEN d.down THEN 'REVISION_MANUAL' ELSE l.status END AS status FROM lines AS l LEFT JOIN "
        "(SELECT l2.line_id, l2.status = 'RESUELTA' AND p_size % 3 <> 0 AND CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN measure_prov IN ('extracted') WHEN 2 THEN quality_prov = 'extracted_uncatalogued' ELSE false END AS down "
        "FROM lines AS l2 JOIN part ON l2.line_id = CAST(p_partkey AS VARCHAR) || '.1') AS d ON d.line_id = l.line_id"
    ),
)
def _(spark, sf):
    return score.apply_verdicts(part_lines(spark, sf), lens.frame(spark, sf, _VERDICTS)).select("line_id", "downgraded", "status")


_REVIEWS = "SELECT conv_id, turn % 2 = 0 AS eligible, turn % 3 <> 0 AS ran, CASE WHEN turn % 3 = 0 AND role = 'user' THEN 'timeout' END AS failure, CAST(length(text) % 3 AS BIGINT) AS n_downgraded, CAST(turn % 4 AS BIGINT) AS n_missing FROM {conversations}"


@query(
    "A42_reviewer_summary",
    f"SELECT CAST(count(*) FILTER (eligible) AS BIGINT) AS eligible, CAST(count(*) FILTER (eligible AND ran) AS BIGINT) AS ran, CAST(sum(n_downgraded) AS BIGINT) AS downgraded, CAST(count(*) FILTER (eligible AND failure IS NOT NULL) AS BIGINT) AS failures, CAST(count(*) FILTER (n_missing > 0) AS BIGINT) AS rows_with_missing, CAST(sum(n_missing) AS BIGINT) AS missing_elements FROM ({lens.sql(_REVIEWS)}) AS r",
)
def _(spark, sf):
    return score.reviewer_summary(lens.frame(spark, sf, _REVIEWS))


# -- policies ---------------------------------------------------------------------------------------

VARIANTS = {
    "default": {},
    "P-1 whole_set": {"finish_set_scope": "whole_set"},
    "P-2 review": {"implicit_multiplicity": "review"},
    "P-3 off": {"material_derivation": "off"},
    "P-4 review": {"unitless_length": "review"},
    "P-5 resolve": {"missing_standard": "resolve"},
    "P-6 ignore": {"quality_coherence": "ignore"},
    "P-13 resolve": {"uncovered_material": "resolve"},
}
_DROPS = {
    "default": "''", "P-1 whole_set": "'FINISH_SCOPE_UNSTATED'", "P-2 review": "''",
    "P-3 off": "'UNMAPPED_VALUE'", "P-4 review": "'UNIT_MISMATCH'", "P-5 resolve": "'STANDARD_MISSING'",
    "P-6 ignore": "'QUALITY_TYPE_INCOHERENCE'", "P-13 resolve": "'UNMAPPED_VALUE'",
}
_ADDS = {"P-2 review": "policies LIKE '%P-2%'", "P-4 review": "length_prov = 'inferred'"}


@query(
    "A34_policy_sensitivity",
    expected(
        " UNION ALL ".join(
            f"SELECT '{v}' AS variant, CAST(count(*) FILTER (len(list_filter(string_split(reasons, '|'), lambda r: r <> '' AND r <> {_DROPS[v]})) = 0 "
            f"AND NOT coalesce({_ADDS.get(v, 'false')}, false)) AS BIGINT) AS resolved, CAST(count(*) AS BIGINT) AS lines FROM lines"
            for v in VARIANTS
        )
    ),
)
def _(spark, sf):
    return runs.policy_sensitivity(part_read(spark, sf), VARIANTS)


@query("P17_policy_overrides", expected("SELECT status, CAST(count(*) AS BIGINT) AS n, '" + "|".join(f"{p}={v}" for p, v, _ in validate.policy_overrides({"missing_standard": "resolve", "hv_scope": "washer_only"})) + "' AS overrides FROM (SELECT CASE WHEN len(list_filter(string_split(reasons, '|'), lambda r: r <> '' AND r <> 'STANDARD_MISSING')) = 0 AND NOT (coalesce(quality_group, '') = 'G13' AND name <> 'ARANDELA') THEN 'RESUELTA' ELSE 'REVISION_MANUAL' END AS status FROM lines) AS s GROUP BY status"))
def _(spark, sf):
    settings = {"missing_standard": "resolve", "hv_scope": "washer_only"}
    label = "|".join(f"{p}={v}" for p, v, _ in validate.policy_overrides(settings))
    lines = validate.lines(part_read(spark, sf), policies=settings)
    return lines.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("overrides", F.lit(label))


@query("J22_trace_spans", f"SELECT row_ref, CAST(strpos(source_text, measure) - 1 AS INT) AS measure_start, CAST(strpos(source_text, measure) - 1 + length(measure) AS INT) AS measure_end FROM {_HITROWS} AS h WHERE measure <> '' AND noun NOT IN ('Brida', 'Válvula')")
def _(spark, sf):
    return part_lines(spark, sf).filter("position = 1 and measure is not null").select("row_ref", "measure_start", "measure_end")


# Evidence for all four strategies in whole documents whose blanks are doubled and whose letters expand when
# folded: a word as written, two words folded with one blank, two words without a blank, a text that is not there.


@query(
    "J22_evidence_offsets",
    lens.sql(
        "WITH d AS (SELECT doc_id, 'ß ﬁ  ' || replace(text, ' ', '  ') AS source, regexp_replace(split_part(text, ' ', 2), '[^A-Za-zÀ-ÿ]', '', 'g') AS a, "
        "regexp_replace(split_part(text, ' ', 3), '[^A-Za-zÀ-ÿ]', '', 'g') AS b FROM {documents} WHERE text IS NOT NULL), "
        "t AS (SELECT *, upper(strip_accents(source)) AS plain, upper(strip_accents(a)) AS pa, upper(strip_accents(b)) AS pb FROM d WHERE a <> '' AND b <> '' AND NOT regexp_matches(a || b, 'ß')), "
        "m AS (SELECT doc_id, 'exact' AS strategy, strpos(source, a) AS s, length(a) AS n FROM t "
        "UNION ALL SELECT doc_id, 'folded', CASE WHEN strpos(source, pa || ' ' || pb) > 0 THEN strpos(source, pa || ' ' || pb) ELSE length(regexp_extract(plain, '(?s)^(.*?)' || pa || '[\\s]+' || pb, 1)) + 1 END, "
        "length(regexp_extract(plain, pa || '[\\s]+' || pb)) FROM t WHERE regexp_matches(plain, pa || '[\\s]+' || pb) "
        "UNION ALL SELECT doc_id, 'loose', CASE WHEN strpos(source, pa || pb) > 0 THEN strpos(source, pa || pb) WHEN strpos(plain, pa || pb) > 0 THEN strpos(plain, pa || pb) "
        "ELSE length(regexp_extract(plain, '(?s)^(.*?)' || array_to_string(regexp_extract_all(pa || pb, '.'), '[\\s]*'), 1)) + 1 END, "
        "CASE WHEN strpos(source, pa || pb) > 0 OR strpos(plain, pa || pb) > 0 THEN length(pa || pb) "
        "ELSE length(regexp_extract(plain, array_to_string(regexp_extract_all(pa || pb, '.'), '[\\s]*'))) END FROM t WHERE regexp_matches(plain, array_to_string(regexp_extract_all(pa || pb, '.'), '[\\s]*'))) "
        "SELECT doc_id, strategy, CAST(s - 1 AS INT) AS start, CAST(s - 1 + n AS INT) AS \"end\" FROM m WHERE s > 0 AND n > 0"
    ),
)
def _(spark, sf):
    letters = lambda n: F.regexp_replace(F.split_part("text", F.lit(" "), F.lit(n)), "[^A-Za-zÀ-ÿ]", "")
    docs = spread(lens.frame(spark, sf, "SELECT doc_id, text FROM {documents} WHERE text IS NOT NULL")).withColumns({"a": letters(2), "b": letters(3)})
    docs = docs.where("a <> '' AND b <> '' AND NOT contains(a || b, 'ß')")
    source = F.concat(F.lit("ß ﬁ  "), F.replace("text", F.lit(" "), F.lit("  ")))
    docs = docs.select("doc_id", "a", "b", source.alias("source")).withColumn("folded", X.fold("source"))
    docs = docs.withColumn("places", reader.offset_map(F.col("source"), F.col("folded")))
    evidence = {"exact": F.col("a"), "folded": F.concat(X.fold("a"), F.lit(" "), X.fold("b")), "loose": F.concat(X.fold("a"), X.fold("b")), "none": F.lit("not in here \u2603")}
    cases = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), e.alias("evidence")) for k, e in evidence.items()])).alias("c")
    asked = docs.select("doc_id", "source", "folded", "places", cases).select("doc_id", "source", "folded", "places", "c.*")
    where = reader.locate(F.col("source"), F.col("folded"), F.col("evidence"), F.lit(0), places=F.col("places"))
    return asked.withColumn("w", where).where("w.found").select("doc_id", "strategy", "w.start", "w.end")


def flagship(spark, sf):
    return status_by_family(spark, sf).orderBy("family", "status")

