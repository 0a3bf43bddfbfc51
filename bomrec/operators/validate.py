"""Rules engine: one output line per element, its status and the typed reasons behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomrec.functions import closed_tables as T
from bomrec.functions import measure as M
from bomrec.functions import text as X
from bomrec.operators import detect as D
from bomrec.operators import normalize as N
from bomrec.operators.catalog import Vocabulary

REASON_TYPE = "array<struct<code:string,kind:string,attribute:string>>"


def policy_overrides(settings: dict[str, str]) -> list[tuple[str, str, str]]:
    """(policy, value, default) of every non-default setting; an unknown value is an error."""
    out = []
    for policy, value in settings.items():
        if policy not in T.POLICIES:
            raise ValueError(f"unknown policy {policy!r}")
        admitted = T.POLICIES[policy]
        if value not in admitted:
            raise ValueError(f"{policy}={value!r} is not valid; admitted: {' | '.join(admitted)}")
        if value != admitted[0]:
            out.append((policy, value, admitted[0]))
    return out


def policy_struct(settings: dict[str, str] | None = None) -> Column:
    """All policies as one constant struct, defaults overridden by the settings."""
    settings = settings or {}
    policy_overrides(settings)
    return F.struct(*[F.lit(settings.get(p, v[0])).alias(p) for p, v in T.POLICIES.items()])


def with_policies(rows: DataFrame, variants: dict[str, dict[str, str]]) -> DataFrame:
    """Evaluate each row under every named policy set; a row fans out to len(variants) rows."""
    sets = F.array(
        *[F.struct(F.lit(n).alias("variant"), policy_struct(s).alias("policy")) for n, s in variants.items()]
    )
    return rows.select("*", F.inline(sets))


def reason(code: str, attribute: str | None = None) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(T.REASON_KINDS[code]).alias("kind"),
        F.lit(attribute).cast("string").alias("attribute"),
    )


def _flag(condition: Column, value: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), value)


def lines(
    read: DataFrame,
    vocabulary: Vocabulary | None = None,
    policies: dict[str, str] | None = None,
    keys: tuple[str, ...] = ("row_ref",),
) -> DataFrame:
    """Lines of read rows. Row-wide decisions (donor measure, finish scope, bare measures) are taken
    on the row's element array before it is exploded, so nothing here shuffles.

    Input rows carry the key columns, ``quantity`` and what a reader added; a ``policy`` struct
    column overrides the ``policies`` argument. Output keeps the keys and any ``variant`` column.
    """
    v = vocabulary or Vocabulary.closed()
    if "policy" not in read.columns:
        read = read.withColumn("policy", policy_struct(policies))
    carried = [*keys, *[c for c in ("variant",) if c in read.columns]]

    def prepared(e: Column) -> Column:
        return e.withField("m", M.parse_measure(e["measure_raw"])).withField(
            "fin", N.resolve_finish(e["finish_raw"], v)
        )

    p = F.col("policy")
    rows = read.withColumn("els", F.transform("elements", prepared))
    anchored = F.exists("els", lambda e: F.coalesce(~e["m"]["bare"], F.lit(False)))
    rows = rows.withColumn(
        "reject_bare", (p["bare_measure_in_set"] == "reject") & (F.size("els") >= 2) & anchored
    )

    # J13 first, so that a rejected bare number can neither be a measure nor a donor.
    def measured(e: Column) -> Column:
        rejected = F.col("reject_bare") & F.coalesce(e["m"]["bare"], F.lit(False))
        return e.withField("rejected", rejected).withField(
            "measure", F.when(~rejected, F.coalesce(e["m"]["canonical"], e["measure_raw"]))
        )

    rows = rows.withColumn("els", F.transform("els", measured))

    def indexed(keep) -> Column:
        return F.filter(
            F.transform("els", lambda e, i: F.struct(i.alias("i"), e.alias("e"))), lambda x: keep(x["e"])
        )

    with_measure = indexed(lambda e: e["measure"].isNotNull())
    principal = F.filter("with_measure", lambda x: x["e"]["role"] == "principal")
    rows = (
        rows.withColumn("with_measure", with_measure)
        .withColumn("donor", F.coalesce(F.get(principal, F.lit(0)), F.get("with_measure", F.lit(0))))
        .withColumn(
            "finish_donor",
            F.when(F.size("els") > 1, F.get(indexed(lambda e: e["fin"]["finish"].isNotNull()), F.lit(0))),
        )
    )

    kind = (
        F.when(F.col("out_of_family"), "X")
        .when(F.col("read_error").isNotNull(), "E")
        .when(F.col("skipped"), "0")
        .when(F.size("els") == 0, "N")
    )
    # Only the donors' fields travel with the exploded elements.
    d, f = F.col("donor"), F.col("finish_donor")
    exploded = rows.filter(~(F.col("out_of_family") & (p["out_of_family"] == "silent_skip"))).select(
        *carried, "quantity", "policy", kind.alias("special"), F.size("els").alias("n_elements"),
        d["i"].alias("d_i"), d["e"]["measure"].alias("d_measure"), d["e"]["measure_raw"].alias("d_raw"),
        d["e"]["measure_start"].alias("d_start"), d["e"]["measure_end"].alias("d_end"),
        d["e"]["m"]["system"].alias("d_system"), d["e"]["m"]["nominal_mm"].alias("d_mm"),
        f["i"].alias("f_i"), f["e"]["fin"]["finish"].alias("f_finish"), f["e"]["finish_raw"].alias("f_raw"),
        f["e"]["finish_start"].alias("f_start"), f["e"]["finish_end"].alias("f_end"),
        F.posexplode_outer(F.when(kind.isNull(), F.col("els"))).alias("pos", "e"),
    )
    return _element_lines(exploded, v, carried)


def _element_lines(exploded: DataFrame, v: Vocabulary, carried: list[str]) -> DataFrame:
    e, p = F.col("e"), F.col("policy")
    special = F.col("special").isNotNull()

    # -- normalisation of the element's own values ----------------------------------------
    own = exploded.withColumns(
        {
            "nm": F.when(~special, N.resolve_name(e["detected_name"], e["guess"], v)),
            "q_own": N.resolve_quality(e["quality_raw"], v),
            "q_rejected": F.when(
                e["rejected"] & e["quality_raw"].isNull() & (p["rejected_measure_as_quality"] != "off"),
                N.resolve_quality(e["measure_raw"], v),
            ),
            "std": F.when(e["standard_raw"].isNotNull(), D.resolve_standard(e["standard_raw"], v)),
            "mat": N.resolve_material(e["material_raw"], v),
        }
    )
    name = F.col("nm.value")
    # P-11: a rejected bare number becomes the quality if the catalogue knows it and it fits.
    recovered = F.coalesce(
        (F.col("q_rejected.source") == "catalog")
        & name.isNotNull()
        & N.incoherence(F.col("q_rejected.group"), name, p["hv_scope"]).isNull(),
        F.lit(False),
    )
    own = own.withColumn("recovered", recovered)
    took, measure_raw = F.col("recovered"), e["measure_raw"]
    extrapolated = e["measure"].isNull() & F.col("d_measure").isNotNull() & (F.col("d_i") != F.col("pos"))
    own = own.withColumns(
        {
            "name": name,
            "name_raw": e["detected_name"],
            "name_rule": F.col("nm.rule"),
            "name_prov": F.when(name.isNotNull(), "table_normalized").otherwise("absent"),
            "name_start": F.when(name.isNotNull(), e["start"]),
            "name_end": F.when(name.isNotNull(), e["end"]),
            "quality_raw": F.when(took, measure_raw).otherwise(e["quality_raw"]),
            "quality_group": F.when(took, F.col("q_rejected.group")).otherwise(F.col("q_own.group")),
            "quality_rule": F.when(
                took, F.concat(F.lit("P-11:quality_from_rejected_measure:"), F.col("q_rejected.group"))
            ).otherwise(N.quality_rule(F.col("q_own"))),
            "quality_prov": F.when(took | F.col("q_own.source").isin("catalog", "vocab"), "table_normalized")
            .when(e["quality_raw"].isNotNull(), "extracted_uncatalogued")
            .otherwise("absent"),
            "quality_start": F.when(took, e["measure_start"]).otherwise(e["quality_start"]),
            "quality_end": F.when(took, e["measure_end"]).otherwise(e["quality_end"]),
            "extrapolated": F.coalesce(extrapolated, F.lit(False)),
            "standard": F.col("std.normalized"),
            "standard_raw": e["standard_raw"],
            "standard_start": e["standard_start"],
            "standard_end": e["standard_end"],
            "standard_prov": F.when(F.col("std.mapped"), "table_normalized")
            .when(F.col("std.normalized").isNotNull(), "extracted")
            .otherwise("absent"),
            "standard_rule": F.when(
                F.col("std.normalized").isNotNull(),
                F.coalesce("std.rule", F.concat(F.lit("standard:"), F.col("std.family"), F.lit(":preserved"))),
            ).when(e["standard_raw"].isNotNull(), "standard:unparsed"),
        }
    )
    donated, rejected = F.col("extrapolated"), F.coalesce(e["rejected"], F.lit(False))
    donated_rule = F.when(
        rejected, F.concat(F.lit('measure_extrapolated (P-10 rejected "'), measure_raw, F.lit('")'))
    ).otherwise("measure_extrapolated")
    own_rule = (
        F.when(rejected, "P-10:bare_measure_rejected")
        .when(e["m"].isNotNull(), F.concat(F.lit("measure:"), e["m"]["system"]))
        .when(measure_raw.isNotNull(), "measure:unparsed")
    )
    own = own.withColumns(
        {
            "quality": F.trim("quality_raw"),
            "measure": F.when(donated, F.col("d_measure")).otherwise(e["measure"]),
            "measure_raw": F.when(donated, F.col("d_raw")).otherwise(measure_raw),
            "measure_start": F.when(donated, F.col("d_start")).otherwise(e["measure_start"]),
            "measure_end": F.when(donated, F.col("d_end")).otherwise(e["measure_end"]),
            "measure_prov": F.when(donated, "extrapolated").when(e["measure"].isNotNull(), "extracted").otherwise("absent"),
            "measure_rule": F.when(donated, donated_rule).otherwise(own_rule),
            "m_system": F.when(donated, F.col("d_system")).when(~rejected, e["m"]["system"]),
            "m_mm": F.when(donated, F.col("d_mm")).when(~rejected, e["m"]["nominal_mm"]),
            "exempt": F.coalesce(F.col("name").isin(*T.LENGTH_EXEMPT), F.lit(False)),
            # The length inside a designation is only taken from the element's own measure.
            "len_raw": F.coalesce(
                e["length_raw"], F.when(~F.col("extrapolated") & ~rejected, e["m"]["length_raw"])
            ),
            "derived": F.when(
                e["material_raw"].isNull() & (p["material_derivation"] == "from_quality"),
                N.derive_material(F.col("quality_raw"), F.col("quality_group"), v),
            ),
            "incoherent": N.incoherence(F.col("quality_group"), F.col("name"), p["hv_scope"]),
        }
    )

    # -- length (F7), material (P-3), finish (P-1, P-12), quantity (F14) ---------------------
    own = own.withColumn(
        "len", F.when(~F.col("exempt"), M.resolve_length(F.col("len_raw"), F.col("m_system"), F.col("m_mm")))
    )
    ln, derived, fin = F.col("len"), F.col("derived"), e["fin"]
    doubtful = ln["implausible"] | ((p["unitless_length"] == "review") & (ln["basis"] == "plausibility"))
    length_from = F.when(e["length_raw"].isNotNull(), e["length_start"]).otherwise(F.col("measure_start"))
    length_to = F.when(e["length_raw"].isNotNull(), e["length_end"]).otherwise(F.col("measure_end"))
    elsewhere = F.col("f_finish").isNotNull() & (F.col("f_i") != F.col("pos"))
    scoped = F.coalesce(elsewhere & fin["finish"].isNull(), F.lit(False))
    whole_set = scoped & (p["finish_set_scope"] == "whole_set")
    unstated = scoped & (p["finish_set_scope"] == "review")
    own_finish_rule = (
        F.when(fin["kind"] == "known", F.concat(F.lit("finish:"), fin["alias"], F.lit("->"), fin["finish"]))
        .when(fin["kind"] == "not_a_finish", F.concat(F.lit("finish:not_a_finish:"), fin["entry_id"]))
        .when(fin["kind"] == "ambiguous", "finish:ambiguous")
        .when(fin["kind"] == "unknown", "finish:unmapped")
    )
    own = own.withColumns(
        {
            "doubtful": F.coalesce(doubtful, F.lit(False)),
            "length_raw": F.when(F.col("exempt"), e["length_raw"]).otherwise(F.col("len_raw")),
            "length_start": F.when(F.col("exempt"), e["length_start"]).when(F.col("len_raw").isNotNull(), length_from),
            "length_end": F.when(F.col("exempt"), e["length_end"]).when(F.col("len_raw").isNotNull(), length_to),
            "material": F.coalesce("mat.value", derived["material"]),
            "material_raw": e["material_raw"],
            "material_prov": F.when(e["material_raw"].isNotNull(), "extracted")
            .when(derived["material"].isNotNull(), "derived")
            .otherwise("absent"),
            "material_rule": F.coalesce(
                "mat.rule", derived["rule"], F.when(derived["outcome"] == "deliberate", "P-3:no-derivable")
            ),
            "material_start": F.when(derived["material"].isNotNull(), F.col("quality_start")).otherwise(e["material_start"]),
            "material_end": F.when(derived["material"].isNotNull(), F.col("quality_end")).otherwise(e["material_end"]),
            "finish": F.when(whole_set, F.col("f_finish")).otherwise(fin["finish"]),
            "finish_raw": F.when(whole_set | unstated, F.col("f_raw")).when(
                F.coalesce(fin["kind"] != "not_a_finish", F.lit(True)), e["finish_raw"]
            ),
            "finish_prov": F.when(whole_set, "extrapolated").when(fin["finish"].isNotNull(), "table_normalized").otherwise("absent"),
            "finish_rule": F.when(whole_set, "P-1:finish_whole_set").when(unstated, "P-1:scope_unstated").otherwise(own_finish_rule),
            "finish_start": F.when(whole_set | unstated, F.col("f_start")).otherwise(e["finish_start"]),
            "finish_end": F.when(whole_set | unstated, F.col("f_end")).otherwise(e["finish_end"]),
            "scoped": scoped,
            "unstated": unstated,
            "assumed_one": F.col("quantity").isNotNull() & ~e["stated"] & (F.col("n_elements") > 1) & (e["role"] != "principal"),
        }
    )
    sure = ln.isNotNull() & ~F.col("doubtful")
    own = own.withColumns(
        {
            "length": F.when(F.col("exempt"), "N/A").when(sure, M.format_length(ln["value"], ln["unit"])),
            "length_prov": F.when(F.col("exempt"), "not_applicable")
            .when(sure & (ln["basis"] == "plausibility"), "inferred")
            .when(sure, "extracted")
            .otherwise("absent"),
            "length_rule": F.when(F.col("exempt"), "length:exempt")
            .when(sure, F.concat(F.lit("length:"), ln["basis"]))
            .when(F.col("doubtful"), "P-4:implausible")
            .when(F.col("len_raw").isNotNull(), "length:unparsed"),
            "quantity_out": F.when(special, F.col("quantity")).otherwise(F.col("quantity") * e["multiplicity"]),
            "quantity_prov": F.when(F.col("quantity").isNull(), "absent")
            .when(F.col("assumed_one"), "inferred")
            .otherwise("extracted"),
        }
    )
    line = F.struct(
        F.concat(
            F.col(carried[0]).cast("string"), F.lit("."),
            F.coalesce("special", (F.col("pos") + 1).cast("string")),
        ).alias("line_id"),
        F.coalesce(F.col("pos") + 1, F.lit(0)).alias("position"),
        F.when(~special, e["role"]).alias("role"),
        F.coalesce(e["multiplicity"], F.lit(1)).alias("multiplicity"),
        F.col("quantity_out").alias("quantity"),
        "quantity_prov",
        *_attribute_columns(),
        _reasons(special).alias("reasons"),
        _policies(special).alias("policies_applied"),
        "quality_group",
    )
    # The generator keeps filters on line columns above it: pushed further down, they would be
    # expanded into the whole rule set, once per reference.
    return own.select(*carried, F.inline(F.array(line))).withColumn("status", line_status(F.col("reasons")))


def _attribute_columns() -> list[Column]:
    out = []
    for a in T.ATTRIBUTES:
        out += [F.col(a), F.col(f"{a}_raw"), F.coalesce(f"{a}_prov", F.lit("absent")).alias(f"{a}_prov"),
                F.col(f"{a}_rule"), F.col(f"{a}_start"), F.col(f"{a}_end")]
    return out


def _reasons(special: Column) -> Column:
    """Every reason a line is not resolved, in evaluation order."""
    p, ln, derived = F.col("policy"), F.col("len"), F.col("derived")
    mixed = ((F.col("m_system") == "metric") & (ln["unit"] == "inch")) | (
        (F.col("m_system") == "imperial") & (ln["unit"] == "mm")
    )
    finish_blank = F.col("finish_raw").isNotNull() & F.col("finish").isNull()
    element = F.array_compact(
        F.array(
            _flag(F.col("name").isNull(), reason("NAME_MISSING", "name")),
            _flag(F.col("measure").isNull(), reason("MEASURE_MISSING", "measure")),
            _flag(~F.col("exempt") & ln.isNull(), reason("LENGTH_MISSING", "length")),
            _flag(F.col("doubtful"), reason("LENGTH_UNIT_IMPLAUSIBLE", "length")),
            _flag((p["unitless_length"] != "review") & (ln["basis"] == "stated") & mixed, reason("UNIT_MISMATCH", "length")),
            _flag(F.col("quality").isNull() | (F.col("quality") == ""), reason("QUALITY_MISSING", "quality")),
            _flag(
                F.col("incoherent").isNotNull() & (p["quality_coherence"] == "review"),
                reason("QUALITY_TYPE_INCOHERENCE", "quality"),
            ),
            _flag(
                F.col("standard").isNull() & (p["missing_standard"] == "review"),
                reason("STANDARD_MISSING", "standard"),
            ),
            _flag(
                (derived["outcome"] == "ambiguous")
                | ((derived["outcome"] == "uncovered") & (p["uncovered_material"] == "review")),
                reason("UNMAPPED_VALUE", "material"),
            ),
            _flag(F.col("unstated"), reason("FINISH_SCOPE_UNSTATED", "finish")),
            _flag(
                finish_blank
                & (
                    (F.col("finish_rule") == "finish:ambiguous")
                    | ((F.col("finish_rule") == "finish:unmapped") & (p["unknown_finish"] == "review"))
                ),
                reason("UNMAPPED_VALUE", "finish"),
            ),
            _flag(
                F.col("quantity").isNull()
                | (F.col("assumed_one") & (p["implicit_multiplicity"] == "review")),
                reason("QUANTITY_NOT_STATED"),
            ),
        )
    )
    whole_row = (
        F.when(F.col("special") == "X", F.array(reason("OUT_OF_FAMILY")))
        .when(F.col("special") == "E", F.array(reason("PROCESSING_FAILED")))
        .when(F.col("special") == "0", F.array(reason("EMPTY_DESCRIPTION")))
        .otherwise(F.array(reason("NO_ELEMENTS_EXTRACTED")))
    )
    return F.when(special, whole_row).otherwise(element).cast(REASON_TYPE)


def _policies(special: Column) -> Column:
    """Which policies fired on a line, sorted."""
    p, ln, derived = F.col("policy"), F.col("len"), F.col("derived")
    finish_gap = F.col("finish_raw").isNotNull() & F.col("finish").isNull()
    fired = {
        "P-1": F.col("scoped"),
        "P-10": F.col("e.rejected"),
        "P-11": F.col("recovered"),
        "P-12": finish_gap & F.col("finish_rule").isin("finish:ambiguous", "finish:unmapped"),
        "P-13": (derived["outcome"] == "uncovered") & (p["uncovered_material"] == "review"),
        "P-2": F.col("assumed_one"),
        "P-3": derived["outcome"].isin("derived", "ambiguous", "deliberate"),
        "P-4": F.col("doubtful") | ((ln["basis"] == "plausibility") & ~F.col("exempt")),
        "P-5": F.col("standard").isNull(),
        "P-6": F.col("incoherent").isNotNull() & (F.col("incoherent") != "HV_OUTSIDE_WASHER"),
        "P-8": F.col("incoherent") == "HV_OUTSIDE_WASHER",
    }
    applied = F.array_compact(F.array(*[_flag(c, F.lit(k)) for k, c in fired.items()]))
    return (
        F.when(F.col("special") == "X", X.strings(["P-9"]))
        .when(special, X.strings([]))
        .otherwise(applied)
    )


def line_status(reasons: Column) -> Column:
    """F16: a line with any reason goes to manual review."""
    return F.when(F.size(reasons) > 0, "REVISION_MANUAL").otherwise("RESUELTA")
