"""Nominal measures and lengths: parsing, formatting and the plausibility window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bomrec.functions.text import let, lookup, squeeze, trim_number

# Unit factor, plausible length/diameter ratio, measure and length patterns.
MM_PER_INCH = 25.4
RATIO_MIN, RATIO_MAX = 0.4, 60.0
NUMBER = "\\d+(?:[.,]\\d+)?"
TAIL = f"(?:\\s?[X\u00d7*]\\s?{NUMBER})?(?:\\s?LG)?"
MEASURE_SCAN = (
    f"M\\s?{NUMBER}{TAIL}"
    f"|(?:\\d+\\s?-\\s?)?\\d+\\s?/\\s?\\d+\\s?\"{TAIL}"
    f"|{NUMBER}\\s?\"{TAIL}"
)
LENGTH_SCAN = f"\\b{NUMBER}\\s?MM\\b"
EIGHTHS = {1: "1/8", 2: "1/4", 3: "3/8", 4: "1/2", 5: "5/8", 6: "3/4", 7: "7/8"}


def _group(text: Column, pattern: str, index: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, index)
    return F.when(found != "", found)


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double")


def parse_inches(text: Column) -> Column:
    """Leading inch expression: mixed, fraction or whole with its mark."""
    mixed = "^(\\d+)\\s*[- ]\\s*(\\d+)\\s*/\\s*(\\d+)\\s*\"?"
    fraction = "^(\\d+)\\s*/\\s*(\\d+)\\s*\"?"
    whole = f"^({NUMBER})\\s*\""
    return (
        F.when(
            text.rlike(mixed),
            _number(_group(text, mixed, 1))
            + F.try_divide(_number(_group(text, mixed, 2)), _number(_group(text, mixed, 3))),
        )
        .when(
            text.rlike(fraction),
            F.try_divide(_number(_group(text, fraction, 1)), _number(_group(text, fraction, 2))),
        )
        .otherwise(_number(_group(text, whole)))
    )


def format_inches(value: Column) -> Column:
    """whole inches, eighth fractions, otherwise up to four decimals."""
    return let(value, _format_inches)


def _format_inches(value: Column) -> Column:
    whole = F.floor(value + 1e-9)
    rest = value - whole
    nearest = F.round(rest * 8).cast("int")
    fraction = F.when(F.abs(rest - nearest / 8) < 1e-6, lookup(EIGHTHS, nearest))
    return (
        F.when(rest < 1e-6, whole.cast("string"))
        .when(fraction.isNull(), trim_number(value))
        .when(whole > 0, F.concat(whole.cast("string"), F.lit("-"), fraction))
        .otherwise(fraction)
    )


def parse_measure(raw: Column) -> Column:
    """struct of system, nominal_mm, canonical, length_raw and bare; null when not a measure."""
    return let(
        F.upper(squeeze(raw)), lambda text: let(parse_inches(text), lambda inches: _parse(text, inches))
    )


def _parse(text: Column, inches: Column) -> Column:
    tail = f"\\s*[X\u00d7*]\\s*({NUMBER})\\s*(?:LG)?\\s*$"
    metric = f"^M\\s*({NUMBER})"
    bare = f"^({NUMBER})(?:\\s*[X\u00d7*]\\s*{NUMBER})?$"
    metric_mm = _number(_group(text, metric))
    bare_mm = _number(_group(text, bare))

    def parsed(system: str, nominal: Column, canonical: Column, length: Column, is_bare: bool) -> Column:
        return F.struct(
            F.lit(system).alias("system"),
            nominal.alias("nominal_mm"),
            canonical.alias("canonical"),
            length.alias("length_raw"),
            F.lit(is_bare).alias("bare"),
        )

    return (
        F.when(
            text.rlike(metric),
            F.when(
                metric_mm > 0,
                parsed(
                    "metric", metric_mm, F.concat(F.lit("M"), trim_number(metric_mm)),
                    _group(text, f"^M\\s*{NUMBER}{tail}"), False,
                ),
            ),
        )
        .when(
            inches.isNotNull(),
            parsed(
                "imperial", inches * MM_PER_INCH, F.concat(format_inches(inches), F.lit('"')),
                _group(text, f"^[^\"]*\"{tail}"), False,
            ),
        )
        .when(
            bare_mm > 0,
            parsed("metric", bare_mm, trim_number(bare_mm), _group(text, f"^{NUMBER}{tail}"), True),
        )
    )


def resolve_length(raw: Column, system: Column, nominal_mm: Column) -> Column:
    """struct of value, unit, basis and implausible; null when the text is not a length."""
    return let(F.upper(F.trim(raw)), lambda text: _resolve_length(text, system, nominal_mm))


def _resolve_length(text: Column, system: Column, nominal_mm: Column) -> Column:
    stated_mm = _number(_group(text, f"^({NUMBER})\\s*MM$"))
    inch_text = text.rlike(f"^({NUMBER}|\\d+\\s*[- ]\\s*\\d+\\s*/\\s*\\d+|\\d+\\s*/\\s*\\d+)\\s*\"$")
    stated_inch = F.when(inch_text, parse_inches(text))
    number = _number(_group(text, f"^({NUMBER})$"))
    ratio_mm = F.try_divide(number, nominal_mm)
    mm_ok = ratio_mm.between(RATIO_MIN, RATIO_MAX)
    inch_ok = (ratio_mm * MM_PER_INCH).between(RATIO_MIN, RATIO_MAX)

    def found(value: Column, unit: str | None, basis: str | None) -> Column:
        return F.struct(
            value.alias("value"), F.lit(unit).cast("string").alias("unit"),
            F.lit(basis).cast("string").alias("basis"), F.lit(unit is None).alias("implausible"),
        )

    return (
        F.when(stated_mm.isNotNull(), found(stated_mm, "mm", "stated"))
        .when(stated_inch.isNotNull(), found(stated_inch, "inch", "stated"))
        .when(number.isNull() | system.isNull(), F.lit(None))
        .when(system == "metric", found(number, "mm", "designation"))
        .when(mm_ok & ~inch_ok, found(number, "mm", "plausibility"))
        .when(inch_ok & ~mm_ok, found(number, "inch", "plausibility"))
        .otherwise(found(number, None, None))
    )


def format_length(value: Column, unit: Column) -> Column:
    return F.when(unit == "mm", F.concat(trim_number(value), F.lit(" mm"))).when(
        unit == "inch", F.concat(format_inches(value), F.lit('"'))
    )
