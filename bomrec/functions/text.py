"""Text folding and comparison as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space, spelled out because Java's \s only covers ASCII. The wide range comes first because it
# rejects most characters with one comparison.
WHITESPACE = "[\\s[\u00a0-\ufeff&&[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]]+"


@lru_cache(maxsize=1)
def _accent_map() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from Unicode decomposition.

    Combining marks come last and have no counterpart, so ``translate`` deletes them.
    """
    accented, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        bare = "".join(c for c in unicodedata.normalize("NFD", char) if not 0x300 <= ord(c) <= 0x36F)
        if bare != char and len(bare) == 1:
            accented.append(char)
            plain.append(bare)
    marks = [chr(c) for c in range(0x300, 0x370)]
    return "".join(accented + marks), "".join(plain)


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, use) -> Column:
    """Evaluate an expression once and use it many times inside another expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_accents(value: Column | str) -> Column:
    """Remove diacritics; pure ASCII text, the common case, skips the translation."""
    c = col(value)
    accented, plain = _accent_map()
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.translate(c, accented, plain)).otherwise(c)


def squeeze(value: Column | str) -> Column:
    """Collapse white space runs to one blank and trim."""
    return F.trim(F.regexp_replace(col(value), WHITESPACE, " "))


def fold(value: Column | str) -> Column:
    """strip diacritics, upper-case, collapse white space, trim."""
    return squeeze(F.upper(strip_accents(value)))


def evidence_fold(value: Column | str) -> Column:
    """upper-case with collapsed white space; accents are kept as written."""
    return F.upper(squeeze(value))


def evidence_matches(source: Column | str, evidence: Column | str) -> Column:
    """literal containment of the evidence in the source row."""
    return F.contains(evidence_fold(source), evidence_fold(evidence))


def compare_key(value: Column | str) -> Column:
    """comparison form where blank and an em dash both mean null."""
    return F.nullif(F.nullif(fold(col(value).cast("string")), F.lit("")), F.lit("\u2014"))


def same(left: Column | str, right: Column | str) -> Column:
    return compare_key(left).eqNullSafe(compare_key(right))


def number_text(value: Column | str) -> Column:
    """A double printed without a trailing ``.0``."""
    c = col(value).cast("double")
    return F.when(
        (c == F.floor(c)) & (F.abs(c) < 1e15), F.floor(c).cast("string")
    ).otherwise(c.cast("string"))


def trim_number(value: Column | str) -> Column:
    """A double with at most four decimals and no trailing zeros."""
    fixed = F.round(col(value), 4).cast("decimal(24,4)").cast("string")
    return F.regexp_replace(fixed, "\\.?0+$", "")


def unmatched_key(spread_by: str) -> Column:
    """A key that no text has, for rows that should find nothing: spread instead of one null key."""
    return F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(spread_by), F.lit(4096)).cast("string"))


def slug(value: Column | str, limit: int, empty: str = "x") -> Column:
    dashed = F.regexp_replace(F.lower(strip_accents(F.trim(col(value)))), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, limit)
    return F.when(cut == "", F.lit(empty)).otherwise(cut)


def entry_id(prefix: str, value: Column | str, limit: int = 40) -> Column:
    """readable vocabulary id such as ``finish-zincado``."""
    return F.concat(F.lit(prefix + "-"), slug(value, limit))


def own_group_id(value: Column | str) -> Column:
    """group id minted for a quality outside the closed catalogue."""
    return F.concat(F.lit("V-"), F.upper(slug(value, 32)))


def escape_pattern(value: Column | str) -> Column:
    return F.regexp_replace(col(value), "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1")


def exact_pattern(value: Column | str) -> Column:
    """anchored pattern that matches exactly this literal."""
    return F.concat(F.lit("^"), escape_pattern(fold(value)), F.lit("$"))


def unescape_jsonish(value: Column | str) -> Column:
    """undo one layer of JSON escaping left inside a quoted value."""
    c = col(value)
    plain = c
    for mark, char in (("n", "\n"), ("r", "\r"), ("t", "\t")):
        plain = F.regexp_replace(plain, "(?<!\\\\)((?:\\\\\\\\)*)\\\\" + mark, "$1" + char)
    plain = F.regexp_replace(plain, "\\\\([\"'\\\\])", "$1")
    return F.when(F.contains(c, F.lit("\\")), plain).otherwise(c)


def _literal(value: str | int | float) -> str:
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(table: dict, key: Column) -> Column:
    """Constant map lookup; a missing or null key gives null."""
    if not table:
        return F.lit(None).cast("string")
    return F.element_at(F.expr("map(" + ", ".join(_literal(x) for kv in table.items() for x in kv) + ")"), key)


def strings(values) -> Column:
    """Typed constant array of strings, also when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def collapse_key(*parts: Column) -> Column:
    """Join nullable parts with the unit separator; null counts as empty."""
    return F.concat_ws("\u001f", *[F.coalesce(p, F.lit("")) for p in parts])


def computed_once(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pass derived columns through a one-record generator.

    Filters and generators above would otherwise be pushed below and expand the definitions of these
    columns, which share sub-expressions many levels deep, once per reference.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*columns))))
