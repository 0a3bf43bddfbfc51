"""Resolution of raw values against the closed tables, with the rule that decided."""

from __future__ import annotations

import re
import re._parser as sre
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomrec.functions import closed_tables as T
from bomrec.functions import spans as S
from bomrec.functions import text as X
from bomrec.operators import detect as D
from bomrec.operators.catalog import Vocabulary, fold_text
from bomrec.session import shared_folder


def _text_of(aliases) -> dict[str, str]:
    return {k: a.text for k, a in aliases.items()}


def resolve_name(detected: Column, guess: Column, vocabulary: Vocabulary) -> Column:
    """Struct of value and rule. The table decides; the reader's guess only fills in."""
    scanned = Vocabulary.scanned(vocabulary.names)
    exact = Vocabulary.exact(vocabulary.names)
    values = {k: a.value for k, a in scanned.items()}
    entries = {k: a.entry_id for k, a in scanned.items() if a.entry_id}
    exact_values = {k: a.value for k, a in exact.items()}
    exact_entries = {k: a.entry_id for k, a in exact.items() if a.entry_id}

    def by_table(key: Column) -> Column:
        value = X.lookup(values, key)
        entry = X.lookup(entries, key) if entries else F.lit(None).cast("string")
        return F.struct(
            value.alias("value"),
            F.coalesce(
                F.concat(F.lit("name:alias:"), entry, F.lit("->"), value),
                F.concat(F.lit("name:table:"), X.lookup(_text_of(scanned), key), F.lit("->"), value),
            ).alias("rule"),
        )

    def by_guess(text: Column) -> Column:
        key = X.fold(text)
        value = X.lookup(exact_values, key)
        entry = X.lookup(exact_entries, key) if exact_entries else F.lit(None).cast("string")
        return F.when(
            value.isNotNull(),
            F.struct(
                value.alias("value"),
                F.coalesce(
                    F.concat(F.lit("name:alias:"), entry, F.lit("->"), value),
                    F.concat(F.lit("name:model:"), F.coalesce(guess, F.lit("null")), F.lit("->"), value),
                ).alias("rule"),
            ),
        )

    def from_scan(hits: Column) -> Column:
        distinct = F.array_distinct(F.transform(hits, lambda h: X.lookup(values, h["text"])))
        return F.when(F.size(distinct) == 1, by_table(F.get(hits, F.lit(0))["text"]))

    return X.let(
        X.fold(detected),
        lambda key: F.coalesce(
            F.when(X.lookup(values, key).isNotNull(), by_table(key)),
            X.let(S.find_texts(key, list(scanned)), from_scan),
            by_guess(guess),
            by_guess(detected),
        ),
    )


def resolve_quality(raw: Column, vocabulary: Vocabulary) -> Column:
    """Struct of group, source (catalog, vocab, ambiguous, out), entry_id, alias_id, resolved."""
    groups = vocabulary.group_by_value()
    aliases = Vocabulary.exact(vocabulary.quality_aliases)
    own: dict[str, list] = {}
    for entry in vocabulary.quality_entries:
        own.setdefault(fold_text(entry.text), []).append(entry)
    single = {k: es[0] for k, es in own.items() if len({e.value for e in es}) == 1}
    clash = [k for k, es in own.items() if len({e.value for e in es}) > 1]
    null = F.lit(None).cast("string")

    def out(group: Column, source: str, entry: Column, alias: Column, resolved: Column) -> Column:
        return F.struct(
            group.alias("group"), F.lit(source).alias("source"), entry.alias("entry_id"),
            alias.alias("alias_id"), resolved.alias("resolved"),
        )

    def judge(key: Column) -> Column:
        catalog = X.lookup(groups, key)
        case = F.when(catalog.isNotNull(), out(catalog, "catalog", null, null, F.trim(raw)))
        if aliases:
            via = X.lookup({k: groups[fold_text(a.value)] for k, a in aliases.items()}, key)
            case = case.when(
                via.isNotNull(),
                out(via, "catalog", null, X.lookup({k: a.entry_id or "" for k, a in aliases.items()}, key),
                    X.lookup({k: a.value for k, a in aliases.items()}, key)),
            )
        if single:
            group = X.lookup({k: e.value for k, e in single.items()}, key)
            entry = X.lookup({k: e.entry_id or "" for k, e in single.items()}, key)
            case = case.when(group.isNotNull(), out(group, "vocab", entry, null, F.trim(raw)))
        if clash:
            case = case.when(key.isin(*clash), out(null, "ambiguous", null, null, F.trim(raw)))
        return case.when(key.isNotNull(), out(null, "out", null, null, F.trim(raw)))

    return X.let(X.fold(raw), judge)


def quality_rule(q: Column) -> Column:
    return (
        F.when(q["alias_id"].isNotNull(), F.concat(F.lit("quality:alias:"), q["alias_id"], F.lit("->"), q["resolved"]))
        .when(q["source"] == "vocab", F.concat(F.lit("quality:vocab:"), q["entry_id"], F.lit(":"), q["group"]))
        .when(q["source"] == "ambiguous", "quality:vocab:ambiguous")
        .when(q["group"].isNotNull(), F.concat(F.lit("quality:"), q["group"]))
        .when(q.isNotNull(), "quality:out_of_catalog")
    )


def canonical_quality(group: Column) -> Column:
    """First value of a group; reported next to the value as written, never instead of it."""
    return X.lookup({g: m[0] for g, m in T.QUALITY_GROUPS.items()}, group)


def resolve_finish(raw: Column, vocabulary: Vocabulary) -> Column:
    """Struct of kind (known, not_a_finish, ambiguous, unknown), finish, alias and entry_id."""
    table = vocabulary.finish_table()

    def outcome(e) -> str:
        return "not_a_finish" if e.kind == "not_a_finish" else f"alias:{e.finish}"

    outcomes = {k: (outcome(es[0]) if len({outcome(e) for e in es}) == 1 else "ambiguous") for k, es in table.items()}
    scanned = {k: outcome(es[0]) for k, es in table.items()}
    null = F.lit(None).cast("string")

    def result(decision: Column, key: Column) -> Column:
        known = F.startswith(decision, F.lit("alias:"))
        return F.struct(
            F.when(known, "known").when(decision.isNull(), "unknown").otherwise(decision).alias("kind"),
            F.when(known, F.regexp_replace(decision, "^alias:", "")).alias("finish"),
            F.when(decision != "ambiguous", X.lookup({k: es[0].alias for k, es in table.items()}, key)).alias("alias"),
            F.when(decision != "ambiguous", X.lookup({k: es[0].id for k, es in table.items()}, key)).alias("entry_id"),
        )

    def from_scan(hits: Column) -> Column:
        distinct = F.array_distinct(F.transform(hits, lambda h: X.lookup(scanned, h["text"])))
        first = F.get(hits, F.lit(0))["text"]
        return F.when(F.size(distinct) > 1, result(F.lit("ambiguous"), null)).otherwise(
            result(F.get(distinct, F.lit(0)), first)
        )

    def judge(key: Column) -> Column:
        exact = X.lookup(outcomes, key)
        return (
            F.when(key.isNull(), F.lit(None))
            .when(exact.isNotNull(), result(exact, key))
            .otherwise(X.let(S.find_texts(key, list(table)), from_scan))
        )

    return X.let(X.fold(raw), judge)


def resolve_material(raw: Column, vocabulary: Vocabulary) -> Column:
    """Struct of value and rule; an unknown material is preserved as written."""
    exact = Vocabulary.exact(vocabulary.materials)
    scanned = Vocabulary.scanned(vocabulary.materials)

    def named(aliases, key: Column) -> Column:
        value = X.lookup({k: a.value for k, a in aliases.items()}, key)
        rule = F.concat(F.lit("material:"), X.lookup(_text_of(aliases), key), F.lit("->"), value)
        return F.when(value.isNotNull(), F.struct(value.alias("value"), rule.alias("rule")))

    return X.let(
        X.fold(raw),
        lambda key: F.when(
            key.isNotNull(),
            F.coalesce(
                named(exact, key),
                named(scanned, F.get(S.find_texts(key, list(scanned)), F.lit(0))["text"]),
                F.struct(raw.alias("value"), F.lit("material:preserved").alias("rule")),
            ),
        ),
    )


def derive_material(raw_quality: Column, group: Column, vocabulary: Vocabulary) -> Column:
    """Struct of outcome (derived, deliberate, ambiguous, uncovered), material and rule."""

    def applies(text: Column, kind: str, value: str) -> Column:
        return F.coalesce(group == value, F.lit(False)) if kind == "group" else text.rlike(f"(?i){value}")

    def judge(text: Column) -> Column:
        deliberate = F.lit(False)
        for kind, value in vocabulary.uncovered:
            deliberate = deliberate | applies(text, kind, value)
        matches = F.array_compact(
            F.array(
                *[
                    F.when(applies(text, kind, value), F.struct(F.lit(i).alias("id"), F.lit(m).alias("material")))
                    for i, kind, value, m, _ in sorted(vocabulary.derivations, key=lambda d: (str(d[4]), d[0]))
                ]
            )
        )

        def outcome(found: Column) -> Column:
            materials = F.array_distinct(F.transform(found, lambda m: m["material"]))
            kind = (
                F.when(F.size(materials) == 0, "uncovered")
                .when(F.size(materials) > 1, "ambiguous")
                .otherwise("derived")
            )
            first = F.get(found, F.lit(0))
            single = F.size(materials) == 1
            return F.struct(
                kind.alias("outcome"),
                F.when(single, first["material"]).alias("material"),
                F.when(single, F.concat(F.lit("P-3:"), first["id"])).alias("rule"),
            )

        none = F.lit(None).cast("string")
        return F.when(
            deliberate, F.struct(F.lit("deliberate").alias("outcome"), none.alias("material"), none.alias("rule"))
        ).otherwise(X.let(matches, outcome))

    return F.when(raw_quality.isNotNull(), X.let(X.evidence_fold(raw_quality), judge))


FACTOR = 8
LEAST_WORDS, MOST_WORDS = 10, 22


def _bits_of(column: str, n: int, log_words: int) -> tuple[Column, Column]:
    """The word and the place in it of the ``n``-th bit that stands for a text in a set of 2 ** (log_words + 6) bits."""
    h = F.xxhash64(F.col(column), F.lit(n))
    return h.bitwiseAND(F.lit((1 << log_words) - 1)), F.shiftrightunsigned(h, 58).cast("int")


def _possible(asked: DataFrame, known: DataFrame, n: int, column: str) -> DataFrame:
    """``asked`` without rows whose ``column`` is surely not among the about ``n`` values of ``known``.

    A Bloom filter of two bits for each value, as one array that all tasks read: at most 32 MB, whatever ``n`` is.
    Where it is too small for ``n``, more rows stay, which costs time but no result.
    """
    log_words = min(MOST_WORDS, max(LEAST_WORDS, (max(1, n) * 16 // 64).bit_length()))
    probes = [_bits_of(column, i, log_words) for i in (1, 2)]
    bit = known.select(F.explode(F.array(*[F.struct(w.alias("word"), b.alias("bit")) for w, b in probes])).alias("p")).select("p.*")
    words = bit.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    dense = known.sparkSession.range(1 << log_words).withColumnRenamed("id", "word").join(words, "word", "left")
    held = dense.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))["bits"].alias("held"))
    test = [F.bit_get(F.get(held.scalar(), w.cast("int")), b) == 1 for w, b in probes]
    return asked.where(test[0] & test[1])


def required_text(pattern: str) -> str:
    """A text that every match of the pattern holds, upper-cased, at most ``FACTOR`` long; '' if none is known.

    Literals of the outermost sequence, of groups in it and of repeats that occur at least once are required;
    alternatives, classes and optional parts are not. Patterns that cannot be read here require nothing.
    """
    try:
        tree = sre.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return ""
    best, run = "", ""

    def walk(items) -> None:
        nonlocal best, run
        for op, value in items:
            if op is sre.LITERAL and 0x20 <= value < 0x7F:
                run += chr(value).upper()
                best = max(best, run, key=len)
            elif op is sre.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
                run = ""
                walk(value[2])
                run = ""
            elif op is not sre.AT:
                run = ""

    walk(tree)
    return best[:FACTOR]


def _pattern_factors(patterns: DataFrame) -> DataFrame:
    """(no, value, material, rule, factor) of patterns (no, value, material, rule)."""

    def read(batches):
        for batch in batches:
            factors = [required_text(v) for v in batch.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(factors, pa.string())], [*batch.schema.names, "factor"])

    return patterns.mapInArrow(read, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in patterns.schema.fields)}, factor string")


def derive_material_join(qualities: DataFrame, entries: DataFrame, uncovered: DataFrame) -> DataFrame:
    """J9 for derivation tables of any size, with equi-joins only.

    ``qualities`` has (raw, group), ``entries`` (id, kind, value, material, decided_at) and ``uncovered`` (kind,
    value), where kind is 'group' or 'pattern'. Groups meet by equality. Of a pattern a required text is
    known; the distinct qualities meet patterns by their pieces of up to ``FACTOR`` characters, and the
    expression runs on what met. Pieces that no pattern requires are left out before they are shuffled. Patterns that require no text meet every distinct quality.

    Returns (raw, group, outcome, material, rule), one row for each distinct (raw, group); same outcomes as
    ``derive_material``, null for a null raw. Patterns match in any case and anywhere unless anchored.
    """
    values = qualities.select("raw", "group").distinct().withColumn("text", X.evidence_fold("raw"))
    one = entries.select("kind", "value", "material", F.struct("decided_at", "id").alias("rank"))
    none = uncovered.select("kind", "value", F.lit(None).cast(one.schema["material"].dataType).alias("material"), F.lit(None).cast(one.schema["rank"].dataType).alias("rank"))
    rules = one.unionByName(none)
    key = F.struct("raw", "group").alias("key")
    by_group = values.where("raw IS NOT NULL").join(
        rules.where("kind = 'group'").select(F.col("value").alias("group"), "material", "rank"), "group"
    ).select(key, "material", "rank")
    patterns = rules.where("kind <> 'group'").groupBy("value").agg(F.collect_list(F.struct("material", "rank")).alias("rules"))
    # Reading a pattern is the dear part, so what was read is kept for the filter and the join.
    spark, path = patterns.sparkSession, f"{shared_folder(patterns.sparkSession)}/bomrec-factors-{uuid.uuid4().hex}"
    _pattern_factors(patterns).write.parquet(path)
    factors = spark.read.parquet(path)
    size = F.greatest(F.length("text"), F.lit(1))
    pieces = F.flatten(F.transform(
        F.sequence(F.lit(1), size),
        lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(FACTOR), size - i + 1)), lambda n: F.substring(F.col("text"), i, n)),
    ))
    asked = values.where("raw IS NOT NULL").select(key, F.explode(F.array_distinct(F.concat(F.array(F.lit("")), pieces))).alias("factor"))
    asked = _possible(asked, factors.select("factor"), factors.count(), "factor")
    met = asked.join(factors, "factor").withColumn("text", X.evidence_fold("key.raw"))
    matched = met.where(F.rlike("text", F.concat(F.lit("(?i)"), "value"))).select("key", F.inline("rules"))
    judged = by_group.unionByName(matched).groupBy("key").agg(
        F.bool_or(F.col("rank").isNull()).alias("deliberate"), F.min("material").alias("low"), F.max("material").alias("high"),
        F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "material"))).alias("first"),
    )
    found = values.join(judged, values["raw"].eqNullSafe(judged["key.raw"]) & values["group"].eqNullSafe(judged["key.group"]), "left")
    single = ~F.col("deliberate") & (F.col("low") == F.col("high"))
    kind = F.when(F.col("raw").isNull(), None).when(F.col("key").isNull(), "uncovered").when(F.col("deliberate"), "deliberate")
    return found.select(
        "raw", "group", kind.when(F.col("low") == F.col("high"), "derived").otherwise("ambiguous").alias("outcome"),
        F.when(single, F.col("low")).alias("material"),
        F.when(single, F.concat(F.lit("P-3:"), F.col("first.rank.id"))).alias("rule"),
    )


def incoherence(group: Column, name: Column, hv_scope: Column | None = None) -> Column:
    """why a quality group does not fit the element type, or null."""
    case = F.when(group.isin(*T.NUT_ONLY_GROUPS) & (name != "TUERCA"), "NUT_ONLY_QUALITY_ON_NON_NUT").when(
        group.isin(*T.BOLT_ONLY_GROUPS) & (name == "TUERCA"), "NON_NUT_QUALITY_ON_NUT"
    )
    if hv_scope is not None:
        washer_only = (hv_scope == "washer_only") & group.isin(*T.HARDNESS_GROUPS) & (name != "ARANDELA")
        case = case.when(washer_only, "HV_OUTSIDE_WASHER")
    return case


# -- join forms for value tables of any size ---------------------------------------------------


def resolve_qualities(values: DataFrame, column: str, catalog: DataFrame, entries: DataFrame) -> DataFrame:
    """J8 as two left joins: catalogue (value, group_id), then live entries (alias, group_id, id)."""
    layer1 = catalog.select(X.fold("value").alias("needle"), F.col("group_id").alias("catalog_group"))
    layer2 = (
        entries.groupBy(X.fold("alias").alias("needle"))
        .agg(F.count_distinct("group_id").alias("n_groups"), F.min("group_id").alias("vocab_group"), F.min("id").alias("entry_id"))
    )
    return (
        values.withColumn("needle", X.fold(column))
        .join(layer1, "needle", "left")
        .join(layer2, "needle", "left")
        .withColumn(
            "source",
            F.when(F.col("catalog_group").isNotNull(), "catalog")
            .when(F.col("n_groups") == 1, "vocab")
            .when(F.col("n_groups") > 1, "ambiguous")
            .otherwise("out"),
        )
        .withColumn(
            "group_id",
            F.when(F.col("source") == "catalog", F.col("catalog_group")).when(F.col("source") == "vocab", F.col("vocab_group")),
        )
        .drop("needle", "catalog_group", "vocab_group", "n_groups", "entry_id")
    )


def equivalent_qualities(values: DataFrame, column: str, catalog: DataFrame) -> DataFrame:
    """Group of every value; two values are equivalent when they share a non-null group.

    Emits values with their group and how many distinct values share it, never the pairs.
    """
    distinct = values.select(column).distinct()
    grouped = distinct.join(
        catalog.select(X.fold("value").alias("needle"), "group_id"), X.fold(column) == F.col("needle"), "left"
    ).drop("needle")
    sizes = grouped.filter("group_id is not null").groupBy("group_id").agg(F.count(F.lit(1)).alias("n_equivalent"))
    return grouped.join(sizes, "group_id", "left")


def standard_columns(values: DataFrame, column: str, vocabulary: Vocabulary) -> DataFrame:
    s = D.resolve_standard(F.col(column), vocabulary)
    return values.withColumn("std", s).select(*values.columns, "std.*")
