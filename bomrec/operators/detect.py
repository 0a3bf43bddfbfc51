"""Detection of names, standards, finishes, materials, measures and qualities in row text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bomrec.functions import closed_tables as T
from bomrec.functions import measure as M
from bomrec.functions import places as P
from bomrec.functions import spans as S
from bomrec.functions import text as X
from bomrec.operators.catalog import Vocabulary
from bomrec.session import shared_folder


def name_hits(folded: Column, vocabulary: Vocabulary) -> Column:
    """Catalogue names in order of appearance."""
    return S.find_texts(folded, list(Vocabulary.scanned(vocabulary.names)))


def name_value(text: Column, vocabulary: Vocabulary) -> Column:
    return X.lookup({k: a.value for k, a in Vocabulary.scanned(vocabulary.names).items()}, text)


def material_hits(folded: Column, vocabulary: Vocabulary) -> Column:
    """Material words."""
    return S.find_texts(folded, list(Vocabulary.scanned(vocabulary.materials)))


def material_value(text: Column, vocabulary: Vocabulary) -> Column:
    return X.lookup({k: a.value for k, a in Vocabulary.scanned(vocabulary.materials).items()}, text)


def finish_hits(folded: Column, vocabulary: Vocabulary) -> Column:
    """Finish aliases; entries declared not to be a finish are not scanned."""
    table = vocabulary.finish_table()
    return S.find_texts(folded, [k for k, es in table.items() if any(e.kind == "alias" and e.finish for e in es)])


def finish_value(text: Column, vocabulary: Vocabulary) -> Column:
    """Finish of a scanned alias: the first live alias entry with that text."""
    table = {}
    for key, entries in vocabulary.finish_table().items():
        aliases = [e for e in entries if e.kind == "alias" and e.finish]
        if aliases:
            table[key] = aliases[0].finish
    return X.lookup(table, text)


def standard_hits(folded: Column, vocabulary: Vocabulary) -> Column:
    """Standard designations; every family starts at its own keyword, so only added aliases can
    overlap a designation and then the longest span wins."""
    families = "|".join(pattern for pattern, _ in T.STANDARD_PATTERNS.values())
    hits = S.scan(folded, f"(?=[DMIAE])(?:{families})")
    added = list(Vocabulary.scanned(vocabulary.standard_aliases))
    return S.claim_longest(F.concat(hits, S.find_texts(folded, added))) if added else hits


def canonical_standard(text: Column) -> Column:
    """Struct of family, canonical and bare designation of the first family found; null if none."""
    out = None
    for family, (pattern, prefix) in T.STANDARD_PATTERNS.items():
        number = F.regexp_replace(F.regexp_extract(text, pattern, 1), "\\s+", "")
        bare = F.concat(F.lit(prefix), number)
        suffix = F.lit("")
        if family == "DIN":
            suffix = F.regexp_replace(F.regexp_extract(text, pattern, 2), "\\s*-\\s*", "-")
        full = F.when(suffix != "", F.concat(bare, F.lit(" "), suffix)).otherwise(bare)
        case = F.struct(F.lit(family).alias("family"), full.alias("canonical"), bare.alias("bare"))
        out = F.when(text.rlike(pattern), case) if out is None else out.when(text.rlike(pattern), case)
    return out


def _equivalence(parts: Column) -> Column:
    """The equivalence applied to a designation, or its bare form when nothing maps."""
    full = X.lookup(T.STANDARD_EQUIVALENCES, parts["canonical"])
    bare = X.lookup(T.STANDARD_EQUIVALENCES, parts["bare"])
    key = F.when(full.isNotNull(), parts["canonical"]).otherwise(parts["bare"])
    target = F.coalesce(full, bare)
    return F.struct(
        F.coalesce(target, parts["bare"]).alias("normalized"),
        F.when(target.isNull(), parts["family"])
        .when(F.startswith(target, F.lit("EN")), F.lit("EN"))
        .otherwise(F.lit("ISO"))
        .alias("family"),
        target.isNotNull().alias("mapped"),
        F.when(
            target.isNotNull(),
            F.concat(F.regexp_replace(key, "\\s+", ""), F.lit("->"), F.regexp_replace(target, "\\s+", "")),
        ).alias("rule"),
    )


def resolve_standard(raw: Column, vocabulary: Vocabulary) -> Column:
    """Struct of normalized, family, mapped and rule; null when no designation is recognised."""
    def own(folded: Column) -> Column:
        return X.let(canonical_standard(folded), lambda parts: F.when(parts.isNotNull(), _equivalence(parts)))

    aliases = Vocabulary.exact(vocabulary.standard_aliases)
    if not aliases:
        return X.let(X.fold(raw), own)
    target = {k: a.value for k, a in aliases.items()}
    entry = {k: a.entry_id or "" for k, a in aliases.items()}

    def via_alias(folded: Column) -> Column:
        mapped = own(X.lookup(target, folded))
        return X.let(
            mapped,
            lambda m: F.when(
                m.isNotNull(),
                F.struct(
                    m["normalized"].alias("normalized"), m["family"].alias("family"),
                    F.lit(True).alias("mapped"),
                    F.concat(F.lit("standard:alias:"), X.lookup(entry, folded)).alias("rule"),
                ),
            ),
        )

    return X.let(X.fold(raw), lambda folded: F.coalesce(own(folded), via_alias(folded)))


def measure_hits(folded: Column) -> Column:
    """measure designations that really parse as one."""
    hits = F.transform(
        S.scan(folded, f"(?=[M0-9])(?:{M.MEASURE_SCAN})"),
        lambda h: F.struct(F.trim(h["text"]).alias("text"), h["start"].alias("start"), h["end"].alias("end")),
    )
    # Every scanned shape parses except a metric zero.
    return F.filter(hits, lambda h: ~h["text"].rlike("^M\\s?0+(?:[.,]0+)?(?![0-9.,])"))


def length_hits(folded: Column) -> Column:
    """lengths written with their own unit."""
    return S.scan(folded, M.LENGTH_SCAN)


def quality_hits(folded: Column, taken: list[Column], vocabulary: Vocabulary) -> Column:
    """catalogue tokens and grades outside the spans already read as something else."""
    free = folded
    for hits in taken:
        free = S.mask(free, hits, folded)
    tokens = list(vocabulary.group_by_value())
    return X.let(
        free,
        lambda text: S.sort_hits(F.concat(S.find_texts(text, tokens), S.scan(text, T.GRADE_SCAN))),
    )


def with_hits(rows: DataFrame, text: str = "source_text", vocabulary: Vocabulary | None = None) -> DataFrame:
    """Add the folded text and one hit array per detector. One narrow pass, no shuffle."""
    v = vocabulary or Vocabulary.closed()
    folded = F.col("folded")
    hits = rows.withColumn("folded", X.fold(text)).withColumns(
        {
            "names": name_hits(folded, v),
            "standards": standard_hits(folded, v),
            "finishes": finish_hits(folded, v),
            "materials": material_hits(folded, v),
            "measures": measure_hits(folded),
            "lengths": length_hits(folded),
        }
    )
    taken = ("names", "standards", "measures", "lengths")
    hits = X.computed_once(hits, ["folded", "names", "standards", "finishes", "materials", "measures", "lengths"])
    hits = hits.withColumn("qualities", quality_hits(folded, [F.col(c) for c in taken], v))
    return X.computed_once(hits, ["qualities"])


def distinct_names(names: Column, vocabulary: Vocabulary) -> Column:
    """Distinct catalogue names of a row."""
    return F.array_distinct(F.transform(names, lambda h: name_value(h["text"], vocabulary)))


def distinct_standards(standards: Column, vocabulary: Vocabulary) -> Column:
    return F.array_distinct(
        F.transform(standards, lambda h: resolve_standard(h["text"], vocabulary)["normalized"])
    )


def distinct_finishes(finishes: Column, vocabulary: Vocabulary) -> Column:
    return F.array_distinct(F.transform(finishes, lambda h: finish_value(h["text"], vocabulary)))


def is_empty_description(text: Column, names: Column, standards: Column) -> Column:
    """Nothing recognisable and fewer than eight letters."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-zÀ-ÿ]", ""))
    return (F.size(names) == 0) & (F.size(standards) == 0) & (letters < 8)


def reader_tier(names: Column, vocabulary: Vocabulary) -> Column:
    """P5: a set goes to the main reader, a single element to the cheap one."""
    return F.when(F.size(distinct_names(names, vocabulary)) >= 2, "main").otherwise("cheap")


def escalate(tier: Column, elements_found: Column) -> Column:
    """P5: the cheap reader found a set, so the row is read again."""
    return (tier == "cheap") & (elements_found > 1)


def is_known_grade(raw: Column | str) -> Column:
    """ASTM grade shapes that need no catalogue entry."""
    return F.trim(X.col(raw)).rlike(T.KNOWN_GRADE)


def detection_coverage(hits: DataFrame) -> DataFrame:
    """Share of rows with at least one hit per detector."""
    detectors = {"name": "names", "standard": "standards", "finish": "finishes", "quality": "qualities"}
    counts = hits.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.size(c) > 0).alias(f"{a}_rows") for a, c in detectors.items()],
    )
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("attribute"), F.col(f"{a}_rows").alias("covered"),
                        F.col("total"),
                        F.round(F.try_divide(100.0 * F.col(f"{a}_rows"), F.col("total")), 6).alias("pct"),
                    )
                    for a in detectors
                ]
            )
        )
    )


def undetected_rows(hits: DataFrame, key: str, detector: str) -> DataFrame:
    """The rows a detector finds nothing in; stays distributed however many they are."""
    return hits.filter(F.size(detector) == 0).select(key)


# -- J1 for vocabularies too large to inline --------------------------------------------------

_PLACE = "core binary, before binary, after binary, room_before int, room_after int, at int"


def alias_index(aliases: DataFrame) -> DataFrame:
    """(lead, core, tail, shift, reach, tokens, head, prefix) beside folded alias texts (needle, ord) and what else they have.

    An alias is its tokens with what stands between them (``core``), and what stands before and behind them. Of an
    alias without letters A-Z and digits all is core. ``head`` is a key of the whole core, ``prefix`` one of the
    first tokens of a long one. ``shift`` and ``reach`` lead from where the core begins to where the alias does
    begin and end.
    """
    spelled = F.col("needle").rlike("[A-Z0-9]")
    part = lambda pattern: F.when(spelled, F.regexp_extract("needle", pattern, 0)).otherwise("")
    core = F.regexp_replace(F.regexp_replace("needle", "^[^A-Z0-9]+", ""), "[^A-Z0-9]+$", "")
    parts = {"lead": part("^[^A-Z0-9]*"), "core": F.when(spelled, core).otherwise(F.col("needle")), "tail": part("[^A-Z0-9]*$")}
    cut = aliases.withColumns(parts).withColumns(
        {"shift": F.length("lead"), "reach": F.length("core") + F.length("tail"), **{c: F.col(c).cast("binary") for c in parts}}
    )

    def keyed(batches):
        for batch in batches:
            tokens, head, prefix = P.core_heads(batch.column("core"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens.astype("int32")), pa.array(head), pa.array(prefix)], [*batch.schema.names, "tokens", "head", "prefix"])

    return cut.mapInArrow(keyed, StructType([*cut.schema, *StructType.fromDDL("tokens int, head long, prefix long")]))


def _wanted(index: DataFrame) -> P.Wanted:
    """What the scan of the texts has to know of the aliases: some numbers and a Bloom filter of at most 8 MB."""
    plain = F.col("tokens") == 0
    seen = index.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.octet_length("lead")).alias("lead"), F.max(F.octet_length("tail")).alias("tail"),
        F.collect_set(F.when(~plain, F.col("tokens"))).alias("spans"), F.collect_set(F.when(plain, F.octet_length("core"))).alias("sizes"),
        F.collect_set(F.when(plain, F.conv(F.hex(F.substring("core", 1, 1)), 16, 10).cast("int"))).alias("openings"),
    ).first()
    bits = P.log_bits(seen["n"])
    place = lambda key, s: F.shiftrightunsigned(key, s).bitwiseAND(F.lit((1 << bits) - 1))
    probes = index.select(F.explode(F.array_distinct(F.array(*[place(F.col(key), s) for key in ("head", "prefix") for s in P.SHIFTS]))).alias("p"))
    held = probes.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[held["word"].to_numpy()] = held["bits"].to_numpy()
    return P.Wanted(seen["spans"], seen["sizes"], seen["openings"], seen["lead"] or 0, seen["tail"] or 0, words.view(np.uint64))


def alias_candidates(texts: DataFrame, key: str, index: DataFrame) -> DataFrame:
    """(key, needle, ord, start, end): all word-bounded occurrences of the indexed aliases in texts (key, folded).

    What else the index has comes along. One pass over the texts finds, by a Bloom filter, the places where an
    alias may stand; only these are sent, with the text of the core and what the aliases need of its surroundings,
    and meet the aliases by an equi-join on that text, so that a key shared by chance finds nothing. The texts
    themselves are not shuffled. Nothing here depends on how many aliases there are.
    """
    spark, path = index.sparkSession, f"{shared_folder(index.sparkSession)}/bomrec-aliases-{uuid.uuid4().hex}"
    index.write.parquet(path)  # read for the filter and for the join
    kept = spark.read.schema(index.schema).parquet(path)
    wanted = _wanted(kept)
    asked = texts.where(F.col(key).isNotNull()).select(key, "folded")
    met_by = StructType.fromDDL(_PLACE)
    names = [key, *met_by.names]

    def scan(batches):
        for batch in batches:
            for text, found in P.places(batch.column(1), wanted):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), *found], names)

    met = asked.mapInArrow(scan, StructType([asked.schema[key], *met_by])).join(kept, "core")
    # Around an alias stands no letter or digit.
    fits = (
        F.endswith("before", "lead") & F.startswith("after", "tail")
        & ((F.octet_length("lead") == 0) | (F.col("room_before") > F.octet_length("lead")))
        & ((F.octet_length("tail") == 0) | (F.col("room_after") > F.octet_length("tail")))
    )
    own = [c for c in index.columns if c not in ("needle", "ord", "lead", "core", "tail", "shift", "reach", "tokens", "head", "prefix")]
    return met.where(fits).select(key, "needle", "ord", (F.col("at") - F.col("shift")).alias("start"), (F.col("at") + F.col("reach")).alias("end"), *own)


def claim_longest_spans(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """``candidates`` without ord: the longest of overlapping ones, then the least ord, then the first.

    Each text's candidates come best first, so one that overlaps a taken one, which is no shorter, has its first or
    its last character taken. That is looked up in a mark for each character, however many candidates overlap.
    """
    best = Window.partitionBy(*keys).orderBy(F.col("start") - F.col("end"), "ord", "start", "needle")

    def claim(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        taken = P.Taken()
        for nth, start, end in batches:
            yield pa.array(taken.add(nth.to_pylist(), start.to_pylist(), end.to_pylist()))

    # Not deterministic, as it goes by the order of rows: no filter may move below it.
    free = F.arrow_udf(claim, "boolean").asNondeterministic()
    ranked = candidates.withColumn("nth", F.row_number().over(best))
    return ranked.withColumn("free", free("nth", "start", "end")).where("free").drop("ord", "nth", "free")


def find_aliases_join(rows: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """J1 for alias tables (alias, value, ord) of any size, with equi-joins only; ``key`` is unique.

    Same result as the inline scan: word-bounded occurrences in the folded text, longest alias first, no
    character used twice. Of aliases with one folded text the one with the least ``ord`` counts.
    """
    table = aliases.withColumn("needle", X.fold("alias")).filter("needle <> ''")
    table = table.groupBy("needle").agg(
        F.min_by(F.struct("alias", "value"), "ord").alias("a"), F.min("ord").cast("long").alias("ord")
    )
    texts = rows.select(F.col(key), X.fold(text).alias("folded"))
    found = claim_longest_spans(alias_candidates(texts, key, alias_index(table)), [key])
    return found.select(key, "a.alias", "a.value", "start", "end")


def find_attributes_join(rows: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """Names, finishes, materials and catalogue qualities by vocabularies of any size, in one pass.

    ``vocabulary`` has (attribute, alias, value, ord). Each attribute is claimed by itself, as the readers'
    scans are, so one span may be a name and a material at once. All attributes share one index and one join.

    Returns (key, attribute, alias, value, start, end).
    """
    table = vocabulary.withColumn("needle", X.fold("alias")).filter("needle <> ''")
    table = table.groupBy("needle", "attribute").agg(
        F.min_by(F.struct("alias", "value"), "ord").alias("a"), F.min("ord").cast("long").alias("ord")
    )
    needles = table.groupBy("needle").agg(F.min("ord").alias("ord"))
    texts = rows.select(F.col(key), X.fold(text).alias("folded"))
    places = alias_candidates(texts, key, alias_index(needles)).drop("ord")
    found = claim_longest_spans(places.join(table, "needle"), [key, "attribute"])
    return found.select(key, "attribute", "a.alias", "a.value", "start", "end")


def exact_alias(values: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Exact lookup on the folded value; the last client alias wins, else the first added one."""
    client = F.col("source") == "client"
    rank = F.struct(F.when(client, 0).otherwise(1), F.when(client, -F.col("ord")).otherwise(F.col("ord")))
    table = (
        aliases.withColumn("needle", X.fold("alias"))
        .groupBy("needle")
        .agg(F.min_by(F.struct("alias", "value", "source"), rank).alias("a"))
        .select("needle", F.col("a.alias").alias("alias"), F.col("a.value").alias("value"), F.col("a.source").alias("alias_source"))
    )
    return values.withColumn("needle", X.fold(column)).join(table, "needle", "left").drop("needle")
