"""From row text to elements: the table-only reader, recorded answers, and evidence checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomrec.functions import closed_tables as T
from bomrec.functions import text as X
from bomrec.operators import detect as D
from bomrec.operators.catalog import Vocabulary

READ_ATTRIBUTES = ("material", "quality", "measure", "length", "standard", "finish")
RESPONSE_SCHEMA = (
    "row_ref string, out_of_family boolean, out_of_family_reason string, error string, "
    "elements array<struct<evidence:string,detected_name:string,normalized_name:string,role:string,"
    "multiplicity:int,"
    + ",".join(f"{a}:struct<value:string,evidence:string>" for a in READ_ATTRIBUTES)
    + ">>"
)
ELEMENT_TYPE = (
    "struct<detected_name:string,guess:string,role:string,start:int,end:int,anchor:int,"
    "multiplicity:int,stated:boolean,claimed:int,count_evidence:string,"
    + ",".join(f"{a}_raw:string,{a}_start:int,{a}_end:int" for a in READ_ATTRIBUTES)
    + ">"
)
AUDIT_TYPE = "array<struct<element:string,attribute:string,evidence:string>>"


def _position(needle: Column, text: Column, start: Column) -> Column:
    """0-based offset at or after a 0-based start, null when absent."""
    found = F.position(needle, text, start + 1)
    return F.nullif(found, F.lit(0)) - 1


def _loose_pattern(folded_needle: Column) -> Column:
    letters = F.regexp_extract_all(
        F.regexp_replace(folded_needle, X.WHITESPACE, ""), F.lit("(?s)(.)"), F.lit(1)
    )
    return F.concat_ws("\\s*", F.transform(letters, X.escape_pattern))


def offset_map(source: Column, folded: Column) -> Column:
    """For each character of the folded text the source character that it comes from; null where folding moves
    nothing, so that offsets are the same.

    Each source character folds to some characters by itself (none for a combining mark, two for a sharp s),
    and white space to one blank after another character, none at the ends. The running sum of these numbers
    is the map, written as the source index repeated so often.
    """
    blanks = [chr(c) for c in (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    characters = F.regexp_extract_all(source, F.lit("(?s)(.)"), F.lit(1))
    stop = F.length(F.regexp_replace(source, X.WHITESPACE + "$", ""))

    def width(known: Column, c: Column, i: Column) -> Column:
        begins = (i > 0) & (i < known["stop"]) & ~F.get(known["cs"], i - 1).isin(*blanks)
        plain = F.ascii(c) < 128
        return F.when(c.isin(*blanks), begins.cast("int")).when(plain, 1).otherwise(F.length(F.upper(X.strip_accents(c))))

    known = F.struct(characters.alias("cs"), stop.alias("stop"))
    places = X.let(known, lambda k: F.flatten(F.transform(k["cs"], lambda c, i: F.array_repeat(i, width(k, c, i)))))
    checked = X.let(places, lambda p: F.when(F.size(p) == F.length(folded), p))
    # Lengths that agree by chance, an expanding letter and a run of blanks, are moved as well.
    moved = (F.length(source) != F.length(folded)) | (F.length(F.upper(X.strip_accents(source))) != F.length(source))
    return F.when(moved, checked)


def locate(
    source: Column, folded: Column, evidence: Column, start: Column, verbatim: bool = False, places: Column | None = None
) -> Column:
    """Where literal evidence sits in a row, from exact to white-space-insensitive.

    Struct of start and end (source offsets), anchor and anchor_end (offsets in the folded text) and found.
    Where folding moves offsets, ``places`` (an ``offset_map``) leads from the folded text back to the source;
    without it such hits have no source offsets. Null or blank evidence counts as found without a span.
    ``verbatim`` evidence is already folded text.
    """
    same_length = F.length(source) == F.length(folded)
    if places is not None:
        same_length = same_length & places.isNull()
    nowhere = F.lit(None).cast("int")

    def to_source(at: Column) -> Column:
        return nowhere if places is None else F.get(places, at.cast("int"))

    def begin(at: Column) -> Column:
        return F.when(same_length, at).otherwise(to_source(at))

    def finish(at: Column) -> Column:
        return F.when(same_length, at).otherwise(to_source(at - 1) + 1)

    # A source offset to search from, in the folded text.
    folded_start = start
    if places is not None:
        folded_start = F.when(same_length | places.isNull(), start).otherwise(F.size(F.filter(places, lambda p: p < start)))

    def search(needle: Column, plain: Column) -> Column:
        exact = F.coalesce(_position(needle, source, start), _position(needle, source, F.lit(0)))
        in_folded = F.coalesce(_position(plain, folded, folded_start), _position(plain, folded, F.lit(0)))
        loose = F.when(
            (plain != "") & exact.isNull() & in_folded.isNull(),
            F.nullif(F.regexp_instr(folded, _loose_pattern(plain)), F.lit(0)) - 1,
        )
        loose_end = loose + F.length(F.regexp_substr(folded, _loose_pattern(plain)))

        def result(e: Column, f: Column, lo: Column) -> Column:
            own_anchor = F.when(same_length, F.coalesce(e, f, lo)).otherwise(F.coalesce(f, lo))
            end = F.when(lo.isNotNull(), loose_end)
            own_end = F.coalesce(own_anchor + F.length(plain) + F.when(lo.isNull(), 0), end)
            return F.struct(
                F.coalesce(e, begin(F.coalesce(f, lo))).cast("int").alias("start"),
                F.coalesce(e + F.length(needle), finish(F.coalesce(f + F.length(plain), end))).cast("int").alias("end"),
                own_anchor.cast("int").alias("anchor"),
                own_end.cast("int").alias("anchor_end"),
                (e.isNotNull() | f.isNotNull() | lo.isNotNull() | (needle == "")).alias("found"),
            )

        return X.let(exact, lambda e: X.let(in_folded, lambda f: X.let(loose, lambda lo: result(e, f, lo))))

    if verbatim:
        return X.let(evidence, lambda n: search(n, n))
    no_span = F.lit(None).cast("int")
    nothing = F.struct(
        no_span.alias("start"), no_span.alias("end"), no_span.alias("anchor"),
        no_span.alias("anchor_end"), F.lit(True).alias("found"),
    )
    trimmed = X.unescape_jsonish(F.trim(evidence))
    return X.let(
        trimmed,
        lambda n: F.when(n.isNull() | (n == ""), nothing).otherwise(X.let(X.fold(n), lambda p: search(n, p))),
    )


_GAP = "[\\s,;:./+()\\-]*"
_COUNT = (
    "(?<![A-Z.,0-9À-ÿ])(\\d+)"
    f"(?:{_GAP}(?<![A-Z.])(?:{'|'.join(T.COUNT_QUALIFIERS)})){{0,2}}{_GAP}$"
)
_INTRODUCED = (
    "(?:[,;:(+][\\s,;:.+()\\-]*"
    f"|(?<![A-Z/À-ÿ])(?:{'|'.join(T.COUNT_CONNECTORS)})/?[\\s.)\\-]*"
)
COUNT_INSIDE = _INTRODUCED + ")" + _COUNT
COUNT_AT_START = _INTRODUCED + "|^[A-Z/À-ÿ]*[\\s.)\\-]*)" + _COUNT


def multiplicity(folded: Column, name_start: Column) -> Column:
    """F8: the count the row writes right before a name: struct of value and evidence, or null.

    One anchored pattern over the short window before the name. A count must be introduced by
    punctuation, a connector word or the start of the row, so a standard's number never counts.
    """
    begin = F.greatest(name_start - T.COUNT_WINDOW, F.lit(0))
    window = F.when(name_start > 0, F.substring(folded, begin + 1, name_start - begin))

    def read(before: Column) -> Column:
        digits = F.when(name_start <= T.COUNT_WINDOW, F.regexp_extract(before, COUNT_AT_START, 1)).otherwise(
            F.regexp_extract(before, COUNT_INSIDE, 1)
        )
        return X.let(
            F.nullif(digits, F.lit("")).try_cast("int"),
            lambda count: F.when(
                count >= 1,
                F.struct(
                    count.alias("value"),
                    F.trim(F.regexp_extract(before, "\\d+[^\\d]*$", 0)).alias("evidence"),
                ),
            ),
        )

    return X.let(window, read)


def _name_start(names: Column, anchor: Column, anchor_end: Column) -> Column:
    """First catalogue name inside the element's span, else where the span starts."""
    inside = F.filter(names, lambda n: (n["start"] >= anchor) & (n["start"] < anchor_end))
    return F.coalesce(F.get(inside, F.lit(0))["start"], anchor)


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def read_with_tables(
    rows: DataFrame, vocabulary: Vocabulary | None = None, text: str = "source_text", trace: bool = True
) -> DataFrame:
    """Table-only reader: one element per catalogue name, values owned by the name before them.

    J10 and W2 work on the row's own arrays, so the whole reader is one narrow stage. With
    ``trace=False`` source spans of the attribute values are left null.
    """
    v = vocabulary or Vocabulary.closed()
    source, folded, names = F.col(text), F.col("folded"), F.col("names")
    hit_rows, places = D.with_hits(rows, text, v), None
    if trace:
        hit_rows, places = hit_rows.withColumn("places", offset_map(source, folded)), F.col("places")

    def advance(acc: Column, n: Column) -> Column:
        where = locate(source, folded, n["text"], acc["cursor"], True, places)
        return X.let(
            where,
            lambda w: F.struct(
                F.coalesce(w["start"], acc["cursor"]).alias("cursor"),
                F.concat(acc["out"], F.array(w)).alias("out"),
            ),
        )

    place_type = "array<struct<start:int,end:int,anchor:int,anchor_end:int,found:boolean>>"
    placed = F.aggregate(
        names,
        F.struct(F.lit(0).alias("cursor"), F.array().cast(place_type).alias("out")),
        advance,
        lambda acc: acc["out"],
    )
    owned = {
        "material": "materials", "quality": "qualities", "measure": "measures",
        "length": "lengths", "standard": "standards", "finish": "finishes",
    }

    def element(n: Column, i: Column) -> Column:
        place = F.get(F.col("placed"), i)
        until = F.get(names, i + 1)["start"]

        def first_owned(hits: str) -> Column:
            mine = F.filter(
                F.col(hits),
                lambda h: ((i == 0) | (h["start"] >= n["start"])) & (until.isNull() | (h["start"] < until)),
            )
            return F.get(mine, F.lit(0))["text"]

        start = _name_start(names, place["anchor"], place["anchor_end"])
        fields = [
            n["text"].alias("detected_name"),
            name_or_null(n["text"]).alias("guess"),
            F.when(i == 0, "principal").otherwise("secondary").alias("role"),
            place["start"].alias("start"), place["end"].alias("end"), place["anchor"].alias("anchor"),
        ]

        def build(m: Column) -> Column:
            out = [
                *fields,
                F.coalesce(m["value"], F.lit(1)).alias("multiplicity"),
                m.isNotNull().alias("stated"),
                F.lit(1).alias("claimed"),
                m["evidence"].alias("count_evidence"),
            ]
            for attribute, hits in owned.items():
                raw = first_owned(hits)
                if trace:
                    span = locate(source, folded, raw, F.coalesce(place["start"], F.lit(0)), True, places)
                    out += [
                        raw.alias(f"{attribute}_raw"),
                        span["start"].alias(f"{attribute}_start"),
                        span["end"].alias(f"{attribute}_end"),
                    ]
                else:
                    out += [
                        raw.alias(f"{attribute}_raw"),
                        _none("int").alias(f"{attribute}_start"), _none("int").alias(f"{attribute}_end"),
                    ]
            return F.struct(*out)

        return X.let(multiplicity(folded, start), build)

    def name_or_null(text_: Column) -> Column:
        return D.name_value(text_, v)

    read = hit_rows.withColumn("placed", placed).withColumn("elements", F.transform("names", element))
    return (
        X.computed_once(read.drop("placed", "places"), ["elements"])
        .withColumns(
            {
                "out_of_family": F.lit(False),
                "out_of_family_reason": _none("string"),
                "read_error": _none("string"),
                "skipped": F.lit(False),
                "unverifiable": F.array().cast(AUDIT_TYPE),
                "tier": F.lit("none"),
            }
        )
    )


def read_with_responses(
    rows: DataFrame, responses: DataFrame, vocabulary: Vocabulary | None = None,
    key: str = "row_ref", text: str = "source_text",
) -> DataFrame:
    """Replay recorded answers, keeping only what the row literally says.

    Elements or values whose evidence is not in the row are dropped and listed in ``unverifiable``;
    an out-of-family claim is cancelled when the row names a catalogue element.
    """
    v = vocabulary or Vocabulary.closed()
    source, folded, names = F.col(text), F.col("folded"), F.col("names")
    joined = D.with_hits(rows, text, v).join(responses, key, "left")
    readable = F.filter(
        F.coalesce("elements", F.array().cast(_response_elements())),
        lambda e: e["evidence"].isNotNull() & e["detected_name"].isNotNull(),
    )

    def audit(element: Column, attribute: Column, evidence: Column) -> Column:
        return F.struct(element.alias("element"), attribute.alias("attribute"), evidence.alias("evidence"))

    def check(e: Column, place: Column) -> Column:
        def attribute(a: str) -> Column:
            cell = F.struct(
                X.unescape_jsonish(e[a]["value"]).alias("value"),
                F.coalesce(e[a]["evidence"], e[a]["value"]).alias("evidence"),
            )

            def judged(c: Column) -> Column:
                return X.let(
                    locate(source, folded, c["evidence"], F.coalesce(place["start"], F.lit(0)), places=F.col("places")),
                    lambda w: F.struct(
                        F.when(w["found"], c["value"]).alias("raw"),
                        F.when(c["value"].isNotNull() & w["found"], w["start"]).alias("start"),
                        F.when(c["value"].isNotNull() & w["found"], w["end"]).alias("end"),
                        F.when(
                            c["value"].isNotNull() & ~w["found"],
                            audit(e["detected_name"], F.lit(a), c["evidence"]),
                        ).alias("drop"),
                    ),
                )

            return X.let(cell, judged).alias(a)

        return F.struct(*[attribute(a) for a in READ_ATTRIBUTES])

    def step(acc: Column, e: Column) -> Column:
        def placed(w: Column) -> Column:
            start = _name_start(names, w["anchor"], w["anchor_end"])

            def counted(m: Column) -> Column:
                def finished(c: Column) -> Column:
                    fields = [
                        e["detected_name"].alias("detected_name"), e["normalized_name"].alias("guess"),
                        e["role"].alias("role"), w["start"].alias("start"), w["end"].alias("end"),
                        w["anchor"].alias("anchor"),
                        F.coalesce(m["value"], F.lit(1)).alias("multiplicity"),
                        m.isNotNull().alias("stated"),
                        F.greatest(F.coalesce(e["multiplicity"], F.lit(1)), F.lit(1)).alias("claimed"),
                        m["evidence"].alias("count_evidence"),
                    ]
                    for a in READ_ATTRIBUTES:
                        fields += [
                            c[a]["raw"].alias(f"{a}_raw"), c[a]["start"].alias(f"{a}_start"),
                            c[a]["end"].alias(f"{a}_end"),
                        ]
                    return F.struct(
                        F.coalesce(w["start"], acc["cursor"]).alias("cursor"),
                        F.concat(acc["out"], F.array(F.struct(*fields).cast(ELEMENT_TYPE))).alias("out"),
                        F.concat(
                            acc["lost"], F.array_compact(F.array(*[c[a]["drop"] for a in READ_ATTRIBUTES]))
                        ).alias("lost"),
                    )

                return X.let(check(e, w), finished)

            kept = X.let(multiplicity(folded, start), counted)
            dropped = F.struct(
                acc["cursor"].alias("cursor"), acc["out"].alias("out"),
                F.concat(
                    acc["lost"], F.array(audit(e["detected_name"], F.lit("(element)"), e["evidence"]))
                ).alias("lost"),
            )
            return F.when(w["found"], kept).otherwise(dropped)

        return X.let(locate(source, folded, e["evidence"], acc["cursor"], places=F.col("places")), placed)

    unreadable = F.size(F.coalesce("elements", F.array().cast(_response_elements()))) - F.size(readable)
    lost_first = F.transform(
        F.filter(F.sequence(F.lit(0), unreadable), lambda i: i > 0),
        lambda i: audit(F.lit("(unreadable)"), F.lit("(element without evidence)"), F.lit("")),
    )
    start = F.struct(
        F.lit(0).alias("cursor"), F.array().cast(f"array<{ELEMENT_TYPE}>").alias("out"),
        F.array().cast(AUDIT_TYPE).alias("lost"),
    )
    skipped = D.is_empty_description(source, names, F.col("standards"))
    claimed_out = F.coalesce("out_of_family", F.lit(False))
    contradicted = claimed_out & (F.size(names) > 0)
    mapped = joined.withColumn("places", offset_map(source, folded))
    read = mapped.withColumn("checked", F.aggregate(readable, start, step)).withColumn("lost_first", lost_first)
    contradiction = F.when(
        contradicted,
        F.array(audit(F.lit("(row)"), F.lit("(out of family contradicted by the table)"), D.name_value(F.get(names, F.lit(0))["text"], v))),
    ).otherwise(F.array().cast(AUDIT_TYPE))
    answered = read.select(
        *[c for c in joined.columns if c not in ("elements", "out_of_family", "out_of_family_reason", "error")],
        F.when(skipped, F.array().cast(f"array<{ELEMENT_TYPE}>")).otherwise(F.col("checked.out")).alias("elements"),
        (claimed_out & ~contradicted & ~skipped).alias("out_of_family"),
        F.when(~contradicted, F.col("out_of_family_reason")).alias("out_of_family_reason"),
        F.when(~skipped, F.col("error")).alias("read_error"),
        skipped.alias("skipped"),
        F.when(skipped, F.array().cast(AUDIT_TYPE))
        .otherwise(F.concat("lost_first", F.col("checked.lost"), contradiction))
        .alias("unverifiable"),
        F.when(skipped, "none").otherwise(D.reader_tier(names, v)).alias("tier"),
    )
    return X.computed_once(
        answered,
        ["elements", "out_of_family", "out_of_family_reason", "read_error", "skipped", "unverifiable", "tier"],
    )


def _response_elements() -> str:
    return RESPONSE_SCHEMA.split("elements ", 1)[1]


def rejected_counts(read: DataFrame, key: str = "row_ref") -> DataFrame:
    """Multiplicities the reader claimed that the row does not support; the row always wins."""
    e = F.col("e")
    return (
        read.select(key, F.posexplode("elements").alias("position", "e"))
        .select(
            key, "position", e["detected_name"].alias("element"), e["claimed"].alias("claimed"),
            e["multiplicity"].alias("row_count"), e["count_evidence"].alias("evidence"),
            F.when(e["stated"] & (e["claimed"] != e["multiplicity"]), "row_says_other")
            .when(~e["stated"] & (e["claimed"] != 1), "not_in_description")
            .alias("reason"),
        )
        .filter("reason is not null")
    )


def unverifiable_values(read: DataFrame, key: str = "row_ref") -> DataFrame:
    """Audit trail of dropped elements and values."""
    return read.select(key, F.inline("unverifiable"))


def reader_diagnostics(read: DataFrame) -> DataFrame:
    """Tiers, escalations, dropped evidence, rejected counts and out-of-family rows."""
    rejected = F.size(
        F.filter("elements", lambda e: (e["stated"] & (e["claimed"] != e["multiplicity"])) | (~e["stated"] & (e["claimed"] != 1)))
    )
    return read.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("tier") == "main").alias("tier_main"),
        F.count_if(F.col("tier") == "cheap").alias("tier_cheap"),
        F.count_if(F.col("tier") == "none").alias("tier_none"),
        F.count_if(D.escalate(F.col("tier"), F.size("elements"))).alias("escalated"),
        F.coalesce(F.sum(F.size("unverifiable")), F.lit(0)).alias("unverifiable"),
        F.coalesce(F.sum(rejected), F.lit(0)).alias("rejected_counts"),
        F.count_if("out_of_family").alias("out_of_family_rows"),
    )


def find_evidence_join(rows: DataFrame, key: str, text: str, evidence: DataFrame) -> DataFrame:
    """F2 between any number of texts and pieces of evidence (evidence_id, evidence): the pairs in which the
    text literally holds the evidence, white space and case aside.

    Evidence of three words or more holds a word that must stand by itself in the text. Its longest such word
    meets the distinct words of the texts in an equi-join; what met comes back as one list for each text and
    is compared there. ``key`` is unique; shorter evidence is not found here but by ``evidence_matches``.
    """
    folded = evidence.select("evidence_id", X.evidence_fold("evidence").alias("needle"))
    inner = F.slice(F.split("needle", " "), F.lit(2), F.greatest(F.size(F.split("needle", " ")) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    asked = folded.withColumn("word", longest).where(F.col("word").isNotNull())
    texts = rows.select(F.col(key), X.evidence_fold(text).alias("folded"))
    words = texts.select(key, F.explode(F.array_distinct(F.split("folded", " "))).alias("word"))
    met = words.join(asked, "word").groupBy(key).agg(F.collect_list(F.struct("evidence_id", "needle")).alias("met"))
    held = F.filter("met", lambda m: F.contains(F.col("folded"), m["needle"]))
    return texts.join(met, key).select(key, F.explode(held).alias("m")).select(key, "m.evidence_id")
