"""Rows to lines: fixture rows, invariant bank, multiplicity shapes and conservation."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bomrec.functions import measure as M
from bomrec.functions import places as P
from bomrec.functions import spans as S
from bomrec.functions import text as X
from bomrec.operators import detect, evaluate, normalize, reader
from bomrec.operators.catalog import FinishEntry, Vocabulary
from bomrec.plans.lines import repeated_rows_to_lines, rows_to_lines

ROW = "row_ref string, source_text string, quantity double"

# Rules that must hold with the table-only reader: (id, description, material, measure, expectations).
MUST = [
    ("bolt with a nut's class", "BOLT ISO 4014 M20x80, 10", "10", "M20x80", {"split": 1, "name": "TORNILLO", "status": "REVISION_MANUAL", "reasons": ["QUALITY_TYPE_INCOHERENCE"]}),
    ("nut with a bolt's class", "NUT ISO 4032 M16, 10.9", "10.9", "M16", {"name": "TUERCA", "status": "REVISION_MANUAL", "reasons": ["QUALITY_TYPE_INCOHERENCE"]}),
    ("nut of class 10", "Tuerca hexagonal ISO 4032 M24, 10", "10", "M24", {"name": "TUERCA", "quality": "10", "quality_group": "G9", "status": "RESUELTA"}),
    ("stainless number", "Tornillo ISO 4017 M8x25, 316", "316", "M8x25", {"name": "TORNILLO", "quality": "316", "quality_group": "G3", "status": "RESUELTA"}),
    ("dipped in words", "BOLT ISO 4017 M20x70, 8.8, hot dip galvanized", "8.8", "M20x70", {"finish": "GALVANIZADO EN CALIENTE"}),
    ("plated in words", "Tornillo ISO 4762 M6x20, 8.8, zinc plated", "8.8", "M6x20", {"finish": "CINCADO", "standard": "ISO 4762"}),
    ("rod", "Varilla roscada M16 x 2000, DIN 975, 8.8", "8.8", "M16x2000", {"split": 1, "name": "VARILLA ROSCADA", "finish": None}),
    ("French screw, old standard", "Vis DIN 912 M8 x 30, 12.9", "12.9", "M8x30", {"name": "TORNILLO", "standard": "ISO 4762", "quality_group": "G7"}),
    ("German nut", "Mutter DIN 934 M16, 8", "8", "M16", {"name": "TUERCA", "standard": "ISO 4032"}),
    ("bolt without length", "BOLT ISO 4014 M24, 8.8", "8.8", "M24", {"status": "REVISION_MANUAL", "reasons": ["LENGTH_MISSING"]}),
    ("no fastener", 'Válvula de bola 2" PN16', "latón", '2"', {"split": 1, "none_resolved": True}),
    ("unknown class", "BOLT DIN 933 M16x40, 5.6", "5.6", "M16x40", {"status": "REVISION_MANUAL", "reasons": ["QUALITY_MISSING"], "no_resolved_quality": "5.6"}),
    ("three elements", "Tornillo DIN 931 M27x140 con tuerca y arandela", "A4-80", "M27x140", {"split": 3, "name": "TORNILLO", "standard": "ISO 4014"}),
]
# What the tables cannot know yet; a failed expectation here is a gap, not an error.
HOLES = [("class of a set", "Tornillo DIN 931 M27x140 con tuerca y arandela", "A4-80", "M27x140", {"quality": "A4-80"})]
EXPECT = (
    "id string, gate string, split int, name string, quality string, quality_group string, finish string, "
    "has_finish boolean, standard string, status string, reasons array<string>, none_resolved boolean, no_resolved_quality string"
)


def _expect(key, e, gate="must"):
    return (key, gate, e.get("split"), e.get("name"), e.get("quality"), e.get("quality_group"), e.get("finish"),
            "finish" in e, e.get("standard"), e.get("status"), e.get("reasons"), e.get("none_resolved", False), e.get("no_resolved_quality"))


def test_rule_bank(spark):
    bank = [(*m, "must") for m in MUST] + [(*h, "hole") for h in HOLES]
    rows = spark.createDataFrame([(k, f"{d} | {m} | {s}", 100.0) for k, d, m, s, *_ in bank], ROW)
    expectations = spark.createDataFrame([_expect(k, e, gate) for k, _, _, _, e, gate in bank], EXPECT)
    results = evaluate.trap_results(rows_to_lines(rows), expectations)
    assert [r.id for r in results.filter("gate = 'must' and not ok").collect()] == []
    assert sorted(tuple(r) for r in evaluate.trap_summary(results).collect()) == [("hole", 0, len(HOLES)), ("must", len(MUST), len(MUST))]


FIXTURE = [
    ("1", 'STUD BOLT 5/8" X 95 LG, ASTM A193, GR B8 W/4 HEX. NUT 5/8", ASTM A194, GR 8', "ASTM A193 GR B8", 10, [("ESPARRAGO", 10), ("TUERCA", 40)]),
    ("2", "Esparrago M24 x 260 DIN 975 con 3 tuercas DIN 934 y 4 arandelas DIN 125, 8.8", "8.8", 12, [("ESPARRAGO", 12), ("TUERCA", 36), ("ARANDELA", 48)]),
    ("3", "HEX BOLT M30 x 90 c/w NUT AND WASHER, 10.9", "10.9", 7, [("TORNILLO", 7), ("TUERCA", 7), ("ARANDELA", 7)]),
    ("4", "Tornillo DIN 931 M27x140 con tuerca y arandela", "A4-80", 9, [("TORNILLO", 9), ("TUERCA", 9), ("ARANDELA", 9)]),
    ("14", "Arandela plana DIN 125 M14, acero, zincada", "acero", 31, [("ARANDELA", 31)]),
]


def test_fixture_rows_split_and_multiply(spark):
    rows = spark.createDataFrame([(r, f"{d} | {m}", float(q)) for r, d, m, q, _ in FIXTURE], ROW)
    lines = rows_to_lines(rows).orderBy("row_ref", "position").collect()
    for ref, _, _, _, want in FIXTURE:
        assert [(ln["name"], ln["quantity"]) for ln in lines if ln["row_ref"] == ref] == want
    washer = next(ln for ln in lines if ln["row_ref"] == "14")
    assert (washer["material"], washer["material_prov"], washer["finish"]) == ("AC", "extracted", "CINCADO")


def test_spans_cut_the_source_text(spark):
    rows = spark.createDataFrame([("1", "Tornillo  Állen DIN 912 M10 x 40, 12.9, géomet", 1.0), ("2", "Tornillo Állen DIN 912 M10 x 40, 12.9, géomet", 1.0)], ROW)
    texts = {r.row_ref: r.source_text for r in rows.collect()}
    two = rows_to_lines(rows).filter("row_ref = '2'").first()
    cut = {a: texts["2"][two[f"{a}_start"]:two[f"{a}_end"]] for a in ("name", "quality", "measure", "standard", "finish")}
    assert cut == {"name": "Tornillo", "quality": "12.9", "measure": "M10 x 40", "standard": "DIN 912", "finish": "géomet"}
    one = rows_to_lines(rows).filter("row_ref = '1'").first()
    assert one["finish"] == "GEOMET"


def test_repeated_rows_give_the_same_lines(spark):
    rows = spark.createDataFrame([(f"{i}", f"{d} | {m}", float(q) if i % 3 else None) for i, (_, d, m, q, _) in enumerate(FIXTURE * 3)], ROW)
    columns = ["line_id", "name", "quality", "quantity", "quantity_prov", "status", F.to_json("reasons").alias("reasons")]
    direct = sorted(map(tuple, rows_to_lines(rows).select(*columns).collect()))
    shared = sorted(map(tuple, repeated_rows_to_lines(rows).select(*columns).collect()))
    assert direct == shared


def test_every_row_yields_a_line(spark):
    rows = spark.createDataFrame([("1", "", 1.0), ("2", "50 | uds", None), ("3", "Pieza suelta sin plano", 2.0), ("4", "NUT", 3.0), ("5", None, 1.0), ("6", None, None), ("7", " \t", 1.0)], ROW)
    for read in (rows_to_lines, repeated_rows_to_lines):
        lines = {r.row_ref: r.line_id for r in read(rows).collect()}
        assert lines == {**{str(i): f"{i}.N" for i in (1, 2, 3, 5, 6, 7)}, "4": "4.1"}


@pytest.fixture(scope="module")
def counts(spark):
    cases = [
        ("BOLT W/3 HEX. NUT", "NUT", 3), ("ROD, 4 WASHER", "WASHER", 4), ("perno con 6 tuercas", "TUERCAS", 6),
        ("perno y 3 arandelas", "ARANDELAS", 3), ("SCREW with WASHER", "WASHER", None), ("DIN 912 and NUT", "NUT", None),
        ('5/8" NUT', "NUT", None), ("M24 arandelas", "ARANDELAS", None), ("2 | HEX BOLT", "HEX BOLT", None),
        ("M8 x 20 WASHER", "WASHER", None), ("5 HEAVY HEX NUT", "NUT", 5), ("AND 0 WASHER", "WASHER", None), ("9/16 NUT", "NUT", None),
    ]
    df = spark.createDataFrame([(t, n, e) for t, n, e in cases], "t string, n string, want int")
    got = df.withColumn("f", X.fold("t")).withColumn("m", reader.multiplicity(F.col("f"), F.position(F.col("n"), F.col("f")) - 1))
    return [(r.t, r.want, r.m["value"] if r.m else None) for r in got.collect()]


def test_multiplicity_shapes(counts):
    assert [(t, got) for t, want, got in counts if want != got] == []


def test_longest_alias_first(spark):
    df = spark.createDataFrame([("A B C D A",)], "t string")
    hits = df.select(S.find_texts(F.col("t"), ["A B", "B C D", "A"]).alias("h")).first().h
    assert [(h.text, h.start) for h in hits] == [("A", 0), ("B C D", 2), ("A", 8)]
    assert S.layers(["BOLT", "STUD BOLT", "NUT"]) == [["STUD BOLT", "BOLT", "NUT"]]


def test_alias_join_equals_inline_scan(spark):
    texts = [(i, t) for i, t in enumerate(["STUD BOLT y hex bolt", "hot dip galv electrolitico", "bolts BOLT-bolt", "añ VIS\tvis", "", None] * 2)]
    rows = spark.createDataFrame(texts, "k int, t string")
    words = ["STUD BOLT", "BOLT", "HEX BOLT", "VIS", "HOT DIP GALV", "GALV ELECTROLITICO"]
    aliases = spark.createDataFrame([(w, w, n) for n, w in enumerate(words)], "alias string, value string, ord int")
    joined = {tuple(r) for r in detect.find_aliases_join(rows, "k", "t", aliases).select("k", "value", "start", "end").collect()}
    inline = rows.select("k", F.inline(S.find_texts(X.fold("t"), words)))
    assert joined == {tuple(r) for r in inline.select("k", "text", "start", "end").collect()}


def _plain_claims(text, needles):
    """Longest first, then by the order of the list, then leftmost; no character twice."""
    found = []
    for n, needle in enumerate(needles):
        pattern = f"(?<![A-Z0-9]){re.escape(needle)}(?![A-Z0-9])"
        at = re.search(pattern, text)
        while at:
            found.append((-len(needle), n, at.start(), needle))
            at = re.compile(pattern).search(text, at.start() + 1)
    taken, out = set(), []
    for size, _, start, needle in sorted(found):
        span = set(range(start, start - size))
        if not span & taken:
            taken |= span
            out.append((needle, start, start - size))
    return sorted(out, key=lambda h: h[1])


def test_alias_join_with_any_number_of_aliases(spark):
    rng = random.Random(4)
    letters = ["a", "B", "é", "9", " ", " ", "-", ".", "(", ")", "ñ", "Ω", "c", "  "]
    make = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    aliases = list(dict.fromkeys([make(8) for _ in range(6000)] + ["(A)", "A.", ".A", "Ω", "-", "ΩΩ", "A B", "B C", "A B C"]))
    texts = [make(60) for _ in range(300)] + ["", "(A)", "A.", "x Ω y", "-- A-B", None]
    folded = lambda values: [X_fold(v) for v in values]
    needles = [n for n in dict.fromkeys(folded(aliases)) if n]
    vocabulary = spark.createDataFrame([(a, a, n) for n, a in enumerate(aliases)], "alias string, value string, ord int")
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in detect.find_aliases_join(rows, "k", "t", vocabulary).collect():
        got.setdefault(r["k"], []).append((X_fold(r["alias"]), r["start"], r["end"]))
    for k, text in enumerate(texts):
        assert sorted(got.get(k, []), key=lambda h: h[1]) == _plain_claims(X_fold(text or ""), needles), text


def X_fold(value):
    from bomrec.operators.catalog import fold_text

    return fold_text(value)


def test_attributes_are_claimed_apart(spark):
    v = Vocabulary.closed()
    table = [("name", a.text, a.value) for a in v.names] + [("material", a.text, a.value) for a in v.materials]
    frame = spark.createDataFrame([(*r, n) for n, r in enumerate(table)], "attribute string, alias string, value string, ord int")
    texts = ["Stud bolt A193 inox with 2 hex nuts", "VIS acero carbono, carbon steel BOLT; arandela", "hexagonal", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = sorted(tuple(r) for r in detect.find_attributes_join(rows, "k", "t", frame).select("k", "attribute", "value", "start", "end").collect())
    folded = rows.select("k", X.fold("t").alias("f"))
    wanted = []
    for attribute, hits, value in (("name", detect.name_hits, detect.name_value), ("material", detect.material_hits, detect.material_value)):
        inline = folded.select("k", F.inline(hits(F.col("f"), v))).select("k", F.lit(attribute), value(F.col("text"), v), "start", "end")
        wanted += [tuple(r) for r in inline.collect()]
    assert got == sorted(wanted) and {w[1] for w in wanted} == {"name", "material"}


def test_measures(spark):
    cases = [("M16x60", "M16", "60", False), ('7/8" X 130 LG', '7/8"', "130", False), ('1-1/2"', '1-1/2"', None, False), ("4.8x25", "4.8", "25", True), ("M0", None, None, None), ("abc", None, None, None), ("7/0", None, None, None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string").select("t", M.parse_measure(F.col("t")).alias("m"))
    got = [(r.t, *((r.m.canonical, r.m.length_raw, r.m.bare) if r.m else (None, None, None))) for r in df.collect()]
    assert got == cases


def test_ambiguous_and_negative_finishes(spark):
    v = Vocabulary.closed()
    v = Vocabulary(v.names, v.materials, (*v.finishes, FinishEntry("x", "RAL", None, "not_a_finish"), FinishEntry("y", "ZN", "PAVONADO")))
    df = spark.createDataFrame([("ral",), ("zn",), ("Zinc plated",), ("mate",)], "t string")
    got = {r.t: r.k for r in df.select("t", normalize.resolve_finish(F.col("t"), v)["kind"].alias("k")).collect()}
    assert got == {"ral": "not_a_finish", "zn": "ambiguous", "Zinc plated": "known", "mate": "unknown"}


def test_offsets_where_folding_moves_them(spark):
    cases = [
        ("Straße  M8   tuerca  é x", "TUERCA", (13, 19)), ("Straße  M8   tuerca", "STRASSE M8", (0, 10)), ("Straße  M8   tuerca", "m8tuerca", (8, 19)),
        ("  ﬁx   bolt ", "FIX BOLT", (2, 11)), ("áb  c", "AB C", (0, 6)), ("x  y", "x  y", (0, 4)), ("x  y", "q", None), ("x  y", " ", ()),
        ("ß  NUT ß  NUT", "nut ss", (3, 8)), ("M8 tuerca", "m8tuerca", (0, 9)), ("M8   tuerca", "M8 TUERCA", (0, 11)),
    ]
    df = spark.createDataFrame([(i, t, e) for i, (t, e, _) in enumerate(cases)], "i int, t string, e string").withColumn("f", X.fold("t"))
    df = df.withColumn("places", reader.offset_map(F.col("t"), F.col("f")))
    got = df.withColumn("w", reader.locate(F.col("t"), F.col("f"), F.col("e"), F.lit(0), places=F.col("places"))).orderBy("i").collect()
    for (text, evidence, want), r in zip(cases, got, strict=True):
        span = None if not r.w.found else () if r.w.start is None else (r.w.start, r.w.end)
        assert span == want, (text, evidence, r.w)


def test_repeated_evidence_moves_on_behind_the_cursor(spark):
    df = spark.createDataFrame([("ß   nut   and ß   nut",)], "t string").withColumn("f", X.fold("t"))
    df = df.withColumn("places", reader.offset_map(F.col("t"), F.col("f")))
    at = [df.select(reader.locate(F.col("t"), F.col("f"), F.lit("SS NUT"), F.lit(c), places=F.col("places"))["start"]).first()[0] for c in (0, 1, 15)]
    assert at == [0, 14, 0]


def test_required_texts():
    cases = {
        r"^(GR\.?\s*)?(B7M?|2HM?)$|^45H$": "", r"^(GR\.?\s*)?Q12(M|H)?$": "Q12", "abc": "ABC", "a+bcd": "BCD", "(?i)xy": "XY", "x(yz)w": "XYZW", "a?b": "B",
        r"\bHV\d{2}": "HV", r"\p{L}x": "", "(": "", "": "", "[ab]c": "C", "(ab|cd)ef": "EF", "x(?:long)?y": "X", "abcdefghijkl": "ABCDEFGH", "(ab){2,}": "AB", "é12": "12",
    }
    assert {p: normalize.required_text(p) for p in cases} == cases


def test_derivation_by_join_equals_the_inline_one(spark):
    v = Vocabulary.closed()
    patterns = ["^A[24]-\\d+$", "HV$", "b7", "^(GR\\.?\\s*)?(B7M?|2HM?|B16)$|^45H$", ".", "^$", "x|y", "8\\.8", "ÉT", "(?:1|2)0"]
    v = Vocabulary(derivations=(*v.derivations, *[(f"p{i}", "pattern", p, ["INOX", "AC"][i % 2], f"2026-0{i % 3 + 1}-01") for i, p in enumerate(patterns) if p != "."]), uncovered=(*v.uncovered, ("pattern", "^NO")))
    values = ["A2-70", "a4-80", "GR B7", "gr. b16", "8.8", "10.9", "200HV", "45H", "none", "étx", " x ", "", "20", None, "B7M é", "NOPE", "zzz"]
    rows = spark.createDataFrame([(x, g) for x in values for g in (None, "G1", "G10", "G6")], "raw string, `group` string")
    entries = spark.createDataFrame([(i, k, value, m, str(at)) for i, k, value, m, at in v.derivations], "id string, kind string, value string, material string, decided_at string")
    gaps = spark.createDataFrame(list(v.uncovered), "kind string, value string")
    got = sorted(map(str, normalize.derive_material_join(rows.union(rows), entries, gaps).collect()))
    inline = rows.withColumn("d", normalize.derive_material(F.col("raw"), F.col("group"), v)).select("raw", "group", "d.outcome", "d.material", "d.rule")
    assert got == sorted(map(str, inline.collect())) and len({r.split("outcome=")[1].split(",")[0] for r in got}) == 5


def test_pieces_that_no_pattern_requires_are_left_out_before_the_shuffle(spark):
    """of all pieces of a text only those go to the join that may be some pattern's required text."""
    known = spark.range(2000).select(F.concat(F.lit("Q"), "id").alias("factor"))
    asked = spark.range(40_000).select(F.concat(F.lit("Q"), "id").alias("factor"))
    left = {r.factor for r in normalize._possible(asked, known, 2000, "factor").collect()}
    assert left >= {f"Q{i}" for i in range(2000)} and len(left) < 4000
    assert normalize._possible(asked, known.limit(0), 0, "factor").count() == 0


def test_hits_are_found_once_and_not_in_filters(spark):
    """no filter below the reader's tasks repeats the scans of a row."""
    rows = spark.createDataFrame([("1", "Hex Bolt DIN 933, M16x60, 8.8"), ("2", "plain"), ("3", None)], "row_ref string, source_text string")
    hits = detect.with_hits(rows.repartition(2)).select("row_ref", F.inline("qualities")).select("row_ref", "text")
    assert [tuple(r) for r in hits.collect()] == [("1", "8.8")]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "regexp_replace" in line for line in plan.splitlines())


def test_aliases_of_one_head_meet_by_their_later_tokens(spark):
    """aliases that share two tokens do not all meet a text that holds these."""
    aliases = [("a b", 0)] + [(f"a b w{i}", i + 1) for i in range(50)] + [("a b w1 x y z p q r s", 99), ("b, w1", 100)]
    table = spark.createDataFrame(aliases, "alias string, ord long")
    index = detect.alias_index(table.select(X.fold("alias").alias("needle"), "ord"))
    assert index.groupBy("head").count().agg(F.max("count")).first()[0] == 1
    rows = spark.createDataFrame([(1, "a b w1 x y z p q r s"), (2, "a b w2; b, w1"), (3, "a b"), (4, None)], "k long, t string")
    found = detect.find_aliases_join(rows, "k", "t", table.withColumn("value", F.col("alias")))
    assert sorted((r.k, r.alias, r.start, r.end) for r in found.collect()) == [
        (1, "a b w1 x y z p q r s", 0, 20), (2, "a b w2", 0, 6), (2, "b, w1", 8, 13), (3, "a b", 0, 3)
    ]


def _aliases(spark, words):
    return spark.createDataFrame([(w, w, n) for n, w in enumerate(words)], "alias string, value string, ord int")


def test_only_places_where_an_alias_may_stand_are_sent(spark):
    """a text goes to no join, and of its places only those that the filter over the aliases lets pass."""
    rng = random.Random(5)
    words = [f"W{i}" for i in range(3000)]
    aliases = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(200)]
    texts = [" ".join([*rng.choices(words, k=2000), alias]) for alias in aliases[:20]]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = detect.find_aliases_join(rows, "k", "t", _aliases(spark, aliases))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    index = detect.alias_index(spark.createDataFrame([(a, n) for n, a in enumerate(aliases)], "needle string, ord int"))
    sent = sum(len(text) for text, _ in P.places(pa.array(texts), detect._wanted(index)))
    assert 20 <= found.count() <= sent < 2000 * 20 // 20


def test_long_aliases_in_texts_of_many_pieces(spark, monkeypatch):
    """aliases of more tokens than a span, over texts longer than a step, whose rows and hits come in pieces."""
    monkeypatch.setattr(P, "STEP", 64)
    monkeypatch.setattr(P, "MOST", 500)
    rng = random.Random(6)
    marks = [" ", " ", " ", "-", ", ", " (", ") ", "é", "Ω "]
    make = lambda n: "".join(rng.choice("AB") + rng.choice(marks) for _ in range(rng.randint(1, n)))
    texts = [make(n) for n in [5, 40, 300] * 15] + ["", None, "A", "B"]
    aliases = ["Ω", "Ω Ω", "(", "A", "-"] + [t[i : i + n] for t in texts if t for n in (3, 9, 19, 23, 50) for i in [rng.randrange(len(t))]]
    rows = spark.createDataFrame([*enumerate(texts), (None, "A B")], "k int, t string")
    got = {}
    for r in detect.find_aliases_join(rows, "k", "t", _aliases(spark, aliases)).collect():
        got.setdefault(r["k"], []).append((X_fold(r["alias"]), r["start"], r["end"]))
    needles = [n for n in dict.fromkeys(map(X_fold, aliases)) if n]
    assert max(len(re.findall("[A-Z0-9]+", n)) for n in needles) > P.SPAN and None not in got
    for k, text in enumerate(texts):
        assert sorted(got.get(k, []), key=lambda h: h[1]) == _plain_claims(X_fold(text or ""), needles), text


def test_many_overlapping_aliases_of_one_text(spark):
    """60,000 aliases of one text that all overlap the next are claimed without comparing each with each."""
    rows = spark.createDataFrame([(1, "A B " * 30_000), (2, "B A")], "k int, t string")
    found = detect.find_aliases_join(rows, "k", "t", _aliases(spark, ["A B", "B A"]))
    got = found.groupBy("k", "alias").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("low"), F.max("end").alias("high"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "A B", 30_000, 0, 119_999), (2, "B A", 1, 0, 3)]


def test_white_space_is_the_same_characters_however_it_is_spelled(spark):
    """the pattern of the folding matches these characters and no others."""
    chars = spark.range(0x10000).where("id NOT BETWEEN 55296 AND 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    got = {r.id for r in chars.where(F.regexp_replace("c", X.WHITESPACE, "") == "").collect()}
    assert got == {*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF}
