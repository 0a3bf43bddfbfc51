"""Readers of labelled, vocabulary and recorded-answer files, always with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bomrec.functions import closed_tables as T
from bomrec.operators.reader import READ_ATTRIBUTES
from bomrec.sources import split

_CELL = "struct<value:string,provenance:string,certainty:string>"
GOLD_SCHEMA = (
    "id string, rowRef string, role string, status string, reasons array<string>, note string, "
    f"attributes struct<{','.join(f'{a}:{_CELL}' for a in T.ATTRIBUTES)}>, "
    "quantity struct<value:double,provenance:string,certainty:string>"
)
ENTRY_SCHEMA = (
    "id string, alias string, kind string, finish string, `group` string, material string, "
    "`when` struct<qualityGroup:string,qualityPattern:string>, matchKind string, matchValue string, "
    "source string, rationale string, decidedBy string, decidedAt string, evidence string"
)


def gold_lines(spark: SparkSession, path: str) -> DataFrame:
    """Gold JSON lines in the flat shape the evaluation operators use."""
    return gold_rows(spark.read.text(path))


def gold_rows(lines: DataFrame) -> DataFrame:
    """S11 over a column ``value`` of JSON lines; blank lines are left out."""
    raw = lines.where(F.trim("value") != "").select(F.from_json("value", GOLD_SCHEMA).alias("e")).select("e.*")
    cells = []
    for a in T.ATTRIBUTES:
        c = F.col(f"attributes.{a}")
        cells += [c["value"].alias(a), c["provenance"].alias(f"{a}_prov"), c["certainty"].alias(f"{a}_cert")]
    q = F.col("quantity")
    return raw.select(
        F.col("rowRef").alias("row_ref"), F.col("id").alias("gold_id"),
        F.substring_index("id", ".", -1).try_cast("int").alias("position"),
        "role", "status", "reasons", *cells,
        q["value"].alias("quantity"), q["provenance"].alias("quantity_prov"), q["certainty"].alias("quantity_cert"),
        "note",
    )


def vocabulary_seed(spark: SparkSession, path: str, attribute: str, block_bytes: int | None = None) -> DataFrame:
    """The entries of seed documents, in the shared entry shape; a large document is many tasks."""
    found = split.json_elements(split.pieces(spark, path, "}", block_bytes), "entries")
    return _entries(found.select(F.from_json("text", f"struct<{_colons(ENTRY_SCHEMA)}>").alias("e")).select("e.*"), attribute)


def vocabulary_log(spark: SparkSession, path: str, attribute: str, block_bytes: int | None = None) -> DataFrame:
    """add/retire/uncover events with a sequence that follows the file order.

    Logs are append-only files, ordered by their names; lines of one file by their position in it. A
    block of a file is read in order by one task, so blocks are numbered and lines counted within them.
    """
    return log_events(split.pieces(spark, path, "\n", block_bytes), attribute)


def log_events(lines: DataFrame, attribute: str) -> DataFrame:
    """S13 over lines (file, block, nth, value). Files are numbered by one window over one row for each, blocks
    by a window for each file."""
    schema = f"action string, at string, `by` string, detail string, entryId string, matchKind string, matchValue string, entry struct<{_colons(ENTRY_SCHEMA)}>"
    raw = lines.where(F.trim("value") != "").select("file", "block", "nth", F.from_json("value", schema).alias("e"))
    counted = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = counted.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("in_file"))
    files = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    in_all = counted.groupBy("file").agg(F.sum("n").alias("n")).select("file", F.coalesce(F.sum("n").over(files), F.lit(0)).alias("in_all"))
    in_block = F.row_number().over(Window.partitionBy("file", "block").orderBy("nth"))
    numbered = raw.withColumn("in_block", in_block).join(in_file, ["file", "block"]).join(in_all, "file")
    return numbered.select(
        (F.col("in_all") + F.col("in_file") + F.col("in_block")).alias("seq"), F.col("e.action").alias("action"), F.col("e.at").alias("at"),
        F.coalesce("e.entry.id", "e.entryId", F.concat(F.lit("uncovered:"), "e.matchValue")).alias("id"),
        F.coalesce("e.entry.alias", "e.entry.matchValue", "e.matchValue").alias("alias"),
        F.coalesce("e.entry.kind", "e.entry.matchKind", "e.matchKind").alias("kind"),
        F.coalesce("e.entry.finish", "e.entry.group", "e.entry.material").alias("value"),
        F.coalesce("e.entry.source", F.lit("added")).alias("source"),
        F.lit(attribute).alias("attribute"),
    )


def _entries(raw: DataFrame, attribute: str) -> DataFrame:
    return raw.select(
        F.lit(attribute).alias("attribute"), "id",
        F.coalesce("alias", "when.qualityGroup", "when.qualityPattern", "matchValue").alias("alias"),
        F.coalesce(
            "kind", F.when(F.col("when.qualityGroup").isNotNull(), "group").when(F.col("when.qualityPattern").isNotNull(), "pattern"), "matchKind"
        ).alias("kind"),
        F.coalesce("finish", "group", "material").alias("value"),
        "source", F.col("decidedAt").alias("decided_at"),
    )


def _colons(ddl: str) -> str:
    return ",".join(":".join(part.strip().split(" ", 1)) if "struct<" not in part.split(" ", 1)[0] else part for part in _top_level(ddl))


def _top_level(ddl: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for char in ddl:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += char
    return [*parts, current]


def reader_answers(spark: SparkSession, path: str, block_bytes: int | None = None) -> DataFrame:
    """Frozen reader answers, documents mapping row to analysis, in the replay shape; a large document is
    many tasks."""
    value = "struct<value:string,evidence:string>"
    attributes = ",".join(f"{a}:{value}" for a in READ_ATTRIBUTES)
    element = (
        f"struct<detectedName:string,normalizedName:string,role:string,evidence:string,multiplicity:int,attributes:struct<{attributes}>>"
    )
    answer = f"struct<outOfFamily:boolean,outOfFamilyReason:string,elements:array<{element}>>"
    found = split.json_elements(split.pieces(spark, path, "}", block_bytes), "respuestas")
    member = F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string,{answer}>")
    return found.select(F.explode(member).alias("row_ref", "a")).select(
        "row_ref", F.col("a.outOfFamily").alias("out_of_family"),
        F.col("a.outOfFamilyReason").alias("out_of_family_reason"), F.lit(None).cast("string").alias("error"),
        F.transform(
            "a.elements",
            lambda e: F.struct(
                e["evidence"].alias("evidence"), e["detectedName"].alias("detected_name"),
                e["normalizedName"].alias("normalized_name"), e["role"].alias("role"),
                e["multiplicity"].alias("multiplicity"),
                *[e["attributes"][a].alias(a) for a in READ_ATTRIBUTES],
            ),
        ).alias("elements"),
    )


def fixture_csv(spark: SparkSession, path: str, schema: str, block_bytes: int | None = None) -> DataFrame:
    """Quoted CSV with a header, doubled quotes and embedded line breaks; a large file is many tasks."""
    return split.csv_rows(split.pieces(spark, path, "\n", block_bytes), schema).drop("file", "block", "nth")
