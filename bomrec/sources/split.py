"""Multi-line records of large files, read by many tasks.

A file is read as pieces between separator characters, block by block. Where a block begins inside a quoted
field or deep in a document cannot be seen from the block, but what each block does to that state can be summed
up: its quotes flip it or not, its brackets raise the depth by one amount or the other. A prefix scan over one
summary per block gives every block the state that it begins with, and with it the records that begin in it.
Records that cross blocks are put together from their fragments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE, BLOCK = ("file",), ("file", "block")


def pieces(spark: SparkSession, path: str, separator: str, block_bytes: int | None = None) -> DataFrame:
    """(file, block, nth, value): the pieces between single-character separators in file order.

    ``block`` is the byte that the block begins at; ``block_bytes`` bounds it (else the session's setting).
    """
    if block_bytes is not None:
        # The split size of a scan is a setting of the session that declares it.
        spark = spark.newSession()
        spark.conf.set("spark.sql.files.maxPartitionBytes", block_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", block_bytes)
    read = spark.read.option("lineSep", separator).text(path)
    return read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"), "value",
    )


def _before(amount: Column) -> Column:
    """Sum over the pieces of the block before this one."""
    order = Window.partitionBy(*BLOCK).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(order), F.lit(0))


def _blocks_before(amount: Column) -> Column:
    order = Window.partitionBy(*FILE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(order), F.lit(0))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _odd(n: Column) -> Column:
    return n % 2 == 1


def records(marked: DataFrame, separator: str) -> DataFrame:
    """(file, block, nth, text) from pieces with a flag ``ends`` on the last piece of each record.

    ``block`` and ``nth`` say where a record begins and order the records of a file. Records inside a block
    are made there; the fragments at block edges, two for a block, meet by the block that the record began in.
    """
    groups = (
        marked.withColumn("g", _before(F.col("ends").cast("int")))
        .withColumn("n_ends", F.sum(F.col("ends").cast("int")).over(Window.partitionBy(*BLOCK)))
        .groupBy(*BLOCK, "g", "n_ends")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "value"))).alias("parts"))
        .withColumn("text", F.array_join("parts.value", separator, ""))
        .drop("parts")
    )
    at_edge = (F.col("g") == 0) | (F.col("g") == F.col("n_ends"))
    whole = groups.where(~at_edge).select(*BLOCK, F.col("g").alias("nth"), "text")
    edges = groups.where(at_edge)
    earlier = Window.partitionBy(*FILE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    began = F.coalesce(F.last(F.when(F.col("n_ends") > 0, F.col("block")), ignorenulls=True).over(earlier), F.lit(-1))
    opened = edges.select(*BLOCK, "n_ends").distinct().withColumn("began", began).drop("n_ends")
    start = F.when((F.col("g") > 0), F.col("block")).otherwise(F.col("began"))
    stitched = (
        edges.join(opened, [*BLOCK])
        .withColumn("start", start)
        .groupBy("file", "start")
        .agg(F.sort_array(F.collect_list(F.struct("block", "g", "text"))).alias("parts"))
        .select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["g"].alias("nth"), F.array_join("parts.text", separator, "").alias("text"))
    )
    return whole.unionByName(stitched)


def quoted_records(lines: DataFrame) -> DataFrame:
    """Records of quoted text (RFC 4180): a line break inside quotes belongs to the field.

    Quotes of a line are counted, those of all lines before it in its block added by a window, those of all
    blocks before by the scan over the blocks.
    """
    counted = lines.withColumn("quotes", _count(F.col("value"), '"')).withColumn("inner", _before(F.col("quotes")))
    states = counted.groupBy(*BLOCK).agg(F.sum("quotes").alias("n")).withColumn("outer", _blocks_before(F.col("n"))).drop("n")
    through = F.col("outer") + F.col("inner") + F.col("quotes")
    marked = counted.join(states, [*BLOCK]).withColumn("ends", ~_odd(through))
    return records(marked.select(*BLOCK, "nth", "value", "ends"), "\n")


def csv_rows(lines: DataFrame, schema: str, header: bool = True) -> DataFrame:
    """Rows of quoted CSV; blank records are left out, as is the header of each file."""
    text = F.regexp_replace("text", "\r$", "")
    found = quoted_records(lines)
    if header:
        found = found.where("block > 0 OR nth > 0")
    found = found.withColumn("text", text).where(F.col("text") != "")
    options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "multiLine": "true"}
    return found.select("file", "block", "nth", F.from_csv("text", schema, options).alias("row")).select("file", "block", "nth", "row.*")


def _bracket_walk(brackets: Column, closes: Column) -> Column:
    """Struct of how a run of brackets changes the depth and how low it goes on the way; ``closes`` adds the
    separator's own brace."""
    step = lambda a, c: F.struct(
        (a["delta"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("delta"),
        F.least(a["low"], a["delta"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("low"),
    )
    characters = F.filter(F.split(brackets, ""), lambda c: c != "")
    walked = F.aggregate(characters, F.struct(F.lit(0).alias("delta"), F.lit(0).alias("low")), step)
    last = closes.cast("int")
    return F.transform(F.array(walked), lambda w: F.struct((w["delta"] - last).alias("delta"), F.least(w["low"], w["delta"] - last).alias("low")))[0]


def json_elements(parts: DataFrame, key: str) -> DataFrame:
    """(file, block, nth, text) of the members of the array or object that ``key`` names at the top of each
    document; ``parts`` are pieces between closing braces, so line breaks mean nothing.

    An element of an object comes as ``"name": {...}``, one of an array as ``{...}``. Elements are objects.
    The state is whether a string is open, the depth, and whether the list at hand is the named one; pieces are
    read for both answers to the first question, and the scan over the blocks picks.
    """
    # Escapes cannot be cut by a brace, so quotes that are left open or close strings.
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    outside = F.regexp_replace("bare", '"[^"]*("|$)', "")
    after = F.regexp_replace(F.regexp_replace("bare", '^[^"]*("|$)', ""), '"[^"]*("|$)', "")
    only = lambda c: F.regexp_replace(c, r"[^\[\]{]", "")
    read = (
        parts.withColumn("bare", bare)
        .withColumns({"quotes": _count(F.col("bare"), '"'), "outside": only(outside), "after": only(after)})
        .withColumns({
            "as_outside": _bracket_walk(F.col("outside"), ~_odd(F.col("quotes"))),
            "as_inside": _bracket_walk(F.col("after"), _odd(F.col("quotes"))),
        })
        .drop("bare", "outside", "after")
        .withColumn("inner", _before(F.col("quotes")))
    )
    sums = [F.sum(F.when(_odd(F.col("inner")) == odd, F.col("as_inside.delta")).otherwise(F.col("as_outside.delta"))).alias(name)
            for name, odd in (("rise_outside", True), ("rise_inside", False))]
    states = read.groupBy(*BLOCK).agg(F.sum("quotes").alias("n"), *sums).withColumn("outer", _blocks_before(F.col("n")))
    rise = F.when(_odd(F.col("outer")), F.col("rise_inside")).otherwise(F.col("rise_outside"))
    states = states.withColumn("rise", rise).withColumn("depth", _blocks_before(F.col("rise"))).select(*BLOCK, "outer", F.col("depth").alias("begin"))
    inside = _odd(F.col("outer") + F.col("inner"))
    walk = F.when(inside, F.col("as_inside")).otherwise(F.col("as_outside"))
    placed = (
        read.join(states, [*BLOCK])
        .withColumn("walk", walk)
        .withColumn("from_", F.col("begin") + _before(F.col("walk.delta")))
        .withColumn("to_", F.col("from_") + F.col("walk.delta"))
        .withColumn("closed", ~_odd(F.col("outer") + F.col("inner") + F.col("quotes")))
    )
    opens = rf'"{key}"\s*:\s*[\[{{]'
    flag = F.when(F.col("value").rlike(opens) & (F.col("from_") + F.col("walk.low") <= 1), True).when(F.col("from_") + F.col("walk.low") <= 1, False)
    upto = Window.partitionBy(*BLOCK).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    flagged = placed.withColumn("own", F.last(flag, ignorenulls=True).over(upto))
    ordered = Window.partitionBy(*FILE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lasts = flagged.groupBy(*BLOCK).agg(F.max_by("own", "nth").alias("left"))
    lasts = lasts.select(*BLOCK, F.coalesce(F.last("left", ignorenulls=True).over(ordered), F.lit(False)).alias("carried"))
    listed = F.coalesce("own", "carried")
    at_element = F.col("closed") & (F.col("to_") == 2)
    # The piece that names the list holds its first element; what stands before is cut off.
    value = F.when(F.col("value").rlike(opens), F.regexp_replace("value", rf'(?s)^.*?"{key}"\s*:\s*[\[{{]', "")).otherwise(F.col("value"))
    named = F.col("value").rlike(opens) & (F.col("from_") + F.col("walk.low") <= 1)
    marked = flagged.join(lasts, [*BLOCK]).select(
        *BLOCK, "nth", F.when(named, value).otherwise(F.col("value")).alias("value"), at_element.alias("ends"), listed.alias("listed")
    )
    # Pieces outside the list end what was open, so that they stay out of its elements.
    marked = marked.withColumn("ends", F.col("ends") | ~F.col("listed")).withColumn("value", F.when(F.col("listed"), F.col("value")).otherwise(F.lit("")))
    text = F.regexp_replace("text", r"^[\s,]+", "")
    found = records(marked.select(*BLOCK, "nth", "value", "ends"), "}").withColumn("text", text)
    return found.where(F.col("text").rlike(r"^(\{|\")")).withColumn("text", F.concat("text", F.lit("}")))
