"""Spreadsheet cells in long form (file, sheet, sheet_idx, row, col, value) to source rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomrec.functions import closed_tables as T
from bomrec.functions import text as X


def _filled() -> Column:
    return F.trim(F.coalesce("value", F.lit(""))) != ""


def header_rows(cells: DataFrame, search_rows: int | None = None) -> DataFrame:
    """Per sheet, the first row with enough non-blank cells.

    Looks at the whole sheet; with ``search_rows`` only at so many leading rows, a filter that reaches
    the scan. Counts are combined before they are shuffled.
    """
    looked = cells if search_rows is None else cells.filter(F.col("row") <= search_rows)
    counted = looked.filter(_filled()).groupBy("file", "sheet", "sheet_idx", "row").count()
    return counted.filter(F.col("count") >= T.MIN_HEADER_CELLS).groupBy("file", "sheet", "sheet_idx").agg(
        F.min("row").alias("header_row")
    )


def selected_sheets(headers: DataFrame) -> DataFrame:
    """The first sheet with a header in each file."""
    return headers.groupBy("file").agg(
        F.min_by(F.struct("sheet", "header_row"), "sheet_idx").alias("s")
    ).select("file", "s.sheet", "s.header_row")


def ignored_sheets(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Sheets not processed, with the reason."""
    chosen = selected_sheets(headers).select("file", "sheet")
    return (
        cells.select("file", "sheet").distinct()
        .join(chosen, ["file", "sheet"], "left_anti")
        .join(headers.select("file", "sheet", "header_row"), ["file", "sheet"], "left")
        .select("file", "sheet", F.when(F.col("header_row").isNull(), "no_header").otherwise("later_sheet").alias("reason"))
    )


def header_key(header: Column) -> Column:
    return F.regexp_replace(F.upper(X.strip_accents(header)), "[^A-Z0-9]", "")


def columns(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """One record per header column of every file: width, key, and its quantity/unit/item roles.

    S5/S7/S10: the first token in priority order decides, then the leftmost column. No header is below the
    lowest one, so cells of later rows are left out before the join; what is left is all of it.
    """
    lowest = sheets.where("file IS NOT NULL").agg(F.max("header_row").alias("lowest"))
    upper = cells.join(lowest, F.col("row") <= F.col("lowest")).drop("lowest")
    head = upper.join(sheets.withColumnRenamed("header_row", "row"), ["file", "sheet", "row"])
    head = head.select("file", "col", F.trim(F.coalesce("value", F.lit(""))).alias("header"))
    head = head.withColumn("key", header_key(F.col("header")))

    def rank(tokens) -> Column:
        case = F.lit(None).cast("int")
        for n, token in reversed(list(enumerate(tokens))):
            case = F.when(F.startswith("key", F.lit(token)), n).otherwise(case)
        return case

    per_file = Window.partitionBy("file")
    quantity = F.struct(rank(T.QUANTITY_HEADERS), "col")
    ranked = head.withColumn(
        "qty_col", F.min(F.when(rank(T.QUANTITY_HEADERS).isNotNull(), quantity)).over(per_file)["col"]
    )
    not_quantity = F.col("qty_col").isNull() | (F.col("col") != F.col("qty_col"))
    unit = F.struct(rank(T.UNIT_HEADERS), "col")
    return (
        ranked.withColumn(
            "unit_col", F.min(F.when(not_quantity & rank(T.UNIT_HEADERS).isNotNull(), unit)).over(per_file)["col"]
        )
        .withColumn("item_col", F.min(F.when(F.col("header").rlike(T.ITEM_HEADER), F.col("col"))).over(per_file))
        .withColumn("width", F.max("col").over(per_file))
    )


def parse_quantity(raw: Column) -> Column:
    """Decimal comma means dots are thousands; a non-empty cell without digits reads as zero."""
    plain = F.when(
        F.contains(raw, F.lit(",")), F.regexp_replace(F.regexp_replace(raw, "\\.", ""), "^([^,]*),", "$1.")
    ).otherwise(raw)
    digits = F.regexp_replace(plain, "[^0-9.\\-]", "")
    number = F.when(digits == "", F.lit(0.0)).when(
        digits.rlike("^-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)$"), digits.try_cast("double")
    )
    return F.when(F.trim(plain) != "", number)


def layouts(cells: DataFrame) -> DataFrame:
    """One record per file: its sheet, header row, width, header of each column and the columns with a role."""
    sheets = selected_sheets(header_rows(cells))
    heads = columns(cells, sheets).groupBy("file").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "header"))).alias("headers"),
        *[F.max(c).alias(c) for c in ("width", "qty_col", "unit_col", "item_col")],
    )
    return sheets.join(heads, "file")


def source_rows(cells: DataFrame) -> DataFrame:
    """Rows with their text, cell offsets, quantity, unit and item reference.

    Cells meet their file's one layout record in an equi-join, then each (file, row) is assembled from
    its own cells; no file is gathered in one place. Cells under a column without a header are labelled
    by their position; cells beyond the header row's width are not part of the table.
    """
    body = cells.join(layouts(cells), ["file", "sheet"])
    joined = body.filter((F.col("row") > F.col("header_row")) & (F.col("col") <= F.col("width"))).withColumn(
        "header", F.element_at("headers", F.col("col"))
    )
    at = lambda c: F.max(F.when(F.col("col") == F.col(c), F.col("value")))
    rows = joined.groupBy("file", "sheet", "row").agg(
        F.array_sort(F.collect_list(F.when(_filled(), F.struct("col", "header", "value")))).alias("cells"),
        F.count_if(_filled()).alias("n_filled"), at("qty_col").alias("qty_text"), at("unit_col").alias("unit"), at("item_col").alias("item_text"),
        F.max(F.when(F.col("col") == F.col("qty_col"), F.coalesce(F.nullif("header", F.lit("")), F.concat(F.lit("col"), "col")))).alias("quantity_column"),
    )
    rows = rows.filter(F.col("n_filled") > 0)  # not the size of the list, which is then made only where it is used
    gap = len(T.CELL_SEPARATOR)
    step = lambda acc, c: F.struct(
        (acc["pos"] + F.length(c["value"]) + gap).alias("pos"),
        F.map_concat(
            F.map_filter(acc["out"], lambda k, v: k != _label(c)),
            F.create_map(
                _label(c),
                F.struct(acc["pos"].alias("start"), (acc["pos"] + F.length(c["value"])).alias("end")),
            ),
        ).alias("out"),
    )
    empty = F.create_map().cast("map<string,struct<start:int,end:int>>")
    offsets = F.aggregate("cells", F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda a: a["out"])
    return rows.select(
        "file", "sheet", F.col("row").alias("row_number"),
        F.coalesce("item_text", F.col("row").cast("string")).alias("row_ref"),
        F.array_join(F.transform("cells", lambda c: c["value"]), T.CELL_SEPARATOR).alias("source_text"),
        offsets.alias("cell_offsets"),
        parse_quantity(F.col("qty_text")).alias("quantity"),
        "quantity_column", "unit",
    )


def _label(cell: Column) -> Column:
    return F.coalesce(F.nullif(cell["header"], F.lit("")), F.concat(F.lit("col"), cell["col"].cast("string")))


def skipped_rows(cells: DataFrame) -> DataFrame:
    """Data rows of the selected sheet whose header-width cells are all blank."""
    body = cells.join(layouts(cells), ["file", "sheet"]).filter(F.col("row") > F.col("header_row"))
    return (
        body.groupBy("file", "sheet", "row")
        .agg(F.count_if((F.col("col") <= F.col("width")) & _filled()).alias("n"))
        .filter("n = 0")
        .select("file", "sheet", F.col("row").alias("row_number"), F.lit("EMPTY_ROW").alias("reason"))
    )


def quantity_candidates(cells: DataFrame, sample_rows: int | None = None) -> DataFrame:
    """For files without a quantity column, columns that mostly parse as numbers.

    Looks at all data rows, or at ``sample_rows`` after the header; a warning, it never decides a value.
    """
    sheets = selected_sheets(header_rows(cells))
    cols = columns(cells, sheets).filter("qty_col is null").select("file", "col", "header")
    sample = cells.join(sheets, ["file", "sheet"]).filter((F.col("row") > F.col("header_row")) & _filled())
    if sample_rows is not None:
        sample = sample.filter(F.col("row") <= F.col("header_row") + sample_rows)
    numeric = F.trim(F.regexp_replace("value", "^([^,]*),", "$1.")).rlike("^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?$")
    return (
        sample.join(cols, ["file", "col"])
        .groupBy("file", "col", "header")
        .agg(F.count_if(numeric).alias("num"), F.count(F.lit(1)).alias("total"))
        .filter(F.col("num") / F.col("total") > 0.8)
        .select("file", "col", "header", "num", "total")
    )


def format_check(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Per file, do row count, descriptions, quantities and spans match the expectation?

    ``expected`` (file, row_ref, quantity). Spans are exact when every offset cuts a non-blank text.
    """
    spans = F.forall(
        F.map_values("cell_offsets"),
        lambda s: (s["start"] >= 0) & (s["end"] <= F.length("source_text")) & (s["start"] < s["end"]),
    )
    wanted = expected.withColumnRenamed("quantity", "expected_quantity").withColumn("wanted", F.lit(True))
    j = rows.join(wanted, ["file", "row_ref"], "full")
    return j.groupBy("file").agg(
        F.bool_and(F.col("source_text").isNotNull() & F.col("wanted").isNotNull()).alias("rows_ok"),
        F.bool_and(F.coalesce(F.length("source_text") > 0, F.lit(False))).alias("text_ok"),
        F.bool_and(F.col("quantity").eqNullSafe(F.col("expected_quantity"))).alias("quantity_ok"),
        F.bool_and(F.coalesce(spans, F.lit(False))).alias("spans_ok"),
    )


def realign_by_position(rows: DataFrame, reference: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Give rows of files without an item column the reference's k-th item.

    Positions are counted inside chunks of row numbers and shifted by the size of the chunks before,
    so one very long file is ranked by many tasks. A chunk's size is its last position, so that the rows are made
    once for both; of the reference only positions that occur are met.
    """
    parts = rows.withColumn("chunk", F.floor(F.col("row_number") / chunk))
    inside = F.row_number().over(Window.partitionBy("file", "chunk").orderBy("row_number"))
    ranked = parts.withColumn("inside", inside)
    sizes = ranked.where("file IS NOT NULL AND chunk IS NOT NULL").groupBy("file", "chunk").agg(F.max("inside").alias("n"))
    earlier = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    mine = ranked.join(offsets, ["file", "chunk"]).withColumn("k", F.col("inside") + F.col("offset")).drop("chunk", "inside", "offset")
    longest = sizes.groupBy("file").agg(F.sum("n").alias("n")).agg(F.max("n").alias("longest"))
    items = reference.select("k", F.col("row_ref").alias("item_ref")).join(longest, F.col("k") <= F.col("longest")).drop("longest")
    return mine.join(items, "k", "left").drop("k")
