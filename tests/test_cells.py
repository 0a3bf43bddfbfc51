"""Spreadsheet cells: what is read and made once, and positions across chunks."""

from pyspark.sql import functions as F

from bomrec.plans import lens
from bomrec.plans.queries_sources import CELLS
from bomrec.sources import cells as S

SF = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_the_grid_is_ranked_once_for_all_cells_of_a_row(spark):
    """Every kind of cell had its own pass over the ranked order lines."""
    assert _plan(lens.frame(spark, SF, CELLS)).count("Window [") == 1


def test_row_numbers_need_no_lists_of_cells(spark):
    """which rows are there is a count; their texts are not put together for it."""
    rows = S.source_rows(lens.frame(spark, SF, CELLS))
    assert "collect_list" not in _plan(rows.select("file", "row_number")) and "collect_list" in _plan(rows.select("source_text"))


def test_headers_below_the_first_rows_and_positions_across_chunks(spark):
    cells = [("a", "s", 1, 1, 9, "title"), ("n", "s", 1, 1, 1, "too few")]
    for file, head in (("a", 3), ("b", 40)):
        cells += [(file, "s", 1, head, c, v) for c, v in enumerate(("ITEM", "NAME", "QTY"), 1)]
        cells += [(file, "s", 1, head + i, c, v) for i in range(1, 8) if i != 4 for c, v in ((2, f"{file}{i}"), (3, str(i)))]
        cells += [(file, "s", 1, head + 4, 2, " "), (file, "s", 1, head + 9, 8, "beyond")]
    frame = spark.createDataFrame(cells, "file string, sheet string, sheet_idx int, row int, col int, value string")
    rows = S.source_rows(frame)
    got = sorted((r.file, r.row_number, r.source_text, r.quantity) for r in rows.collect())
    assert got == sorted((f, h + i, f"{f}{i} | {i}", float(i)) for f, h in (("a", 3), ("b", 40)) for i in range(1, 8) if i != 4)
    assert sorted((r.file, r.row_number) for r in S.skipped_rows(frame).collect()) == [("a", 7), ("a", 12), ("b", 44), ("b", 49)]
    reference = spark.range(1, 5).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("r"), "id").alias("row_ref"))
    for chunk in (2, 10_000):
        items = sorted((r.file, r.row_number, r.item_ref) for r in S.realign_by_position(rows, reference, chunk).collect())
        assert [i for _, _, i in items] == ["r1", "r2", "r3", "r4", None, None] * 2
    assert S.realign_by_position(rows.where("file = 'none'"), reference).collect() == []
