"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomrec.llm.common import before_bucket, fresh, seeded_order

SPREAD = 2**60


def interleaved_shards(
    docs: DataFrame, shards: int = 24, seed: int = 7, id_col: str = "doc_id", source_col: str = "source",
    text_col: str = "text", rows_per_bucket: int = 20_000, shard_col: str = "shard", slot_col: str = "slot",
) -> DataFrame:
    """Deal rows into shards of equal count, each with the mixture of the whole.

    Within each source the rows are shuffled by a seeded hash of their id and ranked; the rank r of n
    becomes the fractional rank (2r-1)/(2n). All rows sorted by it (then source, id) are cut into
    ``shards`` runs whose counts differ by one at most; every source is spread evenly over that order.

    Both ranks are taken inside buckets of bounded size and shifted by what the lower buckets hold:
    hash ranges within a source, then ranges of the fractional rank, whose offsets follow from the
    source counts alone. A source with a third of all rows is so many buckets as any other rows.

    A null source is a source of its own, before all others. Rows with equal ids are told apart by
    their text's checksum; rows equal in both are interchangeable. A null id shuffles as ''. An empty
    table stays empty. All input columns are kept; ``shard_col`` (int) and ``slot_col`` (long, gapless
    from 0 in each shard) are appended and replace columns of that name.
    """
    docs = docs.drop(shard_col, slot_col)
    total = docs.count()
    buckets = max(1, -(-total // rows_per_bucket))
    g, h, b, base, n, r, f, b2, base2, crc = fresh(
        docs, "s_group", "s_hash", "s_bucket", "s_base", "s_n", "s_rank", "s_frac", "s_bucket2", "s_base2", "s_crc"
    )
    order = seeded_order(F.col(id_col), seed)
    rows = docs.withColumns(
        {g: F.concat(F.when(F.col(source_col).isNull(), "0").otherwise("1"), F.coalesce(F.col(source_col).cast("string"), F.lit(""))),
         h: order, crc: F.crc32(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))}
    ).withColumn(b, (F.col(h) / F.lit(SPREAD / buckets)).cast("int"))
    counts = rows.groupBy(g, b).agg(F.count(F.lit(1)).alias(r))
    offsets = before_bucket(counts, [g], b, r, base, n)
    inside = Window.partitionBy(g, b).orderBy(h, id_col, crc)
    ranked = rows.join(offsets, [g, b]).withColumn(r, F.col(base) + F.row_number().over(inside))
    place = F.expr(f"((2 * `{r}` - 1) * {buckets}) div (2 * `{n}`)")
    ranked = ranked.withColumns({f: (2 * F.col(r) - 1) / (2.0 * F.col(n)), b2: place})

    # Rows of a source below range i of the fractional rank: (2r-1) * buckets <= 2 * n * i - 1.
    sources = counts.groupBy(g).agg(F.sum(r).alias(n))
    ranges = sources.withColumn(b2, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    below = F.expr(f"IF(`{b2}` = 0, 0L, (((2 * `{n}` * `{b2}` - 1) div {buckets}) + 1) div 2)")
    starts = ranges.groupBy(b2).agg(F.sum(below).alias(base2))
    across = Window.partitionBy(b2).orderBy(f, g, h, id_col, crc)
    placed = ranked.join(starts, b2).withColumn(r, F.col(base2) + F.row_number().over(across) - 1)
    shard = F.expr(f"(`{r}` * {shards}) div {max(1, total)}").cast("int")
    first = F.expr(f"(`{shard_col}` * {total}L + {shards - 1}) div {shards}")
    placed = placed.withColumn(shard_col, shard).withColumn(slot_col, F.col(r) - first)
    return placed.select(*docs.columns, shard_col, slot_col)
