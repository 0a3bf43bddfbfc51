"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomrec.llm.common import kept

WHITE = " \t\n\x0b\f\r"
KEY = ("sha", "check", "n_bytes")


def without_white(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """One thin row per document: its run, the digest of its normalised text and how it ranks in its group."""
    text = docs[text_col]
    normal = without_white(text)
    return docs.select(
        docs[id_col].alias("id"), F.length(F.coalesce(text, F.lit(""))).alias("n_chars"), normal.alias("normal"),
        F.pmod(F.xxhash64(F.lit("run"), docs[id_col]), F.lit(runs)).cast("int").alias("run"),
    ).select(
        "id", "n_chars", "run", F.sha2(F.col("normal").cast("binary"), 256).alias("sha"),
        F.xxhash64("normal").alias("check"), F.octet_length("normal").alias("n_bytes"),
    )


def merged(entries: DataFrame, run: Column) -> DataFrame:
    """Merge the runs that fall into one: per run and text the best row so far and how many rows it stands for.

    The minimum over a struct aggregates by sorted merge, on the map side first, so a text that a third
    of all rows repeat crosses the network once per task and run.
    """
    return entries.groupBy(run.alias("run"), *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 256, fan_in: int = 16
) -> DataFrame:
    """Group documents whose texts are equal without white space; per group one stays.

    Rows are dealt into ``runs`` runs by their id. Each run is reduced to one entry per text, sorted by
    digest; then rounds merge ``fan_in`` runs at a time until one is left. In every round the entries of
    the merging runs are dealt by (run, digest), so all tasks share each merge and none holds a run
    whole. The last round gives the document that stays; it travels back to the entries of the first
    round and from there to the rows by (run, digest), which spreads a hot group over all runs.

    The digest is SHA-256; an entry also carries a second 64-bit hash and the byte length of the text,
    compared in every merge, so texts under one digest are verified apart.

    Of a group the document with the most code points in its original text stays, then the smallest id
    (a null id is the smallest). Null counts as the empty text, and texts of white space alone equal it.
    Rows that repeat an id are rows of their own in ``group_size``; all that carry the id that stays,
    with a text as long as the longest, are kept. An empty table gives no rows. Other columns are ignored.

    Returns (id, keep_id, group_size, kept, text_sha256), one row per input row.
    """
    if fan_in < 2 or runs < 1:
        raise ValueError("runs >= 1 and fan_in >= 2 are needed")
    rows = kept(digests(docs, id_col, text_col, runs))
    first = rows.select(
        "run", *KEY, F.struct((-F.col("n_chars")).alias("short"), F.col("id").alias("id")).alias("best"),
        F.lit(1).cast("long").alias("n"),
    )
    leaves = merged(first, F.col("run"))
    tree, left = leaves, runs
    while left > 1:
        tree = merged(tree, F.expr(f"run div {fan_in}").cast("int"))
        left = -(-left // fan_in)
    root = tree.select(*KEY, F.col("best").alias("winner"), F.col("n").alias("group_size"))
    answers = leaves.select("run", *KEY).join(root, list(KEY))
    out = rows.join(answers, ["run", *KEY])
    winner = F.col("winner")
    return out.select(
        F.col("id").alias(id_col), winner["id"].alias("keep_id"), "group_size",
        (F.col("id").eqNullSafe(winner["id"]) & (-F.col("n_chars") == winner["short"])).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
