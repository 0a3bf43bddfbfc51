"""Benchmark decontamination by winnowing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomrec.llm.bloom import Bloom, bloom
from bomrec.llm.common import kept
from bomrec.llm.tokens import ALPHANUMERIC, Words, blocks, grams, inside_text, text_bytes

SPAN = 10
GRAM = 5
REACH = SPAN - GRAM
MARKS = "array<struct<k: int, print: long, pos: int, words: array<string>>>"
MARK = pa.list_(pa.struct([("k", pa.int32()), ("print", pa.int64()), ("pos", pa.int32()), ("words", pa.list_(pa.string()))]))


def winnowed(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of the k-grams that are least in some window of ``REACH + 1`` k-grams of one text.

    Of equal minima all are taken, so that two texts choose alike in a window that both have.
    """
    g = grams(hashes, GRAM)
    n = len(hashes) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least = g[:n].copy()
    for i in range(1, REACH + 1):
        np.minimum(least, g[i : i + n], out=least)
    least[~inside_text(first, SPAN)] = 0
    most = np.zeros(len(g), np.uint64)
    for i in range(REACH + 1):
        np.maximum(most[i : i + n], least, out=most[i : i + n])
    return np.flatnonzero((most == g) & (most > 0))


def marks(words: Words, short: tuple[int, ...], wanted: Bloom | None, whole_short: bool) -> list[list[dict]]:
    """Per text its fingerprints, each with the folded words around it.

    Texts are marked by winnowing with the words up to ``REACH`` before and after the k-gram, null beyond
    the text. Items below ``SPAN`` words are one whole-item gram; documents give the grams of those
    lengths. ``wanted`` keeps the fingerprints that may be in the other table.
    """
    hashes, first = words.hashes(), words.first
    out: list[list[dict]] = [[] for _ in words.counts]
    found = [(GRAM, winnowed(hashes, first), REACH, grams(hashes, GRAM))]
    for k in short:
        at = np.flatnonzero(inside_text(first, k))
        g = grams(hashes, k)
        if whole_short:
            owner = np.searchsorted(first, at, "right") - 1
            at = at[words.counts[owner] == k]
        found.append((-k, at, 0, g))
    for k, at, reach, g in found:
        prints = g[at]
        if wanted is not None and len(at):
            # Prints of different lengths share the filter; the join compares the length as well.
            hit = wanted.test(prints)
            at, prints = at[hit], prints[hit]
        owner = np.searchsorted(first, at, "right") - 1
        for p, h, doc in zip(at.tolist(), prints.view(np.int64).tolist(), owner.tolist(), strict=True):
            lo, hi = first[doc], first[doc + 1]
            around = [words.word(i) if lo <= i < hi else None for i in range(p - reach, p + abs(k) + reach)]
            out[doc].append({"k": k, "print": h, "pos": p - lo, "words": around})
    return out


def marked(table: DataFrame, text_col: str, keep: list[str], short: tuple[int, ...], wanted: Bloom | None, whole_short: bool) -> DataFrame:
    """Per row: its ``keep`` columns, how many words it has, and its fingerprints."""
    fields = table.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.schema.fields)

    def scan(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(len(keep)))
            for i, j in blocks(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALPHANUMERIC)
                found = marks(words, short, wanted, whole_short)
                columns = [batch.column(c).slice(i, j - i) for c in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(words.counts, pa.int64()), pa.array(found, MARK)], [*keep, "n_words", "marks"]
                )

    thin = table.select(*keep, F.col(text_col).cast("string").alias("text_"))
    return thin.mapInArrow(scan, f"{schema}, n_words long, marks {MARKS}")


def shared_words(mine: Column, theirs: Column, back: bool) -> Column:
    """How many words next to the k-gram agree in a row, up to ``REACH``, before it or after it."""
    places = [REACH - i if back else REACH + GRAM + i - 1 for i in range(1, REACH + 1)]
    total, going = F.lit(0), F.lit(True)
    for p in places:
        going = going & F.coalesce(F.get(mine, F.lit(p)) == F.get(theirs, F.lit(p)), F.lit(False))
        total = total + going.cast("int")
    return total


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Mark the words of documents that lie in a window of 10 consecutive words of a benchmark item.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and characters beyond ASCII. Both
    tables are winnowed: of every 6 consecutive 5-grams the one with the least hash is a fingerprint, so
    each shared run of 10 words has one in common. Documents and items meet by an equi-join on
    fingerprints; the words themselves are compared in the k-gram and outwards from it, and a shared run
    of 10 or more is a hit. Items of 1 to 9 words are one window as a whole, found by the grams of
    exactly these lengths. A Bloom filter of at most 8 MB over the items' fingerprints spares the
    shuffle of others; it only ever lets too many pass.

    Null and texts without words have no words and no hits. Items without words occur nowhere; a null
    item id is listed as the empty string, and items that repeat an id count once. Each document row is
    judged by itself, so repeated ids give repeated rows. No documents give no rows; no items, no hits.

    Returns (id, n_words, n_hit, n_items, items_sha256, contaminated).
    """
    fingerprints = marked(
        items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")),
        "text", ["item"], tuple(range(1, SPAN)), None, whole_short=True,
    )
    item_marks = kept(fingerprints.select("item", F.inline("marks")).dropDuplicates(["item", "k", "print", "words"]))
    short = tuple(sorted(-r["k"] for r in item_marks.where("k < 0").select("k").distinct().collect()))
    wanted = bloom(item_marks.select("print"), item_marks.count())

    doc_marks = kept(marked(docs, text_col, [id_col], short, wanted, whole_short=False))
    doc_marks = doc_marks.withColumn("row", F.monotonically_increasing_id())
    mine = doc_marks.select("row", F.inline("marks")).withColumnsRenamed({"words": "mine"})
    theirs = item_marks.select("item", "k", "print", F.col("words").alias("theirs"))
    pairs = mine.join(theirs, ["k", "print"])
    core = F.slice("mine", REACH + 1, GRAM) == F.slice("theirs", REACH + 1, GRAM)
    back, ahead = shared_words(F.col("mine"), F.col("theirs"), True), shared_words(F.col("mine"), F.col("theirs"), False)
    runs = pairs.select(
        "row", "item", F.when(F.col("k") > 0, F.col("pos") - back).otherwise(F.col("pos")).alias("begin"),
        F.when(F.col("k") > 0, F.col("pos") + GRAM + ahead).otherwise(F.col("pos") - F.col("k")).alias("stop"),
        F.when(F.col("k") > 0, core & (back + GRAM + ahead >= SPAN)).otherwise(F.col("mine") == F.col("theirs")).alias("real"),
    ).where("real").drop("real").distinct()
    runs = kept(runs)
    order = Window.partitionBy("row").orderBy("begin", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("stop").over(order), F.lit(0))
    covered = F.greatest(F.col("stop") - F.greatest(F.col("begin"), reached), F.lit(0))
    spans = runs.select("row", "begin", "stop").distinct().withColumn("new", covered)
    n_hit = spans.groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    named = runs.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = doc_marks.select("row", id_col, "n_words").join(n_hit, "row", "left").join(named, "row", "left")
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    return out.select(
        id_col, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
