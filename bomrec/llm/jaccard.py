"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomrec.llm.bloom import Bloom, bloom
from bomrec.llm.common import kept, written
from bomrec.llm.components import components
from bomrec.llm.tokens import SPACED, Words, blocks, grams, inside_text, mixed, text_bytes

LOG_COUNTERS = 20
PIECE = 1 << 14
BLOCK_CLASSES, BLOCK_GRAMS = 1 << 10, 1 << 18
COLUMNS, PAIRS = 1 << 10, 1 << 22
DENSE = 256
SECOND = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Rule:
    """Documents are linked when 100 * intersection >= percent * union of their sets of k-word shingles."""

    percent: int = 75
    k: int = 5

    def linked(self, both, n_a, n_b):
        return (100 + self.percent) * both >= self.percent * (n_a + n_b)

    def prefix(self, n):
        """So many of a document's n-grams, first in the common order, meet every partner's first ones."""
        return n - (self.percent * n + 99) // 100 + 1


def shingle_sets(batch_column, rule: Rule):
    """Sorted distinct shingle hashes of each text, with the position of the text in the batch."""
    data, offsets = text_bytes(batch_column)
    for i, j in blocks(offsets):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACED)
        hashes, first = words.hashes(), words.first
        g = grams(hashes, rule.k)
        good = inside_text(first, rule.k)
        for d in range(j - i):
            lo, hi = int(first[d]), int(first[d + 1])
            if hi - lo >= rule.k:
                found = np.unique(g[lo : hi - rule.k + 1][good[lo : hi - rule.k + 1]])
            elif hi > lo:
                found = grams(hashes[lo:hi], hi - lo) + np.uint64(hi - lo)
            else:
                found = np.zeros(0, np.uint64)
            yield i + d, found


def set_key(found: np.ndarray, seed: int) -> int:
    return int(mixed(np.sum(mixed(found ^ np.uint64(seed)), dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def parity(found: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of the set's hashes falls into cell i, of at least as many cells as hashes."""
    cells = max(64, 1 << int(len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """At least so many hashes are in one of two sets only: the cells whose parities differ."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = 8 * len(a), 8 * len(b)
    while n > m:
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    while m > n:
        m //= 2
        y = (y >> m) ^ (y & ((1 << m) - 1))
    return (x ^ y).bit_count()


def counters(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << LOG_COUNTERS) - 1)
    return (found & mask).astype(np.int64), ((found >> np.uint64(32)) & mask).astype(np.int64)


def profiled(docs: DataFrame, id_col: str, text_col: str, rule: Rule, seed: int) -> DataFrame:
    """One pass over the texts: per row the size, key and parity bits of its set; and per task, in rows with
    a piece number, counts of shingles in two arrays of 2**20 counters."""
    kind = docs.schema[id_col].dataType.simpleString()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
    names = [id_col, "n", "key", "other_key", "parity", "piece", "counts"]

    def profile(batches):
        size = 1 << LOG_COUNTERS
        counts, ids = np.zeros((2, size), np.int64), None
        for batch in batches:
            ids, rows = batch.column(0), []
            for _, found in shingle_sets(batch.column(1), rule):
                if len(found):
                    for c, cells in zip(counts, counters(found), strict=True):
                        np.add.at(c, cells, 1)
                    rows.append((len(found), set_key(found, seed), set_key(found, seed + 1), parity(found), None, None))
                else:
                    rows.append((0, None, None, None, None, None))
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]], names
            )
        if ids is not None:
            flat = counts.ravel()
            pieces = [(p, flat[p * PIECE : (p + 1) * PIECE]) for p in range(len(flat) // PIECE)]
            packed = [(p, pa.compress(x.tobytes(), codec="zstd", asbytes=True)) for p, x in pieces if x.any()]
            n = len(packed)
            blank = [pa.nulls(n, t) for t in (ids.type, *kinds[:4])]
            yield pa.RecordBatch.from_arrays(
                [*blank, pa.array([p for p, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary())], names
            )

    thin = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_"))
    schema = f"`{id_col}` {kind}, n long, key long, other_key long, parity binary, piece int, counts binary"
    return thin.mapInArrow(profile, schema)


def levels(counts: DataFrame) -> np.ndarray:
    """How far each counter stands above or below the mean of all, in sixteenths of chance's deviation.

    Counters fill up evenly as the corpus grows; what stands out is a shingle that many documents share.
    The sums have a fixed size whatever the corpus.
    """

    def add(group):
        total = np.sum([np.frombuffer(pa.decompress(x, 8 * PIECE, "zstd", asbytes=True), np.int64) for x in group["counts"]], axis=0)
        return pd.DataFrame({"piece": group["piece"].iloc[:1], "counts": [pa.compress(total.tobytes(), codec="zstd", asbytes=True)]})

    flat = np.zeros(2 << LOG_COUNTERS, np.int64)
    halfway = counts.groupBy("piece", (F.spark_partition_id() % 16).alias("part")).applyInPandas(add, "piece int, counts binary")
    # One job: fetched partition by partition, each piece would be a job of its own.
    for row in halfway.groupBy("piece").applyInPandas(add, "piece int, counts binary").collect():
        flat[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] = np.frombuffer(pa.decompress(row["counts"], 8 * PIECE, "zstd", asbytes=True), np.int64)
    mean = flat.mean()
    return np.clip(np.rint(16 * (flat - mean) / np.sqrt(mean + 1)), -32_000, 32_000).astype(np.int16).reshape(2, -1)


def postings(docs: DataFrame, text_col: str, rule: Rule, seed: int, loud: np.ndarray) -> DataFrame:
    """The incidence matrix, cut by the size-derived bound: per distinct set of a batch its first n-grams.

    The common order is by the count of the n-gram's counters, then hash, so shingles that many documents
    share come last and are dropped unless a document consists of them. ``at`` is the place in that order.
    """

    def emit(batches):
        for batch in batches:
            seen, parts = set(), []
            for _, found in shingle_sets(batch.column(0), rule):
                n = len(found)
                if not n or (key := set_key(found, seed)) in seen:
                    continue
                seen.add(key)
                a, b = counters(found)
                level = np.minimum(loud[0][a], loud[1][b])
                first = found[np.argsort(level, kind="stable")][: rule.prefix(n)]
                parts.append((first, key, n))
            size = [len(p[0]) for p in parts]
            hashes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(np.repeat([p[1] for p in parts], size).astype(np.int64)),
                 pa.array(np.repeat([p[2] for p in parts], size).astype(np.int64)),
                 pa.array((np.concatenate([np.arange(s) for s in size]) if size else np.zeros(0)).astype(np.int32))],
                ["gram", "key", "n", "at"],
            )

    return docs.select(F.col(text_col).cast("string").alias("text_")).mapInArrow(emit, "gram long, key long, n long, at int")


def sets_of(docs: DataFrame, text_col: str, rule: Rule, seed: int, wanted: Bloom) -> DataFrame:
    """(key, grams): the whole sets whose keys the filter lets pass, one row each."""

    def emit(batches):
        for batch in batches:
            seen = {}
            for _, found in shingle_sets(batch.column(0), rule):
                if len(found):
                    key = set_key(found, seed)
                    if key not in seen and wanted.test(np.array([key], np.int64))[0]:
                        seen[key] = found.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.binary())], ["key", "grams"]
            )

    found = docs.select(F.col(text_col).cast("string").alias("text_")).mapInArrow(emit, "key long, grams binary")
    return found.groupBy("key").agg(F.first("grams").alias("grams"))


def may_link(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Drop the pairs (a, b) whose parity bits prove too large a difference."""
    side = lambda s: classes.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("parity").alias(f"p_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def check(batches):
        for batch in batches:
            c = {k: v.to_pylist() for k, v in zip(batch.schema.names, batch.columns, strict=True)}
            good = [
                (100 + rule.percent) * differing(x, y) <= (100 - rule.percent) * (n + m)
                for x, y, n, m in zip(c["p_a"], c["p_b"], c["n_a"], c["n_b"], strict=True)
            ]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b", "n_a", "n_b"])

    return both.mapInArrow(check, "a long, b long, n_a long, n_b long")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact intersection size of each pair's whole sets."""

    def count(batches):
        for batch in batches:
            shared = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort()
                shared.append(int((both[1:] == both[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shared, pa.int64())], ["a", "b", "n_a", "n_b", "shared"])

    one, two = sets.toDF("a", "grams_a"), sets.toDF("b", "grams_b")
    rows = pairs.join(two, "b").join(one, "a").select("a", "b", "n_a", "n_b", "grams_a", "grams_b")
    return rows.mapInArrow(count, "a long, b long, n_a long, n_b long, shared long")


def candidates(lists: DataFrame, rule: Rule, star: str | None) -> DataFrame:
    """Pairs from n-grams whose documents are not all in one component yet.

    With ``star``, each n-gram pairs one document with those of other components: the 'plain' one, which
    has the fewest rare n-grams before it and so lies nearest to what a group of copies has in common, or
    'any' one, another for each n-gram. Without, all documents of different components meet. Pairs whose
    sizes, or places in the common order, leave room for too small an intersection are discarded.
    """
    one = Window.partitionBy("gram")
    open_ = lists.withColumns({"lo": F.min("label").over(one), "hi": F.max("label").over(one)}).where("lo <> hi").drop("lo", "hi")
    if star:
        lead = F.col("at") if star == "plain" else F.xxhash64("gram", "key")
        pick = F.min(F.struct(lead.alias("lead"), "key", "label", "n", "at")).over(one)
        pairs = open_.withColumn("p", pick).select(
            F.col("p.key").alias("x"), F.col("p.label").alias("lx"), F.col("p.n").alias("nx"), F.col("p.at").alias("ax"),
            F.col("key").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("at").alias("ay"),
        )
    else:
        side = lambda s: open_.select("gram", *[F.col(c).alias(c[0] + s) for c in ("key", "label", "n", "at")])
        pairs = side("x").join(side("y"), "gram").where("kx < ky").withColumnsRenamed({"kx": "x", "ky": "y"})
    t = rule.percent
    room = F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay"))
    fits = (100 * F.least("nx", "ny") >= t * F.greatest("nx", "ny")) & ((100 + t) * room >= t * (F.col("nx") + F.col("ny")))
    return pairs.where((F.col("lx") != F.col("ly")) & fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def class_blocks(docs: DataFrame, text_col: str, rule: Rule, seed: int, classes: DataFrame) -> DataFrame:
    """The classes of each component of two or more, with their whole sets, dealt out to pairs of blocks.

    A large component is cut into blocks by a hash of the class, and each class goes to every pair of blocks
    (p, q) that its own is in. Small components share a block.
    """
    some = classes.where("members > 1")
    cut = lambda members, total: F.greatest(F.ceil(members / BLOCK_CLASSES), F.ceil(total / BLOCK_GRAMS), F.lit(1))
    some = some.withColumn("parts", cut(F.col("members"), F.col("total")))
    shared = some.where("parts = 1").agg(cut(F.coalesce(F.count("*"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).alias("n")).first()["n"]
    own = F.pmod(F.xxhash64("key", F.lit(seed)), F.col("parts"))
    home = F.when(F.col("parts") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label", F.lit(seed)), F.lit(shared)))
    some = kept(some.select("key", "n", "copies", "parts", own.alias("own"), home.alias("home")))
    needed = some.select("key")
    sets = written(sets_of(docs, text_col, rule, seed, bloom(needed, some.count())), "sets")
    dealt = some.join(sets, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return dealt.select(
        (F.col("parts") > 1).alias("alone"), "home", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
        "own", "key", "n", "copies", "grams",
    )


def product(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The product of two blocks of the matrix: at [i, j] the size of the intersection of sets a[i] and b[j].

    N-grams of many sets are multiplied as dense columns; of the others the pairs of sets are listed.
    """
    out = np.zeros((len(a), len(b)), np.int64)
    if a is b:
        found, times = np.unique(np.concatenate(a), return_counts=True)
        common = found[times > 1]
    else:
        common = np.intersect1d(np.concatenate(a), np.concatenate(b))

    def columns(sets):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(common, flat)
        hit = common[np.minimum(at, len(common) - 1)] == flat
        at, row = at[hit], row[hit]
        order = np.argsort(at, kind="stable")
        return row[order], np.searchsorted(at[order], np.arange(len(common) + 1))

    if not len(common):
        return out if a is not b else out + np.diag([len(x) for x in a])
    (row_a, from_a), (row_b, from_b) = columns(a), columns(b)
    n_a, n_b = np.diff(from_a), np.diff(from_b)
    dense = n_a * n_b * DENSE > out.size
    wide = np.flatnonzero(dense)
    for i in range(0, len(wide), COLUMNS):
        chosen, sides = wide[i : i + COLUMNS], []
        for row, start, n, m in ((row_a, from_a, n_a, len(a)), (row_b, from_b, n_b, len(b))):
            times = n[chosen]
            k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            ones = np.zeros((m, len(chosen)), np.float32)
            ones[row[np.repeat(start[chosen], times) + k], np.repeat(np.arange(len(chosen)), times)] = 1
            sides.append(ones)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    thin = np.flatnonzero(~dense)
    ends = np.cumsum(n_a[thin] * n_b[thin])
    i = 0
    while i < len(thin):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
        chosen = thin[i:j]
        times = n_a[chosen] * n_b[chosen]
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        c = np.repeat(chosen, times)
        cells = row_a[from_a[c] + k // n_b[c]] * len(b) + row_b[from_b[c] + k % n_b[c]]
        out += np.bincount(cells, minlength=out.size).reshape(out.shape)
        i = j
    if a is b:
        np.fill_diagonal(out, [len(x) for x in a])
    return out


def linked_pairs(blocks_: DataFrame, rule: Rule, listed: bool) -> DataFrame:
    """Links from the products of all pairs of blocks: each of them if ``listed``, else (key, met), where met is
    the number of rows in the classes that a class is linked with in one product."""

    def multiply(table):
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        own = table.column("own").to_numpy()
        sides = []
        for side in (p, q) if p < q else (p,):
            mine = table.filter(pa.array(own == side))
            sets = [np.frombuffer(x, np.uint64) for x in mine.column("grams").to_pylist()]
            sides.append((sets, *(mine.column(c).to_numpy() for c in ("key", "n", "copies"))))
        one, two = sides[0], sides[-1]
        if not one[0] or not two[0]:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        both = product(one[0], two[0])
        good = rule.linked(both, one[2][:, None], two[2][None, :])
        if p == q:
            np.fill_diagonal(good, False)
        if not listed:
            met = [(x[1], g @ y[3]) for x, y, g in ((one, two, good), (two, one, good.T))[: len(sides)]]
            key, met = (np.concatenate(x) for x in zip(*met, strict=True))
            return pa.table({"key": key[met > 0], "met": met[met > 0]})
        x, y = np.nonzero(np.triu(good) if p == q else good)
        turned = one[1][x] > two[1][y]
        pick = lambda k, first: np.where(turned == first, two[k][y], one[k][x])
        found = (pick(1, True), pick(1, False), pick(2, True), pick(2, False), both[x, y])
        return pa.table(dict(zip(names, found, strict=True)))

    names = ("a", "b", "n_a", "n_b", "shared") if listed else ("key", "met")
    schema = ", ".join(f"{c} long" for c in names)
    return blocks_.groupBy("alone", "home", "p", "q").applyInArrow(multiply, schema)


def linked_components(
    docs: DataFrame, id_col: str, text_col: str, rule: Rule, seed: int,
) -> tuple[DataFrame, DataFrame]:
    """The components that links lead between, without all of their links.

    The class by n-gram incidence matrix is kept only where its size-derived bound needs it: of n
    n-grams in a common order, rare ones first, the first n - ceil(percent * n / 100) + 1. Shuffled by
    n-gram, it works as an inverted list: classes that share an n-gram are candidates unless sizes or places
    bound the overlap below what a link needs. No counts are added up over these n-grams, as they alone do
    not decide a link. Overlaps are bounded from above by parity bits, and for what remains the whole sets
    are intersected.

    A group of m near copies has m * m / 2 pairs. So each n-gram pairs one class with the others first (its
    plainest, then another one), the components of the links found are formed, and all pairs are taken only
    between classes of different components. No pair that could join two
    components is left out; pairs inside one are left to ``linked_pairs``.

    Returns (rows, classes): per row (id, n, key); and per class (key, class_id, component_id, n, copies, label,
    members, total), where members and total are the number of classes and of n-grams in its component.
    """
    profile = kept(profiled(docs, id_col, text_col, rule, seed))
    rows = profile.where("piece IS NULL").select(F.col(id_col).alias("id"), "n", "key", "other_key", "parity")
    grouped = rows.where("n > 0").groupBy("key").agg(
        F.min("id").alias("class_id"), F.min("n").alias("n"), F.min("parity").alias("parity"), F.count("*").alias("copies"),
        (F.min("other_key") != F.max("other_key")).alias("clash"),
    )
    classes = kept(grouped)
    if classes.where("clash").head(1):
        raise ValueError("two different sets have one key: choose another seed")
    loud = levels(profile.where("piece IS NOT NULL").select("piece", "counts"))

    one = Window.partitionBy("gram")
    blocks_ = postings(docs, text_col, rule, seed, loud)
    shared = blocks_.withColumns({"lo": F.min("key").over(one), "hi": F.max("key").over(one)}).where("lo <> hi")
    shared = written(shared.select("gram", "key", "n", "at").dropDuplicates(["gram", "key"]), "postings")

    links = failed = labels = None
    for star in ("plain", "any", None):
        lists = shared.withColumn("label", F.col("key")) if labels is None else (
            shared.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        )
        pairs = candidates(lists, rule, star)
        if failed is not None:
            pairs = pairs.join(failed, ["a", "b"], "left_anti")
        left = kept(may_link(pairs, classes, rule))
        needed = left.select(F.col("a").alias("key")).union(left.select("b")).distinct()
        n = needed.count()
        if not n:
            continue
        sets = written(sets_of(docs, text_col, rule, seed, bloom(needed, n)), "sets")
        checked = kept(overlaps(left, sets))
        good = rule.linked(F.col("shared"), F.col("n_a"), F.col("n_b"))
        links = checked.where(good) if links is None else links.union(checked.where(good))
        bad = checked.where(~good).select("a", "b")
        failed = bad if failed is None else failed.union(bad)
        labels = components(links)

    if labels is None:
        labelled = classes.withColumn("label", F.col("key"))
    else:
        labelled = classes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    names = labelled.groupBy("label").agg(
        F.min("class_id").alias("component_id"), F.count("*").alias("members"), F.sum("n").alias("total")
    )
    named = labelled.join(names, "label").select("key", "class_id", "component_id", "n", "copies", "label", "members", "total")
    return rows.select("id", "n", "key"), kept(named)


def found_rows(rows: DataFrame, classes: DataFrame, id_col: str, *more: str) -> DataFrame:
    return rows.join(classes.drop("n"), "key", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"), *more,
    )


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, k: int = 5, seed: int = 1,
) -> DataFrame:
    """The rows of ``ngram_jaccard_join`` without their number of links, for those that need no more."""
    return found_rows(*linked_components(docs, id_col, text_col, Rule(percent, k), seed), id_col)


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, k: int = 5, seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Link documents whose sets of k-word shingles have a Jaccard similarity of ``percent`` % or more.

    Words lie between white space, A-Z lower-cased; a text of fewer than k words is one shingle, a text
    without words links with nothing. Documents with equal sets form one class and are compared once.

    Components are found first (``linked_components``); every link lies inside one. So the class by n-gram
    matrix of each component is multiplied with its transpose, block by block, which counts the overlap of
    every pair of its classes.

    Null counts as the empty text. Rows that repeat an id are rows of their own. A null id is never a
    component's name unless all its ids are null. An empty table gives no rows.

    Returns (rows, links): per row (id, n_shingles, class_id, component_id, n_links), where class_id is the
    smallest id of an equal set, component_id the smallest id that links lead to and n_links the number of
    other rows that the row is linked with, copies included; and all links (a, b, n_a, n_b, shared) between
    keys of classes, a < b. The links are listed when they are read: m near copies have up to m * (m - 1) / 2.
    """
    rule = Rule(percent, k)
    rows, classes = linked_components(docs, id_col, text_col, rule, seed)
    blocks_ = class_blocks(docs, text_col, rule, seed, classes)
    met = linked_pairs(blocks_, rule, listed=False).groupBy("key").agg(F.sum("met").alias("met"))
    counted = kept(classes.join(met, "key", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("met", F.lit(0))))
    n_links = F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    return found_rows(rows, counted, id_col, n_links), linked_pairs(blocks_, rule, listed=True)
