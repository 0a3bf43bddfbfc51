"""SimHash near-duplicates: BK-trees over shards of the distinct fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomrec.llm.common import kept
from bomrec.llm.components import components, forest
from bomrec.llm.tokens import SPACED, Words, blocks, inside_text, text_bytes

BITS, RADIUS, K, SEED = 64, 3, 3, 42
TREE = 1 << 10
HASHED, ASKED = 1 << 15, 1 << 9


def shingle_ranges(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word and text of each k-word shingle; a text of fewer words is one shingle."""
    first, counts = words.first, words.counts
    begin = np.flatnonzero(inside_text(first, k))
    text = np.searchsorted(first, begin, "right") - 1
    few = np.flatnonzero((counts > 0) & (counts < k))
    begin, last = np.concatenate([begin, first[few]]), np.concatenate([begin + k - 1, first[few + 1] - 1])
    text = np.concatenate([text, few])
    order = np.argsort(text, kind="stable")
    return begin[order], last[order], text[order]


def fingerprints(column: pa.Array, k: int = K) -> np.ndarray:
    """SimHash of each text: a bit is set if it is in more than half of the hashes of its shingles."""
    from xxhash import xxh64_intdigest

    data, offsets = text_bytes(column)
    out = np.zeros(len(column), np.uint64)
    for i, j in blocks(offsets):
        part = data[offsets[i] : offsets[j]]
        words = Words(part, offsets[i : j + 1] - offsets[i], SPACED)
        # Lower-cased words, each with one space behind it, and where they begin and end in that.
        inside = SPACED.is_word[part]
        plain = np.where(inside, SPACED.fold[part], np.uint8(32))
        keep = inside.copy()
        keep[words.end[words.end < len(part)]] = True
        place = np.cumsum(keep) - 1
        start = place[words.start] if len(part) else words.start
        end = start + (words.end - words.start)
        plain = plain[keep].tobytes()
        begin, last, text = shingle_ranges(words, k)
        ones = np.zeros((j - i, BITS), np.int64)
        for at in range(0, len(begin), HASHED):
            a, b, t = start[begin[at : at + HASHED]].tolist(), end[last[at : at + HASHED]].tolist(), text[at : at + HASHED]
            hashes = np.array([xxh64_intdigest(plain[x:y], SEED) for x, y in zip(a, b, strict=True)], "<u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            edges = np.flatnonzero(np.diff(t, prepend=-1))
            ones[t[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
        n = np.bincount(text, minlength=j - i)
        set_bits = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little")
        out[i:j] = np.ascontiguousarray(set_bits).view("<u8")[:, 0]
    return out


class Tree:
    """A BK-tree in arrays: nodes by level, the children of a node side by side and by their distance to it.

    ``edge[i]`` is 65 * parent + distance for node i + 1, in ascending order, so the children that lie
    within some distances of a parent are one range of it.
    """

    def __init__(self, values: np.ndarray) -> None:
        nodes, edges = [values[:1]], []
        rest, parent, base = values[1:], np.zeros(len(values) - 1, np.int64), 0
        while len(rest):
            key = parent * 65 + np.bitwise_count(rest ^ nodes[-1][parent - base])
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            first = np.diff(key, prepend=-1) != 0
            base += len(nodes[-1])
            parent = base + np.cumsum(first) - 1
            nodes.append(rest[first])
            edges.append(key[first])
            rest, parent = rest[~first], parent[~first]
        self.values = np.concatenate(nodes)
        self.edge = np.concatenate([*edges, np.zeros(0, np.int64)])

    def dump(self) -> bytes:
        return self.values.astype("<u8").tobytes() + self.edge.astype("<i8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        tree, n = cls.__new__(cls), len(data) // 16 + 1
        tree.values = np.frombuffer(data, "<u8", n)
        tree.edge = np.frombuffer(data, "<i8", n - 1, 8 * n)
        return tree

    def within(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) for all asked[i] and values[j] that differ in at most ``radius`` bits.

        All asked values go down together; from a node at distance d only the edges d - radius to
        d + radius are followed, by the triangle inequality.
        """
        hits = []
        for at in range(0, len(asked), ASKED):
            i = np.arange(at, min(at + ASKED, len(asked)))
            j = np.zeros(len(i), np.int64)
            while len(i):
                d = np.bitwise_count(asked[i] ^ self.values[j]).astype(np.int64)
                near = d <= radius
                hits.append((i[near], j[near]))
                low = np.searchsorted(self.edge, 65 * j + np.maximum(d - radius, 0))
                n = np.searchsorted(self.edge, 65 * j + np.minimum(d + radius, BITS), "right") - low
                total = np.cumsum(n)
                i, j = np.repeat(i, n), np.repeat(low + 1 - (total - n), n) + np.arange(int(total[-1]))
        return tuple(np.concatenate(x) for x in zip(*hits, strict=True))


def shard_masks(n: int, tree: int = TREE) -> list[int]:
    """Bit masks so that two fingerprints within ``RADIUS`` bits agree under one of them at least.

    Four parts of the bits: three changes leave one part as it was. As many bits of the part are used as make
    shards of about ``tree`` of n evenly spread fingerprints; where a whole part is too little, the other 48
    bits are divided into four in turn.
    """
    part = BITS // (RADIUS + 1)
    need = max(0, (max(1, n) - 1).bit_length() - (tree - 1).bit_length())
    top = [((1 << part) - 1) << (part * p) for p in range(RADIUS + 1)]
    if need <= part:
        return [((1 << need) - 1) << (part * p) for p in range(RADIUS + 1)]
    out, inner = [], (BITS - part) // (RADIUS + 1)
    for mask in top:
        others = [b for b in range(BITS) if not mask >> b & 1]
        for q in range(RADIUS + 1):
            chosen = others[inner * q : inner * (q + 1)][: need - part]
            out.append(mask | sum(1 << b for b in chosen))
    return out


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint_links(prints: DataFrame, tree: int = TREE) -> DataFrame:
    """Links (a, b) that join exactly those of the distinct longs in ``prints`` that small steps lead between.

    Each shard of fingerprints that agree under a mask is split into parts of about ``tree`` by hash; each
    part becomes a BK-tree, and a tree is sent to all parts of its shard, which search it. So no task and no
    row holds more than a tree and a part, however large a shard is, and nothing passes through the driver.
    A task returns a spanning forest of the links that it found, not the links, so groups of near copies
    stay linear.
    """
    prints = prints.toDF("print")
    masks = shard_masks(prints.count(), tree)
    shards = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), (F.col("print").bitwiseAND(F.lit(signed(m)))).alias("bits")) for i, m in enumerate(masks)]))
    rows = prints.select("print", shards.alias("s")).select("s.mask", "s.bits", "print")
    sizes = rows.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    parts = F.ceil(F.col("n") / F.lit(tree))
    rows = rows.join(sizes, ["mask", "bits"]).select("mask", "bits", F.pmod(F.xxhash64("print"), parts).alias("part"), "print")

    def build(table: pa.Table) -> pa.Table:
        values = np.sort(table["print"].to_numpy().view(np.uint64))
        held = [pa.array([table[c][0].as_py()], pa.int64()) for c in ("mask", "bits", "part")]
        return pa.table([*held, pa.array([Tree(values).dump()], pa.binary())], ["mask", "bits", "part", "tree"])

    trees = rows.withColumn("mask", F.col("mask").cast("long")).groupBy("mask", "bits", "part")
    trees = kept(trees.applyInArrow(build, "mask long, bits long, part long, tree binary"))
    other = trees.toDF("mask", "bits", "other", "asked")
    pairs = trees.join(other, ["mask", "bits"]).where("part <= other").select("tree", "asked")

    def search(batches):
        for batch in batches:
            for mine, theirs in zip(batch.column(0), batch.column(1), strict=True):
                found, asked = Tree.load(mine.as_py()), Tree.load(theirs.as_py()).values
                i, j = found.within(asked, RADIUS)
                ends = forest(asked[i].view(np.int64), found.values[j].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

    return pairs.mapInArrow(search, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, tree: int = TREE) -> DataFrame:
    """Fingerprint each whole text and join what fingerprints of at most ``RADIUS`` different bits lead between.

    The bits of a fingerprint are the majority of the XXH64 (seed 42) bits of all k-word shingles, repeats
    included, of the text with A-Z lower-cased and words separated by single spaces.

    Null texts and texts without words have the fingerprint zero, which links like any other. Fewer than k
    words are one shingle. Equal fingerprints are searched once, so repeated rows and copies cost a row of
    two longs; rows that repeat an id are judged by their own texts. A null id stays null and is no
    component's smallest id unless it has no other. Very long texts are hashed piece by piece. An empty table gives
    no rows; other columns are ignored.

    Returns (id, fingerprint as 16 hex digits, component_id).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def hashed(batches):
        for batch in batches:
            prints = fingerprints(batch.column(1), k).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["key_", "print"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_"))
    rows = kept(rows.mapInArrow(hashed, f"key_ {kind}, print long"))
    groups = kept(rows.groupBy("print").agg(F.min("key_").alias("least")))
    labels = components(fingerprint_links(groups.select("print"), tree)).toDF("print", "label")
    placed = groups.join(labels, "print", "left").withColumn("label", F.coalesce("label", "print"))
    least = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    named = placed.select("print", "label").join(least, "label").select("print", "component_id")
    return rows.join(named, "print").select(F.col("key_").alias(id_col), hex_digits(F.col("print")).alias("fingerprint"), "component_id")


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))
