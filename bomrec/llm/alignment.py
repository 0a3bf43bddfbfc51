"""Alignment of two tokenizers over the same bytes, as Arrow tables inside tasks and partial counts in Spark."""

from __future__ import annotations

import hashlib
import json
import re
import sys
from dataclasses import dataclass
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomrec.llm.common import written
from bomrec.llm.tokens import blocks, text_bytes

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 1 << 20
JOIN_ROWS, LARGE_GROUP = 1 << 20, 64
#: Vocabularies up to this size have their best counts broadcast, one row for each id of the first.
SMALL_VOCABULARY = 1 << 18
KNOWN_PIECES, KNOWN_LENGTH = 400_000, 64
#: Fixed value: how byte-level vocabularies split texts before merging.
SPLIT = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN = regex.compile("[\t\n\r -~\u00a0-\u017f\u2013\u2014\u2018-\u201e\u2026]*")
SPACED = re.compile(" +[^ ]*")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


@dataclass(frozen=True)
class Pair:
    """The files of a byte-level BPE (first) and of a sentencepiece model (second), at one path on all machines."""

    byte_bpe: str = BYTE_BPE
    pieces: str = PIECES


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: visible Latin-1 as itself, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Loaded:
    """Both tokenizers, the bytes of their tokens, and the texts that ids are written as in a list of groups."""

    def __init__(self, pair: Pair) -> None:
        import os

        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = tokenizers.Tokenizer.from_file(pair.byte_bpe)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=pair.pieces)
        alphabet, named = byte_alphabet(), {i: t for t, i in self.first.get_vocab(with_added_tokens=True).items()}
        tokens = [named.get(i, "") for i in range(max(named) + 1)]
        self.bytes_a = pa.array([bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in tokens], pa.binary())
        self.bytes_b = pa.array([piece_bytes(self.second.id_to_piece(i)) for i in range(self.second.get_piece_size())], pa.binary())
        written_as = [f"{i}{mark}" for size, marks in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for mark in marks for i in range(size)]
        self.written_as = pa.array(written_as, pa.large_string())

        inner = (self.second.id_to_piece(i) for i in range(self.second.get_piece_size()))
        self.space = [self.second.piece_to_id("▁")]
        apart = not any(re.search("[^▁]▁", x) for x in inner) and self.second.id_to_piece(self.space[0]) == "▁"
        self.cuts_b = SPACED if apart else None
        self.known = (Known(self.encode_first), Known(self.encode_second))
        self.merge = self.merger()

    def merger(self):
        """A merge of single pieces for vocabularies whose ids are in the order of their merges, or None."""
        model = json.loads(self.first.to_str())["model"]
        pairs = (x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        if any(model["vocab"].get(a + b) != 256 + n for n, (a, b) in enumerate(pairs)):
            return None
        import tiktoken

        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t) and i < 256 + len(model["merges"])}
        return tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode_first(self, pieces: list[str]) -> list[list[int]]:
        """Pieces of the split rule are merged by themselves; others go through the tokenizer as a whole."""
        if self.merge is None:
            return [e.ids for e in self.first.encode_batch_fast(pieces, add_special_tokens=False)]
        out = [self.merge(p.encode()) if len(p) <= KNOWN_LENGTH else None for p in pieces]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.first.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def encode_second(self, pieces: list[str]) -> list[list[int]]:
        found = self.second.encode([t[1:] for t in pieces], num_threads=1)
        return [x if t != " " else self.space for t, x in zip(pieces, found, strict=True)]

    def encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Token lists of the texts, by the first tokenizer of space + text and by the second of the text.

        Neither tokenizer merges across the places at which texts are cut here, so each distinct piece is
        encoded once: the first splits texts by the rule in ``SPLIT`` before it merges, which is repeated here
        for the plain characters whose classes never changed, and the second has no token with a space behind
        another character. Other texts, such as those that hold the mark for a space, are encoded whole.
        """
        plain = [f" {t}" for t in texts.to_pylist()]
        known = [PLAIN.fullmatch(t) is not None for t in plain]
        first = self.known[0].token_lists([SPLIT.findall(t) if k else [] for t, k in zip(plain, known, strict=True)])
        if not all(known):
            odd = self.first.encode_batch_fast([t for t, k in zip(plain, known, strict=True) if not k], add_special_tokens=False)
            rest = (e.ids for e in odd)
            lists = [x if k else next(rest) for k, x in zip(known, first.to_pylist(), strict=True)]
            first = pa.array(lists, pa.list_(pa.int32()))
        cut = [self.cuts_b.findall(t) if self.cuts_b and "▁" not in t else [t] for t in plain]
        return first, self.known[1].token_lists(cut)


class Known:
    """Token ids of text pieces seen so far: a piece is looked up once for each place where it stands.

    Pieces are numbered; the ids of piece p are ``ids[begin[p] : begin[p] + size[p]]``. Long pieces are
    forgotten after the block, and all of them when there are too many.
    """

    def __init__(self, encode) -> None:
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.begin, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def token_lists(self, pieces: list[list[str]]) -> pa.Array:
        """The token list of each text, which is given in pieces."""
        flat = list(chain.from_iterable(pieces))
        if len(self.number) > KNOWN_PIECES:
            self.forget()
        new = list(set(flat).difference(self.number))
        if new:
            found = self.encode(new)
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))])
            self.number.update(zip(new, range(len(self.size) - len(new), len(self.size)), strict=True))
        at = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.begin[at] - ends[:-1], size) + np.arange(ends[-1])]
        edges = ends[np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])]
        for piece in new:
            if len(piece) > KNOWN_LENGTH:
                del self.number[piece]
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))


def worker_tables(pair: Pair) -> Loaded:
    """The tokenizers of this worker process, which serves many tasks. Task code comes by value, so its own
    module cannot hold them."""
    place = sys.modules.setdefault("bomrec_alignment_held", ModuleType("bomrec_alignment_held"))
    if getattr(place, "pair", None) != (pair.byte_bpe, pair.pieces):
        place.tables, place.pair = Loaded(pair), (pair.byte_bpe, pair.pieces)
    return place.tables


def vocabulary_sizes(pair: Pair) -> tuple[int, int]:
    tables = Loaded(pair)
    return len(tables.bytes_a), len(tables.bytes_b)


def tokens(ids: pa.Array, pieces: pa.Array) -> pa.Table:
    """One row for each token: its document, its id, and the byte of the document that it ends before."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    running = pc.cumulative_sum(pc.binary_length(pieces).take(flat).cast(pa.int64()))
    before = pa.concat_arrays([pa.array([0], pa.int64()), running]).take(ids.offsets[:-1])
    return pa.table({"doc": doc, "id": flat, "end": pc.subtract(running, before.take(doc))})


def spelled(found: pa.Table, pieces: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For which documents the joined bytes of the tokens are the bytes data[offsets[i]:offsets[i+1]]."""
    n = len(offsets) - 1
    doc = found["doc"].to_numpy()
    length = np.zeros(n, np.int64)
    np.maximum.at(length, doc, found["end"].to_numpy())
    same = length == np.diff(offsets)
    joined = pieces.take(found.filter(pa.array(same).take(found["doc"]))["id"].combine_chunks())
    got, _ = text_bytes(joined)
    wanted = data[np.repeat(same, np.diff(offsets))]
    where = np.concatenate([[0], np.cumsum(np.diff(offsets)[same])])
    off = np.searchsorted(where, np.flatnonzero(got != wanted), "right") - 1
    same[np.flatnonzero(same)[np.unique(off)]] = False
    return same


def counted(t: pa.Table, large: pa.ChunkedArray) -> pa.Table:
    """Tokens with ``count_all``: equal ids of large groups become one row with their count."""
    one = t.filter(pc.invert(large))
    one = one.append_column("count_all", pa.repeat(pa.scalar(1, pa.int64()), len(one)))
    many = t.filter(large).group_by(["group", "id"], use_threads=False).aggregate([([], "count_all")])
    return pa.concat_tables([one, many.select(one.column_names)])


def linked(a: pa.Table, b: pa.Table, of_group: pa.Array, width: int) -> pa.Table:
    """(doc, pair, times): how often each document links an id pair; the pair of ids (x, y) is x * width + y.

    ``a`` and ``b`` are the tokens with their ``group``. Equal ids of a large group are counted before the join, and
    the join is taken over slices of ``a`` that give a bounded number of rows.
    """
    n = len(of_group)
    sizes = [np.bincount(t["group"].to_numpy(), minlength=n) for t in (a, b)]
    large = pa.array(sizes[0] * sizes[1] > LARGE_GROUP)
    a, b = (counted(t, large.take(t["group"])) for t in (a, b))
    fan = np.bincount(b["group"].to_numpy(), minlength=n)[a["group"].to_numpy()]
    order = np.argsort(a["group"].to_numpy(), kind="stable")
    a, cuts = a.take(pa.array(order)), np.cumsum(fan[order]) // JOIN_ROWS
    parts = []
    for part in np.split(np.arange(len(order)), np.flatnonzero(np.diff(cuts)) + 1):
        left = a.take(pa.array(part))
        groups = left["group"]
        right = b if len(part) == len(order) else b.filter(pc.is_in(b["group"], value_set=groups.combine_chunks().unique()))
        pairs = left.join(right, "group", join_type="inner", right_suffix="_b", use_threads=False)
        pair = pc.add(pc.multiply(pairs["id"].cast(pa.int64()), width), pairs["id_b"].cast(pa.int64()))
        times = pc.multiply(pairs["count_all"], pairs["count_all_b"])
        seen = pa.table({"doc": of_group.take(pairs["group"].combine_chunks()), "pair": pair, "times": times})
        parts.append(seen.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")]))
    if len(parts) == 1:
        return parts[0].rename_columns(["doc", "pair", "times"])
    whole = pa.concat_tables(parts).group_by(["doc", "pair"], use_threads=False).aggregate([("times_sum", "sum")])
    return whole.rename_columns(["doc", "pair", "times"])


def digests(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, ends: np.ndarray, tables: Loaded) -> list[str]:
    """SHA-256 of each document's groups written out; ``ends`` has the number of tokens up to each document."""
    n_a, n_b = len(tables.bytes_a), len(tables.bytes_b)
    last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (group_a, group_b))
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = a + n_a * last_a
    order[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * n_a + b + n_b * last_b
    data, at = text_bytes(tables.written_as.take(pa.array(order)))
    edges = at[np.concatenate([[0], ends])]
    return ["" if s == e else hashlib.sha256(data[s : e - 1].data).hexdigest() for s, e in zip(edges[:-1], edges[1:], strict=True)]


def align_block(texts: pa.Array, tables: Loaded) -> tuple[dict[str, np.ndarray | list], pa.Table]:
    """Columns of the documents (without corpus-wide counts) and the links (doc, pair, times) of some texts."""
    n = len(texts)
    asked = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    some = texts.filter(asked)
    spaced = pc.binary_join_element_wise(pa.scalar(" "), some, pa.scalar(""))
    data, offsets = text_bytes(spaced)
    first, second = (tokens(ids, pieces) for ids, pieces in zip(tables.encode(some), (tables.bytes_a, tables.bytes_b), strict=True))
    good = spelled(first, tables.bytes_a, data, offsets) & spelled(second, tables.bytes_b, data, offsets)
    mask = pa.array(good)
    first, second = (t.filter(mask.take(t["doc"])) for t in (first, second))
    # The place of a token's end is its document and byte in one number.
    ends = [pa.table({"at": pc.add(pc.multiply(t["doc"].cast(pa.int64()), 1 << 40), t["end"])}) for t in (first, second)]
    common = np.sort(ends[0].join(ends[1], "at", join_type="inner", use_threads=False)["at"].to_numpy())
    cut_doc = common >> 40
    cut = offsets[cut_doc] + (common & ((1 << 40) - 1))
    out: dict[str, np.ndarray | list] = {}
    rows = np.flatnonzero(asked.to_numpy(zero_copy_only=False))
    grouped, per_doc = [], []
    for name, t in (("n_a", first), ("n_b", second)):
        doc = t["doc"].to_numpy()
        group = np.searchsorted(cut, offsets[doc] + t["end"].to_numpy())
        grouped.append((t["id"].to_numpy(), group))
        per_doc.append(np.bincount(doc, minlength=len(some)))
        out[name] = np.zeros(n, np.int64)
        out[name][rows] = per_doc[-1]
    (ids_a, group_a), (ids_b, group_b) = grouped
    found = digests(ids_a, ids_b, group_a, group_b, np.cumsum(per_doc[0] + per_doc[1]), tables)
    sha = np.full(n, "", object)
    sha[rows] = found
    links = linked(
        pa.table({"group": group_a, "id": ids_a}), pa.table({"group": group_b, "id": ids_b}), pa.array(rows[cut_doc]), len(tables.bytes_b)
    )
    out["n_groups"] = np.bincount(rows[cut_doc], minlength=n)
    out["n_links"] = np.bincount(links["doc"].to_numpy(), links["times"].to_numpy(), minlength=n).astype(np.int64)
    out["groups_sha256"] = sha.tolist()
    return out, links


def positions(links: pa.Table, n: int) -> tuple[pa.Table, pa.Array, pa.Array]:
    """The distinct pairs of a block, most frequent first, with their number of documents, and for each of ``n``
    documents the list of its pairs' positions in that table and of how often it links them."""
    pairs = links.group_by("pair", use_threads=False).aggregate([("doc", "count")]).sort_by([("doc_count", "descending"), ("pair", "ascending")])
    at = pc.index_in(links["pair"].combine_chunks(), value_set=pairs["pair"].combine_chunks())
    doc = links["doc"].to_numpy()
    order = np.lexsort((at.to_numpy(), doc))
    edges = pa.array(np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(edges, pa.array(x[order].astype(np.int32))) for x in (at.to_numpy(), links["times"].to_numpy())]
    return pairs, *lists


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pair: Pair = Pair()) -> tuple[DataFrame, DataFrame]:
    """Align two tokenizations of each whole text and count linked id pairs over all documents.

    Tasks tokenize blocks of texts and go on with Arrow: token lists are flattened with their parent indices,
    segmented cumulative sums give the byte that each token ends before, a hash join on (document, end) gives
    the cuts at which both tokenizers end a token, a join on the group gives the links, and ``Table.group_by``
    counts them for each document and the number of documents for each pair. Spark adds the counts of all blocks
    by pair and sends each block the totals of its own pairs only.

    Null, empty and misspelled texts (joined token bytes differ from space + text) have no tokens: zeros and an
    empty ``groups_sha256``. Every row counts as a document of its own, so repeated ids and texts repeat their
    result and are counted again; a null id stays null. Ties for an id's best count are all best. A text longer
    than a block is a block of its own; a task holds about 100 bytes for each byte of a block. Other columns are
    ignored. An empty table gives no rows.

    Returns (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and the pair table
    (id_a, id_b, n_docs, best).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    lists = "pairs array<int>, times array<int>, dictionary array<long>, dictionary_docs array<int>"
    shape = f"`{id_col}` {kind}, block long, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, {lists}"
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def tokenize(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            tables = worker_tables(pair)
            _, offsets = text_bytes(batch.column(1))
            for i, j in blocks(offsets, BLOCK_BYTES):
                n, block = j - i, block + 1
                columns, links = align_block(batch.column(1).slice(i, n), tables)
                known, at, times = positions(links, n)
                held = [pa.array(columns[c]) for c in (*COUNTS, "groups_sha256")]
                none = [pa.nulls(n, longs), pa.nulls(n, ints)]
                names = [id_col, "block", *COUNTS, "groups_sha256", "pairs", "times", "dictionary", "dictionary_docs"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.repeat(pa.scalar(block), n), *held, at, times, *none], names)
                ends = pa.array([0, len(known)], pa.int32())
                entries = [
                    pa.ListArray.from_arrays(ends, known["pair"].combine_chunks()),
                    pa.ListArray.from_arrays(ends, known["doc_count"].combine_chunks().cast(pa.int32())),
                ]
                empty = [pa.nulls(1, batch.column(0).type), pa.array([block]), *[pa.nulls(1, pa.int64())] * len(COUNTS), pa.nulls(1, pa.string())]
                yield pa.RecordBatch.from_arrays([*empty, pa.nulls(1, ints), pa.nulls(1, ints), *entries], names)

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_"))
    aligned = written(rows.mapInArrow(tokenize, shape), "alignment")

    small, width = vocabulary_sizes(pair)
    width = F.lit(width).cast("long")
    entries = aligned.where("dictionary IS NOT NULL").select(
        "block", F.posexplode(F.arrays_zip("dictionary", "dictionary_docs")).alias("at", "entry")
    )
    entries = entries.select("block", "at", F.col("entry.dictionary").alias("pair"), F.col("entry.dictionary_docs").alias("docs"))
    counted = entries.withColumn("n_docs", F.sum("docs").over(Window.partitionBy("pair")))
    first = F.expr("pair div width")
    most = counted.withColumn("width", width).groupBy(first.alias("id_a")).agg(F.max("n_docs").alias("most"))
    if small <= SMALL_VOCABULARY:
        most = F.broadcast(most)
    counted = counted.withColumn("width", width).withColumn("id_a", first)
    counted = counted.join(most, "id_a").withColumn("best", F.col("n_docs") == F.col("most"))

    def totals(left: pa.Table, right: pa.Table) -> pa.Table:
        n_docs, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        at = right["at"].to_numpy()
        n_docs[at], best[at] = right["n_docs"].to_numpy(), right["best"].to_numpy()
        pairs, times = left["pairs"].combine_chunks(), left["times"].combine_chunks()
        doc = pc.list_parent_indices(pairs).to_numpy()
        at, times = pc.list_flatten(pairs).to_numpy(), pc.list_flatten(times).to_numpy().astype(np.int64)
        sums = []
        for x in (best, n_docs):
            out = np.zeros(left.num_rows, np.int64)
            np.add.at(out, doc, times * x[at])
            sums.append(pa.array(out))
        return pa.table(
            [left[id_col], *[left[c] for c in COUNTS], *sums, left["groups_sha256"]], [id_col, *COUNTS, "n_best", "count_sum", "groups_sha256"]
        )

    shown = f"`{id_col}` {kind}, {', '.join(f'{c} long' for c in COUNTS)}, n_best long, count_sum long, groups_sha256 string"
    own = aligned.where("n_a IS NOT NULL").drop("dictionary", "dictionary_docs")
    sent = counted.select(F.col("block").alias("of_block"), "at", "n_docs", F.col("best").cast("int").alias("best"))
    rows = own.groupBy("block").cogroup(sent.groupBy("of_block")).applyInArrow(totals, shown)
    table = counted.select("id_a", (F.col("pair") % width).alias("id_b"), "n_docs", "best").distinct()
    return rows, table
