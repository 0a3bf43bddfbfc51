"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomrec.llm.common import fresh, seeded_order
from bomrec.llm.tokens import Alphabet, Words, blocks, mixed, text_bytes

LOG_WORDS = 14
DIMS = 48
WIDTH = 2 * DIMS + 2
WINDOW = 2
PIECE = 1 << 10
STRIDE = 1 << 16
#: Bound on the labelled rows that the network is fitted on.
SAMPLE = 20_000


def _kinds() -> np.ndarray:
    """0 white space, 1 lower-case letters and bytes beyond ASCII, 2 upper-case letters, 3 digits, 4 the rest."""
    kind = np.full(256, 4, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = 0
    kind[97:123] = kind[0x80:] = 1
    kind[65:91], kind[48:58] = 2, 3
    return kind


KIND = _kinds()
VISIBLE = Alphabet(KIND > 0, lower=False)


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary cells of the words of each text, and where each text's words begin.

    A word is a run between white space, and its cell the hash of its shape together with its letters:
    letters of words of lower case count, other words go by their shape, the kinds of character that
    they run through. So capitals, symbols and digits stuck to invented words fall into shared cells.
    """
    words = Words(data, offsets, VISIBLE)
    if not len(words.start):
        return np.zeros(0, np.int64), words.first
    kind = KIND[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[words.start] = True
    size = words.end - words.start
    turn = (kind.astype(np.uint64) + np.uint64(1)) * change
    at = np.arange(len(data))
    owner = np.clip(np.searchsorted(words.start, at, "right") - 1, 0, None)
    nth = np.concatenate([[0], np.cumsum(change)])
    place = nth[:-1] - nth[words.start[owner]]
    weight = mixed((place.astype(np.uint64) << np.uint64(8)) + turn) * change
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight, dtype=np.uint64)])
    shape = total[words.end] - total[words.start]
    low = np.concatenate([[0], np.cumsum((kind == 1).astype(np.int64))])
    plain = (low[words.end] - low[words.start]) >= size - 1
    cell = mixed(np.where(plain, words.hashes(), shape * np.uint64(3) + np.uint64(7)))
    return (cell >> np.uint64(64 - LOG_WORDS)).astype(np.int64), words.first


def index_vectors(seed: int = 5, nonzero: int = 4) -> np.ndarray:
    """The random index vector of each cell: ``nonzero`` places of +1 or -1, from a seeded hash."""
    cells = np.arange(1 << LOG_WORDS, dtype=np.uint64)
    out = np.zeros((1 << LOG_WORDS, DIMS), np.float32)
    for i in range(nonzero):
        h = mixed(cells * np.uint64(nonzero) + np.uint64(i) + np.uint64(seed << 32))
        np.add.at(out, (cells.astype(np.int64), (h % np.uint64(DIMS)).astype(np.int64)), np.where(h >> np.uint64(63), 1, -1))
    return out


def context_sums(ids: np.ndarray, first: np.ndarray, index: np.ndarray, total: np.ndarray) -> None:
    """Add to each word's row the index vectors of the words up to ``WINDOW`` before and after it."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for begin in range(0, len(ids), STRIDE):
        lo, hi = max(0, begin - WINDOW), min(len(ids), begin + STRIDE + WINDOW)
        cells, texts = ids[lo:hi], text[lo:hi]
        near = np.zeros((hi - lo, DIMS), np.float32)
        for d in range(1, min(WINDOW + 1, hi - lo)):
            same = (texts[d:] == texts[:-d])[:, None]
            near[d:] += index[cells[:-d]] * same
            near[:-d] += index[cells[d:]] * same
        own = slice(begin - lo, min(begin + STRIDE, len(ids)) - lo)
        order = np.argsort(cells[own], kind="stable")
        found, starts = np.unique(cells[own][order], return_index=True)
        total[found] += np.add.reduceat(near[own][order], starts, axis=0)


def word_vectors(docs: DataFrame, text_col: str, index: np.ndarray) -> np.ndarray:
    """Random indexing over all texts: unit context vectors of all cells, summed over tasks by pieces."""

    def scan(batches):
        total = np.zeros((1 << LOG_WORDS, DIMS))
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in blocks(offsets):
                context_sums(*word_ids(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), index, total)
        pieces = [(p, total[p * PIECE : (p + 1) * PIECE]) for p in range((1 << LOG_WORDS) // PIECE)]
        # Sums of +1 and -1 are whole numbers: their order cannot change them.
        pieces = [(p, pa.compress(np.rint(x).astype(np.int64).tobytes(), codec="zstd", asbytes=True)) for p, x in pieces if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pieces], pa.int32()), pa.array([x for _, x in pieces], pa.binary())], ["piece", "sums"])

    def add(group):
        size = 8 * PIECE * DIMS
        total = np.sum([np.frombuffer(pa.decompress(x, size, "zstd", asbytes=True), np.int64) for x in group["sums"]], axis=0)
        return pd.DataFrame({"piece": group["piece"].iloc[:1], "sums": [pa.compress(total.tobytes(), codec="zstd", asbytes=True)]})

    kind = "piece int, sums binary"
    parts = docs.select(F.col(text_col).cast("string").alias("text_")).mapInArrow(scan, kind)
    halfway = parts.groupBy("piece", (F.spark_partition_id() % 16).alias("part")).applyInPandas(add, kind)
    vectors = np.zeros((1 << LOG_WORDS, DIMS))
    for row in halfway.groupBy("piece").applyInPandas(add, kind).toLocalIterator():
        sums = np.frombuffer(pa.decompress(row["sums"], 8 * PIECE * DIMS, "zstd", asbytes=True), np.int64)
        vectors[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] = sums.reshape(PIECE, DIMS)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Per text the mean and the spread of its words' vectors, how often a vector repeats the one before
    it, and the length on a log scale."""
    ids, first = word_ids(data, offsets)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    sums = np.zeros((2, len(n), DIMS))
    for begin in range(0, len(ids), STRIDE):
        v = vectors[ids[begin : begin + STRIDE]]
        texts, starts = np.unique(text[begin : begin + STRIDE], return_index=True)
        sums[0, texts] += np.add.reduceat(v, starts, axis=0)
        sums[1, texts] += np.add.reduceat(v * v, starts, axis=0)
    mean, square = sums / np.maximum(n, 1)[:, None]
    spread = np.sqrt(np.maximum(square - mean * mean, 0))
    same = (ids[1:] == ids[:-1]) & (text[1:] == text[:-1])
    repeats = np.bincount(text[1:][same], minlength=len(n)) / np.maximum(n - 1, 1)
    return np.concatenate([mean, spread, repeats[:, None], np.log1p(n)[:, None] / 10], axis=1).astype(np.float32)


@dataclass
class Network:
    """Two layers over standardised features; logits are divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, steps: int = 1500, seed: int = 9) -> Network:
    """Train by Adam on four fifths of the rows; on the last fifth choose the temperature that its likelihood favours.

    With one class only, or no rows at all, the score is that class's smoothed share.
    """
    if len(y) < 10 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    cut = max(1, len(y) // 5)
    hold, train = order[:cut], order[cut:]
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-4
    net = Network(mean, scale, draw.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), draw.normal(0, hidden**-0.5, hidden), 0.0)
    z, t = (x[train] - mean) / scale, y[train].astype(float)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        rows = draw.integers(0, len(t), min(512, len(t)))
        a = z[rows] @ params[0] + params[1]
        h = np.maximum(a, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -60, 60)))
        d = (p - t[rows]) / len(rows)
        back = np.outer(d, params[2]) * (a > 0)
        grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
        for w, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, *params[:3], float(params[3][0]))
    logits, truth = net.logit(x[hold]), y[hold]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    losses = [np.mean(np.logaddexp(0, np.where(truth > 0, -1, 1) * logits / c)) for c in grid]
    net.temperature = float(grid[int(np.argmin(losses))])
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    cut: float = 0.3, sample: int = SAMPLE, corpus: DataFrame | None = None,
) -> DataFrame:
    """Score each whole text: how likely its label is 1.

    Word vectors come from the contexts of all texts of ``corpus`` (by default the documents): every
    vocabulary cell sums the sparse random vectors of its neighbours. A text is the mean and spread of
    its words' vectors. A two-layer network is fitted on the labelled rows, at most ``sample`` of them by
    a seeded order of their ids, and its probabilities are calibrated by one temperature on rows it was not
    trained on. All else covers every row.

    ``labels`` has (id, label) of the rows to learn from; null labels are left out, of several labels of
    an id the least counts. Null and empty texts have no words and are scored as such. Without labels, or
    with one class, all scores are that class's smoothed share. Rows that repeat an id are scored row by
    row; an empty table gives no rows. Other columns are ignored.

    Returns (id, score, predicted), predicted being 1 from a score of ``cut`` on.
    """
    index = index_vectors()
    vectors = word_vectors(docs if corpus is None else corpus, text_col, index)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"))
    known = known.orderBy(seeded_order(F.col(id_col), 13), id_col).limit(sample)

    def features(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in blocks(offsets):
                x = pooled(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], vectors)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())],
                    ["id", "label", "x"],
                )

    id_kind = docs.schema[id_col].dataType.simpleString()
    # The sample has a bound, so it may be sent to all tasks.
    joined = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_")).join(F.broadcast(known), id_col)
    rows = joined.mapInArrow(features, f"id {id_kind}, label int, x binary").dropDuplicates(["id"]).collect()
    rows.sort(key=lambda r: str(r["id"]))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(float) if rows else np.zeros((0, WIDTH))
    net = fit(x, np.array([r["label"] for r in rows], int))

    def judge(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            scores = [np.zeros(0)]
            for i, j in blocks(offsets):
                scores.append(net.score(pooled(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], vectors)))
            score = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32))], [id_col, "score", "predicted"]
            )

    whole = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(fresh(docs, "text_")[0]))
    return whole.mapInArrow(judge, f"`{id_col}` {id_kind}, score double, predicted int")
