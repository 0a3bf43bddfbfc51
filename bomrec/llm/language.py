"""Language identification with error-correcting output codes over byte n-grams."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomrec.llm.common import fresh
from bomrec.llm.tokens import mixed, pieces, text_bytes

ORDERS = (1, 2, 3)
LOG_FEATURES = 14
PIECE = 1 << 16
UNKNOWN = "und"
PREDICTED = "lang_pred string, score double, ambiguous boolean"


def codewords(n: int, seed: int = 3, random_bits: int = 31) -> np.ndarray:
    """A code of +1/-1 words, one for each of n languages; equal seeds give equal codes.

    Up to five languages: the exhaustive code, all 2**(n-1) - 1 different splits. More: of many random
    codes the one whose nearest two words (and complements) lie furthest apart.
    """
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, float).T
    draw = np.random.default_rng(seed)
    best, apart = None, -1
    bits = max(random_bits, 4 * int(np.ceil(np.log2(n))))
    for _ in range(200):
        code = draw.choice([-1.0, 1.0], size=(n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        gap = code @ code.T
        np.fill_diagonal(gap, -code.shape[1])
        nearest = (code.shape[1] - gap.max()) / 2
        if nearest > apart:
            best, apart = code, nearest
    return best


def features(data: np.ndarray, offsets: np.ndarray, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams that end at each byte of the texts: (orders, bytes) ids, and what to leave out.

    Bytes other than letters count as one space each; n-grams do not reach over the begin of a text.
    The first ``lead`` bytes are context only.
    """
    folded = np.where((data >= 0x80) | ((data | 0x20) >= 97) & ((data | 0x20) <= 122), data, 32).astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    ids = np.empty((len(ORDERS), len(data)), np.int32)
    out = np.empty((len(ORDERS), len(data)), bool)
    code = np.zeros(len(data), np.uint64)
    for k in range(max(ORDERS)):
        code[k:] += folded[: len(data) - k] << np.uint64(8 * k)
        if k + 1 in ORDERS:
            i = ORDERS.index(k + 1)
            ids[i] = (mixed(code + np.uint64((k + 1) << 40)) >> np.uint64(64 - LOG_FEATURES)).astype(np.int32)
            out[i] = (place < k) | (folded == 32) & (k == 0)
            out[i, :lead] = True
    return ids, out


class Model:
    """One weight table for each bit, the bits' reliabilities, and the codewords."""

    def __init__(self, counts: dict[str, np.ndarray], sharpness: float = 3.0) -> None:
        """``counts``: per language how often each feature occurs, over all training rows.

        The classifier of a bit is the log ratio of an n-gram's share among the languages whose codeword
        has a 1 there to its share among the others, each language weighing alike. Its expected margin
        for a text of each language follows from the counts. Margins are divided by the bit's mean
        expected margin, and a bit's loss is weighted by its least expected margin over the languages.
        """
        self.languages = sorted(counts)
        n = len(self.languages)
        self.code = codewords(n)
        shares = np.stack([counts[c] + 0.5 for c in self.languages]) if n else np.zeros((0, 1))
        shares = shares / shares.sum(axis=1, keepdims=True)
        if n < 2:
            self.weights = np.zeros((1 << LOG_FEATURES, 1), np.float32)
            self.reliability = np.ones(1)
        else:
            one = np.stack([shares[col > 0].mean(axis=0) for col in self.code.T])
            zero = np.stack([shares[col < 0].mean(axis=0) for col in self.code.T])
            logs = np.log(one / zero)
            expected = shares @ logs.T * self.code
            scale = np.maximum(np.abs(expected).mean(axis=0), 1e-9)
            self.weights = (logs / scale[:, None]).T.astype(np.float32)
            least = np.maximum((expected / scale).min(axis=0), 0.05)
            self.reliability = least / least.sum()
        self.sharpness = sharpness

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text the mean margin of each bit over its n-grams."""
        n, bits = len(offsets) - 1, self.weights.shape[1]
        sums, used = np.zeros((n, bits)), np.zeros(n)
        for i, j, begin, stop, lead in pieces(offsets, PIECE):
            ends = np.clip(offsets[i : j + 1], begin, stop) - begin
            ids, left_out = features(data[begin:stop], ends, lead)
            steps = np.zeros((stop - begin, bits), np.float32)
            for f, skip in zip(ids, left_out, strict=True):
                w = self.weights[f]
                w[skip] = 0
                steps += w
            total = np.zeros((stop - begin + 1, bits))
            np.cumsum(steps, axis=0, out=total[1:])
            seen = np.concatenate([[0], np.cumsum((~left_out).sum(axis=0))])
            sums[i:j] += total[ends[1:]] - total[ends[:-1]]
            used[i:j] += seen[ends[1:]] - seen[ends[:-1]]
        return sums / np.maximum(used, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword by weighted logistic loss, its probability, and whether the second is as near."""
        loss = np.log1p(np.exp(-np.clip(self.sharpness * self.code[None] * margins[:, None], -60, 60)))
        loss = (loss * self.reliability).sum(axis=2) * self.code.shape[1]
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        ordered = np.sort(loss, axis=1)
        close = (ordered[:, 1] - ordered[:, 0] < 0.05 * self.code.shape[1]) if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, p[np.arange(len(p)), best], close


def learn(rows: DataFrame, text_col: str, lang_col: str) -> Model:
    """Count n-grams by language over all given rows, in tasks, and fit the bits' classifiers from them.

    What is gathered is one fixed-size vector for each language.
    """
    size = 1 << LOG_FEATURES

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            data, offsets = text_bytes(batch.column(0))
            codes, kinds = pd.factorize(np.array(names, object))
            for i, j, begin, stop, lead in pieces(offsets):
                ends = np.clip(offsets[i : j + 1], begin, stop) - begin
                ids, skip = features(data[begin:stop], ends, lead)
                owner = np.repeat(codes[i:j], np.diff(ends)) * size
                for f, out in zip(ids, skip, strict=True):
                    seen = np.bincount((owner + f)[~out], minlength=size * len(kinds)).reshape(-1, size)
                    for c in np.flatnonzero(seen.any(axis=1)):
                        totals[kinds[c]] = totals.get(kinds[c], 0) + seen[c]
        vectors = [np.asarray(total, np.int64).tobytes() for total in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(vectors, pa.binary())], ["lang", "counts"])

    def add(group):
        total = np.sum([np.frombuffer(c, np.int64) for c in group["counts"]], axis=0)
        return pd.DataFrame({"lang": group["lang"].iloc[:1], "counts": [total.tobytes()]})

    parts = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(count, "lang string, counts binary")
    # Sums of task vectors in two steps, so that one language's vectors never meet in one task all at once.
    halfway = parts.groupBy("lang", F.spark_partition_id().alias("part") % 32).applyInPandas(add, "lang string, counts binary")
    found = halfway.groupBy("lang").applyInPandas(add, "lang string, counts binary").collect()
    return Model({r["lang"]: np.frombuffer(r["counts"], np.int64).astype(float) for r in found})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(
    docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Predict the language of each whole text; learn from the text and the non-null language of ``train``.

    Every language has a codeword; a binary n-gram classifier for each bit of the code judges all bytes
    of a text, and loss-weighted decoding picks the codeword nearest to the margins. ``score`` is that
    language's share of the exponentiated losses; ``ambiguous`` marks texts whose second codeword is
    about as near. Counting covers all training rows; the model has a fixed size for each language.

    A text that is null or has no letter is ``und`` with score 0. With no language learned all texts are
    ``und``; with one, texts with a letter have it with score 1. Repeated rows and ids are judged row by
    row. An empty table gives no rows. Extra columns, whatever their names, are kept.

    Appends lang_pred, score, ambiguous, which replace columns of these names.
    """
    made = ["lang_pred", "score", "ambiguous"]
    rows = docs.drop(*made)
    model = learn(train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), text_col, lang_col)
    keep = list(rows.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    n = len(keep)

    def predict(batches):
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            data, offsets = text_bytes(batch.column(n))
            letters = batch.column(n + 1).to_numpy(zero_copy_only=False).astype(bool)
            if model.languages:
                best, score, close = model.decode(model.margins(data, offsets))
            else:
                best, score, close = np.full(len(letters), -1), np.zeros(len(letters)), np.zeros(len(letters), bool)
            known = letters & (best >= 0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in range(n)], pa.array(names[np.where(known, best, len(names) - 1)], pa.string()),
                 pa.array(np.where(known, score, 0.0)), pa.array(known & close)],
                [*keep, *made],
            )

    text = F.col(text_col)
    whole, letter = fresh(rows, "whole_text", "has_letter")
    ready = rows.withColumns({whole: text, letter: F.coalesce(text.rlike(r"\p{L}"), F.lit(False))})
    return ready.mapInArrow(predict, f"{schema}, {PREDICTED}")
