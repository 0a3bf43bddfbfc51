"""A Bloom filter of bounded size over a column of 64-bit hashes, built by tasks and merged by pieces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PIECE = 1 << 16
LEAST_BITS, MOST_BITS = 13, 26


def _probes(keys: np.ndarray, log_bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << log_bits) - 1)
    return [(keys >> np.uint64(s)) & mask for s in (0, 19, 38)]


class Bloom:
    """May say yes for a key that was not added, never no for one that was. At most 8 MB."""

    def __init__(self, bits: np.ndarray, log_bits: int) -> None:
        self.bits, self.log_bits = bits, log_bits

    def test(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        hit = np.ones(len(keys), bool)
        for p in _probes(keys, self.log_bits):
            hit &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
        return hit


def bloom(hashes: DataFrame, n: int) -> Bloom:
    """Filter over the one long column of ``hashes``; ``n`` is about how many distinct values it has.

    The size follows ``n`` up to 8 MB. With more keys it lets more pass, which costs time but no result.
    """
    log_bits = min(MOST_BITS, max(LEAST_BITS, int(max(1, n) * 32 - 1).bit_length()))
    size = (1 << log_bits) // 8
    column = hashes.columns[0]

    def collect(batches):
        bits = np.zeros(1 << log_bits, bool)
        for batch in batches:
            for p in _probes(batch[column].to_numpy(np.int64).view(np.uint64), log_bits):
                bits[p] = True
        packed = np.packbits(bits, bitorder="little")
        pieces = [(i // PIECE, packed[i : i + PIECE]) for i in range(0, size, PIECE)]
        pieces = [(i, x.tobytes()) for i, x in pieces if x.any()]
        yield pd.DataFrame({"piece": [i for i, _ in pieces], "data": [x for _, x in pieces]})

    def merge(group):
        total = np.bitwise_or.reduce(np.stack([np.frombuffer(x, np.uint8) for x in group["data"]]))
        return pd.DataFrame({"piece": group["piece"].iloc[:1], "data": [total.tobytes()]})

    kind = "piece int, data binary"
    parts = hashes.mapInPandas(collect, kind).groupBy("piece").applyInPandas(merge, kind)
    bits = np.zeros(size, np.uint8)
    # At most 8 MB, in one job: fetched partition by partition, each would be a job of its own.
    for row in parts.collect():
        bits[row["piece"] * PIECE : row["piece"] * PIECE + len(row["data"])] = np.frombuffer(row["data"], np.uint8)
    return Bloom(bits, log_bits)
