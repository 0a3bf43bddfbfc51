"""Spelling variants: words one edit apart meet as prefix ranges of sorted rotations."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomrec.llm.common import kept

RUN = re.compile("[A-Za-zÀ-ÿ]+")
MARK = "$"
LEAST_LENGTH, LEAST_COUNT = 5, 3
DROP_EVERY = 97
WRITTEN_LENGTH = 48
HELD_WORDS, HELD_CHARACTERS = 200_000, 8 << 20
FAR = np.iinfo(np.int64).max
PRIME, BASE = (1 << 127) - 1, 0x1F3D5B79_9C0FFEE3_A7D1B2C4_5E6F8091


def observed(run: str, prefix: int) -> str:
    """The run, or without one code point where the checksum of ``<id>:<run>`` says so."""
    h = zlib.crc32(run.encode(), prefix)
    if h % DROP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) over all whole texts. Tasks add up what they have seen before anything is shuffled."""

    def count(batches):
        held: dict[str, int] = {}
        size = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                prefix = zlib.crc32(f"{key.as_py() if key.is_valid else ''}:".encode())
                plain = text.as_py().encode().lower().decode()
                for run, n in Counter(RUN.findall(plain)).items():
                    word = observed(run, prefix) if len(run) >= least_length else ""
                    if len(word) >= least_length:
                        if word not in held:
                            size += len(word)
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS or size > HELD_CHARACTERS:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("string").alias("key_"), F.col(text_col).cast("string").alias("text_"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Rotations:
    """Rotations of a marked word as strings, or beyond a length as polynomial digests from prefix sums, so
    that a word of n characters costs n short keys and not n * n characters."""

    def __init__(self, word: str) -> None:
        self.word, self.size = word, len(word)
        if self.size >= WRITTEN_LENGTH:
            self.sums, self.powers = [0], [1]
            for c in word:
                self.sums.append((self.sums[-1] * BASE + ord(c)) % PRIME)
                self.powers.append(self.powers[-1] * BASE % PRIME)

    def key(self, head: int, tail: int) -> str:
        """word[head:] + mark + word[:tail]."""
        length = self.size - head + 1 + tail
        if length <= WRITTEN_LENGTH:
            return self.word[head:] + MARK + self.word[:tail]
        front = (self.sums[-1] - self.sums[head] * self.powers[self.size - head]) % PRIME
        both = ((front * BASE + ord(MARK)) * self.powers[tail] + self.sums[tail]) % PRIME
        return f"{length}:{both:032x}"


def rotation_keys(batches):
    """For each word (wid, word, n): its rotations as they are (``kind`` 0), and each rotation but its last
    character, which is the edited one (1; 2 for the last of equal neighbours, at which alone it counts as
    inserted, so that no pair of words meets twice)."""
    names = ["key", "kind", "wid", "n"]

    def rows(keys, kinds, wids, ns):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.int8()), pa.array(wids, pa.int64()), pa.array(ns, pa.int64())], names)

    for batch in batches:
        out = keys, kinds, wids, ns = [], [], [], []
        for wid, word, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            word = word.as_py()
            turns, size = Rotations(word), len(word)
            for i in range(size + 1):
                keys.append(turns.key(i, i))
                kinds.append(0)
                if i < size:
                    keys.append(turns.key(i + 1, i))
                    kinds.append(2 if i + 1 == size or word[i + 1] != word[i] else 1)
                if len(keys) > HELD_WORDS:
                    more = len(keys) - len(wids)
                    wids.extend([wid] * more)
                    ns.extend([n] * more)
                    yield rows(*out)
                    for x in out:
                        x.clear()
            more = len(keys) - len(wids)
            wids.extend([wid] * more)
            ns.extend([n] * more)
        if keys:
            yield rows(*out)


def neighbours(starts: np.ndarray, kind: np.ndarray, wid: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(wid, near, best n, best wid) of each row with near words in its group, from groups of equal keys.

    Rows that skip a character are replacements of each other, and those of kind 2 are the word of kind 0 with
    a character inserted. A group has one row for each character and one word of kind 0 at most. Instead of
    pairs each row gets how many near words it has here, and the largest.
    """
    group = np.cumsum(np.bincount(starts, minlength=len(kind))[: len(kind)]) - 1
    order = np.lexsort((wid, -n))
    rank = np.empty(len(n), np.int64)
    rank[order] = np.arange(len(n))
    skips, inserts, whole = kind > 0, kind == 2, kind == 0
    least = lambda which: np.minimum.reduceat(np.where(which, rank, FAR), starts)
    total = lambda which: np.add.reduceat(which.astype(np.int64), starts)
    first = least(skips)[group]
    second = least(skips & (rank != first))[group]
    best = np.where(skips, np.where(rank == first, second, first), least(inserts)[group])
    best = np.where(inserts, np.minimum(best, least(whole)[group]), best)
    near = np.where(skips, total(skips)[group] - 1 + inserts * total(whole)[group], total(inserts)[group])
    some = near > 0
    chosen = order[best[some]]
    return wid[some], near[some], n[chosen], wid[chosen]


def scan_groups(batches):
    """Go through rows sorted by key; the group at the end of a batch waits for the next batch."""
    names = ["wid", "near", "best_n", "best_wid"]
    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        keys = table["key"].combine_chunks()
        fresh = np.ones(len(keys), bool)
        fresh[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(fresh)
        waiting = table.slice(starts[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _scanned(table.slice(0, starts[-1]), starts[:-1])], names)
    if waiting is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _scanned(waiting, np.zeros(1, np.int64))], names)


def _scanned(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """``neighbours`` of the groups with more than one row."""
    columns = [table[c].to_numpy() for c in ("kind", "wid", "n")]
    sizes = np.diff(starts, append=table.num_rows)
    several = np.repeat(sizes > 1, sizes)
    if not several.any():
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    sizes = sizes[sizes > 1]
    return neighbours(np.cumsum(sizes) - sizes, *[c[several] for c in columns])


def near_words(words: DataFrame) -> DataFrame:
    """(wid, n_near, best_n, best_wid) of each of the words (wid, word, n) that has a near word.

    All rotations of the marked words are sorted, each also without the character that a rotation ends with:
    the words of one prefix range differ in that character only. Tasks scan the ranges.
    """
    keys = words.select("wid", "word", "n").mapInArrow(rotation_keys, "key string, kind byte, wid long, n long")
    ranges = keys.repartition("key").sortWithinPartitions("key")
    found = ranges.mapInArrow(scan_groups, "wid long, near long, best_n long, best_wid long")
    best = F.max(F.struct("best_n", (-F.col("best_wid")).alias("back")))
    return found.groupBy("wid").agg(F.sum("near").alias("n_near"), best.alias("best")).select(
        "wid", "n_near", F.col("best.best_n").alias("best_n"), (-F.col("best.back")).alias("best_wid")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(wid, root) from (wid, form), a form being more frequent than its word: each round doubles the steps."""
    steps = kept(forms.select("wid", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while steps.where("moved").head(1):
        ahead = steps.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        steps = steps.join(ahead, "root", "left")
        steps = kept(steps.select("wid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return steps.select("wid", "root")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """Words of all whole texts with their near words (one code point inserted, deleted or replaced), the form
    that each is a variant of, and the root that forms lead to.

    Words are sorted by code points once and numbered in that order; rotations and links carry numbers. The
    words of a prefix range differ in one character, so a range is no larger than the alphabet, and each gives
    its words counts and the largest near word, not pairs.

    Null texts and texts without letters have no words. A null id counts as the empty string. Repeated rows
    count again. Ties for the largest near word go to the first in code-point order. Very long runs are words
    like others: their rotations are keyed by 127-bit digests. An empty table gives no rows; other columns
    are ignored.

    Returns (word, form, root, n, n_near, form_n).
    """
    counts = kept(word_counts(docs, id_col, text_col, least_length).where(F.col("n") >= least_count))
    words = kept(counts.orderBy("word").select(F.monotonically_increasing_id().alias("wid"), "word", "n"))
    near = kept(near_words(words))
    joined = words.join(near, "wid", "left")
    forms = near.join(words.select("wid", "n"), "wid").where("best_n >= 2 * n").select("wid", F.col("best_wid").alias("form"), F.col("best_n").alias("form_n"))
    forms = kept(forms)
    name = lambda new: words.select(F.col("wid").alias(new), F.col("word").alias(f"{new}_word"))
    told = forms.join(roots(forms), "wid").join(name("form"), "form").join(name("root"), "root")
    told = told.select("wid", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "form_n")
    return joined.join(told, "wid", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )
