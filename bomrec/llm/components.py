"""Connected components of a link table: forests inside tasks first, label passing for what is left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomrec.llm.common import kept

STEP = 1 << 20
#: So many links of a forest (16 bytes each) are finished by one task; more of them by rounds of joins.
ONE_TASK = 1 << 20


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that links a - b lead to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links a - b but the least of each component, with that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = least_linked(len(nodes), at[: len(a)], at[len(a) :])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def forests(batches):
    """The forest of all links that a task sees, from which the links seen so far are dropped as it grows."""
    held, size, known = [], 0, 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > STEP + 2 * known:
            held = [forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            size = known = len(held[0][0])
    if size:
        a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["node", "label"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b) of longs; the label is the least node that links lead to.

    Each task replaces its links by a forest of stars. If the stars of all tasks are few they meet in one
    task; else nodes take, in rounds, the least label among their neighbours and then the label of their
    label, so chains halve. Rounds are joins and combinable minima; no node's neighbours are ever listed.
    """
    shape = "node long, label long"
    stars = kept(links.select("a", "b").mapInArrow(forests, shape))
    roots = F.inline(F.array(F.struct("node", "label"), F.struct(F.col("label").alias("node"), "label")))
    if stars.count() <= ONE_TASK:
        return kept(stars.coalesce(1).mapInArrow(forests, shape).select(roots).distinct())
    edges = stars.select(F.col("node").alias("a"), F.col("label").alias("b"))
    edges = kept(edges.union(edges.select("b", "a")).distinct().toDF("node", "other"))
    labels = kept(edges.groupBy("node").agg(F.min("other").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        near = edges.join(labels.toDF("other", "seen"), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        taken = labels.join(near, "node").select("node", F.least("label", "seen").alias("step"), F.col("label").alias("was"))
        new = taken.select(F.col("node").alias("step"), F.col("step").alias("label"))
        new = kept(taken.join(new, "step").select("node", "label", (F.col("label") != F.col("was")).alias("moved")))
        labels = new.select("node", "label")
        if not new.where("moved").head(1):
            return labels
