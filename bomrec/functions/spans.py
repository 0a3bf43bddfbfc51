"""Occurrences of closed alias tables in text, longest alias first, no character used twice.

The scan stays inside the JVM: every table becomes one alternation (rarely two), each match is
fenced by a private-use mark, and splitting on that mark yields text and match pieces whose running
length gives the positions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from bomrec.functions import text as X

HIT_TYPE = "array<struct<text:string,start:int,end:int>>"
FENCE = "\ue010"
WORD_MASK = "\ue000"  # stands for a letter or digit that is already taken
GAP_MASK = "\ue001"  # stands for any other character that is already taken
MAX_ALIASES = 5000  # larger tables go through operators.detect.find_aliases_join


@dataclass(frozen=True)
class Alias:
    text: str
    value: str
    source: str = "client"
    entry_id: str | None = None


def quote(literal: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\/\-])", r"\\\1", literal)


def _overlaps_partially(a: str, b: str) -> bool:
    """True when a tail of one text can be the head of the other at word boundaries."""
    return any(
        left[-size:] == right[:size] and not left[-size - 1].isalnum() and not right[size].isalnum()
        for left, right in ((a, b), (b, a))
        for size in range(1, min(len(left), len(right)))
    )


def layers(texts: Sequence[str]) -> list[list[str]]:
    """Split texts, longest first, into groups in which leftmost match equals longest-first claims.

    Only aliases that can partially overlap must be tried one after the other.
    """
    ordered = sorted(dict.fromkeys(texts), key=len, reverse=True)
    groups: list[list[str]] = []
    for text in ordered:
        if groups and not any(_overlaps_partially(text, other) for other in groups[-1]):
            groups[-1].append(text)
        else:
            groups.append([text])
    return groups


def _prefix_tree(words: Sequence[str]) -> str:
    """Alternation factored by common prefixes, longest continuation first."""
    tails: dict[str, list[str]] = {}
    for word in words:
        if word:
            tails.setdefault(word[0], []).append(word[1:])
    if not tails:
        return ""
    body = "|".join(quote(head) + _prefix_tree(rest) for head, rest in sorted(tails.items()))
    if "" in words:
        return f"(?:{body})?"
    return body if len(tails) == 1 else f"(?:{body})"


def bounded(texts: Sequence[str]) -> str:
    """Pattern for any of the texts between word boundaries; the first-letter check comes first
    because it rejects most positions."""
    edge = f"[A-Z0-9{WORD_MASK}]"
    heads = "".join(sorted({quote(t[0]) for t in texts}))
    return f"(?=[{heads}])(?<!{edge})(?:{_prefix_tree(list(texts))})(?!{edge})"


def scan(text: Column, pattern: str | Column) -> Column:
    """All leftmost, non-overlapping matches of a pattern with their 0-based span."""
    if isinstance(pattern, str):
        pattern = F.lit(pattern)
    grouped = F.concat(F.lit("("), pattern, F.lit(")"))
    pieces = F.split(F.regexp_replace(text, grouped, F.lit(f"{FENCE}$1{FENCE}")), FENCE, -1)
    start = F.struct(
        F.lit(0).alias("pos"), F.lit(False).alias("inside"), F.array().cast(HIT_TYPE).alias("hits")
    )

    def step(acc: Column, piece: Column) -> Column:
        end = acc["pos"] + F.length(piece)
        hit = F.struct(piece.alias("text"), acc["pos"].alias("start"), end.alias("end"))
        hits = F.when(acc["inside"], F.concat(acc["hits"], F.array(hit))).otherwise(acc["hits"])
        return F.struct(end.alias("pos"), (~acc["inside"]).alias("inside"), hits.alias("hits"))

    return F.aggregate(pieces, start, step, lambda acc: acc["hits"])


def mask(text: Column, hits: Column, source: Column) -> Column:
    """Blank the spans of the hits, keeping the length and the word boundaries of the source."""

    def cover(acc: Column, hit: Column) -> Column:
        size = hit["end"] - hit["start"]
        piece = F.substring(source, hit["start"] + 1, size)
        piece = F.regexp_replace(piece, "[^A-Z0-9]", GAP_MASK)
        piece = F.regexp_replace(piece, "[A-Z0-9]", WORD_MASK)
        return F.overlay(acc, piece, hit["start"] + 1, size)

    return F.aggregate(hits, text, cover)


def find_texts(folded: Column, texts: Sequence[str]) -> Column:
    """Word-bounded occurrences of the folded texts, ordered by position."""
    if len(texts) > MAX_ALIASES:
        raise ValueError(f"{len(texts)} aliases exceed the inline bound {MAX_ALIASES}; use the join form")
    groups = layers([t for t in texts if t])
    if not groups:
        return F.array().cast(HIT_TYPE)

    def rest(text: Column, n: int) -> Column:
        hits = scan(text, bounded(groups[n]))
        if n + 1 == len(groups):
            return hits
        return X.let(
            hits, lambda h: F.concat(h, X.let(mask(text, h, folded), lambda t: rest(t, n + 1)))
        )

    return sort_hits(rest(folded, 0)) if len(groups) > 1 else rest(folded, 0)


def sort_hits(hits: Column) -> Column:
    def order(a: Column, b: Column) -> Column:
        return F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)

    return F.array_sort(hits, order)


def claim_longest(candidates: Column) -> Column:
    """Keep the longest of overlapping candidates; ties go to the earlier candidate."""
    ranked = F.array_sort(
        F.transform(
            candidates,
            lambda h, i: F.struct(
                (h["start"] - h["end"]).alias("rank"), i.alias("ord"),
                h["text"].alias("text"), h["start"].alias("start"), h["end"].alias("end"),
            ),
        )
    )

    def step(acc: Column, c: Column) -> Column:
        taken = F.exists(acc, lambda h: (h["start"] < c["end"]) & (c["start"] < h["end"]))
        return F.when(taken, acc).otherwise(
            F.concat(acc, F.array(F.struct(c["text"], c["start"], c["end"])))
        )

    return sort_hits(F.aggregate(ranked, F.array().cast(HIT_TYPE), step))
