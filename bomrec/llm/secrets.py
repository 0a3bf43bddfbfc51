"""Secret scans with one deterministic automaton for all rules."""

from __future__ import annotations

import hashlib
import re._parser as patterns
from array import array
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomrec.llm.tokens import text_bytes


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an ASCII pattern, matched leftmost and longest, and how long its tail must be.

    ``least_tail`` counts the bytes from the one at which the pattern is first satisfied to the end;
    shorter matches are consumed but dropped. ``any_case`` matches letters in either case.
    """

    kind: str
    pattern: str
    least_tail: int = 1
    any_case: tuple[str, ...] = ()

    def text(self) -> str:
        out = self.pattern
        for word in self.any_case:
            out = out.replace(word, "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word))
        return out


KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8, KEYWORDS),
    Rule("access", r"AKIA[A-Z0-9]+", 12),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"gh[pousr]_[A-Za-z0-9]+", 36),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 16),
)


@dataclass
class Graph:
    """States with steps on byte sets and empty steps."""

    steps: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.steps.append([])
        self.empty.append([])
        return len(self.steps) - 1

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def reversed(self) -> Graph:
        out = Graph([[] for _ in self.steps], [[] for _ in self.steps])
        for s, steps in enumerate(self.steps):
            for on, t in steps:
                out.steps[t].append((on, s))
            for t in self.empty[s]:
                out.empty[t].append(s)
        return out

    def add(self, tree, begin: int) -> int:
        """Add a parsed pattern after ``begin``; returns the state that it ends in."""
        for op, value in tree:
            if op is patterns.SUBPATTERN:
                begin = self.add(value[3], begin)
            elif op is patterns.BRANCH:
                end = self.state()
                for way in value[1]:
                    self.empty[self.add(way, begin)].append(end)
                begin = end
            elif op is patterns.MAX_REPEAT:
                least, most, what = value
                for _ in range(least):
                    begin = self.add(what, begin)
                if most is patterns.MAXREPEAT:
                    loop = self.state()
                    self.empty[begin].append(loop)
                    self.empty[self.add(what, loop)].append(loop)
                    begin = loop
                else:
                    ends = [begin]
                    for _ in range(most - least):
                        ends.append(self.add(what, ends[-1]))
                    begin = self.state()
                    for e in ends:
                        self.empty[e].append(begin)
            else:
                end = self.state()
                self.steps[begin].append((byte_set(op, value), end))
                begin = end
        return begin


def byte_set(op, value) -> frozenset[int]:
    if op is patterns.LITERAL:
        return frozenset([value])
    if op is not patterns.IN:
        raise ValueError(f"rules are made of characters, classes, groups and repeats, not {op}")
    out: set[int] = set()
    for kind, what in value:
        if kind is patterns.LITERAL:
            out.add(what)
        elif kind is patterns.RANGE:
            out.update(range(what[0], what[1] + 1))
        else:
            raise ValueError(f"classes list characters and ranges, not {kind}")
    if max(out) > 127:
        raise ValueError("rules are ASCII")
    return frozenset(out)


class Automaton:
    """A minimal deterministic automaton as transition arrays over byte classes.

    ``table[s]`` has the next state for each byte class, ``masks[s]`` the rules that are satisfied in s.
    For walking, arrays are linked: a row holds the next rows themselves and, last, its mask. ``dead`` is
    the row that no rule can be satisfied from, if there is one. Only the arrays travel to tasks.
    """

    def __init__(self, graph: Graph, starts: list[int], ends: list[int], anywhere: bool) -> None:
        sets = sorted({on for steps in graph.steps for on, _ in steps}, key=sorted)
        kinds: dict[tuple[bool, ...], int] = {}
        self.classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
        sample = [self.classes.index(c) for c in range(len(kinds))]
        start = graph.closure(frozenset(starts))
        number, todo, table = {start: 0}, [start], []
        while todo:
            here, row = todo.pop(0), []
            for b in sample:
                there = frozenset(t for s in here for on, t in graph.steps[s] if b in on)
                there = graph.closure(there | frozenset(starts) if anywhere else there)
                if there not in number:
                    number[there] = len(number)
                    todo.append(there)
                row.append(number[there])
            table.append(row)
        masks = [0] * len(number)
        for subset, s in number.items():
            masks[s] = sum(1 << i for i, e in enumerate(ends) if e in subset)
        # Minimise: split blocks of states until all of a block agree on the blocks they step to.
        block = masks
        while True:
            seen: dict[tuple, int] = {}
            finer = [seen.setdefault((block[s], *[block[t] for t in table[s]]), len(seen)) for s in range(len(table))]
            if len(seen) == len(set(block)):
                break
            block = finer
        first = {b: s for s, b in reversed(list(enumerate(finer)))}
        order = sorted(first, key=first.__getitem__)
        name = {b: i for i, b in enumerate(order)}
        self.table = [array("H", [name[finer[t]] for t in table[first[b]]]) for b in order]
        self.masks = [masks[first[b]] for b in order]
        self.link()

    def link(self) -> None:
        rows: list[list] = [[] for _ in self.table]
        for row, steps, mask in zip(rows, self.table, self.masks, strict=True):
            row.extend([rows[t] for t in steps])
            row.append(mask)
        self.begin = rows[0]
        self.dead = next((r for r in rows if not r[-1] and all(x is r for x in r[:-1])), None)

    def __getstate__(self) -> tuple:
        return self.classes, self.table, self.masks

    def __setstate__(self, state: tuple) -> None:
        self.classes, self.table, self.masks = state
        self.link()


class Scanner:
    """All rules compiled: one automaton that finds where rules are satisfied anywhere in a text, and for
    each rule one that runs back from there to its start and one that runs on to its end."""

    def __init__(self, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> None:
        self.rules = rules
        graph, starts, ends = Graph(), [], []
        self.back, self.ahead, self.again = [], [], []
        for rule in rules:
            tree = patterns.parse(rule.text())
            starts.append(graph.state())
            ends.append(graph.add(tree, starts[-1]))
            own = Graph()
            begin = own.state()
            end = own.add(tree, begin)
            self.ahead.append(Automaton(own, [begin], [end], False))
            self.again.append(Automaton(own, [begin], [end], True))
            self.back.append(Automaton(own.reversed(), [end], [begin], False))
        self.all = Automaton(graph, starts, ends, True)

    def satisfied(self, text: bytes) -> list[tuple[int, int]]:
        """The one pass: where a match of some rule ends, with the mask of such rules."""
        row, out = self.all.begin, []
        for i, c in enumerate(text.translate(self.all.classes), 1):
            row = row[c]
            if row[-1]:
                out.append((i, row[-1]))
        return out

    def start(self, r: int, text: bytes, end: int, least: int) -> int | None:
        """The leftmost start, not before ``least``, of a match of rule r that ends at ``end``."""
        auto, best = self.back[r], None
        row = auto.begin
        for i in range(end - 1, least - 1, -1):
            row = row[auto.classes[text[i]]]
            if row is auto.dead:
                break
            if row[-1]:
                best = i
        return best

    def stop(self, r: int, text: bytes, start: int) -> int:
        """The end of the longest match of rule r from ``start``."""
        auto, best = self.ahead[r], start
        row = auto.begin
        for i in range(start, len(text)):
            row = row[auto.classes[text[i]]]
            if row is auto.dead:
                break
            if row[-1]:
                best = i + 1
        return best

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, leftmost and not overlapping within a rule, by start and rule.

        Matches may not begin before the last one of their rule ended, but the one pass also says where those
        end that did. When the way back from such an end shows no start, the rule's own automaton, begun
        where the last match ended, goes on beside the pass until it is satisfied itself, so that every byte
        is seen a bounded number of times.
        """
        found, n = [], len(self.rules)
        reached, at = [0] * n, [0] * n
        rows: list[list | None] = [None] * n
        for end, mask in self.satisfied(text):
            for r, rule in enumerate(self.rules):
                if not mask >> r & 1 or end <= reached[r]:
                    continue
                if rows[r] is None:
                    start = self.start(r, text, end, reached[r])
                    if start is None:
                        rows[r], at[r] = self.again[r].begin, reached[r]
                if rows[r] is not None:
                    row, classes = rows[r], self.again[r].classes
                    for i in range(at[r], end):
                        row = row[classes[text[i]]]
                    rows[r], at[r] = row, end
                    start = self.start(r, text, end, reached[r]) if row[-1] else None
                if start is not None:
                    reached[r], rows[r] = self.stop(r, text, start), None
                    if reached[r] - end + 1 >= rule.least_tail:
                        found.append((start, r, reached[r]))
        return sorted(found)


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def points(text: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each byte offset."""
    out, last, n = {}, 0, 0
    for p in sorted(set(places)):
        n += len(text[last:p].decode("utf-8", "replace"))
        out[p], last = n, p
    return out


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Rule, ...] = BASE_RULES,
    more: tuple[Rule, ...] = MORE_RULES,
) -> DataFrame:
    """Find secrets of all kinds in each whole text, in one pass over its bytes.

    The rules become one automaton by subset construction and minimisation; its transition arrays are
    walked once. Only where a rule is satisfied do the rule's own automata fix the span: leftmost start
    after the last span of its kind, longest end. Spans are half-open and count code points.

    Null counts as the empty text, which has no spans. Texts may be of any length and hold any runs: the work
    is in proportion to their length. Each row is judged by itself, so repeated ids and
    texts repeat their result; an empty table gives no rows. Other columns are ignored.

    Returns (id, spans array<struct<kind, start, stop>>, n (map from base kind to its number of spans),
    base_sha256 of the base spans, spans_text), spans by start and then as the rules are listed.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    scanner, kinds = compiled((*base, *more)), [r.kind for r in (*base, *more)]

    def scan(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            spans, counts, hashes, texts = [], [], [], []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                found = scanner.spans(text)
                at = points(text, [p for s, _, e in found for p in (s, e)])
                spans.append([{"kind": kinds[r], "start": at[s], "stop": at[e]} for s, r, e in found])
                named = [(r, f"{kinds[r]}:{at[s]}:{at[e]}") for s, r, e in found]
                counts.append([sum(r == b for r, _ in named) for b in range(len(base))])
                hashes.append(hashlib.sha256(",".join(x for r, x in named if r < len(base)).encode()).hexdigest())
                texts.append(",".join(x for _, x in named))
            shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, shape), pa.array(counts, pa.list_(pa.int64())), pa.array(hashes, pa.string()),
                 pa.array(texts, pa.string())],
                [id_col, "spans", "n", "base_sha256", "spans_text"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text_"))
    shape = "spans array<struct<kind: string, start: long, stop: long>>, n array<long>, base_sha256 string, spans_text string"
    found = rows.mapInArrow(scan, f"`{id_col}` {kind}, {shape}")
    return found.withColumn("n", F.map_from_arrays(F.array(*[F.lit(r.kind) for r in base]), "n"))
