"""SimHash components and spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import CLASHING, SCHEMA, prose, rows, table, words
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from bomrec.llm import simhash, variants


def plain_print(text):
    w = words(text)
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def hard_rows():
    rng = random.Random(5)
    base = prose(rng, 300)
    out = list(rows())
    out += [(1000 + i, base.replace(" ", " " * (i % 3 + 1), i) + (" x" * (i % 4)), "en", "s") for i in range(40)]
    out += [(2000 + i, " ".join(f"w{rng.random()}" if rng.random() < 0.02 else w for w in base.split(" ")), "en", "s") for i in range(40)]
    out += [(3000, "a " * 200_000, "en", "s"), (3001, "x" * 300_000, "en", "s"), (3002, "ÄÖ é ß " * 50, "en", "s"), (None, base, None, None)]
    return out


@pytest.mark.parametrize("tree", [4, 1024])
def test_simhash_components(spark, tree):
    some = hard_rows()
    got = simhash.simhash_components(table(spark, some, clashing=True), tree=tree).collect()
    prints = [plain_print(t) for _, t, _, _ in some]
    label = plain_components(prints)
    least = {}
    for (doc_id, *_), at in zip(some, label, strict=True):
        least[at] = min((x for x in (least.get(at), doc_id) if x is not None), default=None)
    wanted = [(d, f"{p:016x}", least[at]) for (d, *_), p, at in zip(some, prints, label, strict=True)]
    assert Counter(tuple(r) for r in got) == Counter(wanted)
    assert len({w[2] for w in wanted}) < len({w[1] for w in wanted})


def test_simhash_of_an_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tree_follows_all_edges_in_reach():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(2000)], np.uint64)
    values = np.unique(centres[rng.integers(0, 40, 2000)] ^ flips)
    tree = simhash.Tree.load(simhash.Tree(values).dump())
    asked = np.concatenate([values[::3], rng.integers(0, 1 << 63, 50, np.uint64)])
    i, j = tree.within(asked, 3)
    got = sorted(zip(asked[i].tolist(), tree.values[j].tolist(), strict=True))
    wanted = sorted((a, v) for a in asked.tolist() for v in values.tolist() if (a ^ v).bit_count() <= 3)
    assert got == wanted and sorted(tree.values.tolist()) == values.tolist()
    assert len(simhash.Tree(values[:1]).within(values, 0)[0]) == 1


@pytest.mark.parametrize("n", [1, 5000, 10**6, 10**8, 10**11])
def test_masks_leave_no_link_out(n):
    masks = simhash.shard_masks(n)
    rng = random.Random(n)
    assert all(0 <= m < 1 << 64 for m in masks)
    for _ in range(2000):
        change = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not change & m for m in masks)


def plain_variants(some):
    seen = Counter()
    for doc_id, text, *_ in some:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    n = {w: c for w, c in seen.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a[i:] == b[i + 1 :]

    form, count = {}, {}
    for w in n:
        found = [v for v in n if near(w, v)]
        count[w] = len(found)
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return out


def test_spelling_variants(spark):
    rng = random.Random(9)
    some = list(rows())
    base = ["straße", "colour", "aaaaab", "grüßen", "banana", "letters", "xyzzyx"]
    for i in range(400):
        text = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeßÉZ") + w[at:], w[:at] + rng.choice("abÿ") + w[at + 1 :]]) or "a"
            text.append(w)
        some.append((rng.randrange(100), " ".join(text), None, "s"))
    some += [(5000 + i, "L" * 3000 + " " + "L" * 2999 + "m " + "L" * 3001, "en", "s") for i in range(3)]
    some += [(6000 + i, ("ab" * 23 + "c ") * (6 - i) + "ab" * 23 + "cd " + "ab" * 24, "en", "s") for i in range(4)]
    got = variants.spelling_variants(table(spark, some, clashing=True)).collect()
    wanted = plain_variants(some)
    assert Counter(tuple(r) for r in got) == Counter(wanted)
    assert sum(w[1] is not None and w[1] != w[2] for w in wanted) > 0 and any(len(w[0]) > 2000 and w[4] for w in wanted)


def test_variants_of_nothing(spark):
    assert variants.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert variants.spelling_variants(spark.createDataFrame([(1, None, "en", "s"), (2, "12 34", None, None)], SCHEMA)).collect() == []


def test_a_very_long_word_stays_linear(spark):
    long = "q" * 400_000
    some = [(i, f"{long} {long}r", "en", "s") for i in range(3)]
    got = {len(r["word"]): r for r in variants.spelling_variants(spark.createDataFrame(some, SCHEMA)).collect()}
    assert [got[400_000]["n_near"], got[400_001]["n_near"], got[400_000]["form"]] == [1, 1, None]


def test_scan_keeps_groups_that_batches_cut(spark):
    counts = spark.createDataFrame([(f"word{chr(97 + i % 26)}{'x' * (i // 26)}", i + 3) for i in range(200)], "word string, n long")
    words_ = counts.orderBy("word").select(F.monotonically_increasing_id().alias("wid"), "word", "n")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        small = sorted(tuple(r) for r in variants.near_words(words_).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == sorted(tuple(r) for r in variants.near_words(words_).collect()) and small
    assert set(CLASHING)


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_components_of_chains_stars_and_rings(spark, monkeypatch, one_task):
    from bomrec.llm import components

    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = random.Random(12)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(600 + i, 600 + (i + 1) % 30) for i in range(30)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(-5, 7), (7, 7), (9, 9)]
    rng.shuffle(links)
    label = {}
    for a, b in links:
        x, y = label.get(a, {a}), label.get(b, {b})
        for n in (both := x | y):
            label[n] = both
    got = [tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()]
    wanted = {n: min(g) for n, g in label.items() if len(g) > 1}
    assert len(got) == len(set(got)) and {n: x for n, x in got if n != 9} == wanted
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
