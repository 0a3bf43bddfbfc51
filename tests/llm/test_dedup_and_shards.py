"""Exact dedup, sharding and mixing against plain Python over small tables."""

import collections
import hashlib
import re
import zlib

import fixtures
import pytest
from pyspark.sql import functions as F

from bomrec.llm import exact_dedup, mixing, sharding


@pytest.mark.parametrize("clashing", [False, True])
def test_exact_dedup(spark, clashing):
    some = fixtures.rows()
    got = exact_dedup.exact_dedup(fixtures.table(spark, clashing=clashing), runs=16, fan_in=4).collect()
    groups = collections.defaultdict(list)
    for i, text, *_ in some:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()].append((-len(text or ""), i is not None, i))
    best = {k: min(v, key=lambda r: (r[0], r[1], r[2] or 0)) for k, v in groups.items()}
    assert len(got) == len(some)
    for r in got:
        assert r["keep_id"] == best[r["text_sha256"]][2] and r["group_size"] == len(groups[r["text_sha256"]])
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept) == set(groups)


def test_exact_dedup_of_no_rows(spark):
    assert exact_dedup.exact_dedup(fixtures.table(spark, [])).collect() == []


@pytest.mark.parametrize("per_bucket", [4, 20_000])
def test_shards_are_even_and_mixed(spark, per_bucket):
    some = fixtures.rows()
    placed = sharding.interleaved_shards(fixtures.table(spark, clashing=True), shards=5, rows_per_bucket=per_bucket)
    got = placed.collect()
    assert len(got) == len(some) and got[0]["size"] == "kept size"
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r)
    counts = [len(v) for v in by_shard.values()]
    assert max(counts) - min(counts) <= 1 and set(by_shard) == set(range(5))
    for v in by_shard.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    for source, n in collections.Counter(r[3] for r in some).items():
        share = [sum(r["source"] == source for r in v) for v in by_shard.values()]
        assert max(share) - min(share) <= 2, (source, n, share)
    again = sharding.interleaved_shards(fixtures.table(spark), shards=5, rows_per_bucket=7)
    where = lambda df: collections.Counter((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in df.collect())
    repeated = {i for i, n in collections.Counter(r[0] for r in some).items() if n > 1}
    strip = lambda c: {k: v for k, v in c.items() if k[0] not in repeated}
    assert strip(where(placed)) == strip(where(again))


def test_shards_of_no_rows(spark):
    assert sharding.interleaved_shards(fixtures.table(spark, [])).collect() == []


def filled(sizes, weights, cap=3.0):
    """Targets by sharing the excess again until none is above its cap."""
    total, target, fixed = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in fixed)
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        for i in open_:
            target[i] = left * weights[i] / sum(weights[j] for j in open_)
        above = [i for i in open_ if target[i] > cap * sizes[i]]
        if not above:
            return target
        for i in above:
            target[i] = cap * sizes[i]
            fixed.add(i)


@pytest.mark.parametrize("per_bucket", [5, 20_000])
def test_mixture_meets_its_targets(spark, per_bucket):
    some = fixtures.rows(n=400)
    table = fixtures.table(spark, some, clashing=True)
    got = mixing.entropy_mix(table, rows_per_bucket=per_bucket).collect()
    assert len(got) == len(some) and got[0]["shard"] == "kept shard"
    sizes = collections.Counter()
    for _, text, _, source in some:
        sizes[source] += len(fixtures.words(text))
    names = sorted((s for s in sizes if s is not None)) + [None]
    wanted = dict(zip(names, filled([sizes[s] for s in names], [1.0 + i % 3 for i in range(len(names))]), strict=True))
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len(fixtures.words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        assert abs(r["target"] - wanted[r["source"]]) < 1e-6 * max(1, wanted[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in names:
        # The long texts have 3,000 words; the short ones make up for their rounding.
        assert abs(taken[s] - wanted[s]) <= max(0.06 * wanted[s], 400), (s, taken[s], wanted[s])
    again = mixing.entropy_mix(fixtures.table(spark, some).repartition(7), rows_per_bucket=per_bucket)
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in again.collect()) == sorted((r["doc_id"] or -1, r["taken"]) for r in got)


def test_targets_share_the_excess_again(spark):
    sizes = [5, 1000, 10, 40, 0, 300]
    totals = spark.createDataFrame([(f"0s{i}", s) for i, s in enumerate(sizes)], "skey string, source_size long")
    got = [r["target"] for r in mixing.source_targets(totals).orderBy("skey").collect()]
    want = filled(sizes, [1.0 + i % 3 for i in range(len(sizes))])
    assert got == pytest.approx(want) and sum(got) == pytest.approx(sum(sizes))


def test_mixture_of_no_rows_and_of_no_words(spark):
    assert mixing.entropy_mix(fixtures.table(spark, [])).collect() == []
    none = mixing.entropy_mix(fixtures.table(spark, [(1, None, None, None), (2, " ", None, "a")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in none] == [(0, 0.0, 0)] * 2


def test_crc_matches_the_text(spark):
    row = spark.createDataFrame([("é",)], "t string").select(F.crc32(F.col("t").cast("binary")).alias("c")).head()
    assert row["c"] == zlib.crc32("é".encode())
