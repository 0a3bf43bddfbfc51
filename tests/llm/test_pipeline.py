"""The pipeline's stages, each judged on its own input, and the whole of it on a small folder of tables."""

import collections
import random

import fixtures
import pytest
from test_text_operators import ITEM, hits, linked_groups

import __spark_entry__
import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(8)
    some = [r for r in fixtures.rows(n=96) if r[0] is None or r[0] != 3]
    some += [(500 + i, f"{fixtures.prose(rng, 30)} {ITEM} {fixtures.prose(rng, 30)}", "en", "s1") for i in range(4)]
    some += [(600, "12 34 ... 56", "en", "s1"), (601, None, None, None)]
    fixtures.table(spark, some).selectExpr("*", "length(text) AS n_chars", "'kept' AS key").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, some


def test_stages_filter_as_plain_python_does(spark, folder):
    path, some = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "mixing_to_weights", "sharding"]

    def of(df):
        return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]

    told = stages["language_id"](spark, docs, path)
    assert told.columns == docs.columns
    lost = collections.Counter(some) - collections.Counter(of(told))
    assert all(not any(c.isalpha() for c in t or "") for _, t, *_ in lost)
    assert all(any(c.isalpha() for c in t or "") for _, t, *_ in of(told))

    deduped = stages["ngram_jaccard_join"](spark, docs, path)
    _, group = linked_groups(some)
    by_group = collections.defaultdict(list)
    for row, g in zip(some, group, strict=True):
        by_group[g if fixtures.words(row[1]) else (row[0], row[1])].append(row)
    first = {g: min(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for g, rows in by_group.items()}
    assert deduped.columns == docs.columns
    assert sorted((str(r[0]), str(r[1])) for r in of(deduped)) == sorted((str(r[0]), str(r[1])) for r in first.values())

    clean = stages["benchmark_decontamination"](spark, docs, path)
    want = [r for r in some if not hits(r[1], [(1, ITEM)])[4]]
    assert clean.columns == docs.columns and collections.Counter(of(clean)) == collections.Counter(want)

    mixed = stages["mixing_to_weights"](spark, docs, path)
    assert mixed.columns == docs.columns
    times, there = collections.Counter(of(mixed)), collections.Counter(some)
    assert set(times) <= set(there) and all(n <= 3 * there[r] for r, n in times.items())


def test_run_shards_what_the_stages_keep(spark, folder):
    path, some = folder
    got = corpus_pipeline.run(spark, path).collect()
    assert {(r["doc_id"], r["text"]) for r in got} <= {(r[0], r[1]) for r in some}
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert not any(hits(r["text"], [(1, ITEM)])[4] for r in got)


def test_stages_of_no_rows(spark, folder):
    path, _ = folder
    none = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    assert [f(spark, none, path).count() for _, f in corpus_pipeline.STAGES] == [0] * 5


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
