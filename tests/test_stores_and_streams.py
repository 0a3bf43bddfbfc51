"""Files, stores and streaming feeds."""

import datetime
import json
import os
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from bomrec.functions.closed_tables import ATTRIBUTES
from bomrec.operators import kpi, revisions
from bomrec.sources import records, stores
from bomrec.streaming import feeds


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_gold_seed_log_answers_and_csv(spark, tmp_path):
    cell = {"value": "x", "provenance": "extracted", "certainty": "C"}
    gold = {"id": "1.2", "rowRef": "1", "role": "secondary", "status": "RESUELTA", "reasons": [], "attributes": {"name": cell, "finish": cell}, "quantity": {"value": 3, "provenance": "extracted", "certainty": "P"}}
    g = records.gold_lines(spark, _write(tmp_path / "gold.jsonl", json.dumps(gold))).first()
    assert (g.row_ref, g.position, g["name"], g.finish_cert, g.quantity, g.quantity_cert) == ("1", 2, "x", "C", 3.0, "P")

    seed = {"entries": [{"id": "a", "alias": "ZN", "kind": "alias", "finish": "CINCADO", "source": "client", "decidedAt": "2026-01-01"}, {"id": "b", "when": {"qualityGroup": "G1"}, "material": "INOX"}]}
    rows = {r.id: (r.alias, r.kind, r.value) for r in records.vocabulary_seed(spark, _write(tmp_path / "seed.json", json.dumps(seed, indent=1)), "finish").collect()}
    assert rows == {"a": ("ZN", "alias", "CINCADO"), "b": ("G1", "group", "INOX")}

    events = [{"action": "add", "at": "1", "by": "x", "detail": "", "entry": {"id": "n", "alias": "mate", "kind": "alias", "finish": "MATE", "source": "added"}}, {"action": "retire", "at": "2", "by": "x", "detail": "", "entryId": "n"}]
    log = records.vocabulary_log(spark, _write(tmp_path / "log.jsonl", "\n".join(map(json.dumps, events))), "finish")
    from bomrec.operators.catalog import current_entries

    state = current_entries(log.unionByName(log)).first()
    assert (state.id, state.alias, state.value, state.retired_at) == ("n", "mate", "MATE", "2")

    # A later file may be larger, so that its blocks are read first; its events still come after.
    late = [{**e, "detail": "x" * 5000} for e in events[1:]]
    _write(tmp_path / "log2.jsonl", "\n".join(map(json.dumps, late)))
    _write(tmp_path / "log1.jsonl", json.dumps(events[0]))
    ordered = records.vocabulary_log(spark, str(tmp_path / "log[12].jsonl"), "finish").orderBy("seq").collect()
    assert [r.action for r in ordered] == ["add", "retire"]

    answers = {"respuestas": {"7": {"outOfFamily": False, "elements": [{"detectedName": "NUT", "normalizedName": "TUERCA", "role": "principal", "evidence": "NUT", "multiplicity": 2, "attributes": {"quality": {"value": "8", "evidence": "8"}}}]}}}
    a = records.reader_answers(spark, _write(tmp_path / "answers.json", json.dumps(answers))).first()
    assert (a.row_ref, a.elements[0].detected_name, a.elements[0].quality.value) == ("7", "NUT", "8")

    csv = records.fixture_csv(spark, _write(tmp_path / "f.csv", 'id,text\n1,"a ""b"", c\nd"\n'), "id int, text string")
    assert csv.first().text == 'a "b", c\nd'


def test_run_store_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "runs")
    header = spark.createDataFrame([("r1", 10)], "run_id string, n_rows int")
    metrics = spark.createDataFrame([("r1", "m", 1.0)], "run_id string, name string, value double")
    lines = spark.createDataFrame([("r1", "1.1")], "run_id string, line_id string")
    stores.save_run(header, metrics, lines, path, "r1")
    metrics.drop("run_id").write.parquet(f"{path}/metrics/run_id=half/attempt=a")  # a run that died before its commit
    assert [r.run_id for r in stores.load_runs(spark, path, "metrics").collect()] == ["r1"]
    stores.save_run(header, metrics, lines, path, "r1")
    assert stores.load_runs(spark, path, "lines").count() == 1


def test_snapshots_exports_and_quotation(spark, tmp_path):
    path = str(tmp_path / "snap")
    schema = "project string, revision string, line_id string, fingerprint string, status string"
    lines = spark.createDataFrame([("p", "1", "a", "f1", "RESUELTA"), ("p", "2", "b", "f2", "RESUELTA")], schema)
    stores.save_snapshot(lines, path)
    stores.save_snapshot(lines.filter("revision = '2'").withColumn("line_id", F.lit("c")), path)
    assert [r.line_id for r in stores.load_snapshot(spark, path, "p", "2").collect()] == ["c"]
    assert [r.line_id for r in stores.load_snapshot(spark, path, "p", "1").collect()] == ["a"]
    reg = str(tmp_path / "reg")
    stores.register_exports(lines, spark, reg, exists=False)
    stores.register_exports(lines, spark, reg, exists=True)
    assert spark.read.parquet(reg).count() == 2


def test_diff_is_symmetric(spark):
    schema = "fingerprint string, line_id string, quantity double, status string"
    a = spark.createDataFrame([("x", "1", 1.0, "RESUELTA"), ("y", "2", 2.0, "RESUELTA"), ("z", "3", None, "RESUELTA"), ("z", "4", 1.0, "RESUELTA")], schema)
    b = spark.createDataFrame([("x", "5", 1.0, "RESUELTA"), ("w", "6", 2.0, "RESUELTA"), ("z", "7", 1.0, "RESUELTA")], schema)
    ab = {r.fingerprint: r.kind for r in revisions.diff(a, b).collect()}
    ba = {r.fingerprint: r.kind for r in revisions.diff(b, a).collect()}
    assert ab == {"x": "unchanged", "y": "removed", "w": "added", "z": "ambiguous"}
    swap = {"added": "removed", "removed": "added"}
    assert ba == {k: swap.get(v, v) for k, v in ab.items()}


def test_nearest_rank_matches_definition(spark):
    values = [11, 1, 5, 5, 5, 3_000_000_000, 70_000, 70_001, 2, 9]
    row = kpi.nearest_rank(spark.createDataFrame([(v,) for v in values], "v long"), "v", (0.5, 0.9)).first()
    ordered = sorted(values)
    assert (row.p50, row.p90) == (ordered[4], ordered[8])


MILESTONE = "project_id string, revision_id string, flow_id string, event_type string, ts timestamp, seq long"


def _stream(spark, df, tmp_path, name):
    source = str(tmp_path / name)
    df.repartition(1).write.parquet(source)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)


def _drain(writer, tmp_path, name):
    query = writer.option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


@pytest.fixture(scope="module")
def stateful(spark):
    pytest.importorskip("google.protobuf")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def _batches(spark, batches, schema, tmp_path, name):
    """One file, and so one micro-batch, for each list of rows."""
    source = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"b={i}"))
    flat = tmp_path / f"{name}-flat"
    flat.mkdir()
    for i in range(len(batches)):
        (part,) = (source / f"b={i}").glob("part-*.parquet")
        part.rename(flat / f"{i:04}.parquet")
        os.utime(flat / f"{i:04}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    frame = spark.createDataFrame([], schema)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(flat))


DAY = datetime.datetime(2026, 1, 1)


def _milestones():
    rng = random.Random(6)
    seqs = list(range(200))
    rng.shuffle(seqs)
    rows = [(f"p{rng.randrange(4)}", "r", f"f{rng.randrange(3)}", rng.choice(["rfq_sent", "po_sent"]), DAY + datetime.timedelta(minutes=s + rng.randrange(-20, 20)), s) for s in seqs]
    return rows, [rows[i : i + 40] for i in range(0, 200, 40)]


def test_first_milestone_by_seq_from_batches_out_of_order(stateful, tmp_path):
    rows, batches = _milestones()
    stream = _batches(stateful, batches, MILESTONE, tmp_path, "m")
    _drain(feeds.first_milestones(stream).writeStream.format("memory").queryName("milestones_out").outputMode("update"), tmp_path, "m")
    told = {}
    for r in stateful.table("milestones_out").collect():
        key = (r.project_id, r.flow_id, r.event_type)
        told[key] = min(told.get(key, r.seq), r.seq)
    batch = feeds.first_milestones(stateful.createDataFrame(rows, MILESTONE)).collect()
    assert told == {(r.project_id, r.flow_id, r.event_type): r.seq for r in batch} and len(batch) == 24
    assert {(r.project_id, r.flow_id, r.event_type, r.seq, r.ts) for r in batch} <= {(p, f, k, s, t) for p, _, f, k, t, s in rows}


def test_streamed_firsts_run_no_python_for_each_key(spark, tmp_path):
    """without a horizon nearly every event is a key of its own, so keys are aggregated and not called one by one."""
    stream = _stream(spark, spark.createDataFrame(_milestones()[0], MILESTONE), tmp_path, "plain")
    plan = feeds.first_milestones(stream)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan


def test_first_milestone_is_told_once_behind_the_watermark(stateful, tmp_path):
    rows, batches = _milestones()
    late = [("end", "r", "f", "x", DAY + datetime.timedelta(days=9), 900)]
    again = [(*r[:4], DAY + datetime.timedelta(days=10), 1000 + r[5]) for r in rows[:50]]
    end = [("end", "r", "f", "y", DAY + datetime.timedelta(days=30), 2000)]
    stream = _batches(stateful, [*batches, late, again, end], MILESTONE, tmp_path, "w")
    out = feeds.first_milestones(stream, "1 day")
    _drain(out.writeStream.format("memory").queryName("told_out").outputMode("append"), tmp_path, "w")
    got = sorted((r.project_id, r.flow_id, r.event_type, r.seq) for r in stateful.table("told_out").collect() if r.project_id != "end")
    batch = feeds.first_by_seq(stateful.createDataFrame(rows, MILESTONE), list(feeds.MILESTONE_KEY)).collect()
    assert got == sorted((r.project_id, r.flow_id, r.event_type, r.seq) for r in batch)


def test_first_seen_entries(stateful, tmp_path):
    schema = "entry_id string, ts timestamp, seq long"
    batches = [[("a", DAY, 5), ("b", DAY, 2)], [("a", DAY, 3), ("b", DAY, 9)], [("a", DAY, 4), ("c", DAY, 1)]]
    stream = _batches(stateful, batches, schema, tmp_path, "e")
    _drain(feeds.first_seen_entries(stream).writeStream.format("memory").queryName("entries_out").outputMode("update"), tmp_path, "e")
    assert sorted((r.entry_id, r.seq) for r in stateful.table("entries_out").collect()) == [("a", 3), ("a", 5), ("b", 2), ("c", 1)]


def test_vocabulary_feed_is_idempotent_and_equals_the_fold(stateful, tmp_path):
    from bomrec.operators.catalog import current_entries

    schema = "action string, id string, at string, seq long, alias string, value string"
    rng = random.Random(11)
    log = []
    for seq in range(120):
        kind = rng.choice(["add", "add", "retire"])
        log.append((kind, f"e{rng.randrange(12)}", f"t{rng.randrange(30)}", seq, f"alias {seq}" if kind == "add" else None, None))
    shuffled = [log[:40], log[80:], log[40:80], log[:60]]  # out of order, and part of it again
    stream = _batches(stateful, shuffled, schema, tmp_path, "v")
    _drain(feeds.publish_updates(feeds.vocabulary_updates(stream), str(tmp_path / "out")), tmp_path, "v")
    updates = stateful.read.parquet(str(tmp_path / "out"))
    columns = ["id", "decided_at", "alias", "retired_at"]
    want = sorted(tuple(r) for r in current_entries(stateful.createDataFrame(log, schema)).select(columns).collect())
    assert sorted(tuple(r) for r in feeds.latest_entries(updates).select(columns).collect()) == want
    last = [tuple(r) for r in updates.where("epoch = 3").collect()]
    assert last == []  # what comes again tells nothing
    feeds.compact_updates(stateful, str(tmp_path / "out"), str(tmp_path / "small"))
    small = stateful.read.parquet(str(tmp_path / "small"))
    assert sorted(tuple(r) for r in feeds.latest_entries(small).select(columns).collect()) == want and small.count() == len(want)


class _OneValue:
    """A state of one value that counts what is asked of it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


def test_vocabulary_state_is_read_and_written_once_for_a_batch():
    """F8: the calls to the state follow the ids of a micro-batch, not its events."""
    state = _OneValue()
    entry = feeds._Entry(StructType([StructField("alias", StringType())]))
    entry.init(state)
    log = [Row(action="retire" if i % 3 == 2 else "add", at=f"t{i % 50}", seq=i, alias=f"a{i}") for i in range(300)]
    (told,) = entry.handleInputRows(("x",), iter(reversed(log)), None)
    assert state.calls == 2 and (told.version, told.n_moves, told.decided_at, told.alias, told.retired_at) == (149, 100, "t47", "a97", "t49")
    assert list(entry.handleInputRows(("x",), iter(log[:150]), None)) == [] and state.calls == 3


PAIRS = "session_id string, line_id string, ts timestamp, seq long, event_type string"


def test_live_pairs_equal_batch_pairs(stateful, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), "l", DAY + datetime.timedelta(seconds=10 * i), i, rng.choice(["started", "saved", "saved", "other", "started"])) for i in range(150)]
    stream = _batches(stateful, [rows[i : i + 25] for i in range(0, 150, 25)], PAIRS, tmp_path, "pairs")
    _drain(feeds.live_correction_pairs(stream).writeStream.format("memory").queryName("pairs_out").outputMode("append"), tmp_path, "pairs")
    live = sorted((r.session_id, r.started_at, r.seconds) for r in stateful.table("pairs_out").collect())
    batch = sorted((r.session_id, r.started_at, r.seconds) for r in kpi.correction_pairs(stateful.createDataFrame(rows, PAIRS)).collect())
    assert live == batch and len(live) > 10


def test_open_starts_expire(stateful, tmp_path):
    at = lambda hours: DAY + datetime.timedelta(hours=hours)
    batches = [
        [("a", "l", at(0), 0, "started"), ("b", "l", at(0), 1, "started")], [("c", "l", at(10), 2, "started")], [("c", "l", at(10.5), 3, "started")],
        [("b", "l", at(11), 4, "started"), ("a", "l", at(11), 5, "saved")], [("b", "l", at(11.5), 6, "saved"), ("c", "l", at(11.5), 7, "saved")],
    ]
    stream = _batches(stateful, batches, PAIRS, tmp_path, "expire")
    out = feeds.live_correction_pairs(stream, lateness="1 minute", lifetime_seconds=2 * 3600)
    _drain(out.writeStream.format("memory").queryName("expire_out").outputMode("append"), tmp_path, "expire")
    assert sorted((r.session_id, r.seconds) for r in stateful.table("expire_out").collect()) == [("b", 1800.0), ("c", 3600.0)]


def test_quotation_file(spark, tmp_path):
    schema = "row_ref string, line_id string, position int, quantity double, quantity_prov string, status string, reasons array<struct<code:string>>, " + ", ".join(f"{a} string" for a in ATTRIBUTES)
    row = ("1", "1.1", 1, 2.0, "extracted", "REVISION_MANUAL", [("LENGTH_MISSING",)], "TUERCA", None, '8 "x"; y', "M8", None, None, None)
    stores.write_quotation(spark.createDataFrame([row], schema), str(tmp_path / "q"))
    text = "".join(p.read_text() for p in (tmp_path / "q").glob("*.csv")).splitlines()
    assert text[0].startswith("familia;linea_id;fila_origen;cantidad")
    assert '"8 ""x""; y"' in text[1] and text[1].endswith("LENGTH_MISSING")


def test_ranked_pages_read_the_ranges_they_touch(spark, tmp_path):
    from bomrec.operators import panel

    values = [(i * 7919 % 1003, f"v{i % 5}") for i in range(1003)]
    path = str(tmp_path / "pages")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        panel.write_ranked(spark.createDataFrame(values, "k int, v string").repartition(5), ["v", "k"], path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    ordered = sorted(values, key=lambda r: (r[1], r[0]))
    page = lambda n: [tuple(r) for r in panel.ranked_page(spark, path, n, 50).collect()]
    for n in (0, 1, 7, 19, 20):
        assert page(n) == ordered[50 * n : 50 * n + 50]
    assert page(-1) == page(99) == ordered[1000:] and page(-2) == page(19) and page(-99) == page(0)
    plan = panel.ranked_page(spark, path, -1, 2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(range_#\d+ = \d+\)", plan) and spark.read.parquet(f"{path}/ranges").count() > 4
    panel.write_ranked(spark.createDataFrame([], "k int, v string"), ["k"], str(tmp_path / "none"))
    assert panel.ranked_page(spark, str(tmp_path / "none"), 0, 5).collect() == []
