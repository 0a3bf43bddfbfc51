"""Multi-line records over files cut into small blocks, against the standard parsers."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from bomrec.sources import records, split


def _field(rng):
    return "".join(rng.choice(['a', 'b', '"', '""', "\n", "\r\n", ",", "é", "5\"", " ", "x" * 30]) for _ in range(rng.randint(0, 12)))


@pytest.mark.parametrize("block", [40, 300, 1 << 20])
def test_csv_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    wanted = []
    for f in range(3):
        out = io.StringIO()
        write = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n")
        write.writerow(["id", "a", "b"])
        for i in range(80):
            row = (1000 * f + i, _field(rng) if i != 40 else "long\n" * 200, _field(rng))
            wanted.append(row)
            write.writerow(row)
        text = out.getvalue()
        (tmp_path / f"f{f}.csv").write_text(text if f else text.rstrip("\n"), encoding="utf-8", newline="")
    lines = split.pieces(spark, str(tmp_path), "\n", block)
    got = split.quoted_records(lines).where("block > 0 OR nth > 0").collect()
    read = [next(csv.reader(io.StringIO(r["text"], newline=""))) for r in got]
    assert sorted((int(i), a, b) for i, a, b in read) == sorted(wanted)
    if block < 1000:
        assert lines.select("file", "block").distinct().count() > 20
    rows = records.fixture_csv(spark, str(tmp_path), "id int, a string, b string", block).collect()
    assert sorted((r.id, r.a or "", r.b or "") for r in rows) == sorted((i, a, b) for i, a, b in wanted)


def _value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return rng.choice(['}', '{"entries": [', "a\\\"b", "\\", "]", "x\ny", "é", "", '"', '\\"'])
    if kind == 1:
        return rng.choice([None, True, 12, -1.5])
    if kind < 4:
        return {f"k{i}": _value(rng, depth + 1) for i in range(rng.randint(0, 3))}
    return [_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]


@pytest.mark.parametrize("block", [30, 500, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_json_blocks(spark, tmp_path, block, indent):
    rng = random.Random(7)
    listed, named = [], []
    for f in range(4):
        items = [{"id": f"{f}.{i}", "v": _value(rng)} for i in range(40 if f else 0)]
        members = {f"{f}/{i}}}\"": {"v": _value(rng), "w": {"x": [1, {}]}} for i in range(30)}
        document = {"version": 1, "meta": {"a": {"b": [{"c": "}"}]}}, "entries": items, "other": [{"id": "no"}, [[{}]]], "respuestas": members, "tail": {"z": {}}}
        listed += items
        named += members.items()
        (tmp_path / f"d{f}.json").write_text(json.dumps(document, indent=indent, ensure_ascii=False), encoding="utf-8")
    parts = split.pieces(spark, str(tmp_path), "}", block)
    got = [json.loads(r["text"]) for r in split.json_elements(parts, "entries").collect()]
    assert sorted(map(json.dumps, got)) == sorted(map(json.dumps, listed))
    got = [json.loads("{" + r["text"] + "}") for r in split.json_elements(parts, "respuestas").collect()]
    assert sorted(map(json.dumps, got)) == sorted(json.dumps({k: v}) for k, v in named)


def test_nothing_to_split(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert records.fixture_csv(spark, str(tmp_path), "id int").collect() == []
    (tmp_path / "empty.csv").write_text('{"entries": []}')
    assert split.json_elements(split.pieces(spark, str(tmp_path), "}"), "entries").collect() == []


def test_log_order_follows_files_and_blocks(spark, tmp_path):
    wanted = []
    for f in range(3):
        events = [{"action": "add", "at": f"{f}-{i}", "entry": {"id": f"{f}.{i}", "alias": "x" * (i % 7)}} for i in range(60)]
        wanted += [e["at"] for e in events]
        (tmp_path / f"log{f}.jsonl").write_text("\n".join(map(json.dumps, events)) + "\n\n")
    got = records.vocabulary_log(spark, str(tmp_path), "finish", 200).orderBy("seq").collect()
    assert [r["at"] for r in got] == wanted and [r["seq"] for r in got] == list(range(1, 181))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "200"
    assert split.pieces(spark, str(tmp_path), "\n", 200).agg(F.count_distinct("file", "block")).first()[0] > 20
