"""WARC archives: exact round trip, byte ranges, revisits."""

import base64
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from bomrec.llm import warc


def pages(n=40):
    rng = random.Random(1)
    out = [(i, f"http://e.org/{i} x", rng.choice(["same page", "", None, f"<p>{i}</p>" * rng.randint(1, 400), "é" * 50])) for i in range(n)]
    return [*out, (100, None, "x" * 3_000_000), (101, "u", bytes(rng.randrange(32, 127) for _ in range(200_000)).decode())]


@pytest.mark.parametrize("split_bytes", [1 << 10, 64 << 10, 8 << 20])
def test_round_trip(spark, tmp_path, split_bytes):
    some = pages()
    table = spark.createDataFrame(some, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).repartition(3)
    made = warc.write_archives(table, f"{tmp_path}/a", archive_bytes=1 << 16)
    assert made.agg(F.sum("records")).head()[0] == len(some)
    got = {r["record_id"]: r for r in warc.read_archives(made, split_bytes).collect()}
    assert len(got) == len(some)
    first = {}
    for i, _, html in sorted(some, key=lambda r: r[0]):
        first.setdefault(html or "", i)
    for i, _, html in some:
        r, data = got[f"<urn:page:{i}>"], (html or "").encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if first[html or ""] == i:
            assert r["record_type"] == "response" and r["payload"] == data and r["refers_to"] is None
        else:
            assert r["record_type"] == "revisit" and r["payload"] is None and r["refers_to"] == f"<urn:page:{first[html or '']}>"


def test_small_payloads_are_never_revisits(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(table, f"{tmp_path}/a", least_bytes=3)).collect()
    assert {r["record_id"][10:-1]: r["record_type"] for r in got} == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


def test_repeated_rows_and_null_ids_and_no_rows(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "b"), (2, "u", "b")], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(table, f"{tmp_path}/a")).collect()
    assert sorted((r["record_id"], r["record_type"]) for r in got) == [
        ("<urn:page:1>", "response"), ("<urn:page:1>", "response"), ("<urn:page:2>", "revisit"), ("<urn:page:>", "response")]
    assert warc.read_archives(warc.write_archives(table.limit(0), f"{tmp_path}/b")).collect() == []


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_ranges_own_what_begins_in_them_and_false_magic_is_passed():
    rng = random.Random(3)
    good = [warc.record("response", i, "u", warc.MAGIC * rng.randint(0, 9) + rng.randbytes(rng.randint(0, 500)), "2024-01-01T00:00:00Z") for i in range(30)]
    junk = [gzip.compress(b"no record"), warc.MAGIC + b"junk", b"\x1f\x8b", zlib.compress(b"x")]
    data = b"".join(g + (rng.choice(junk) if i % 4 == 0 else b"") for i, g in enumerate(good))
    for step in (7, 64, 1000, len(data)):
        found = [h["warc-record-id"] for a in range(0, len(data), step) for _, h, _ in warc.records_from(Bytes(data), a, min(a + step, len(data)))]
        assert found == [f"<urn:page:{i}>" for i in range(30)]
    assert warc.parsed(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n") is None
