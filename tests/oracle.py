"""Runs registered queries next to their SQL checks in DuckDB. Also usable as a script:
``python tests/oracle.py SF_DIR [KEY_PREFIX ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bomrec.plans.lens import TABLES  # noqa: E402


def session():
    from bomrec.session import local_session

    return local_session("8", quiet=True)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def kinds(types) -> list[str]:
    names = []
    for t in types:
        t = str(t).upper()
        for kind, marks in (("int", ("BIGINT", "INT", "LONG", "SHORT")), ("float", ("DOUBLE", "FLOAT")),
                            ("str", ("VARCHAR", "STRING")), ("bool", ("BOOL",)), ("ts", ("TIMESTAMP",)), ("date", ("DATE",))):
            if any(t.startswith(m) for m in marks):
                t = kind
                break
        names.append(t)
    return names


def compare(df, con, sql: str) -> str | None:
    """None when the Spark result equals the check, else what differs."""
    got_columns = df.columns
    got = _rows(got_columns, [tuple(r) for r in df.collect()])
    res = con.sql(sql)
    want = _rows(res.columns, res.fetchall())
    if sorted(got_columns) != sorted(res.columns):
        return f"columns {sorted(got_columns)} != {sorted(res.columns)}"
    spark_kinds = dict(zip(got_columns, kinds(f.dataType.simpleString() for f in df.schema.fields), strict=True))
    duck_kinds = dict(zip(res.columns, kinds(res.types), strict=True))
    off = {c: (spark_kinds[c], duck_kinds[c]) for c in got_columns if spark_kinds[c] != duck_kinds[c]}
    if len(got) != len(want):
        extra = sorted(set(got) - set(want), key=str)[:3]
        missing = sorted(set(want) - set(got), key=str)[:3]
        return f"{len(got)} rows != {len(want)}; only spark {extra}; only check {missing}"
    for g, w in zip(got, want, strict=True):
        if g != w:
            return f"{sorted(got_columns)}: {g} != {w}"
    return f"types {off}" if off else None


def main(argv: list[str]) -> int:
    from bomrec.plans import CHECKS, QUERIES

    sf_dir, prefixes = argv[0], argv[1:]
    spark, con = session(), connect(sf_dir)
    bad = 0
    for key in sorted(QUERIES):
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = QUERIES[key](spark, sf_dir)
            if key in CHECKS:
                problem = compare(df, con, CHECKS[key])
                n = ""
            else:
                problem, n = None, f"{df.count()} rows, no check"
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {key:34s} {time.time() - start:6.1f}s {n} {problem or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) > 0)
