"""Run catalogue queries and their SQL side by side.

``python tests/compare.py <sf_dir> [query ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (bytearray, bytes)):
        return bytes(value).hex()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(cell(r[i]) for i in order) for r in rows], key=repr)


def kind(name: str) -> str:
    name = name.lower()
    for family, words in {
        "int": ("bigint", "hugeint", "integer", "int", "smallint"), "double": ("double", "float"), "text": ("varchar", "string"),
        "time": ("timestamp", "timestamp_ntz"), "date": ("date",), "bool": ("boolean",),
    }.items():
        if name in words:
            return family
    return name


def compare(df, con, sql):
    """Differences between a DataFrame and a statement's result, empty when they agree."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    want = rows_of(names, cursor.fetchall())
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    exact = {n: (t, types[n].lower()) for n, t in df.dtypes}
    for n, (ours, theirs) in exact.items():
        same_width = {"bigint": "bigint", "int": "integer"}
        if kind(ours) != kind(theirs):
            problems.append(f"type of {n}: {ours} vs {theirs}")
        elif ours in same_width and theirs != same_width[ours]:
            problems.append(f"width of {n}: {ours} vs {theirs}")
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)}")
    if got != want:
        ours, theirs = set(map(repr, got)), set(map(repr, want))
        problems.append(f"only ours {sorted(ours - theirs)[:2]}")
        problems.append(f"only sql {sorted(theirs - ours)[:2]}")
    return problems


def main(sf_dir: str, wanted: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from tideline.session import local_session

    spark = local_session("compare", cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in wanted or queries:
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problems = compare(df, con, oracles[name])
                note = "ok" if not problems else "DIFF " + " | ".join(problems)
            else:
                note = f"rows {df.count()}"
        except Exception as err:  # report every query before failing
            note = f"FAIL {str(err)[:700]}"
        bad += note.startswith(("DIFF", "FAIL"))
        print(f"{name:34s} {time.time() - started:6.2f}s {note}", flush=True)
    print(f"{bad} bad; without sql: {sorted(set(queries) - set(oracles))}; orphan sql: {sorted(set(oracles) - set(queries))}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
