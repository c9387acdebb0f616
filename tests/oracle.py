"""Compare a Spark query with its DuckDB text: same columns, same types, same multiset of rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def kind(name):
    name = str(name).lower()
    return {"bigint": "long", "integer": "int", "varchar": "string", "hugeint": "huge"}.get(name, name)


def mismatch(df, con, sql):
    """None when equal, else a short text."""
    rel = con.sql(sql)
    want_types = dict(zip(rel.columns, (kind(x) for x in rel.types)))
    got_types = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    if want_types != got_types:
        return f"types {got_types} != {want_types}"
    cols = sorted(want_types)
    order = {c: i for i, c in enumerate(rel.columns)}
    want = sorted((tuple(r[order[c]] for c in cols) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    if want == got:
        return None
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}; only spark {list(set(got) - set(want))[:2]}; only sql {list(set(want) - set(got))[:2]}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(diff)} of {len(want)} rows differ, e.g. spark {diff[0][0]} sql {diff[0][1]}"
