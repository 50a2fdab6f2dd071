"""Differential test on generated driver tables with deliberately skewed keys.

One customer places a third of all orders and fires a third of all events, one part is
on a third of all lines, some customers only have cancelled / open orders, and events
straddle New Year.  Every registered metric runs on these tables in Spark and in its
DuckDB oracle; results must be equal value for value.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import os
import tempfile

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from shopmetrics.oracle import all_sql
from shopmetrics.plans import cohort
from shopmetrics.plans.registry import all_queries
from shopmetrics.sources.adapters import DriverTables

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date"}
RAW = ["region", "nation", "customer", "part", "orders", "lineitem", "events"]


def _write(root: str, name: str, table: pa.Table) -> None:
    pq.write_table(table, os.path.join(root, f"{name}.parquet"))


def make_driver_tables(root: str, seed: int = 11) -> None:
    rng = np.random.default_rng(seed)
    hot_user, hot_part = 7, 3
    _write(root, "region", pa.table({"r_regionkey": pa.array(range(5), pa.int32()),
                                     "r_name": [f"REGION_{i}" for i in range(5)]}))
    _write(root, "nation", pa.table({"n_nationkey": pa.array(range(25), pa.int32()),
                                     "n_name": [f"NATION_{i}" for i in range(25)],
                                     "n_regionkey": pa.array([i % 5 for i in range(25)], pa.int32())}))
    n_cust = 120
    _write(root, "customer", pa.table({
        "c_custkey": pa.array(range(n_cust), pa.int64()),
        "c_name": [f"Customer#{i}" for i in range(n_cust)],
        "c_nationkey": pa.array(rng.integers(0, 25, n_cust), pa.int32()),
        "c_acctbal": rng.uniform(-999, 9999, n_cust).round(2),
        "c_mktsegment": rng.choice(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], n_cust),
    }))
    n_part = 60
    _write(root, "part", pa.table({
        "p_partkey": pa.array(range(n_part), pa.int64()),
        "p_name": rng.choice(["red widget", "small ring", "blue gear", "green bolt"], n_part),
        "p_brand": [f"Brand#{i % 7}" for i in range(n_part)],
        "p_type": rng.choice(["ECONOMY", "STANDARD", "PROMO", "LARGE", "MEDIUM", "SMALL"], n_part),
        "p_size": pa.array(rng.integers(1, 50, n_part), pa.int32()),
        "p_retailprice": (rng.integers(90000, 200000, n_part) / 100.0),
    }))
    n_ord = 900
    cust = rng.integers(0, n_cust, n_ord)
    cust[rng.random(n_ord) < 1 / 3] = hot_user
    status = rng.choice(["F", "O", "P"], n_ord, p=[0.7, 0.15, 0.15])
    status[cust == 11] = "P"            # a customer with cancelled orders only
    start = dt.datetime(2023, 1, 1)
    dates = [start + dt.timedelta(days=int(d)) for d in rng.integers(0, 720, n_ord)]
    _write(root, "orders", pa.table({
        "o_orderkey": pa.array(range(n_ord), pa.int64()),
        "o_custkey": pa.array([None if i % 31 == 5 else int(c) for i, c in enumerate(cust)], pa.int64()),  # some without a buyer
        "o_orderstatus": status,
        "o_totalprice": rng.integers(1000, 5000000, n_ord) / 100.0,
        "o_orderdate": pa.array(dates, pa.timestamp("us")),
        "o_orderpriority": rng.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], n_ord),
    }))
    lines = []
    for o in range(n_ord):
        for ln in range(int(rng.integers(0, 6))):
            part = hot_part if rng.random() < 1 / 3 else int(rng.integers(0, n_part))
            qty = float(rng.integers(1, 50))
            lines.append((o, part, int(rng.integers(0, 10)), ln + 1, qty,
                          round(qty * float(rng.integers(900, 2000)) / 1.0, 2),
                          float(rng.integers(0, 11)) / 100.0, float(rng.integers(0, 9)) / 100.0,
                          str(rng.choice(["R", "A", "N"])), str(rng.choice(["O", "F"])), dates[o]))
    cols = list(zip(*lines))
    _write(root, "lineitem", pa.table({
        "l_orderkey": pa.array(cols[0], pa.int64()), "l_partkey": pa.array(cols[1], pa.int64()),
        "l_suppkey": pa.array(cols[2], pa.int64()), "l_linenumber": pa.array(cols[3], pa.int32()),
        "l_quantity": pa.array(cols[4], pa.float64()), "l_extendedprice": pa.array(cols[5], pa.float64()),
        "l_discount": pa.array(cols[6], pa.float64()), "l_tax": pa.array(cols[7], pa.float64()),
        "l_returnflag": list(cols[8]), "l_linestatus": list(cols[9]),
        "l_shipdate": pa.array(cols[10], pa.timestamp("us")),
    }))
    n_ev = 1500
    users = rng.integers(0, 40, n_ev)
    users[rng.random(n_ev) < 1 / 3] = hot_user
    ev_start = dt.datetime(2023, 12, 25)
    ts = [ev_start + dt.timedelta(seconds=int(s)) for s in rng.integers(0, 20 * 86400, n_ev)]
    _write(root, "events", pa.table({
        "event_id": pa.array(range(n_ev), pa.int64()),
        "ts": pa.array(ts, pa.timestamp("us")),
        "user_id": pa.array([None if i % 29 == 3 else int(u) for i, u in enumerate(users)], pa.int64()),  # and without a user
        "event_type": rng.choice(["view", "click", "signup", "error", "purchase"], n_ev, p=[.4, .25, .15, .1, .1]),
        "value": rng.uniform(0, 100, n_ev).round(2),
        "props": [json.dumps({"k": int(k)}) for k in rng.integers(0, n_part, n_ev)],
    }))


def _norm(v):
    if v is pd.NA:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        return v.item()
    return v


def _rows(df, cols):
    out = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def skewed_dir():
    root = tempfile.mkdtemp(prefix="shopmetrics-skewed-")
    make_driver_tables(root)
    return root


def test_all_metrics_match_oracle_on_skewed_tables(spark, skewed_dir):
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skewed_dir}/{t}.parquet')")
    months = sorted(r[0] for r in cohort.cohort_cells(DriverTables(spark, skewed_dir).orders)
                    .select("month_number").distinct().collect())
    sqls = all_sql(months)
    mismatched = {}
    for name, q in all_queries().items():
        found = q(spark, skewed_dir)
        s = found.toPandas()
        con.execute(f"CREATE OR REPLACE VIEW oracle_{name} AS {sqls[name]}")  # as the driver does
        rel = con.sql(f"SELECT * FROM oracle_{name}")
        types = {c: str(t).split("(")[0] for c, t in zip(rel.columns, rel.types)}
        d = rel.df()
        cols = sorted(s.columns)
        if cols != sorted(d.columns):
            mismatched[name] = "columns"
        elif {c: TYPES.get(t, t) for c, t in types.items()} != {f.name: f.dataType.simpleString().split("(")[0] for f in found.schema}:
            mismatched[name] = f"types {types}"
        elif _rows(s, cols) != _rows(d, cols):
            mismatched[name] = f"values ({len(s)} vs {len(d)} rows)"
    assert mismatched == {}
