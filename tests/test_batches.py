"""Keyed append and the cohort state: retries, failures, refused keys, retractions, pruned reads."""

from __future__ import annotations

import pytest
from conftest import D, M, make_orders, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shopmetrics.model import ORDERS
from shopmetrics.plans import cohort as C
from shopmetrics.plans.cohort_state import CohortState, corrections, signed
from shopmetrics.sources.batches import KeyedTable


def order(oid, user=1, day="2024-01-01", total=10, status="completed"):
    return (oid, oid, user, D(day), None if total is None else M(total), M(0), "card", status)


def orders_of(spark, *given):
    return spark.createDataFrame(list(given), ORDERS)


def ids(table):
    return sorted(r[0] for r in table.read().select("order_id").collect())


def test_same_batch_twice_and_known_keys(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "orders", width=10)
    assert rows(t.read()) == [] and t.read().columns == ORDERS.names
    first = orders_of(spark, order(1), order(2), order(15))
    assert rows(t.append(first, "day1")) == []
    before = sorted(rows(t.read()))
    assert rows(t.append(first, "day1")) == [] and sorted(rows(t.read())) == before == sorted(rows(first))
    again = t.append(orders_of(spark, order(2, total=99), order(3), order(15), order(16)), "day2")
    assert sorted(rows(again)) == [(2, "key exists", 1), (15, "key exists", 1)]
    assert ids(t) == [1, 2, 3, 15, 16]
    assert rows(t.read().where("order_id = 2"), "total_amount") == [(M(10),)]
    # The earlier batch once more: its own rows are no obstacle, those of the later batch are.
    assert rows(t.append(first, "day1")) == [] and ids(t) == [1, 2, 3, 15, 16]


def test_repeated_and_null_keys_in_a_batch(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "order_items", width=100)
    schema = "order_id long, line_number int, product_id long, quantity int, unit_price decimal(18,4)"
    data = [(1, 1, 7, 1, None), (1, 1, 7, 2, None), (1, 1, 7, 2, None), (1, 2, 7, 1, None), (None, 1, 7, 1, None), (None, 1, 7, 5, None), (2, None, 1, 1, None)]
    refused = t.append(spark.createDataFrame(data, schema), "a")
    assert sorted(rows(refused), key=str) == sorted([(1, 1, "key repeated", 2), (None, 1, "key is null", 2), (2, None, "key is null", 1)], key=str)
    assert sorted(rows(t.read(), "order_id", "line_number", "quantity")) == [(1, 1, 1), (1, 2, 1)]


def test_a_write_that_dies_leaves_the_old_rows(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "orders", width=10)
    t.append(orders_of(spark, order(1), order(2)), "day1")
    bad = orders_of(spark, order(3), order(4)).withColumn("total_amount", F.when(F.col("order_id") == 4, F.raise_error("lost").cast("decimal(18,2)"))
                                                          .otherwise(F.col("total_amount")))
    with pytest.raises(PySparkException):
        t.append(bad, "day2")
    assert ids(t) == [1, 2]
    # Files of a write that never finished are not read either.
    good = orders_of(spark, order(3), order(4))
    t.append(good, "day2")
    (tmp_path / "rows" / "batch=day2" / "_SUCCESS").unlink()
    assert ids(t) == [1, 2]
    assert rows(t.append(good, "day2")) == [] and ids(t) == [1, 2, 3, 4]


def test_keys_are_looked_for_in_the_touched_ranges_only(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "orders", width=10)
    t.append(orders_of(spark, *[order(i) for i in range(100)]), "old")
    plan = t.known_keys([3], "new")._jdf.queryExecution().executedPlan().toString()
    assert "(key_range" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "ReadSchema: struct<order_id:bigint>" in plan
    files = {r[0] for r in t.known_keys([3], "new").select(F.input_file_name()).collect()}
    assert files and all("key_range=3/" in f for f in files)


def test_empty_batch_and_bad_names(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path), "orders")
    assert rows(t.append(orders_of(spark), "none")) == [] and ids(t) == []
    with pytest.raises(ValueError, match="a batch is named"):
        t.append(orders_of(spark), "../x")


def state_equals(state, orders, every=False):
    """All measures of C1–C8 side by side; with ``every`` also each metric by itself."""
    own, fresh = state.cells(), C.cohort_cells(orders)
    assert sorted(rows(C.cell_report(own)), key=str) == sorted(rows(C.cell_report(fresh)), key=str)
    if every:
        for (name, a), b in zip(C.report_of(own).items(), C.report_of(fresh).values()):
            assert sorted(rows(a), key=str) == sorted(rows(b), key=str), name


def test_state_after_batches_with_retractions_equals_a_fresh_one(spark, tmp_path):
    s = CohortState(spark, str(tmp_path), buckets=4)
    final = make_orders(spark)
    old = final.withColumn("status", F.when(F.col("order_id").isin(4, 6, 7, 8), "completed").otherwise(F.col("status")))
    assert s.apply(signed(old.where("order_id <= 3")), "b1")
    state_equals(s, old.where("order_id <= 3"))
    assert s.apply(signed(old.where("order_id > 3")), "b2")
    state_equals(s, old)
    # User 4 leaves altogether, user 3's first month moves, user 2 loses a month.
    assert s.apply(corrections(old.where("order_id in (4, 6, 7, 8)"), final.where("order_id in (4, 6, 7, 8)")), "b3")
    state_equals(s, final, every=True)
    assert not s.apply(corrections(old.where("order_id in (4, 6, 7, 8)"), final.where("order_id in (4, 6, 7, 8)")), "b3")
    state_equals(s, final)


def test_state_with_null_users_amounts_and_an_empty_batch(spark, tmp_path):
    s = CohortState(spark, str(tmp_path), buckets=2)
    a = [order(1, None), order(2, 5, total=None), order(3, 5, "2024-02-01", total=None), order(4, 5, "2024-02-09", 7), order(5, 6, "2024-02-01", None)]
    s.apply(signed(orders_of(spark, *a)), "a")
    s.apply(signed(orders_of(spark)), "empty")
    assert s.changes.committed() == ["a", "empty"]
    state_equals(s, orders_of(spark, *a))
    s.apply(signed(orders_of(spark, a[3]), -1), "c")
    state_equals(s, orders_of(spark, *a[:3], a[4]))


def test_a_run_that_dies_between_both_writes_changes_nothing(spark, tmp_path):
    s = CohortState(spark, str(tmp_path), buckets=2)
    a, b = orders_of(spark, order(1, 1), order(2, 2)), orders_of(spark, order(3, 1, "2023-12-01"), order(4, 3))
    s.apply(signed(a), "a")
    write, s.changes.write = s.changes.write, None
    with pytest.raises(TypeError):
        s.apply(signed(b), "b")
    state_equals(s, a)
    s.changes.write = write
    s.apply(signed(orders_of(spark, order(9, 9))), "c")  # another batch in between doesn't see the half-written one
    s.apply(signed(b), "b")
    state_equals(s, a.union(b).union(orders_of(spark, order(9, 9))))


def test_a_batch_reads_the_buckets_it_touches(spark, tmp_path):
    s = CohortState(spark, str(tmp_path), buckets=16)
    s.apply(signed(orders_of(spark, *[order(i, i) for i in range(200)])), "a")
    plan = s.before([3])._jdf.queryExecution().executedPlan().toString()
    assert "(bucket" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    files = [r[0] for r in s.before([3]).select(F.input_file_name()).distinct().collect()]
    assert files and all("bucket=3/" in f for f in files)
