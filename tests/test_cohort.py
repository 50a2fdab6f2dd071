from __future__ import annotations

from conftest import make_orders, rows

from shopmetrics.plans import cohort as C
from shopmetrics.plans import dashboard as D
from shopmetrics.plans import revenue as R


def test_c1_sizes(spark):
    assert rows(C.cohort_sizes(make_orders(spark))) == [("2024-01", 2, 2), ("2024-02", 1, 1)]


def test_c2_retention(spark):
    out = rows(C.cohort_retention(make_orders(spark)))
    assert out == [
        ("2024-01", "2024-01", 2, 2, 100.0, 0),
        ("2024-01", "2024-03", 2, 1, 50.0, 2),
        ("2024-02", "2024-02", 1, 1, 100.0, 0),
    ]


def test_c3_revenue_sums_to_r1(spark):
    o = make_orders(spark)
    c3 = rows(C.cohort_revenue(o))
    assert sum(r[4] for r in c3) == sum(r[2] for r in rows(R.revenue_monthly(o)))


def test_c4_user_value(spark):
    out = rows(C.cohort_user_value(make_orders(spark)))
    assert out == [("2024-01", 2, 3, 1.5, 350.0, 175.0, 116.67), ("2024-02", 1, 1, 1.0, 30.0, 30.0, 30.0)]


def test_c4p_agrees_with_c4(spark):
    o = make_orders(spark)
    c4 = [(r[0], r[1], r[2], r[3]) for r in rows(C.cohort_user_value(o))]
    assert c4 == rows(C.cohort_engagement(o))


def test_c5_retention_matrix_observed_cells_only(spark):
    wide = rows(C.retention_matrix_wide(make_orders(spark)))
    assert wide == [("2024-01", 100.0, 50.0), ("2024-02", 100.0, None)]


def test_c5_agrees_with_c2(spark):
    o = make_orders(spark)
    c2 = {(r[0], r[5]): round(r[4], 1) for r in rows(C.cohort_retention(o))}
    c5 = {(r[0], r[1]): r[2] for r in rows(C.retention_matrix(o))}
    assert c2 == c5


def test_c7_c8_ltv(spark):
    o = make_orders(spark)
    assert rows(C.ltv_curve(o)) == [("2024-01", 0, 150.0), ("2024-01", 2, 175.0), ("2024-02", 0, 30.0)]
    assert rows(C.ltv_latest(o)) == [("2024-01", 175.0), ("2024-02", 30.0)]


def test_c7_rounds_cells_before_accumulating(spark):
    rows_ = [(1, 1, "2024-01-05", 100.40, 0, "completed"), (2, 1, "2024-03-10", 50.40, 5, "completed"),
             (3, 2, "2024-01-20", 200, 0, "completed")]
    o = make_orders(spark, rows_)
    assert rows(C.revenue_matrix(o)) == [("2024-01", 0, 300.0), ("2024-01", 2, 50.0)]
    assert rows(C.ltv_curve(o)) == [("2024-01", 0, 150.0), ("2024-01", 2, 175.0)]


def test_month_zero_retention_is_100_and_sizes_sum_to_buyers(spark):
    o = make_orders(spark)
    assert all(r[2] == 100.0 for r in rows(C.retention_matrix(o)) if r[1] == 0)
    assert sum(r[1] for r in rows(C.cohort_sizes(o))) == rows(R.repeat_rate(o))[0][0]


def test_t10_lod_cohorts_use_any_status(spark):
    out = rows(D.retention_lod(make_orders(spark)), "cohort_month", "month_number", "retained_users", "cohort_size")
    assert out == [("2024-01", 0, 2, 3), ("2024-01", 1, 1, 3), ("2024-01", 2, 1, 3)]


def test_cohort_report_equals_individual_metrics(spark):
    o = make_orders(spark)
    report = C.cohort_report(o)
    for name, df in report.items():
        assert rows(df) == rows(getattr(C, name)(o)), name


def test_cohort_base_salts(spark):
    o = make_orders(spark)
    plain = sorted(rows(C.cohort_base(o)))
    assert plain == sorted(rows(C.cohort_base(o, salts=1))) == sorted(rows(C.cohort_base(o, salts=5)))
    assert len(plain) == o.where("status = 'completed'").count()
