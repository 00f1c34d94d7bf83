"""One-pass summaries, quantiles from buckets and the text format on odd logs."""

import pytest
from pyspark.sql import functions as F

from imgrel.operators import metrics

LABELS = lambda: {"kind": (F.col("kind"), ["a", "b"]), "free": (F.col("free"), None)}


def log(spark, rows):
    return spark.createDataFrame(rows, "kind string, free string, latency_s double, label_kind int")


def test_summary_counts_every_label_once(spark):
    rows = [("a", "x", 0.004, 1), ("a", None, 40.0, 1), (None, "x", 0.005, 1), ("c", "", None, 1)]
    df = metrics.summary(log(spark, rows), LABELS(), "latency_s")
    found = {(r.metric, r.label): (r.n, round(r.total, 6), r.buckets[0], r.buckets[-1]) for r in df.collect()}
    assert found == {
        ("kind", "a"): (2, 40.004, 1, 2), ("kind", "b"): (0, 0.0, 0, 0), ("kind", "c"): (1, 0.0, 0, 0), ("free", "x"): (2, 0.009, 2, 2),
        ("free", ""): (1, 0.0, 0, 0), ("all", ""): (4, 40.009, 2, 3),
    }
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("latency_s") and plan.count("Scan ExistingRDD[kind") == 1  # one pass over the log


def test_summary_of_an_empty_log(spark):
    found = {(r.metric, r.label): r.n for r in metrics.summary(log(spark, []), LABELS(), "latency_s").collect()}
    assert found == {("kind", "a"): 0, ("kind", "b"): 0, ("all", ""): 0}


@pytest.mark.parametrize("values, want", [([], None), ([0.001] * 20, 0.00475), ([100.0], 30.0), ([0.004, 0.02], 0.0235), ([7.0, 7.0, 100.0], 30.0)])
def test_quantiles(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "v double").agg(metrics.bucket_counts(F.col("v")).alias("b"))
    assert df.select(metrics.bucket_quantile(F.col("b"), 0.95).alias("q")).first().q == want


def test_text_format(spark):
    rows = metrics.summary(log(spark, [("a", "x", 0.3, 1), ("a", "x", 2.0, 1)]), {"kind": (F.col("kind"), ["a", "b"])}, "latency_s")
    text = {r.metric: r.body.split("\n") for r in metrics.full_exposition(rows, "p", {"kind": ("By kind.", "counter"), "all": ("All.", "histogram")}).collect()}
    assert text["kind"] == ["# HELP p_kind_total By kind.", "# TYPE p_kind_total counter", 'p_kind_total{label="a"} 2', 'p_kind_total{label="b"} 0']
    assert text["all"][:3] == ["# HELP p_all All.", "# TYPE p_all histogram", 'p_all_bucket{le="0.005"} 0']
    assert text["all"][-4:] == ['p_all_bucket{le="30"} 2', 'p_all_bucket{le="+Inf"} 2', "p_all_sum 2.300", "p_all_count 2"]
