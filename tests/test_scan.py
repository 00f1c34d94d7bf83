"""Running values over ranges, with hot, null and single keys."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from imgrel.operators import limits, scan


def some_rows(seed, n=3000):
    rng = random.Random(seed)
    return [(rng.choice([1] * 18 + [2, None]), rng.randint(0, 200), k, rng.choice([None, 1, 5, -3]), rng.choice([None] * 30 + [True, False])) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, t long, id long, v long, flag boolean").repartition(4)


@pytest.mark.parametrize("parts", [1, 7])
def test_running_values_are_loops(spark, parts):
    rows = some_rows(parts)
    sums = {r.id: r.before for r in scan.running_sum(frame(spark, rows), ["key"], ["t", "id"], "v", "before", parts).collect()}
    lasts = {r.id: r.last for r in scan.last_known(frame(spark, rows), ["key"], ["t", "id"], "flag", "last", parts).collect()}
    whole = {r.id: r.before for r in scan.running_sum(frame(spark, rows), [], ["t", "id"], "v", "before", parts).collect()}
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for _, own in groupby(sorted(rows, key=order), key=lambda r: r[0]):
        total, last = 0, None
        for _, _, i, v, flag in own:
            last = last if flag is None else flag
            assert (sums[i], lasts[i]) == (total, last)
            total += v or 0
    total = 0
    for _, _, i, v, _ in sorted(rows, key=lambda r: r[1:3]):
        assert whole[i] == total
        total += v or 0
    assert len(sums) == len(lasts) == len(whole) == len(rows)


def test_nothing_to_scan(spark):
    empty = frame(spark, [])
    assert scan.running_sum(empty, ["key"], ["t", "id"], "v", "x").count() == 0 == scan.last_known(empty, ["key"], ["t"], "flag", "x").count()


def test_a_hot_key_is_spread(spark):
    """With nine tenths of the rows on one key no range holds much more than its share."""
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 50).otherwise(-1).alias("key"), F.col("id").alias("t"), F.lit(1).alias("v"))
    sizes = [r["count"] for r in scan.ranges(rows, ["key"], ["t"], 8).groupBy(scan.PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    before = scan.running_sum(rows, ["key"], ["t"], "v", "n", 8).where("key = -1").agg(F.max("n"), F.count("n")).first()
    assert tuple(before) == (17_999, 18_000)


def test_a_busy_server(spark):
    """Requests that run on one server with nine tenths of them, against counting pairs."""
    rng = random.Random(9)
    events = [(0 if rng.random() < 0.9 else rng.randint(1, 5), k, s := rng.randint(0, 300), s + rng.randint(1, 20)) for k in range(600)]
    df = spark.createDataFrame(events, "server long, event_id long, start long, end long")
    found = {r.event_id: r.running for r in limits.in_flight(df, 5).collect()}
    assert found == {i: sum(s2 == s and e2 > t and (t2, i2) < (t, i) for s2, i2, t2, e2 in events) for s, i, t, _ in events}
