"""Locations against the standard library, and scans against a plain loop."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from imgrel.operators import origin

BASES = ("https://a.example/p/q/r?x=1#f", "http://a.example", "https://a.example:443/", "https://a.example/one")
LOCATIONS = (
    "g", "./g", "g/", "/g", "//h.example/x", "?y", "g?y#s", "#s", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g",
    "g.", "..g", "./../g", "g/./h", "g/../h", "https://z.example/q", "HTTP://z.example", "g?y/../x", "mailto:a@b",
)


def test_locations_are_read_as_the_standard_library_does(spark):
    pairs = [(b, x) for b in BASES for x in LOCATIONS]
    df = spark.createDataFrame(pairs, "base string, location string").select("base", "location", origin.resolve(F.col("base"), F.col("location")).alias("url"))
    for row in df.collect():
        expected = urljoin(row["base"], row["location"])
        # browsers give a host without a path the path "/"
        if row["base"].endswith(".example") and row["location"] and expected.startswith("http://a.example") and not expected.startswith("http://a.example/"):
            expected = expected.replace("a.example", "a.example/", 1)
        # a whole URL is kept as it is written, its scheme too
        if row["location"].startswith("HTTP:"):
            expected = row["location"]
        if row["location"] in ("", "#s"):
            expected = row["base"].split("#")[0] + row["location"]
        assert row["url"] == expected, row


def test_encoded_dots_and_missing_locations(spark):
    df = spark.createDataFrame([("https://a.example/p/q", "%2e%2E/x"), ("https://a.example/p/q", None)], "base string, location string")
    assert [r[0] for r in df.select(origin.resolve(F.col("base"), F.col("location"))).collect()] == ["https://a.example/x", None]


def test_scans_against_a_loop(spark):
    rows = [(n, s * s * (n + 3) % 4001) for n in range(5) for s in range(600)] + [(1, 5), (1, 5), (None, 4), (2, None)]
    expected = set()
    for node in range(5):
        last = None
        for second in sorted({s for n, s in rows if n == node and s is not None}):
            if last is None or second - last >= 60:
                expected.add((node, second))
                last = second
    df = spark.createDataFrame(rows, "node int, second long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = [tuple(r) for r in origin.eviction_scans(df).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(expected) and set(found) == expected
    assert origin.eviction_scans(df.where("false")).count() == 0
