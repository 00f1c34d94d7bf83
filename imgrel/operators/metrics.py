"""Counters, histograms and rates of an access log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Upper bounds of the latency histogram in seconds.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
# Statuses with a counter of their own.
STATUSES = ("200", "304", "400", "401", "403", "404", "406", "413", "415", "500", "501", "502", "503", "508")
# Methods, path and label of each route.
ROUTES = (
    (("GET", "HEAD"), "/health", "health"), (("GET", "HEAD"), "/health/live", "health_live"),
    (("GET", "HEAD"), "/health/ready", "health_ready"), (("GET", "HEAD"), "/images/by-path", "public_by_path"),
    (("GET", "HEAD"), "/images/by-url", "public_by_url"), (("POST",), "/images:transform", "transform"),
    (("POST",), "/images", "upload"), (("GET", "HEAD"), "/metrics", "metrics"),
)


def route(method: Column, path: Column) -> Column:
    out = F.lit("unknown")
    for methods, known, label in ROUTES:
        out = F.when(method.isin(*methods) & (path == known), label).otherwise(out)
    return out


def status_label(status: Column) -> Column:
    return F.when(status.isin(*STATUSES), status).otherwise("other")


def counts_by(df: DataFrame, label: Column, domain: list[str]) -> DataFrame:
    """``(label, n)`` for every label of a fixed domain, zeros included."""
    known = df.sparkSession.createDataFrame([(x,) for x in domain], "label string")
    counted = df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram(df: DataFrame, label: str, value: str) -> DataFrame:
    """``(label, le, n)``: cumulative counts by bound, ``+Inf`` last; one pass with partial aggregation."""
    names = [str(b) if b != int(b) else str(float(b)) for b in BOUNDS]
    counts = df.groupBy(label).agg(
        *(F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(BOUNDS)), F.count(value).alias("inf")
    )
    pairs = F.array(
        *(F.struct(F.lit(n).alias("le"), F.col(f"b{k}").alias("n")) for k, n in enumerate(names)),
        F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("n")),
    )
    return counts.select(label, F.explode(pairs).alias("p")).select(label, "p.le", "p.n")


def quantile(df: DataFrame, label: str, value: str, q: float) -> DataFrame:
    """``(label, quantile)`` from the buckets: linear inside a bucket, the last finite bound above it."""
    buckets = histogram(df, label, value).withColumn(
        "bound", F.when(F.col("le") == "+Inf", float("inf")).otherwise(F.col("le").cast("double"))
    )
    order = Window.partitionBy(label).orderBy("bound")
    steps = buckets.select(
        label, "bound", "n", F.coalesce(F.lag("bound").over(order), F.lit(0.0)).alias("low"),
        F.coalesce(F.lag("n").over(order), F.lit(0)).alias("under"), F.max("n").over(Window.partitionBy(label)).alias("total"),
    )
    hit = steps.where(F.col("n") >= F.col("total") * q)
    first = hit.groupBy(label).agg(F.min_by(F.struct("bound", "n", "low", "under", "total"), "bound").alias("b"))
    inside = F.col("b.low") + (F.col("b.bound") - F.col("b.low")) * (F.col("b.total") * q - F.col("b.under")) / (F.col("b.n") - F.col("b.under"))
    return first.select(label, F.round(
        F.when(F.col("b.bound") == float("inf"), F.col("b.low")).when(F.col("b.n") == F.col("b.under"), F.col("b.bound")).otherwise(inside), 6
    ).alias("quantile"))


def rate(log: DataFrame, minutes: int = 5) -> DataFrame:
    """Requests and errors of each route by tumbling window."""
    start = F.window(F.col("ts").cast("timestamp"), f"{minutes} minutes")["start"]
    return log.groupBy(F.unix_seconds(start).alias("window_start"), route(F.col("method"), F.col("path")).alias("route")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= "500").alias("errors"),
    )


def hit_ratio(log: DataFrame) -> DataFrame:
    known = log.where("cache_status IS NOT NULL")
    return known.groupBy("format").agg(
        F.count_if(F.col("cache_status") == "hit").alias("hits"), F.count(F.lit(1)).alias("lookups"),
        F.round(F.avg((F.col("cache_status") == "hit").cast("double")), 6).alias("ratio"),
    )


def exposition(buckets: DataFrame, label: str, name: str) -> DataFrame:
    """Histogram rows as lines of the text format, one row for each label."""
    bound = F.when(F.col("le") == "+Inf", float("inf")).otherwise(F.col("le").cast("double"))
    shown = F.when(F.col("le").endswith(".0"), F.substring_index("le", ".", 1)).otherwise(F.col("le"))
    line = F.concat(F.lit(f'{name}_bucket{{{label}="'), F.col(label), F.lit('",le="'), shown, F.lit('"} '), F.col("n").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct(bound.alias("bound"), line.alias("line"))))
    return buckets.groupBy(label).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("body"))


def problem(status: Column, title: Column, detail: Column) -> Column:
    """An error body in the problem-details format."""
    return F.to_json(F.struct(F.lit("about:blank").alias("type"), title.alias("title"), status.alias("status"), detail.alias("detail")))


def bucket_counts(value: Column) -> Column:
    """An aggregate: cumulative counts of ``value`` by bound, ``+Inf`` last, as one array."""
    return F.array(*(F.count_if(value <= b) for b in BOUNDS), F.count(value))


def bucket_quantile(buckets: Column, q: float) -> Column:
    """The quantile that the counts of ``bucket_counts`` tell: linear inside a bucket, the last finite bound beyond; null without values."""
    bounds, most = F.array(*(F.lit(float(b)) for b in (0.0, *BOUNDS))), len(BOUNDS)
    total = F.get(buckets, most)
    at = F.array_position(F.transform(buckets, lambda n: n >= total * q), True).cast("int") - 1
    low, under = F.get(bounds, at), F.coalesce(F.get(buckets, at - 1), F.lit(0))
    here = F.get(buckets, at)
    inside = low + (F.get(bounds, at + 1) - low) * (total * q - under) / F.nullif(here - under, F.lit(0))
    return F.when(total > 0, F.round(F.when(at == most, low).otherwise(F.coalesce(inside, F.get(bounds, at + 1))), 6))


def summary(df: DataFrame, labels: dict[str, tuple[Column, list[str] | None]], value: str) -> DataFrame:
    """``(metric, label, n, total, buckets)`` for every label and for all rows together, in one pass over ``df``.

    ``labels`` gives each metric its column and the fixed domain of its
    labels, zeros included, or None for those that occur.  ``all`` is the metric of
    all rows, with an empty label.  Rows with a null label do not count there.
    """
    names = list(labels)
    marked = df.select(F.col(value), *(column.alias(f"label_{name}") for name, (column, _) in labels.items()))
    columns = [F.col(f"label_{name}") for name in names]
    grouped = marked.groupingSets([*([c] for c in columns), []], *columns).agg(
        F.grouping_id().alias("set"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), bucket_counts(F.col(value)).alias("buckets"),
    )
    every = (1 << len(names)) - 1
    metric, label = F.lit("all"), F.lit("")
    for k, name in enumerate(names):
        own = F.col("set") == every - (1 << (len(names) - 1 - k))
        metric, label = F.when(own, name).otherwise(metric), F.when(own, F.col(f"label_{name}")).otherwise(label)
    found = grouped.select(metric.alias("metric"), label.alias("label"), "n", "total", "buckets").where("label IS NOT NULL")
    # a table of the code's own labels
    fixed = [(name, x) for name, (_, domain) in labels.items() for x in domain or ()] + [("all", "")]
    known = df.sparkSession.createDataFrame(fixed, "metric string, label string")
    none = F.array(*(F.lit(0).cast("long") for _ in range(len(BOUNDS) + 1)))
    return found.join(known, ["metric", "label"], "full_outer").select(
        "metric", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("buckets", none).alias("buckets"),
    )


def sliding(log: DataFrame, length: str, step: str) -> DataFrame:
    """Requests, errors and the 95th percentile of the latency of each route by sliding window."""
    start = F.window(F.col("ts").cast("timestamp"), length, step)["start"]
    counted = log.groupBy(start.alias("start"), route(F.col("method"), F.col("path")).alias("route")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= "500").alias("errors"), bucket_counts(F.col("latency_s")).alias("buckets"),
    )
    return counted.select(F.unix_seconds("start").alias("window_start"), "route", "n", "errors", bucket_quantile(F.col("buckets"), 0.95).alias("p95"))


def _shown(bound: float) -> str:
    return str(int(bound)) if bound == int(bound) else str(bound)


def full_exposition(rows: DataFrame, prefix: str, described: dict[str, tuple[str, str]]) -> DataFrame:
    """``(metric, body)``: the text format of a ``summary``: help and type, then counters or histograms by label.

    ``described`` gives each metric its help and ``counter`` or ``histogram``.
    """
    facts = rows.sparkSession.createDataFrame([(m, h, k) for m, (h, k) in described.items()], "metric string, help string, kind string")
    name = F.concat(F.lit(f"{prefix}_"), F.col("metric"))
    of = F.when(F.col("label") == "", "").otherwise(F.concat(F.lit('label="'), F.col("label"), F.lit('"')))
    braced = F.when(of == "", "").otherwise(F.concat(F.lit("{"), of, F.lit("}")))
    bounds = F.array(*(F.lit(_shown(b)) for b in BOUNDS), F.lit("+Inf"))
    comma = F.when(of == "", "").otherwise(F.concat(of, F.lit(",")))
    bucket = lambda le, k: F.concat(name, F.lit("_bucket{"), comma, F.lit('le="'), le, F.lit('"} '), F.get("buckets", k).cast("string"))
    lines = F.when(F.col("kind") == "counter", F.array(F.concat(name, F.lit("_total"), braced, F.lit(" "), F.col("n").cast("string")))).otherwise(F.concat(
        F.transform(bounds, bucket),
        F.array(
            F.concat(name, F.lit("_sum"), braced, F.lit(" "), F.format_string("%.3f", "total")),
            F.concat(name, F.lit("_count"), braced, F.lit(" "), F.get("buckets", len(BOUNDS)).cast("string")),
        ),
    ))
    full = F.when(F.col("kind") == "counter", F.concat(name, F.lit("_total"))).otherwise(name)
    head = F.concat(F.lit("# HELP "), full, F.lit(" "), F.col("help"), F.lit("\n# TYPE "), full, F.lit(" "), F.col("kind"))
    shown = rows.join(F.broadcast(facts), "metric").select("metric", head.alias("head"), "label", F.array_join(lines, "\n").alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("label", "text")))  # one text for each label
    return shown.groupBy("metric", "head").agg(ordered.alias("all")).select(
        "metric", F.concat("head", F.lit("\n"), F.array_join(F.transform("all", lambda x: x["text"]), "\n")).alias("body")
    )
