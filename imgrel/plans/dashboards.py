"""All metrics of a log in one pass, sliding windows, and the whole text format."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.views import duck, view
from .service import _ROUTE

_NAMES = [label for *_, label in metrics.ROUTES] + ["unknown"]


def _summary(spark, sf):
    labels = {
        "requests": (metrics.route(F.col("method"), F.col("path")), _NAMES),
        "responses": (metrics.status_label(F.col("status")), [*metrics.STATUSES, "other"]),
        "cache": (F.col("cache_status"), ["hit", "miss"]),
        "duration_seconds": (F.col("format"), ["avif", "bmp", "jpeg", "png", "tiff", "webp"]),
    }
    return metrics.summary(view(spark, sf, "log"), labels, "latency_s")


def o_summary(spark, sf):
    rows = _summary(spark, sf)
    return rows.select("metric", "label", "n", F.round("total", 3).alias("total"), F.array_join(F.transform("buckets", lambda n: n.cast("string")), ",").alias("buckets"))


_COUNTS = "count(*) AS n, sum(latency_s) AS total, [" + ", ".join(f"count(*) FILTER (latency_s <= {float(b)}::DOUBLE)" for b in metrics.BOUNDS) + ", count(latency_s)] AS buckets"
_ALL = duck("log") + f""", l AS (SELECT {_ROUTE} AS requests, CASE WHEN status IN ('422', '429') THEN 'other' ELSE status END AS responses, cache_status AS cache, format AS duration_seconds, latency_s FROM log),
g AS (SELECT 'requests' AS metric, requests AS label, {_COUNTS} FROM l GROUP BY 2 UNION ALL SELECT 'responses', responses, {_COUNTS} FROM l GROUP BY 2 UNION ALL SELECT 'cache', cache, {_COUNTS} FROM l GROUP BY 2
  UNION ALL SELECT 'duration_seconds', duration_seconds, {_COUNTS} FROM l GROUP BY 2 UNION ALL SELECT 'all', '', {_COUNTS} FROM l),
d AS (SELECT 'requests' AS metric, unnest({_NAMES}) AS label UNION ALL SELECT 'responses', unnest({[*metrics.STATUSES, 'other']}) UNION ALL SELECT 'cache', unnest(['hit', 'miss'])
  UNION ALL SELECT 'duration_seconds', unnest(['avif', 'bmp', 'jpeg', 'png', 'tiff', 'webp']) UNION ALL SELECT 'all', ''),
s AS (SELECT metric, label, coalesce(n, 0) AS n, coalesce(total, 0) AS total, coalesce(buckets, list_transform(range({len(metrics.BOUNDS) + 1}), lambda x: 0::BIGINT)) AS buckets FROM d LEFT JOIN g USING (metric, label))
"""
O_SUMMARY = _ALL + "SELECT metric, label, n, round(total, 3) AS total, array_to_string(buckets, ',') AS buckets FROM s"


def o4_sliding(spark, sf):
    return metrics.sliding(view(spark, sf, "log"), "1 hour", "15 minutes")


_BOUND_ROWS = "(FROM (VALUES " + ", ".join(f"({k}, {float(b)}::DOUBLE)" for k, b in enumerate(metrics.BOUNDS)) + f", ({len(metrics.BOUNDS)}, 'inf'::DOUBLE)) AS t(k, bound))"
O4_SLIDING = duck("log") + f""", w AS (SELECT (floor(epoch(ts))::BIGINT // 900 - back) * 900 AS window_start, {_ROUTE} AS route, status, latency_s FROM log, range(4) AS r(back)),
b AS {_BOUND_ROWS}, h AS (SELECT window_start, route, k, bound, count(*) FILTER (latency_s <= bound) AS n FROM w, b GROUP BY ALL),
s AS (SELECT *, coalesce(lag(bound) OVER o, 0) AS low, coalesce(lag(n) OVER o, 0) AS under, max(n) OVER (PARTITION BY window_start, route) AS total FROM h WINDOW o AS (PARTITION BY window_start, route ORDER BY k)),
f AS (SELECT DISTINCT ON (window_start, route) * FROM s WHERE n >= total * 0.95::DOUBLE ORDER BY window_start, route, k),
c AS (SELECT window_start, route, count(*) AS n, count(*) FILTER (status >= '500') AS errors FROM w GROUP BY ALL)
SELECT c.window_start, c.route, c.n, c.errors, round(CASE WHEN total = 0 THEN NULL WHEN isinf(bound) THEN low WHEN f.n = under THEN bound ELSE low + (bound - low) * (total * 0.95::DOUBLE - under) / (f.n - under) END, 6) AS p95
FROM c JOIN f USING (window_start, route)"""

_HELP = {"requests": ("Requests by route.", "counter"), "responses": ("Responses by status.", "counter"), "cache": ("Lookups of the cache.", "counter"), "duration_seconds": ("Seconds by output format.", "histogram")}


def k7_text(spark, sf):
    """Counters and histograms with their help, types, sums and counts."""
    return metrics.full_exposition(_summary(spark, sf), "imgrel", _HELP)


_LES = "[" + ", ".join(f"'{metrics._shown(b)}'" for b in metrics.BOUNDS) + ", '+Inf']"
K7_TEXT = _ALL + f""", t AS (SELECT *, 'imgrel_' || metric AS name FROM s WHERE metric <> 'all'),
x AS (SELECT metric, name, label, CASE WHEN metric <> 'duration_seconds' THEN name || '_total{{label="' || label || '"}} ' || n ELSE
  array_to_string(list_transform(range(1, {len(metrics.BOUNDS) + 2}), lambda k: name || '_bucket{{label="' || label || '",le="' || ({_LES})[k] || '"}} ' || buckets[k]), chr(10))
  || chr(10) || name || '_sum{{label="' || label || '"}} ' || printf('%.3f', total) || chr(10) || name || '_count{{label="' || label || '"}} ' || buckets[{len(metrics.BOUNDS) + 1}] END AS text FROM t),
k AS (FROM (VALUES {", ".join(f"('{m}', '{h}', '{k}')" for m, (h, k) in _HELP.items())}) AS v(metric, help, kind))
SELECT metric, '# HELP ' || full_ || ' ' || any_value(help) || chr(10) || '# TYPE ' || full_ || ' ' || any_value(kind) || chr(10) || string_agg(text, chr(10) ORDER BY label) AS body
FROM (SELECT *, CASE WHEN kind = 'counter' THEN name || '_total' ELSE name END AS full_ FROM x JOIN k USING (metric)) GROUP BY metric, full_"""

QUERIES = {"o_summary": (o_summary, O_SUMMARY), "o4_sliding": (o4_sliding, O4_SLIDING), "k7_text": (k7_text, K7_TEXT)}
