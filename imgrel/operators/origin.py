"""Remote sources as tables: what the origin cache holds, what is fetched, and what a cached answer looks like."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import http, negotiate, urls

REDIRECTS = (301, 302, 303, 307, 308)


def origin_key(namespace: str, url: Column) -> Column:
    """The key of a fetched body; sources and watermarks have namespaces of their own."""
    return F.sha2(F.concat(F.lit(f"{namespace}:"), url), 256)


def size_error(declared: Column, actual: Column, most: int) -> Column:
    """A cap on what a response declares and on what it really holds."""
    return F.when((declared > most) | (actual > most), f"remote response exceeds {most} bytes")


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments carried out, percent-encoded dots included."""
    segments = F.split(path, "/", -1)
    plain = F.transform(segments, lambda s: F.regexp_replace(s, "(?i)%2e", "."))
    named = F.transform(F.arrays_zip(segments.alias("as_is"), plain.alias("plain")), lambda s: F.when(s["plain"].isin(".", ".."), s["plain"]).otherwise(s["as_is"]))
    kept = F.aggregate(
        F.slice(named, 2, F.size(named)), F.array().cast("array<string>"),
        lambda out, s: F.when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(s == ".", out).otherwise(F.concat(out, F.array(s))),
    )
    closed = F.element_at(plain, -1).isin(".", "..")
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(closed & (F.size(kept) > 0), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve(base: Column, location: Column) -> Column:
    """A location as browsers read it against the URL that it came from; null without one."""
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*+://[^/?#]*+)", 1)
    path = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*+://[^/?#]*+([^?#]*+)", 1)
    path = F.when(path == "", "/").otherwise(path)
    place, tail = F.regexp_extract(location, "^([^?#]*+)", 1), F.regexp_extract(location, "^[^?#]*+(.*+)$", 1)
    within = F.when(F.startswith(location, F.lit("/")), place).otherwise(F.concat(F.regexp_extract(path, "^(.*/)", 1), place))
    return (
        F.when(location.rlike("^[A-Za-z][A-Za-z0-9+.-]*+:"), location)
        .when(F.startswith(location, F.lit("//")), F.concat(F.substring_index(base, "//", 1), location))
        .when(location.rlike("^(#|$)"), F.concat(F.regexp_extract(base, "^([^#]*+)", 1), location))
        .when(F.startswith(location, F.lit("?")), F.concat(origin, path, location))
        .otherwise(F.concat(origin, _without_dots(within), tail))
    )


def follow(start: DataFrame, responses: DataFrame, max_bytes: int, most: int = 5) -> DataFrame:
    """``start`` (url, distinct) with ``final``, ``n_hops``, ``outcome`` and the ``length`` of what was fetched.

    ``responses`` has src, status, location, encoding, declared and length, one
    row a URL.  Each of them is resolved and held against the URL policy once,
    however many chains pass it; a step is then one join on the URL.
    """
    target = resolve(F.col("src"), F.col("location"))
    edges = responses.withColumn("target", target).select(
        F.col("src").alias("src_"), F.col("status").alias("status_"), "target",
        F.when(F.col("status").isin(*REDIRECTS), urls.url_status(F.col("target"))).alias("allowed_"),
        http.encodings_allowed(F.coalesce("encoding", F.lit(""))).alias("encoding_"),
        size_error(F.col("declared"), F.col("length"), max_bytes).isNotNull().alias("large_"), F.col("length").alias("length_"),
    )
    rows = start.select("url", F.col("url").alias("final"), F.lit(0).cast("long").alias("n_hops"), F.lit(None).cast("long").alias("outcome"), F.lit(None).cast("long").alias("length"))
    for step in range(most + 1):
        seen = rows.join(edges, (rows["final"] == edges["src_"]) & rows["outcome"].isNull(), "left")
        moved = F.col("status_").isin(*REDIRECTS)
        outcome = (
            F.when(F.col("outcome").isNotNull(), F.col("outcome")).when(F.col("src_").isNull(), 502)
            .when(moved & F.lit(step == most), 508).when(moved & F.col("target").isNull(), 502)
            .when(moved & (F.col("allowed_") != 200), F.col("allowed_")).when(moved, F.lit(None))
            .when(~F.col("status_").between(200, 299) | ~F.col("encoding_"), 502).when(F.coalesce("large_", F.lit(False)), 413).otherwise(200)
        )
        goes_on = moved & outcome.isNull()
        fetched = F.col("outcome").isNull() & (outcome == 200)
        rows = seen.select(
            "url", F.when(goes_on, F.col("target")).otherwise(F.col("final")).alias("final"),
            (F.col("n_hops") + F.when(goes_on, 1).otherwise(0)).alias("n_hops"), outcome.cast("long").alias("outcome"),
            F.when(fetched, F.col("length_")).otherwise(F.col("length")).cast("long").alias("length"),
        )
    return rows


def fetch(requests: DataFrame, cached: DataFrame, responses: DataFrame, max_bytes: int, ttl: int, namespace: str = "src", most: int = 5) -> DataFrame:
    """``requests`` (id, url, now) with ``outcome``, ``origin`` (hit, miss or null), ``final``, ``n_hops`` and ``length``.

    The policy comes first, then the origin cache ``cached`` (key, mtime,
    size), and only what it lacks is fetched, each URL once however many
    requests ask for it.  The requests are the side that may be skewed; both
    tables that they meet have one row a URL.
    """
    asked = requests.withColumn("policy_", urls.url_status(F.col("url"))).withColumn("key_", origin_key(namespace, F.col("url")))
    entries = cached.select(F.col("key").alias("entry_"), "mtime", "size")
    looked = asked.join(entries, (asked["key_"] == entries["entry_"]) & (asked["policy_"] == 200), "left")
    fresh = F.coalesce(F.col("now") - F.col("mtime") <= ttl, F.lit(False))
    looked = looked.withColumn("origin", F.when(F.col("policy_") == 200, F.when(fresh, "hit").otherwise("miss")))
    wanted = looked.where("origin = 'miss'").select("url").distinct()
    got = follow(wanted, responses, max_bytes, most).withColumnsRenamed({"url": "url_", "outcome": "outcome_", "length": "length_"})
    joined = looked.join(got, (looked["url"] == got["url_"]) & (looked["origin"] == "miss"), "left")
    hit = F.col("origin") == "hit"
    outcome = F.when(F.col("policy_") != 200, F.col("policy_")).when(hit, F.when(F.col("size") > max_bytes, 413).otherwise(200)).otherwise(F.col("outcome_"))
    return joined.select(
        "id", "origin", outcome.cast("long").alias("outcome"), F.coalesce("final", "url").alias("final"), F.coalesce("n_hops", F.lit(0)).cast("long").alias("n_hops"),
        F.when(outcome == 200, F.when(hit, F.col("size")).otherwise(F.col("length_"))).cast("long").alias("length"),
    )


def answers(looked: DataFrame) -> DataFrame:
    """Looked-up requests (state, age, body, if_none_match, public) with the status and Age of the cached answer; null for a miss."""
    tag = negotiate.etag(F.col("body"))
    same = F.col("public") & negotiate.not_modified(F.col("if_none_match"), tag)
    hit = F.col("state") == "hit"
    return looked.withColumns({
        "status": F.when(hit, F.when(same, 304).otherwise(200)).cast("long"), "age_header": F.when(hit, F.col("age").cast("string")),
    })


def eviction_scans(writes: DataFrame, interval: int = 60) -> DataFrame:
    """``writes`` (node, second) that start an eviction scan: the first of a node, then any ``interval`` seconds or more after the last.

    Repeated seconds are one; the rest is read in order, batch by batch, and
    only the last scan is kept in memory, so a node may have any number of writes.
    """
    schema = writes.select("node", F.col("second").cast("long")).schema

    def started(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, last = None, None
        for batch in batches:
            seconds, nodes = batch["second"].to_numpy(), batch["node"].to_numpy()
            firsts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]]) if len(nodes) else np.array([], int)
            picked = []
            for begin, end in zip(firsts, [*firsts[1:], len(nodes)]):
                if node is None or nodes[begin] != node:
                    node, last = nodes[begin], None
                at = begin if last is None else begin + np.searchsorted(seconds[begin:end], last + interval)
                while at < end:
                    picked.append(at)
                    last = seconds[at]
                    at = begin + np.searchsorted(seconds[begin:end], last + interval)
            yield batch.iloc[picked]

    known = writes.where("node IS NOT NULL AND second IS NOT NULL").select("node", F.col("second").cast("long")).distinct()
    return known.repartition("node").sortWithinPartitions("node", "second").mapInPandas(started, schema)
