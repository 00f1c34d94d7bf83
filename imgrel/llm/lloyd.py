"""Operator 12: centroid clustering by delta Lloyd, in whole numbers.

Vectors are written once, bucketed by a row number; each round writes an
assignment for each (row number, cluster, squared distance) in the same
buckets, so the two are merged without a shuffle, and vectors never move
again.  A round compares a vector with the centroids that the last round has
changed; a vector whose own centroid is among them is compared with all.  From
the same pass every task returns what its vectors have moved from cluster to
cluster, as signed sums and counts; these are added up and go into the global
sums, from which the next centroids are made.  Only these sums (clusters times
dimensions) come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Buckets, materialize, table

CLUSTERS, ROUNDS, LENGTH, SCALE, SALT = 8, 10, 64, 1024, 3
#: Components beyond this count as this.
LIMIT = 1 << 53
_LONG = (1 << 63) - 1
#: Below this, products and sums of 64 components are exact in doubles.
_EXACT = 1 << 22


def quantized(vectors: DataFrame, length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """``(vec_id, q)`` of the rows whose vector has ``length`` components, none null or not finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))
    kept = vectors.where(F.coalesce((F.size("embedding") == length) & finite, F.lit(False)))
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(scaled(x)).cast("bigint")).alias("q"))


def first_by_hash(rows: DataFrame, clusters: int = CLUSTERS, salt: int = SALT) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of ``salt:vec_id``, in this order; a null id comes last."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r.q) for r in rows.orderBy(order.asc_nulls_last(), "q").limit(clusters).select("q").collect()]


def squared_distances(q: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact; whole numbers of any size (dtype object) where a component is large."""
    largest = max(int(np.abs(q).max(initial=0)), max((abs(x) for c in centroids for x in c), default=0))
    if largest < _EXACT and q.shape[1] <= LENGTH:
        a, c = q.astype(np.float64), np.array(centroids, np.float64).reshape(-1, q.shape[1])
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    out = np.empty((len(q), len(centroids)), object)
    for k, centroid in enumerate(centroids):
        c = np.array(centroid, object)
        for at in range(0, len(q), 1024):
            out[at : at + 1024, k] = ((q[at : at + 1024].astype(object) - c) ** 2).sum(axis=1)
    return out


def reassign(
    q: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: list[list[int]], changed: list[int]
) -> tuple[np.ndarray, np.ndarray]:
    """New owners and squared distances; an owner of -1 is none.  Of equally near centroids the first counts."""
    owner, distance = owner.copy(), distance.copy()
    moved = np.isin(owner, [-1, *changed]) | (distance == _LONG)
    rows = np.flatnonzero(moved)
    if len(rows):
        found = squared_distances(q[rows], centroids)
        owner[rows] = found.argmin(axis=1)
        distance[rows] = np.minimum(found.min(axis=1), _LONG)
    rows = np.flatnonzero(~moved)
    if len(rows) and changed:
        found = squared_distances(q[rows], [centroids[k] for k in changed])
        best, near = np.array(changed)[found.argmin(axis=1)], np.minimum(found.min(axis=1), _LONG)
        nearer = ((near < distance[rows]) | (near == distance[rows]) & (best < owner[rows])).astype(bool)
        owner[rows[nearer]], distance[rows[nearer]] = best[nearer], near[nearer]
    return owner, distance


def transfers(q: np.ndarray, old: np.ndarray, new: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
    """Add to ``counts`` and ``sums`` (of Python's numbers) what vectors take from their old clusters to their new ones."""
    rows = np.flatnonzero(old != new)
    q = q[rows] if np.abs(q).max(initial=0) < _EXACT else q[rows].astype(object)
    for cluster in range(len(counts)):
        for side, sign in ((new, 1), (old, -1)):
            mine = side[rows] == cluster
            if mine.any():
                counts[cluster] += sign * int(mine.sum())
                sums[cluster] += sign * q[mine].sum(axis=0).astype(object)


_STATE = "row_id bigint, cluster int, distance bigint, n bigint, sums array<decimal(38,0)>"


def _round(rows: DataFrame, centroids: list[list[int]], changed: list[int]) -> DataFrame:
    """The new assignments, and (without a row_id) each task's transfers by cluster."""
    length = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), object), np.zeros((len(centroids), length), object)
        names = ["row_id", "cluster", "distance", "n", "sums"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0))]
        for batch in batches:
            q = batch.column("q").flatten().to_numpy().reshape(-1, length)
            old = batch.column("cluster").to_numpy()
            new, distance = reassign(q, old, batch.column("distance").to_numpy(), centroids, changed)
            transfers(q, old, new, counts, sums)
            state = [batch.column("row_id"), pa.array(new, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays([*state, *(pa.nulls(len(batch), k) for k in kinds[3:])], names)
        moved = [k for k in range(len(centroids)) if counts[k] or sums[k].any()]
        if moved:
            columns = [[None] * len(moved), moved, [None] * len(moved), [counts[k] for k in moved], [[Decimal(x) for x in sums[k]] for k in moved]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return rows.select("row_id", "q", "cluster", "distance").mapInArrow(run, _STATE)


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, salt: int = SALT
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of each vector that is kept.

    A vector is kept if it has ``length`` components, none null or not
    finite; rows that repeat are vectors each of their own, and where ids
    repeat the smaller vector comes first among the starting centroids.  With
    fewer vectors than ``clusters`` there are as many centroids as vectors; an
    empty table gives an empty result.  Components beyond 2 ** 53 count as
    that, and a distance or a sum of distances beyond a long as the largest
    long.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    out = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    tables = Buckets(spark, "row_id")
    rows = quantized(vectors, length, scale).withColumn("row_id", F.monotonically_increasing_id())
    rows = tables.write(rows.repartition(tables.buckets, "row_id"))
    centroids = first_by_hash(rows, clusters, salt)
    if not centroids:
        tables.close()
        return spark.createDataFrame([], out)
    counts, sums = [0] * len(centroids), [[0] * length for _ in centroids]
    changed, state = list(range(len(centroids))), None
    for turn in range(rounds + 1):
        if state is None:
            given = rows.withColumns({"cluster": F.lit(-1), "distance": F.lit(-1).cast("bigint")})
        else:
            given = rows.join(state.select("row_id", "cluster", "distance").hint("merge"), "row_id")
        written = tables.write(_round(given, centroids, changed))
        state = written.where("row_id IS NOT NULL")
        if turn == rounds:
            break
        added = F.array(*(F.sum(F.col("sums")[at]) for at in range(length)))
        for r in written.where("row_id IS NULL").groupBy("cluster").agg(F.sum("n").alias("n"), added.alias("x")).collect():
            counts[r.cluster] += r.n
            sums[r.cluster] = [s + int(x) for s, x in zip(sums[r.cluster], r.x)]
        means = [[x // n for x in s] if n else c for s, n, c in zip(sums, counts, centroids)]
        changed = [k for k, (old, new) in enumerate(zip(centroids, means)) if old != new]
        centroids = means
        if not changed:  # all later rounds would leave everything as it is
            break
    inertia = {r.cluster: int(r.total) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    total = min(sum(inertia.values()), _LONG)
    facts = [
        (k, min(inertia[k], _LONG), total, hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for k in sorted(inertia)
    ]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    found = rows.select("row_id", "vec_id").join(state.select("row_id", "cluster", "distance").hint("merge"), "row_id")
    # one row for each cluster
    result = materialize(found.join(F.broadcast(facts), "cluster").select(*(x.split()[0] for x in out.split(", "))))
    tables.close()
    return result


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(rounds: int) -> str:
    parts = [
        """v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, q FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8
)""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(v.q) AS q,
         min(8 * list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT + k) AS near
  FROM v CROSS JOIN c{r} c GROUP BY vec_id
)""")
        if r < rounds:
            parts.append(f"""m{r} AS (
  SELECT near % 8 AS k, i, (sum(x)::BIGINT - ((sum(x)::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS x
  FROM (SELECT near, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY near % 8, i
), c{r + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(n.q, c.q) AS q FROM c{r} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS q FROM m{r} GROUP BY k) n ON n.k = c.k
)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, (near % 8)::INTEGER AS cluster, near // 8 AS distance, (sum(near // 8) OVER (PARTITION BY near % 8))::BIGINT AS cluster_inertia,
       (sum(near // 8) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.k = near % 8"""


OP12_SQL = _sql(ROUNDS)
