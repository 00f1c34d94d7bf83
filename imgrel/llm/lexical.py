"""Operator 13: ranked lexical search by WAND over document shards.

``index`` reads the documents once.  Every task cuts its rows into shards of a
bounded number of documents and postings, and a shard is one row: its
documents with their lengths, its terms, and for each term the documents that
hold it with its counts.  Nothing is shuffled but one number a term and task,
for the document frequencies.

``search`` deals the asked items into blocks of a bounded size; a block is
broadcast, and each task runs its shards past it.  In a shard a term's impact
on each of its documents is known exactly, and so is the largest.  Cursors
stand on the terms' documents; in the order of these, the pivot is the first
document up to which the largest impacts together reach the worst score in
the full heap, and all cursors before it skip to it.  Only a document that all
cursors before the pivot stand on is scored.  An item's heap goes on from shard to
shard of a task; the tasks' heaps are merged in two steps.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, table
from .words import word_lists

TOP = 10
#: A shard ends after so many documents, or postings.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 20
#: Terms of items that are searched at once, and that an index is restricted to.
BLOCK_TERMS = 1 << 17
#: Tasks whose heaps are merged first.
MERGED = 1000
_ORDER = 10**9


def counts_of(raw: bytes | None) -> Counter:
    """How often each term stands in a text; a null text has none."""
    found: Counter = Counter()
    for words in word_lists(raw or b""):
        found.update(words)
    return found


class _Shard:
    """Documents and postings of a shard that is being filled."""

    def __init__(self):
        self.ids: list = []
        self.lengths: list[int] = []
        self.terms: dict[bytes, tuple[list[int], list[int]]] = {}
        self.postings = 0

    def add(self, doc_id: object, length: int, counts: list[tuple[bytes, int]]) -> None:
        at = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.postings += len(counts)
        for term, count in counts:
            docs, times = self.terms.setdefault(term, ([], []))
            docs.append(at)
            times.append(count)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def row(self, id_type: pa.DataType) -> pa.RecordBatch:
        columns = {
            "doc_ids": pa.array([self.ids], pa.list_(id_type)),
            "lengths": pa.array([self.lengths], pa.list_(pa.int64())),
            "filled": pa.array([sum(n > 0 for n in self.lengths)], pa.int64()),
            "total": pa.array([sum(self.lengths)], pa.int64()),
            "terms": pa.array([list(self.terms)], pa.list_(pa.binary())),
            "sizes": pa.array([[len(docs) for docs, _ in self.terms.values()]], pa.list_(pa.int32())),
            "docs": pa.array([np.array([x for docs, _ in self.terms.values() for x in docs], np.int32)], pa.list_(pa.int32())),
            "times": pa.array([np.array([x for _, times in self.terms.values() for x in times], np.int64)], pa.list_(pa.int64())),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def index(docs: DataFrame, terms: list[bytes] | None = None) -> DataFrame:
    """One row for each shard of ``docs``; with ``terms``, postings of these only (lengths count all terms).

    The rows' other columns are ignored; repeated rows are documents each of
    their own.  An empty table gives an empty index.
    """
    asked = docs.sparkSession.sparkContext.broadcast(None if terms is None else frozenset(terms))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, shard, id_type = asked.value, _Shard(), None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = counts_of(text.as_py())
                held = found.items() if wanted is None else [(t, found[t]) for t in wanted & found.keys()]
                shard.add(doc_id, found.total(), list(held))
                if shard.full():
                    yield shard.row(id_type)
                    shard = _Shard()
        if shard.ids:
            yield shard.row(id_type)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_ids array<{kind}>, lengths array<bigint>, filled bigint, total bigint, terms array<binary>, "
        "sizes array<int>, docs array<int>, times array<bigint>",
    )


@dataclass
class Postings:
    """A term's documents in a shard, in order, its impact on each, and the largest impact."""

    docs: list[int]
    impacts: list[int]
    most: int


def wand(lists: list[Postings], ids: list, best: list[tuple], top: int) -> int:
    """Bring the shard's best documents into ``best``, a list of up to ``top`` of ``(-score, id is null, id)`` in order.

    Returns the number of documents that were scored.
    """
    scored = 0
    worst = -best[-1][0] if len(best) == top else 1
    # of each term that still has documents: the document its cursor is on, its list and the cursor
    cursors = [[p.docs[0], k, 0] for k, p in enumerate(lists)]
    while cursors:
        cursors.sort()
        bound, pivot = 0, -1
        for cursor in cursors:
            bound += lists[cursor[1]].most
            if bound >= worst:
                pivot = cursor[0]
                break
        if pivot < 0:
            break
        aligned, score, ended = cursors[0][0] == pivot, 0, False
        for cursor in cursors:
            doc, k, at = cursor
            if doc > pivot or not aligned and doc == pivot:
                break
            docs = lists[k].docs
            if aligned:
                score += lists[k].impacts[at]
                at += 1
            else:
                at = bisect_left(docs, pivot, at + 1)
            if at < len(docs):
                cursor[0], cursor[2] = docs[at], at
            else:
                cursor[2], ended = -1, True
        if aligned:
            scored += 1
            if score >= worst:
                doc_id = ids[pivot]
                insort(best, (-score, doc_id is None, doc_id if doc_id is not None else 0))
                del best[top:]
                if len(best) == top:
                    worst = -best[-1][0]
        if ended:
            cursors = [c for c in cursors if c[2] >= 0]
    return scored


def shard_postings(shard: dict, weights: dict[bytes, int], filled: int, total: int) -> dict[bytes, Postings]:
    """Postings of the terms of ``weights`` in a shard; ``filled`` documents of the corpus hold ``total`` terms."""
    lengths = np.array(shard["lengths"], np.int64)
    norms = 8 * (10 + 90 * lengths * filled // max(total, 1))
    ends = np.cumsum(shard["sizes"])
    docs, times = np.asarray(shard["docs"], np.int64), np.asarray(shard["times"], np.int64)
    out = {}
    for term, start, end in zip(shard["terms"], ends - shard["sizes"], ends):
        weight = weights.get(term)
        if weight:
            at, tf = docs[start:end], times[start:end]
            impacts = weight * (_ORDER * tf // (1000 * tf + norms[at]))
            keep = impacts > 0
            if keep.any():
                out[term] = Postings(at[keep].tolist(), impacts[keep].tolist(), int(impacts.max()))
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, dict]]:
    for batch in batches:
        for k in range(len(batch)):
            lists = {c: batch.column(c)[k].values for c in ("lengths", "sizes", "docs", "times")}
            shard = {c: v.to_numpy(zero_copy_only=False) for c, v in lists.items()}
            yield batch.column("doc_ids")[k].values, shard | {"terms": batch.column("terms")[k].as_py()}


def _best(shards: DataFrame, items: list[tuple], weights: dict[bytes, int], filled: int, total: int, top: int, kinds: tuple) -> DataFrame:
    """Each task's best documents of each of ``items``, a list of ``(id, terms)``."""
    shared = shards.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, known = shared.value
        heaps: list[list[tuple]] = [[] for _ in asked]
        id_type = None
        for ids, shard in _shards(batches):
            id_type, ids = ids.type, ids.to_pylist()
            postings = shard_postings(shard, known, filled, total)
            for (_, terms), heap in zip(asked, heaps):
                lists = [postings[t] for t in terms if t in postings]
                if lists:
                    wand(lists, ids, heap, top)
        rows = [(item, None if none else doc_id, -score) for (item, _), heap in zip(asked, heaps) for score, none, doc_id in heap]
        if rows:
            item_ids, doc_ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item_ids), pa.array(doc_ids, id_type), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"]
            )

    return shards.mapInArrow(run, f"item_id {kinds[0]}, doc_id {kinds[1]}, score bigint")


def _ranked(rows: DataFrame, top: int, *groups: Column) -> DataFrame:
    within = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, term)``, each once; rows with the same item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column("text").to_pylist()):
                terms = pa.array(list(counts_of(text)), pa.binary())
                same = batch.column("item_id").take(pa.array(np.full(len(terms), k)))
                yield pa.RecordBatch.from_arrays([same, terms], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"item_id {kind}, term binary").distinct()


def _blocks(asked: DataFrame, most: int) -> int:
    """The least power of two of blocks, by a hash of item_id, that have at most ``most`` rows each, or one item."""
    sizes = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).select(F.xxhash64("item_id").alias("hash"), "n")
    blocks = 1
    while blocks < 1 << 20:
        largest = sizes.groupBy(F.pmod("hash", F.lit(blocks))).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"))
        if largest.where((F.col("n") > most) & (F.col("items") > 1)).isEmpty():
            break
        blocks *= 2
    return blocks


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best documents of each item, with a score above 0.

    A document without terms counts nowhere; a null doc_id comes last among
    equal scores, and repeated rows are ranked each.  An item without terms, or
    whose terms no document holds, has no rows; rows with the same item_id are
    one item, a null one included.  ``block_terms`` bounds what is broadcast
    at once (an item's own terms are together); the corpus is indexed once,
    with all its terms where the items have more than that.
    """
    asked = materialize(item_terms(items))
    words = asked.select("term").distinct()
    few = words.limit(block_terms + 1).collect()
    shards = materialize(index(docs, [bytes(r.term) for r in few] if len(few) <= block_terms else None))
    filled, total = shards.agg(F.sum("filled"), F.sum("total")).first()
    frequency = shards.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy(
        F.col("x.terms").alias("term")
    ).agg(F.sum("x.sizes").alias("df"))
    ratio = F.lit(2.0 * (filled or 0) + 2) / (2 * F.col("df") + 1).cast("double")
    weighted = asked.join(frequency, "term").withColumn("weight", F.floor(1000 * F.log(ratio)))
    weighted = materialize(weighted.select("item_id", "term", "weight"))
    kinds = tuple(df.schema[c].dataType.simpleString() for df, c in ((items, "item_id"), (docs, "doc_id")))
    found, blocks = [], _blocks(weighted, block_terms)
    for block in range(blocks):
        own: dict = {}
        weights: dict[bytes, int] = {}
        for row in weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():
            own.setdefault(row.item_id, []).append(bytes(row.term))
            weights[bytes(row.term)] = row.weight
        found.append(_best(shards, list(own.items()), weights, filled or 0, total or 0, top, kinds))
    heaps = found[0]
    for more in found[1:]:
        heaps = heaps.unionByName(more)
    heaps = heaps.withColumn("part", F.floor(F.spark_partition_id() / MERGED))
    merged = _ranked(heaps, top, F.col("item_id"), F.col("part")).drop("rank", "part")
    return _ranked(merged, top, F.col("item_id")).select("item_id", "rank", "doc_id", "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, {_TERMS} AS terms FROM documents
), s AS (
  SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
), q AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
  FROM p, s GROUP BY term
), scored AS (
  SELECT q.item_id, p.doc_id,
         sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY q.item_id, p.doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
