"""Operator 7: SimHash near-dedup by a segment-popcount embedding.

A fingerprint of 64 bits is mapped to the bit counts of its 32 two-bit
segments.  The Manhattan distance of two such vectors never exceeds the number
of differing bits, so pairs within 4 bits lie within 4 there.  The segments
form three groups of 12, 12 and 8; of a distance of at most 4, the first group
has at most 1, or the second has at most 1, or the third has 0 (else the sum
were 5 or more).  Each group is a unit grid: a fingerprint is put into its own
cell and, in the first two groups, into the cells one step up, so that two
fingerprints within the budget always meet.  What meets is verified exactly.

Equal fingerprints are joined once, through the smallest doc_id.  Cells hold
distinct fingerprints.  A cell with more than ``HOT`` of them is split by the
popcounts of the other groups, under what is left of the budget: of a pair in
a cell of the first group, the second group's distance is at most 2 or the
third's at most 1; likewise for the second; a pair that only the third group
finds differs by 2 in both others.  What is still large is dealt into blocks
of ``BLOCK``, and each pair of blocks is a group of its own, so no task holds
more than two blocks of a group.  A group returns a spanning forest of its
links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, keep_rows, look_up, materialize, merge_labels, table, text_key

BLOCK = 2048
#: Fingerprints in a cell from which it is split, rather than dealt into blocks: a member is copied some 30 times then.
HOT = 16 * BLOCK
MAX_BITS = 4
SHINGLE = 4
#: (first two-bit segment, segments, Manhattan budget) of each group.
GROUPS = ((0, 12, 1), (12, 12, 1), (24, 8, 0))
#: (other group, Manhattan budget in it) by which a hot cell of each group is split.
SPLITS = (((1, 2), (2, 1)), ((0, 2), (2, 1)), ((0, 2),))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash as a signed 64-bit integer; 0 for a null text or one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, 42) for p in parts], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp`` for every row; null and empty texts get fingerprint 0."""
    columns = docs.select(*keep, "text")
    schema = ", ".join(f"{n} {t}" for n, t in columns.dtypes[:-1]) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps, pa.int64())], [*keep, "fp"])

    return columns.mapInArrow(run, schema)


def _popcounts(fp: Column, group: int) -> Column:
    """The bit counts of a group's segments, two bits each."""
    first, segments, _ = GROUPS[group]
    low = F.lit(0x5555555555555555 & ((1 << (2 * segments)) - 1))
    bits = F.shiftrightunsigned(fp, 2 * first)
    return bits.bitwiseAND(low) + F.shiftrightunsigned(bits, 1).bitwiseAND(low)


def _reached(fp: Column, group: int, budget: int, label: int) -> list[Column]:
    """Cells of a group such that two fingerprints within the budget always share one, marked with ``label``.

    Within 1, the lower of two is put into the other's cell; within 2, both
    are put into all cells next to their own and meet in one between.
    """
    own = _popcounts(fp, group) + F.lit(label << 32)
    cells = [own]
    for s in range(GROUPS[group][1] if budget else 0):
        segment = F.shiftrightunsigned(own, 2 * s).bitwiseAND(F.lit(3))
        cells.append(F.when(segment < 2, own + F.lit(1 << (2 * s))))
        if budget > 1:
            cells.append(F.when(segment > 0, own - F.lit(1 << (2 * s))))
    return cells


def _cells(fp: Column) -> Column:
    """The cells that a fingerprint is put into, as an array of longs."""
    found = [c for g, (_, _, budget) in enumerate(GROUPS) for c in _reached(fp, g, budget, g)]
    return F.array_compact(F.array(*found))


def _parts(fp: Column, cell: Column) -> Column:
    """The parts of a hot cell that a fingerprint is put into, as an array of longs."""
    group, out = F.shiftrightunsigned(cell, 32), F.lit(None)
    for g, splits in enumerate(SPLITS):
        found = [c for other, budget in splits for c in _reached(fp, other, budget, 1 + other)]
        out = F.when(group == g, F.array(*found)).otherwise(out)
    return F.array_compact(out)


def _links_in_groups(fps: np.ndarray, groups: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of the links inside runs of equal ``groups``."""
    n = len(fps)
    labels = np.arange(n)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes <= 64, sizes)
    at, step = np.flatnonzero(small[:-1]), 1
    found_i, found_j = [], []
    while len(at):
        at = at[at + step < n]
        at = at[groups[at + step] == groups[at]]
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= max_bits]
        found_i.append(near)
        found_j.append(near + step)
        step += 1
    if found_i:
        merge_labels(labels, np.concatenate(found_i), np.concatenate(found_j))
    for start, size in zip(starts[sizes > 64], sizes[sizes > 64]):
        own, part = np.arange(size), fps[start : start + size]
        for k in range(0, size, 256):
            i, j = np.nonzero(np.bitwise_count(part[k : k + 256, None] ^ part[None, k:]) <= max_bits)
            merge_labels(own, i + k, j + k)
        labels[start : start + size] = own + start
    linked = np.flatnonzero(labels != np.arange(n))
    return linked, labels[linked]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """Links ``(a, b)`` that join all fingerprints within ``max_bits`` of each other.

    ``distinct`` has one row for each fingerprint ``fp``.  The result is a
    union of spanning forests: its components are those of all links.
    """
    if max_bits > MAX_BITS:
        raise ValueError(f"the grid covers up to {MAX_BITS} differing bits")
    fp, cell = F.col("fp"), F.col("cell")
    cells = distinct.select("fp", F.explode(_cells(fp)).alias("cell"))
    # at most 2 * 3**12 + 3**8 cells exist, whatever the input: safe to broadcast
    large = materialize(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block))
    sized = cells.join(F.broadcast(large), "cell", "left")
    usual = sized.where(F.coalesce("size", F.lit(0)) <= hot).select("cell", F.lit(0).cast("long").alias("part"), "fp", "size")
    split = sized.where(F.col("size") > hot).select("cell", F.explode(_parts(fp, cell)).alias("part"), "fp")
    # no bound on these: Spark joins them by their size
    parts = materialize(split.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block))
    dealt = usual.unionByName(split.join(parts, ["cell", "part"], "left"))
    blocks = F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int")
    dealt = dealt.select("cell", "part", "fp", blocks.alias("blocks"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("cell", "part", "fp", "own", other.alias("other")).select(
        "cell", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
    )
    group = ["cell", "part", "i", "j"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rest[group].to_numpy()
            open_ = (keys == keys[-1]).all(axis=1)
            yield from emit(rest[~open_])
            rest = rest[open_]
        if rest is not None:
            yield from emit(rest)

    def emit(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(rows) < 2:
            return
        keys = rows[group].to_numpy()
        changed = (keys[1:] != keys[:-1]).any(axis=1)
        fps = rows["fp"].to_numpy()
        a, b = _links_in_groups(fps.view(np.uint64), np.r_[0, np.cumsum(changed)], max_bits)
        if len(a):
            yield pd.DataFrame({"a": np.minimum(fps[a], fps[b]), "b": np.maximum(fps[a], fps[b])})

    return dealt.mapInPandas(run, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row for each row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links.  Null texts
    count as empty; all texts without words share fingerprint 0 and are linked
    like any others.  Repeated rows come back as often as they came; a null
    doc_id takes part in the links but never names a component, unless nothing
    else is in it.  Other columns are ignored; an empty table gives an empty one.
    """
    fps = materialize(fingerprints(docs, shingle))
    names = _names(fps, max_bits)
    return look_up(fps, names, "fp", F.col("copies")).select("doc_id", "fp", "component_id")


def _names(fps: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, copies, component, component_id)``, one row for each fingerprint in ``fps``."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    found = components(links(distinct.select("fp"), max_bits))
    member = materialize(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "copies", "first_id", F.coalesce("component", "fp").alias("component")
    ))
    named = materialize(member.groupBy("component").agg(
        F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members")
    ))
    return materialize(look_up(member, named, "component", F.col("members")).select(
        "fp", "copies", "component", "component_id"
    ))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each near-duplicate group, with all its columns.

    The smallest doc_id stays, a null one last; of equal ones the text with
    the smaller hash.  A row is known by its doc_id and its text's
    digest: other texts under the same doc_id, or under none, are judged by
    themselves, and rows equal in both leave one row.
    """
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"), F.monotonically_increasing_id().alias("row_id"))
    rows = materialize(fingerprints(rows, shingle, ("doc_id", "text_key", "row_id")))
    grouped = materialize(look_up(rows, _names(rows, max_bits), "fp", F.col("copies")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "row_id")
    best = materialize(grouped.groupBy("component").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size")))
    judged = materialize(look_up(grouped, best, "component", F.col("size")).where("row_id <> best.row_id").select(
        "doc_id", "text_key",
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("text_key").eqNullSafe(F.col("best.text_key"))).alias("same"),
    ).distinct())
    return keep_rows(docs, judged.where("NOT same"), judged.where("same"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select("doc_id", hexed.alias("fingerprint"), "component_id")
