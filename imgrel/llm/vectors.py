"""Operator 1: embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated (two rounds of random signs and a Walsh-Hadamard
transform) and split into blocks of ``BLOCK_DIMS`` dimensions.  A cosine of at
least c means a squared distance of at most 2 - 2c; so in some block the
squared distance is at most that block's proportional share of it.  Each block
is range-joined on a grid over its first ``GRID_DIMS`` coordinates: a vector
lies in its home cell and is copied to the later neighbour cells that its
budget reaches.  Candidates are verified by their exact cosine in the task
that finds them, and a pair counts only in the first block whose budget it
keeps, so the union needs no distinct.

Equal vectors are joined once.  A cell with more than ``MAX_HOMES`` vectors is
split by a second grid over the block's other coordinates, under what a vector
has left of the budget there.  What is still large is dealt into parts; a task
holds the home vectors of one part and streams the rest past them.  It returns
sums of links and a spanning forest, not pairs.

A vector of d dimensions lies in some 70 cells for each 64 of them, so its cost
grows with the square of d.  Vectors longer than ``MAX_LENGTH`` are therefore
not split into blocks: they travel once for each part of ``MAX_HOMES`` of them.

Vectors travel whole: ids and coordinates would do for the grid, but then every
pair that a block lets pass would have to be sent to where its vectors are,
and in a group of near copies these are all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, look_up, materialize, merge_labels, table

COSINE = 0.95
BLOCK_DIMS, GRID_DIMS = 8, 5
MAX_HOMES = 4096
#: Longer vectors are one block in one cell: all pairs of them are compared, part by part.
MAX_LENGTH = 4096
_FIELD = 7  # bits of a grid coordinate in a cell's key


class Subspaces:
    """The rotation, the blocks and the grid for vectors of one length."""

    def __init__(self, length: int, cosine: float):
        self.length = length
        self.padded = 1 << max(0, length - 1).bit_length()
        self.dims = min(BLOCK_DIMS, self.padded) if length <= MAX_LENGTH else self.padded
        self.blocks = self.padded // self.dims
        self.grid = min(GRID_DIMS, self.dims) if self.blocks > 1 or length <= MAX_LENGTH else 0
        self.rest = min(self.dims, BLOCK_DIMS) - self.grid if self.grid else 0
        total = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
        self.budget = total / self.blocks
        self.side = max(np.sqrt(self.budget) * (1 + 1e-9), 2 / np.sqrt(self.padded), 1 / 60)
        draw = np.random.default_rng([length, 1977])
        self.signs = draw.integers(0, 2, (2, self.padded)) * 2.0 - 1
        # the neighbours after the home cell, so that of two cells one gets the other's vectors
        steps = [s for s in product((-1, 0, 1), repeat=self.grid) if s > (0,) * self.grid]
        self.steps = np.array(steps, np.int64).reshape(len(steps), self.grid)
        self.below = (self.steps == -1).astype(float)
        self.above = (self.steps == 1).astype(float)
        # of the second grid all neighbours, the cell itself first
        steps = sorted(product((-1, 0, 1), repeat=self.rest), key=any)
        self.fine_steps = np.array(steps, np.int64).reshape(len(steps), self.rest)
        self.fine_later = np.array([s >= (0,) * len(s) for s in steps])

    def units(self, vectors: np.ndarray) -> np.ndarray:
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
        return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))

    def rotate(self, units: np.ndarray) -> np.ndarray:
        """Only sums and differences of columns: a row's result never depends on the rows beside it."""
        out = np.zeros((len(units), self.padded))
        out[:, : self.length] = units
        for signs in self.signs:
            out = out * signs
            half = 1
            while half < self.padded:
                pairs = out.reshape(len(out), self.padded // (2 * half), 2, half)
                left, right = pairs[:, :, 0, :], pairs[:, :, 1, :]
                out = np.stack((left + right, left - right), axis=2).reshape(len(out), self.padded)
                half *= 2
            out = out / np.sqrt(self.padded)
        return out

    def cells(self, rotated: np.ndarray, homes_only: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """``(rows, keys, home)`` for each block: first the home cells, then the neighbours reached."""
        places = _FIELD * np.arange(self.grid)
        for block in range(self.blocks):
            at = rotated[:, block * self.dims : block * self.dims + self.grid]
            cell = np.floor(at / self.side).astype(np.int64)
            yield np.arange(len(at)), ((cell + 64) << places).sum(axis=1), True
            if homes_only:
                continue
            down = np.square(at - cell * self.side)
            up = np.square((cell + 1) * self.side - at)
            rows, which = np.nonzero(down @ self.below.T + up @ self.above.T <= self.budget + 1e-9)
            yield rows, ((cell[rows] + self.steps[which] + 64) << places).sum(axis=1), False

    def fine(self, rotated: np.ndarray, block: int) -> np.ndarray:
        """The home cells of the second grid over the rest of a block."""
        start = block * self.dims + self.grid
        at = rotated[:, start : start + self.rest]
        return ((np.floor(at / self.side).astype(np.int64) + 64) << (_FIELD * np.arange(at.shape[1]))).sum(axis=1)

    def split(self, rotated: np.ndarray, blocks: np.ndarray, keys: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(rows, fine cells, home)`` of rows in hot cells.

        Of two home vectors the earlier one's is copied to the later one's
        fine cell; a copy goes to all that its budget still reaches.
        """
        for block in np.unique(blocks):
            own = np.flatnonzero(blocks == block)
            at = rotated[own, block * self.dims : (block + 1) * self.dims]
            near, rest = at[:, : self.grid], at[:, self.grid : self.grid + self.rest]
            low = (((keys[own, None] >> (_FIELD * np.arange(self.grid))) & 127) - 64) * self.side
            spent = np.square(np.maximum(np.maximum(low - near, near - low - self.side), 0)).sum(axis=1)
            cell = np.floor(rest / self.side).astype(np.int64)
            down, up = np.square(rest - cell * self.side), np.square((cell + 1) * self.side - rest)
            cost = down @ (self.fine_steps == -1).T.astype(float) + up @ (self.fine_steps == 1).T.astype(float)
            reached = (cost + spent[:, None] <= self.budget + 1e-9) & (self.fine_later | ~home[own, None])
            reached[:, 0] |= home[own]
            rows, which = np.nonzero(reached)
            codes = ((cell[rows] + self.fine_steps[which] + 64) << (_FIELD * np.arange(rest.shape[1]))).sum(axis=1)
            yield own[rows], codes, home[own[rows]] & (which == 0)

    def links(self, a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray, block: int, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of linked pairs whose first block within budget is ``block``; ``same``: b is a, each pair once."""
        part = slice(block * self.dims, (block + 1) * self.dims)
        # in single precision, whose error the margin below covers; what passes is looked at in double
        pa, pb = ra[:, part].astype(np.float32), rb[:, part].astype(np.float32)
        sa, sb = (pa * pa).sum(axis=1), (pb * pb).sum(axis=1)
        for i in range(0, len(a), 256):
            for j in range(i if same else 0, len(b), 2048):
                near = sa[i : i + 256, None] + sb[None, j : j + 2048] - 2 * (pa[i : i + 256] @ pb[j : j + 2048].T)
                x, y = np.nonzero(near <= np.float32(self.budget + 2e-5))
                x, y = x + i, y + j
                if same:
                    x, y = x[x < y], y[x < y]
                step = max(1, (1 << 20) // self.padded)
                for k in range(0, len(x), step):
                    u, v = x[k : k + step], y[k : k + step]
                    diff = ra[u] - rb[v]
                    kept = (diff * diff).reshape(len(u), self.blocks, self.dims).sum(axis=2) <= self.budget
                    first = kept[:, block] & ~kept[:, :block].any(axis=1)
                    u, v = u[first], v[first]
                    linked = np.einsum("ij,ij->i", a[u], b[v]) >= cosine
                    if linked.any():
                        yield u[linked], v[linked]


class _Group:
    """The home vectors of one part of a cell, and the links found with them."""

    def __init__(self, space: Subspaces, block: int, cosine: float):
        self.space, self.block, self.cosine = space, block, cosine
        self.waiting, self.ids = [], None

    def add_homes(self, ids: np.ndarray, counts: np.ndarray, units: np.ndarray) -> None:
        self.waiting.append((ids, counts, units))

    def close_homes(self) -> None:
        if self.ids is not None:
            return
        if self.waiting:
            self.ids, self.counts, self.units = (np.concatenate(x) for x in zip(*self.waiting))
        else:
            self.ids, self.counts, self.units = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, self.space.length))
        self.rotated = self.space.rotate(self.units)
        self.found, self.labels = np.zeros(len(self.ids), np.int64), np.arange(len(self.ids))
        for u, v in self.space.links(self.units, self.rotated, self.units, self.rotated, self.block, self.cosine, True):
            np.add.at(self.found, u, self.counts[v])
            np.add.at(self.found, v, self.counts[u])
            merge_labels(self.labels, u, v)

    def add_others(self, ids: np.ndarray, counts: np.ndarray, units: np.ndarray, out: list) -> None:
        self.close_homes()
        if not len(self.ids):
            return
        found, first = np.zeros(len(ids), np.int64), np.full(len(ids), -1)
        rotated = self.space.rotate(units)
        for u, v in self.space.links(self.units, self.rotated, units, rotated, self.block, self.cosine, False):
            np.add.at(self.found, u, counts[v])
            np.add.at(found, v, self.counts[u])
            new, at = np.unique(v, return_index=True)
            new, at = new[first[new] < 0], at[first[new] < 0]
            first[new] = u[at]
            merge_labels(self.labels, u, first[v])  # both are linked to v
        linked = np.flatnonzero(first >= 0)
        if len(linked):
            out.append((ids[linked], self.ids[first[linked]], found[linked]))

    def finish(self, out: list) -> None:
        self.close_homes()
        linked = np.flatnonzero(self.found > 0)
        if len(linked):
            out.append((self.ids[linked], self.ids[self.labels[linked]], self.found[linked]))


_CELL = "space int, block int, key long"


def _links(classes: DataFrame, cosine: float, max_homes: int) -> DataFrame:
    """``(a, b, links)``: a is linked to b (or is b), and has so many more links."""
    kind = "<f4" if dict(classes.dtypes)["embedding"] == "array<float>" else "<f8"

    def space_of(spaces: dict[int, Subspaces], length: int) -> Subspaces:
        return spaces[length] if length in spaces else spaces.setdefault(length, Subspaces(int(length), cosine))

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spaces: dict[int, Subspaces] = {}
        for batch in batches:
            for length, part in batch.groupby(batch["embedding"].map(len)):
                space = space_of(spaces, length)
                rotated = space.rotate(space.units(np.stack(part["embedding"].to_numpy()).astype(np.float64)))
                for block, (_, keys, _) in enumerate(space.cells(rotated, homes_only=True)):
                    yield pd.DataFrame({"space": length, "block": block, "key": keys, "fine": space.fine(rotated, block)})

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spaces: dict[int, Subspaces] = {}
        for batch in batches:
            for length, part in batch.groupby(batch["embedding"].map(len)):
                space = space_of(spaces, length)
                vectors = np.stack(part["embedding"].to_numpy())
                packed = np.array([v.tobytes() for v in vectors.astype(kind)], object)
                ids, counts = part["class_id"].to_numpy(), part["copies"].to_numpy()
                block = -1
                for rows, keys, home in space.cells(space.rotate(space.units(vectors.astype(np.float64)))):
                    block += home
                    if len(rows):
                        yield pd.DataFrame({
                            "space": length, "block": block, "key": keys, "home": home, "class_id": ids[rows], "copies": counts[rows], "vector": packed[rows],
                        })

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spaces: dict[int, Subspaces] = {}
        for batch in batches:
            for length, part in batch.groupby("space"):
                space = space_of(spaces, length)
                raw = np.frombuffer(b"".join(part["vector"]), kind).reshape(len(part), -1).astype(np.float64)
                blocks, keys, home = (part[c].to_numpy() for c in ("block", "key", "home"))
                for rows, fine, home in space.split(space.rotate(space.units(raw)), blocks, keys, home):
                    yield part.iloc[rows].assign(fine=fine, home=home)

    # Spark broadcasts these two while they are small: a row stands for more than max_homes vectors in a block
    cell = ["space", "block", "key"]
    sizes = materialize(classes.mapInPandas(homes, f"{_CELL}, fine long").groupBy(*cell, "fine").agg(F.count(F.lit(1)).alias("n")))
    hot = materialize(sizes.groupBy(*cell).agg(F.sum("n").alias("n")).where(F.col("n") > max_homes).select(*cell, F.lit(True).alias("hot")))
    large = materialize(sizes.join(hot, cell).where(F.col("n") > max_homes).select(
        *cell, "fine", F.ceil(F.col("n") / max_homes).cast("int").alias("parts")
    ))
    row = "class_id long, copies long, vector binary"
    cells = classes.mapInPandas(spread, f"{_CELL}, home boolean, {row}").join(hot, cell, "left")
    usual = cells.where("hot IS NULL").withColumn("fine", F.lit(0).cast("long")).drop("hot")
    fine = cells.where("hot").drop("hot").mapInPandas(split, f"{_CELL}, home boolean, {row}, fine long")
    fine = fine.join(large, [*cell, "fine"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parts = usual.withColumn("parts", F.lit(1)).unionByName(fine)
    parts = parts.withColumn("own", F.when(F.col("home"), F.pmod(F.xxhash64("class_id"), F.col("parts"))).cast("int"))
    group = [*cell, "fine", "part"]
    dealt = parts.select(
        *cell, "fine", F.explode(F.sequence(F.coalesce("own", F.lit(0)), F.col("parts") - 1)).alias("part"),
        "own", "class_id", "copies", "vector",
    ).select(*group, F.when(F.col("own") == F.col("part"), 0).otherwise(1).alias("other"), "class_id", "copies", "vector")
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, "other")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spaces: dict[int, Subspaces] = {}
        open_, at, out = None, None, []
        for batch in batches:
            of, other = [batch[c].to_numpy() for c in group], batch["other"].to_numpy()
            ids, counts, vectors = batch["class_id"].to_numpy(), batch["copies"].to_numpy(), batch["vector"].to_numpy()
            starts = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in (*of, other)], axis=0)])
            for start, end in zip(starts, np.r_[starts[1:], len(batch)]):
                here = tuple(int(x[start]) for x in of)
                if at != here:
                    if open_:
                        open_.finish(out)
                    at, open_ = here, _Group(space_of(spaces, here[0]), here[1], cosine)
                raw = np.frombuffer(b"".join(vectors[start:end]), kind).reshape(end - start, -1).astype(np.float64)
                rows = ids[start:end], counts[start:end], open_.space.units(raw)
                if other[start]:
                    open_.add_others(*rows, out)
                else:
                    open_.add_homes(*rows)
            if out:
                yield pd.DataFrame(dict(zip(("a", "b", "links"), (np.concatenate(x) for x in zip(*out)))))
                out = []
        if open_:
            open_.finish(out)
        if out:
            yield pd.DataFrame(dict(zip(("a", "b", "links"), (np.concatenate(x) for x in zip(*out)))))

    return dealt.mapInPandas(verify, "a long, b long, links long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, max_homes: int = MAX_HOMES) -> DataFrame:
    """``(vec_id, n_links, component_id)``, one row for each row of ``vectors``.

    All rows of ``(vec_id, embedding)`` are compared, whatever their other
    columns say.  Vectors that are null, empty, zero, or hold null or
    non-finite components, rows without a vec_id, and vectors of different
    lengths link with nothing; a row of that kind is its own component.  Rows
    with equal vectors are linked like any others, repeated rows included.  An
    empty table gives an empty result.
    """
    rows = vectors.select("vec_id", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(
        F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False)
    )
    good = rows.where(valid)
    classes = materialize(good.groupBy("embedding").agg(
        F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies")
    ))
    found = materialize(_links(classes, cosine, max_homes))
    sums = found.groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("links"))
    labels = components(found.select("a", "b")).withColumnRenamed("node", "class_id")
    facts = materialize(
        classes.join(sums, "class_id", "left").join(labels, "class_id", "left").select(
            "embedding", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "class_id").alias("component_id"),
        )
    )
    linked = look_up(good, facts, "embedding", F.col("copies")).select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)


def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM v
  UNION
  SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.node WHERE r.root < p.b
), comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp ON comp.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
