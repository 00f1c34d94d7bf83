"""Operator 8: bounded-space online packing of token sequences.

A task tokenises its documents, cuts off full windows, and places each rest
into the open window that it fills best.  Up to ``OPEN`` windows are open in a
task; when all are and none fits, the fullest is emitted.  The windows that
are open at the end are leftovers: they are merged in a second pass, in groups
of a fixed number of tasks, where pieces may be cut to fill every window but
the group's last.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_letters, default_path
from .shared import materialize, table

LENGTH = 2048
OPEN = 64
#: Tasks whose leftovers are merged together: at most TASKS * OPEN windows in a group.
TASKS = 8
#: White space as the vocabulary's pattern means it (fixed value), and the pattern without look-ahead.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


class FastIds:
    """The ids that ``tokenizers`` gives, by ``tiktoken`` with the same vocabulary.

    The usual pattern leaves the last white space of a run to the word that
    follows.  Cutting the text there instead lets the pattern do without
    look-ahead, which is much faster.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        of_letter = {c: b for b, c in byte_letters().items()}
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(of_letter[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in added}
        self.plain = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = added
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else lambda x: [x]
        self.run_of_space = re.compile(f"[{SPACE}][{SPACE}][^{SPACE}]").search
        self.split_spaces = re.compile(f"(?<=[{SPACE}])(?=[{SPACE}][^{SPACE}])").split

    def __call__(self, text: str) -> list[int]:
        if self.run_of_space(text) is None and not any(a in text for a in self.added):
            return self.plain(text)
        out: list[int] = []
        for k, part in enumerate(self.split_added(text)):
            if k % 2:
                out.append(self.added[part])
            else:
                for x in self.split_spaces(part):
                    out += self.plain(x)
        return out


@lru_cache(maxsize=2)
def fast_ids(path: str) -> FastIds:
    return FastIds(path)


class Windows:
    """Open windows of one task.  ``add`` yields finished sequences: lists of pieces."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.pieces: list[list] = []
        self.free = np.zeros(0, dtype=np.int64)

    def add(self, piece: tuple, size: int) -> list | None:
        """Place a piece of less than a window; what had to be emitted for it, if anything."""
        room = self.free - size
        fits = np.flatnonzero(room >= 0)
        done = None
        if len(fits):
            k = int(fits[np.argmin(room[fits])])
            self.pieces[k].append(piece)
            self.free[k] -= size
            if self.free[k] == 0:
                done = self.pieces.pop(k)
                self.free = np.delete(self.free, k)
            return done
        if len(self.pieces) == self.most:
            k = int(np.argmin(self.free))
            done = self.pieces[k]
            self.pieces[k], self.free[k] = [piece], self.length - size
            return done
        self.pieces.append([piece])
        self.free = np.append(self.free, self.length - size)
        return None


SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, leftover int"
)
_TYPES = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows as Arrow arrays, in which a null beside a large doc_id leaves it as it is."""
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _rows(sequence: list, sequence_id: int, leftover: int = -1) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, ids, tokens in sequence:
        size = len(ids) // 4
        yield doc_id, start, size, tokens, sequence_id, offset, ids, leftover
        offset += size


def pack(
    docs: DataFrame, length: int = LENGTH, most_open: int = OPEN, end_id: int = 1, path: str | None = None,
    group: int = TASKS,
) -> DataFrame:
    """All tokens of ``docs`` in sequences of at most ``length``, one row for each piece.

    Columns: doc_id, start, length, doc_tokens, sequence_id, offset and ids
    (little-endian unsigned 32-bit).  A document's tokens are its text's ids
    and ``end_id``; null and empty texts have the latter alone.  Repeated rows
    are packed as often as they come, a null doc_id stays null, other columns
    are ignored, an empty table gives no piece.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, windows = fast_ids(path), Windows(length, most_open)
        task = TaskContext.get().partitionId()
        number, rows, held = task << 32, [], 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array(tokenize(text), dtype="<u4").tobytes() + end if text else end
                tokens = len(ids) // 4
                whole = tokens // length * length
                for at in range(0, whole, length):
                    rows.append((doc_id, at, length, tokens, number, 0, ids[4 * at : 4 * (at + length)], -1))
                    number += 1
                if tokens > whole:
                    done = windows.add((doc_id, whole, ids[4 * whole :], tokens), tokens - whole)
                    if done:
                        rows.extend(_rows(done, number))
                        number += 1
                held += len(ids)
                if held > 1 << 24:
                    if rows:
                        yield _batch(rows)
                    rows, held = [], 0
        for k, sequence in enumerate(windows.pieces):
            rows.extend(_rows(sequence, k, task))
        if rows:
            yield _batch(rows)

    def merge(key: tuple, pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by([(c, "ascending") for c in ("leftover", "sequence_id", "offset")])
        number, offset, rows = (1 << 62) + (key[0].as_py() << 32), 0, []
        for doc_id, start, ids, tokens in zip(*(pieces.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
            at, size = 0, len(ids) // 4
            while at < size:
                n = min(size - at, length - offset)
                rows.append((doc_id, start + at, n, tokens, number, offset, ids[4 * at : 4 * (at + n)], -1))
                at, offset = at + n, offset + n
                if offset == length:
                    number, offset = number + 1, 0
        return pa.Table.from_batches([_batch(rows)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = materialize(rows.mapInArrow(run, SCHEMA))
    grouped = packed.where("leftover >= 0").groupBy(F.floor(F.col("leftover") / group).alias("part"))
    merged = grouped.applyInArrow(merge, SCHEMA)
    return packed.where("leftover < 0").unionByName(merged).drop("leftover")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
