"""Operator 6: byte-level BPE encoding and decoding.

A piece of text is a doubly linked list of symbols.  A priority queue holds
the merges of neighbours by rank and position; an entry whose symbols have
changed since it was pushed is stale and skipped.  Decoding concatenates
vocabulary strings.  Whole texts are processed in tasks, batch by batch; a
task keeps the ids of words it has met, up to a fixed number of them.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: The pre-tokenisation pattern of the byte-level vocabulary (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and pieces whose ids a task keeps; later ones are encoded anew each time.
CACHE = 400_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of a ``tokenizers`` file of the byte-level BPE kind."""

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        letters = byte_letters()
        of_letter = {c: b for b, c in letters.items()}
        self.byte_ids = [vocabulary[letters[b]] for b in range(256)]
        self.size = max(vocabulary.values()) + 1
        #: The rank of a pair, by left id times size plus right id; and the id that each rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocabulary[left] * self.size + vocabulary[right], rank)
            self.made.append(vocabulary[left + right])
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*vocabulary.values(), *added.values()])
        self.strings = [b""] * size
        for word, i in vocabulary.items():
            self.strings[i] = bytes(of_letter[c] for c in word)
        for word, i in added.items():
            self.strings[i] = word.encode()
        self.added = added
        self.find_added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.find_pieces = regex.compile(PIECES).findall
        self.cache, self.words, self.pieces = cache, {}, {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.  A queue entry is rank times length plus position."""
        byte_ids, size, ranks, made = self.byte_ids, self.size, self.ranks.get, self.made
        ids = [byte_ids[b] for b in piece]
        n = len(ids)
        queue = []
        for k in range(n - 1):
            rank = ranks(ids[k] * size + ids[k + 1])
            if rank is not None:
                queue.append(rank * n + k)
        if not queue:
            return ids
        heapify(queue)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while queue:
            rank, k = divmod(heappop(queue), n)
            left, j = ids[k], after[k]
            if left < 0 or j >= n or ranks(left * size + ids[j]) != rank:
                continue  # stale: one of the two has been merged since
            merged = ids[k] = made[rank]
            ids[j] = -1
            j = after[k] = after[j]
            if j < n:
                before[j] = k
                rank = ranks(merged * size + ids[j])
                if rank is not None:
                    heappush(queue, rank * n + k)
            j = before[k]
            if j >= 0:
                rank = ranks(ids[j] * size + merged)
                if rank is not None:
                    heappush(queue, rank * n + j)
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> bytes:
        """The ids of a text without added tokens, as native unsigned 32-bit integers."""
        out, pieces, room = array("I"), self.pieces, self.cache
        for piece in self.find_pieces(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = array("I", self.merge(piece.encode("utf-8")))
                if len(pieces) < room:
                    pieces[piece] = ids
            out.extend(ids)
        return out.tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of a space and a word that holds none."""
        if word.isalpha():
            return array("I", self.merge(b" " + word.encode("utf-8"))).tobytes()
        if word[-1] in ".,!?;:" and word[:-1].isalpha():
            known = self.words.get(word[:-1])
            if known is None:
                known = array("I", self.merge(b" " + word[:-1].encode("utf-8"))).tobytes()
            return known + array("I", self.merge(word[-1].encode("utf-8"))).tobytes()
        return self._plain(" " + word)

    def _spaced(self, text: str) -> bytes:
        """As ``_plain``.  A piece holds a space only in front or in a run of white
        space, so a text may be cut before each single space between words."""
        parts = text.split(" ")
        if "" in parts or len(parts) == 1:
            return self._plain(text)
        out, words, room, last = [self._plain(parts[0])], self.words, self.cache, parts[0][-1]
        get = words.get
        for part in parts[1:]:
            if last.isspace() or part[0].isspace():
                return self._plain(text)
            last = part[-1]
            ids = get(part)
            if ids is None:
                ids = self._word(part)
                if len(words) < room:
                    words[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> array:
        """The ids of a whole text; null counts as empty."""
        text, out, at = text or "", array("I"), 0
        if self.find_added:
            for m in self.find_added.finditer(text):
                out.frombytes(self._spaced(text[at : m.start()]))
                out.append(self.added[m.group()])
                at = m.end()
        out.frombytes(self._spaced(text[at:] if at else text))
        return out

    def decode(self, ids) -> str:
        """The text of ids, special tokens included."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBPE:
    return ByteBPE(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _little(ids: array) -> bytes:
    import sys

    if sys.byteorder == "big":
        ids = ids[:]
        ids.byteswap()
    return ids.tobytes()


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def _added(df: DataFrame, column: str, run) -> DataFrame:
    """``df`` through ``run``, which adds a last column; one of that name is left out, others pass as Arrow arrays."""
    kept = [f for f in df.schema.fields if f.name != column.split()[0]]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [column])
    return df.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, schema)


def encode_texts(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with a last column ``ids``: an array of token ids of the whole text.

    Null and empty texts have no ids.  A column ``ids`` that ``df`` has already
    is replaced.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            ids = pa.array([bpe.encode(t) for t in batch.column(text).to_pylist()], pa.list_(pa.int32()))
            yield _with(batch, "ids", ids)

    return _added(df, "ids array<int>", run)


def decode_ids(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with a last column ``decoded``: the text of the token ids; null ids count as none."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            decoded = [bpe.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield _with(batch, "decoded", pa.array(decoded, pa.string()))

    return _added(df, "decoded string", run)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every whole text; digests of both, one row for each row of ``docs``.

    Both directions run in one pass, so ids need not leave the task.  Null
    texts count as empty; repeated rows and null doc_ids come back as they are;
    other columns are ignored.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = codec(path), hashlib.sha256
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text)
                counts.append(len(ids))
                ids_digests.append(sha(_little(ids)).hexdigest())
                text_digests.append(sha(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
