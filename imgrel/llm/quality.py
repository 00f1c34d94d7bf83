"""Operator 3: quality classifier by Naive Bayes support vectors.

Features are indicators of n-grams of three kinds, hashed to one space: word
shapes (one to four of them; letters and digits shrink to a run of one class,
punctuation stays, and a word that repeats the one before is marked as such),
lower-cased words (one or two), and their characters (four bytes).  Each
indicator is scaled by the log-count ratio of the two classes; on the scaled
indicators a linear model with hinge loss is fitted by dual coordinate descent.

The fit uses a bounded sample of labelled rows (``max_rows``, the first by a
hash of doc_id, of those as many as have ``max_features`` indicators
together); every text is scored whole, in pieces that end at the first white
space after a fixed size, so only a text without any is looked at in one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table

BITS = 19
MAX_ROWS = 8192
#: Indicators of all rows that a model is fitted on, which bounds the driver's memory; a row has at most 2 ** BITS.
MAX_FEATURES = 4_000_000
#: score >= THRESHOLD keeps a document: in doubt it stays.
THRESHOLD = 0.3
#: Bytes of a text that are looked at together.
PIECE = 1 << 20
LOWER, UPPER, DIGIT, WIDE = b"a", b"A", b"0", b"a"
_CLASSES = bytes(
    LOWER[0] if 97 <= b <= 122 else UPPER[0] if 65 <= b <= 90 else DIGIT[0] if 48 <= b <= 57 else WIDE[0] if b >= 128 else b
    for b in range(256)
)
_RUNS = [(re.compile(sign + sign + b"+").sub, sign) for sign in (LOWER, UPPER, DIGIT)]
_SPACE = re.compile(rb"[\x20\x09-\x0D]").search
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Known(dict):
    """Numbers of tokens, by a hash; at most ``room`` of them are kept."""

    def __init__(self, room: int):
        self.room = room

    def __missing__(self, token: bytes) -> int:
        number = zlib.crc32(token) + 1
        if len(self) < self.room:
            self[token] = number
        return number


class Shapes:
    """N-gram indicators of a text, as positions below ``2 ** bits``."""

    def __init__(self, bits: int = BITS, orders: int = 4, chars: int = 4, cache: int = 200_000):
        self.bits, self.orders, self.chars, self.known = bits, orders, chars, _Known(cache)

    def _ids(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))

    def _places(self, grams: np.ndarray, kind: int) -> np.ndarray:
        """A multiplicative hash, by kind of n-gram."""
        mixed = (grams + np.uint64(kind * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * _MIX) >> np.uint64(64 - self.bits)).astype(np.int32)

    def _ngrams(self, ids: np.ndarray, orders: int, kind: int) -> Iterator[np.ndarray]:
        grams = ids
        for n in range(1, orders + 1):
            if n > 1:
                grams = grams[:-1] * np.uint64(0x100000001B3) + ids[n - 1 :]
            if not len(grams):
                return
            yield self._places(grams, kind + n)

    def _bytes(self, raw: bytes) -> Iterator[np.ndarray]:
        for at in range(0, len(raw), PIECE):
            part = np.frombuffer(raw[at : at + PIECE + self.chars - 1], np.uint8).astype(np.uint64)
            grams = np.zeros(max(0, len(part) - self.chars + 1), np.uint64)
            for k in range(self.chars):
                grams = grams << np.uint64(8) | part[k : k + len(grams)]
            yield self._places(grams, 0)

    def _found(self, raw: bytes) -> Iterator[np.ndarray]:
        """Positions piece by piece; what n-grams need of the piece before is carried over."""
        at, last, shape_tail, word_tail, char_tail = 0, b"", np.zeros(0, np.uint64), np.zeros(0, np.uint64), b""
        while at < len(raw):
            end = at + PIECE
            gap = _SPACE(raw, end) if end < len(raw) else None
            end = gap.start() if gap else len(raw)
            piece, at = raw[at:end], end
            lower = piece.lower()
            words, lows, shaped = piece.split(), lower.split(), piece.translate(_CLASSES)
            for run, sign in _RUNS:
                shaped = run(sign, shaped)
            shapes = shaped.split()
            if words:
                for k, same in enumerate(map(eq, [last, *words], words)):
                    if same:
                        shapes[k] = b"\x00same"
                last = words[-1]
            ids = np.concatenate([shape_tail, self._ids(shapes)])
            yield from self._ngrams(ids, self.orders, 10)
            shape_tail = ids[max(0, len(ids) - self.orders + 1) :]
            ids = np.concatenate([word_tail, self._ids(lows)])
            yield from self._ngrams(ids, 2, 20)
            word_tail = ids[-1:]
            yield from self._bytes(char_tail + lower)
            char_tail = (char_tail + lower)[-(self.chars - 1) :]

    def features(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) <= PIECE:
            found = np.concatenate([np.zeros(0, np.int32), *self._found(raw)])
            found.sort()
            return found[np.r_[True, found[1:] != found[:-1]][: len(found)]]
        seen = np.zeros(1 << self.bits, bool)
        for places in self._found(raw):
            seen[places] = True
        return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    """Log-count ratios of the indicators and the linear weights on them."""

    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float = 2.0

    def score(self, features: np.ndarray) -> float:
        """The logistic of ``scale`` times the margin."""
        values = scaled(self.ratio, features)
        margin = self.bias + float(self.weights[features] @ values)
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.scale * margin, -60, 60))))


def scaled(ratio: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The indicators times their ratios, no longer than 1, so long texts weigh no more than short ones."""
    x = ratio[features]
    return x / np.sqrt((x * x).sum() + 1)


def fit(rows: list[np.ndarray], positive: np.ndarray, bits: int = BITS, cost: float = 1.0, epochs: int = 20) -> Model:
    """Scale the indicators, then dual coordinate descent for the hinge loss.

    Without both classes the score is constant: 0 if all labels are 0, else 1.
    """
    if positive.all() or not positive.any():
        none = np.zeros(1 << bits)
        return Model(none, none, -30.0 if len(positive) and not positive.any() else 30.0)
    counts = np.ones((2, 1 << bits))
    for features, label in zip(rows, positive):
        counts[int(label), features] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    values = [scaled(ratio, features).astype(np.float32) for features in rows]
    sign = np.where(positive, 1.0, -1.0)
    # both classes carry the same total cost, so the rarer one is not given up
    most = cost * 0.5 * len(rows) / np.where(positive, positive.sum(), (~positive).sum())
    square = np.array([float((x * x).sum()) + 1 for x in values])
    alpha, weights, bias = np.zeros(len(rows)), np.zeros(1 << bits), 0.0
    order, active = np.random.default_rng(7), np.arange(len(rows))
    for epoch in range(epochs):
        # rows that the last pass left alone rest until the next pass over all
        everything = epoch % 5 == 0
        active, largest, moved = np.arange(len(rows)) if everything else active, 0.0, []
        for k in order.permutation(active):
            slope = sign[k] * (weights[rows[k]] @ values[k] + bias) - 1
            new = min(max(alpha[k] - slope / square[k], 0.0), most[k])
            step = (new - alpha[k]) * sign[k]
            if step:
                weights[rows[k]] += step * values[k]
                bias += step
                alpha[k] = new
                largest = max(largest, abs(step))
                moved.append(k)
        active = np.array(moved, np.int64)
        if largest < 1e-3 and everything:
            break
    return Model(ratio, weights, bias)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's text leaves ``part`` when divided by ``parts``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, max_features: int = MAX_FEATURES
) -> Model:
    """Fit on the labelled documents outside the held-out fifth.

    At most ``max_rows`` labels (the first by a hash of doc_id) are looked up
    in ``docs``; this bounds the broadcast, the driver's memory and the time of
    the fit at any input size.  Rows from the same order on which the indicators
    would be more than ``max_features`` are left out.  Of contradictory labels the lower one counts, and
    of documents with one doc_id the text with the smallest hash, so a label gives one row however often
    its id repeats; null labels and ids are ignored.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        .select(F.col("doc_id").alias("labelled_id"), F.col("quality").alias("label"))
    )
    pairs = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).groupBy(
        "labelled_id", "label"
    ).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", F.xxhash64("labelled_id").alias("place"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes(bits)
        for batch in batches:
            features = [shapes.features(t).astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").cast(pa.int32()), batch.column("place"), pa.array(features, pa.binary())], ["label", "place", "features"]
            )

    rows = materialize(pairs.mapInArrow(run, "label int, place long, features binary"))
    sizes = rows.select("place", F.octet_length("features").alias("size")).toPandas().sort_values(["place", "size"])
    beyond = sizes["place"][sizes["size"].cumsum() > 4 * max_features]
    if len(beyond):
        rows = rows.where(F.col("place") < int(beyond.iloc[0]))
    rows = rows.toPandas().sort_values(["features", "label"])  # the same fit whatever the order of arrival
    return fit([np.frombuffer(x, "<i4") for x in rows["features"]], (rows["label"] == 1).to_numpy(), bits)


def score(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """``docs`` with a last column ``quality_score`` (0 to 1, higher is better) from the whole text.

    Null and empty texts get the score of a text without words.  A column of
    that name that ``docs`` has already is replaced.  The other columns pass
    through the tasks as Arrow arrays, untouched.
    """
    kept = [f for f in docs.schema.fields if f.name != "quality_score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, known = Shapes(bits), shared.value
        for batch in batches:
            scores = pa.array([known.score(shapes.features(t)) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "quality_score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["quality_score double"])
    return docs.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, schema)


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    return score(docs, train(docs, labels)).where(F.col("quality_score") >= THRESHOLD).select(*docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
