"""Operator 4: language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a fixed seed and the
letter's code point, so that no alphabet has to be known.  The vector of a
trigram binds the vectors of its letters, each permuted by its place (rolled
and multiplied).  A text's profile bundles (sums) the vectors of its trigrams;
a language's prototype bundles the profiles of its texts, each with weight 1.
A text gets the language whose prototype has the largest cosine with it.

Training sums trigram weights by language inside each task and bundles once
for a batch, so what is shuffled is one vector for each task and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import held_out
from .shared import table

SIZE = 1024
#: Characters of a text that are looked at together.
PIECE = 1 << 20
#: Code points are at most 21 bits long; 0 stands for everything between words.
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=4096)
def letter_vector(code: int, size: int = SIZE) -> np.ndarray:
    return np.random.default_rng([code, 20_011]).integers(0, 2, size).astype(np.float32) * 2 - 1


def gram_counts(text: str | None, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text over lower-cased letters and single gaps, packed into 63 bits each, and their counts.

    A text is read in pieces, so that memory follows its distinct trigrams; the
    last two signs of a piece go before the next.
    """
    lower, letters = (text or "").lower(), _letters()
    tail, any_letter = np.zeros(1, np.int64), False
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(lower) + 1, piece):
        codes = np.frombuffer(lower[at : at + piece].encode("utf-32-le", "surrogatepass"), "<u4")
        known = letters[codes]
        any_letter = any_letter or bool(known.any())
        last = [0] if at + piece > len(lower) else []
        codes = np.concatenate([tail, np.where(known, codes, 0).astype(np.int64), np.array(last, np.int64)])
        codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
        found, n = np.unique((codes[:-2] << (2 * _BITS)) | (codes[1:-1] << _BITS) | codes[2:], return_counts=True)
        if len(grams):
            grams, where = np.unique(np.concatenate([grams, found]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
        else:
            grams, counts = found, n
        tail = codes[-2:]
    none = np.zeros(0, np.int64)
    return (grams, counts) if any_letter else (none, none)


def gram_vectors(grams: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The bound vectors of packed trigrams, one row each."""
    mask = (1 << _BITS) - 1
    out = np.ones((len(grams), size), np.float32)
    for place in range(3):
        codes, which = np.unique((grams >> (_BITS * place)) & mask, return_inverse=True)
        out *= np.array([np.roll(letter_vector(int(c), size), place) for c in codes], np.float32).reshape(-1, size)[which]
    return out


def prototypes(docs: DataFrame, size: int = SIZE) -> dict[str, np.ndarray]:
    """The prototype of each non-null ``lang`` in ``docs``, from the whole texts.

    The driver gets one vector for each language.  Texts without a letter add nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang")["text"]:
                counted = [(g, n / n.sum()) for g, n in map(gram_counts, part) if len(g)]
                if not counted:
                    continue
                grams, at = np.unique(np.concatenate([g for g, _ in counted]), return_inverse=True)
                weights = np.bincount(at, np.concatenate([w for _, w in counted]))
                total = sums.setdefault(lang, np.zeros(size))
                for k in range(0, len(grams), 4096):
                    total += weights[k : k + 4096] @ gram_vectors(grams[k : k + 4096], size)
        # rounded, so that the order in which tasks are summed cannot change a result
        rows = [(lang, k, float(np.round(x, 6))) for lang, total in sums.items() for k, x in enumerate(total)]
        yield pd.DataFrame(rows, columns=["lang", "place", "x"])

    parts = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInPandas(
        run, "lang string, place int, x double"
    )
    sums = parts.groupBy("lang", "place").agg(F.sum(F.col("x").cast("decimal(30,6)")).cast("double").alias("x"))
    found = sums.toPandas()
    out = {}
    for lang, rows in sorted(found.groupby("lang")):
        vector = np.zeros(size)
        vector[rows["place"].to_numpy()] = rows["x"].to_numpy()
        out[str(lang)] = vector
    return out


def identify(docs: DataFrame, learned: dict[str, np.ndarray], size: int = SIZE) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row; score is the cosine, not below 0.

    A text that is null or has no letter is ``und`` with score 0, and so is
    every text if nothing was learned.  Of equally near languages the first in
    order of name is taken.  Other columns are ignored.
    """
    langs = sorted(learned)
    matrix = np.array([learned[x] / max(np.linalg.norm(learned[x]), 1e-12) for x in langs], np.float64).reshape(-1, size)
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counted = [gram_counts(t) for t in part.column("text").to_pylist()]
                profiles = np.zeros((len(counted), size), np.float32)
                rows = np.repeat(np.arange(len(counted)), [len(g) for g, _ in counted])
                grams, place = np.unique(np.concatenate([g for g, _ in counted]), return_inverse=True)
                counts = np.concatenate([n for _, n in counted])
                for k in range(0, len(grams), 2048):
                    near = (place >= k) & (place < k + 2048)
                    block = np.zeros((len(counted), min(2048, len(grams) - k)), np.float32)
                    block[rows[near], place[near] - k] = counts[near]
                    profiles += block @ gram_vectors(grams[k : k + 2048], size)
                length = np.linalg.norm(profiles, axis=1).astype(np.float64)
                cosine = profiles.astype(np.float64) @ known.T / np.maximum(length, 1e-12)[:, None]
                none = np.array([len(g) == 0 for g, _ in counted]) | (len(langs) == 0)
                best = cosine.argmax(axis=1) if len(langs) else np.zeros(len(counted), int)
                names = ["und" if n else langs[b] for n, b in zip(none, best)]
                scores = [0.0 if n else float(min(1.0, max(0.0, c[b]))) for n, b, c in zip(none, best, cosine)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    learned = prototypes(docs.where(~out))
    return identify(docs, learned).select("doc_id", out.alias("held_out"), "lang_pred", "score")
