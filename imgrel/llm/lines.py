"""Operator 5: line dedup by content-defined chunks, grown to whole passages.

Every line is known by a hash.  Two rolling hashes over the hashes of two
neighbouring lines of text choose the boundaries: one says whether a chunk
opens before them, the other whether a chunk closes after them.  A chunk goes
from where one opens to the next place where one closes, so it has two lines
at least, depends on nothing but its own lines, and comes back wherever its
passage is moved to.  Chunks may overlap.  One in ``gap`` pairs of lines
neither opens nor closes; without a gap every pair is a chunk.

A chunk that stands at an earlier place anchors the two documents to each
other at a shift.  From there the lines' hashes are compared at that shift, and
what is equal around it belongs to the passage.  Last, each passage is
compared by its bytes with the lines at the earlier place, and goes if they
are the same.

Hashes, ids and positions are joined.  Texts are shuffled once, to lie bucketed
by row, and of a text that is repeated the passages cross the network once
more.  A chunk that very many documents hold is one hot key of joins that
adaptive execution splits; a passage is cut out once, however often it is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pii import let
from .shared import Buckets, materialize, table

MIN_LINES = 2
#: One pair of lines in so many is no boundary.
GAP = 16
#: A chunk closes after so many lines of text at the latest.
MOST = 8


def line_hashes(text: Column) -> Column:
    """A hash of each line; the last bit is 1 for a line of text and 0 for one of white space."""

    def signed(line: Column) -> Column:
        hashed = F.shiftleft(F.xxhash64(line), 1)
        return F.when(line.rlike(r"\S"), hashed.bitwiseOR(F.lit(1))).otherwise(hashed)

    return F.transform(F.split(text, "\n", -1), signed)


def _of_text(hashes: Column) -> Column:
    """Positions (from 0) of the lines of text."""
    return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.get(hashes, i).bitwiseAND(F.lit(1)) == 1)


def chunks(hashes: Column, min_lines: int = MIN_LINES, gap: int = GAP) -> Column:
    """The chunks of a text as ``(at, until, digest)``, with the positions of their first and last line.

    White lines inside a chunk belong to it and do not count.
    """

    def cut(solid: Column) -> Column:
        def chosen(k: Column, side: int) -> Column:
            """Whether the pair of lines of text k and k + 1 opens (0) or closes (1) a chunk."""
            if not gap:
                return F.lit(True)
            rolling = F.xxhash64(F.lit(side), F.get(hashes, F.get(solid, k)), F.get(hashes, F.get(solid, k + 1)))
            return F.pmod(rolling, F.lit(gap)) != 0

        def chunk(k: Column) -> Column:
            last = F.size(solid) - 1
            ends = [F.when(chosen(k + d - 1, 1), k + d) for d in range(min_lines - 1, MOST)] if gap else []
            end = F.least(F.coalesce(*ends, k + (MOST if gap else min_lines - 1)), last)
            at, until = F.get(solid, k), F.get(solid, end)
            return F.struct(at.alias("at"), until.alias("until"), F.xxhash64(F.slice(hashes, at + 1, until - at + 1)).alias("digest"))

        starts = F.filter(F.sequence(F.lit(0), F.size(solid) - min_lines), lambda k: chosen(k, 0))
        return F.when(F.size(solid) >= min_lines, F.transform(starts, chunk))

    return let(_of_text(hashes), cut)


def equal_runs(mine: Column, theirs: Column, low: Column) -> Column:
    """All stretches ``(start, until)`` of positions in ``mine`` that equal ``theirs``, whose first element stands at ``low``."""
    high = F.least(F.size(mine), low + F.size(theirs))
    edges = F.filter(
        F.sequence(low - 1, high), lambda i: (i < low) | (i >= high) | (F.get(mine, i) != F.get(theirs, i - low))
    )

    def between(edges: Column) -> Column:
        run = lambda k: F.struct((F.get(edges, k) + 1).alias("start"), (F.get(edges, k + 1) - 1).alias("until"))
        return F.filter(F.transform(F.sequence(F.lit(0), F.size(edges) - 2), run), lambda r: r["start"] <= r["until"])

    return let(edges, between)


def passages(mine: Column, runs: Column, min_lines: int, shift: Column, same: Column) -> Column:
    """What goes of equal runs, as ``(start, until)``: from the first to the last line of text, if these are ``min_lines``.

    In one and the same text two places must not overlap, so there each window
    of ``min_lines`` lines is a passage of its own, if it is shorter than the shift.
    """

    def of_run(run: Column) -> Column:
        inside = F.filter(F.sequence(run["start"], run["until"]), lambda i: F.get(mine, i).bitwiseAND(F.lit(1)) == 1)

        def windows(solid: Column) -> Column:
            def window(k: Column) -> Column:
                return F.struct(F.get(solid, k).alias("start"), F.get(solid, k + min_lines - 1).alias("until"))

            whole = F.array(F.struct(F.get(solid, F.lit(0)).alias("start"), F.get(solid, F.size(solid) - 1).alias("until")))
            each = F.filter(
                F.transform(F.sequence(F.lit(0), F.size(solid) - min_lines), window), lambda w: w["until"] - w["start"] < shift
            )
            return F.when(F.size(solid) >= min_lines, F.when(same, each).otherwise(whole))

        return let(inside, windows)

    return F.flatten(F.filter(F.transform(runs, of_run), lambda x: x.isNotNull()))


def dedup_passages(docs: DataFrame, min_lines: int = MIN_LINES, gap: int = 0) -> DataFrame:
    """``(doc_id, text, n_removed)``, one row for each row of ``docs``; ``n_removed`` counts lines.

    A line goes if it lies in a passage of ``min_lines`` lines of text or more
    that stands at an earlier place too, in the order of doc_id (null comes
    last), hash of the text, row and position, that it does not overlap, and
    that a chunk anchors to it.  Without a ``gap`` these are all such passages.  So the first place of each
    line's text stays.  A text that loses all its lines becomes
    empty; a null text stays null.  Rows that repeat are places each of their
    own; other columns are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tables = Buckets(spark, "row_id")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "text", F.xxhash64("text").alias("text_hash"),
        F.when(F.contains("text", F.lit("\n")), line_hashes(F.col("text"))).alias("hashes"),
    )
    rows = tables.write(rows.repartition(tables.buckets, "row_id"), "zstd")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row_id", "at")
    lined = tables.files(0).where("hashes IS NOT NULL").select("row_id", "doc_id", "text_hash", "hashes")
    found = lined.select(
        "row_id", "doc_id", "text_hash", F.size("hashes").alias("n_lines"), F.inline(chunks(F.col("hashes"), min_lines, gap))
    ).select("digest", place.alias("place"), "until", "n_lines")
    repeated = found.groupBy("digest").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    repeated = materialize(repeated.where("first < last").select(
        "digest", F.col("first").alias("first"), F.col("first.row_id").alias("b"), F.col("first.at").alias("b_at")
    ))
    shift = F.col("place.at") - F.col("b_at")
    same = F.col("place.row_id") == F.col("b")
    anchored = found.join(repeated, "digest").where(
        (F.col("place") > F.col("first")) & ~(same & (shift <= F.col("until") - F.col("place.at")))
    ).select(F.col("place.row_id").alias("a"), "b", shift.alias("shift"), "n_lines").distinct()
    hashes = lined.select(F.col("row_id").alias("b"), F.col("hashes").alias("theirs"))
    # the part of the earlier text that the later one's lines can meet
    low = F.greatest(F.col("shift"), F.lit(0))
    beside = materialize(anchored.join(hashes, "b").select("a", "b", "shift", low.alias("low"), F.slice(
        "theirs", low - F.col("shift") + 1, F.greatest(F.lit(0), F.least(F.col("n_lines"), F.size("theirs") + F.col("shift")) - low)
    ).alias("theirs")))
    mine = rows.select(F.col("row_id").alias("a"), "hashes")
    runs = equal_runs(F.col("hashes"), F.col("theirs"), F.col("low"))
    grown = let(runs, lambda r: passages(F.col("hashes"), r, min_lines, F.col("shift"), F.col("a") == F.col("b")))
    wanted = materialize(mine.join(beside.hint("merge"), "a").select("a", "b", "shift", F.inline(grown)).select(
        "a", "start", "until", "b", (F.col("start") - F.col("shift")).alias("b_start"), (F.col("until") - F.col("start") + 1).alias("n")
    ).groupBy("a", "start", "until").agg(F.min(F.struct("b", "b_start", "n")).alias("from")).select("a", "start", "until", "from.*"))
    piece = lambda text, at, n: F.array_join(F.slice(F.split(text, "\n", -1), at + 1, n), "\n")
    asked = wanted.select("b", "b_start", "n").distinct()
    texts = rows.select(F.col("row_id").alias("b"), "text").join(asked.hint("merge"), "b").select(
        "b", "b_start", "n", piece(F.col("text"), F.col("b_start"), F.col("n")).alias("passage")
    )
    dropped = materialize(wanted.join(texts.hint("merge"), ["b", "b_start", "n"]).groupBy("a").agg(
        F.collect_list(F.struct("start", "until", "n", "passage")).alias("passages")
    ))
    joined = rows.select("row_id", "doc_id", "text").join(dropped.withColumnRenamed("a", "row_id").hint("merge"), "row_id", "left")

    def rest(lines: Column) -> Column:
        equal = lambda p: F.array_join(F.slice(lines, p["start"] + 1, p["n"]), "\n").cast("binary") == p["passage"].cast("binary")
        gone = F.flatten(F.transform(F.filter("passages", equal), lambda p: F.sequence(p["start"], p["until"])))

        def without(gone: Column) -> Column:
            kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
            return F.struct(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("n"))

        return let(F.array_distinct(gone), without)

    judged = joined.withColumn("left", F.when(F.col("passages").isNotNull(), let(F.split("text", "\n", -1), rest)))
    result = materialize(judged.select(
        "doc_id", F.when(F.col("left").isNull(), F.col("text")).otherwise(F.col("left.text")).alias("text"),
        F.coalesce("left.n", F.lit(0)).cast("long").alias("n_removed"),
    ), "zstd")
    tables.close()
    return result


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents"), gap=GAP)
