"""Operator 10: chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation many times, each time with a few more turns.
A rolling hash over the turns gives every prefix of a conversation a digest;
a conversation whose last digest is an inner digest of another is a snapshot
of it.  An anti-join keeps the maximal conversations, one of each group of
equal ones, and only these are rendered.  Digests are made distinct before the
join, so a first turn that many conversations share is one row in it.

A conversation is rendered as one text, so it has to fit a task; rows without
a conv_id are conversations of one turn each and never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pii import let
from .shared import materialize, table

START, END = "<|im_start|>", "<|im_end|>"


def prefix_digests(turns: Column) -> Column:
    """The digest of each prefix, from that of the prefix before and the turn.

    Turns are taken in blocks of the square root of their number, so that no
    array is copied for each of them.
    """

    def step(acc: Column, turn: Column) -> Column:
        parts = [F.sha2(F.coalesce(turn[c], F.lit("\x00null")).cast("binary"), 256) for c in ("role", "text")]
        digest = F.unhex(F.sha2(F.concat(F.hex(acc["last"]), *parts).cast("binary"), 256))
        return let(digest, lambda d: F.struct(F.concat(acc["out"], F.array(d)).alias("out"), d.alias("last")))

    def run(width: Column) -> Column:
        def block(acc: Column, k: Column) -> Column:
            start = F.struct(F.array().cast("array<binary>").alias("out"), acc["last"].alias("last"))
            done = F.aggregate(F.slice(turns, k * width + 1, width), start, step)
            return let(done, lambda d: F.struct(F.concat(acc["out"], F.array(d["out"])).alias("out"), d["last"].alias("last")))

        start = F.struct(F.array().cast("array<array<binary>>").alias("out"), F.lit("").cast("binary").alias("last"))
        blocks = F.sequence(F.lit(0), F.ceil(F.size(turns) / width).cast("int") - 1)
        return F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["out"]))

    return let(F.ceil(F.sqrt(F.size(turns))).cast("int"), run)


def conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns, digests, copies)``: the turns in order and the digest of each prefix; equal ones without an id are one row."""
    turn = F.struct("turn", "role", "text")
    named = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    lone = turns.where("conv_id IS NULL").select("conv_id", F.array(turn).alias("turns"))
    named = named.select("conv_id", "turns", prefix_digests(F.col("turns")).alias("digests"), F.lit(1).cast("long").alias("copies"))
    lone = lone.withColumn("digest", prefix_digests(F.col("turns"))[0]).groupBy("digest").agg(
        F.min("turns").alias("turns"), F.count(F.lit(1)).alias("copies")
    )
    return named.unionByName(lone.select(F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"), "turns", F.array("digest").alias("digests"), "copies"))


def maximal(convs: DataFrame) -> DataFrame:
    """``(conv_id, digest, n_copies)`` of the conversations that prefix no longer one, the smallest id of equal ones."""
    inner = convs.select(
        F.explode(F.slice("digests", 1, F.size("digests") - 1)).alias("digest")
    ).distinct()
    last = convs.select("conv_id", F.element_at("digests", -1).alias("digest"), "copies")
    groups = last.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.sum("copies").alias("n_copies"))
    return groups.join(inner, "digest", "left_anti").select("conv_id", "digest", "n_copies")


def render(turns: Column) -> Column:
    """Each turn as ``<|im_start|>role``, a line feed, its text, ``<|im_end|>`` and a line feed; nulls as empty."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(END + "\n")
    )), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_copies, text)`` of each maximal conversation.

    ``turns`` has conv_id, turn, role and text.  Turns are ordered by turn,
    then role, then text, nulls first; repeated rows of a conversation count
    once.  Each row without a conv_id is a conversation of one turn.  Null
    roles and texts differ from empty ones when prefixes are compared, and are
    rendered as empty.  ``n_copies`` counts the equal conversations.  Other
    columns are ignored.
    """
    convs = materialize(conversations(turns.select("conv_id", "turn", "role", "text")))
    kept = materialize(maximal(convs)).select(F.col("conv_id").alias("kept_id"), F.col("digest").alias("kept"), "n_copies")
    same = F.col("conv_id").eqNullSafe(F.col("kept_id")) & (F.element_at("digests", -1) == F.col("kept"))
    return convs.join(kept, same).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", render(F.col("turns")).alias("text")
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP10_SQL = """
WITH r AS (SELECT *, CASE WHEN conv_id IS NULL THEN 'row ' || row_number() OVER () ELSE 'id ' || conv_id END AS k FROM conversations),
t AS (SELECT DISTINCT k, conv_id, turn, role, text FROM r),
c AS (
  SELECT k, conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY turn, role, text) AS l,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                    ORDER BY turn, role, text) AS text
  FROM t GROUP BY k, conv_id
),
p AS (SELECT DISTINCT list_slice(l, 1, i) AS l FROM (SELECT l, unnest(range(1, n_turns)) AS i FROM c)),
g AS (SELECT l, first(k ORDER BY conv_id NULLS LAST, k) AS k, count(*) AS n_copies FROM c GROUP BY l)
SELECT c.conv_id, c.n_turns, g.n_copies, c.text
FROM g JOIN c USING (k) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = g.l)
"""
