"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, exact, langid, lexical, licenses, lines, lloyd, packing, pii, quality, simhash, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_vectors": vectors.op1_vectors,
        "op2_pii": pii.op2_pii,
        "op3_quality": quality.op3_quality,
        "op4_langid": langid.op4_langid,
        "op5_lines": lines.op5_lines,
        "op6_bpe": bpe.op6_bpe,
        "op7_simhash": simhash.op7_simhash,
        "op8_packing": packing.op8_packing,
        "op9_exact_dedup": exact.op9_exact_dedup,
        "op10_chat": chat.op10_chat,
        "op11_licenses": licenses.op11_licenses,
        "op12_clusters": lloyd.op12_clusters,
        "op13_search": lexical.op13_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_vectors": vectors.OP1_SQL,
        "op9_exact_dedup": exact.OP9_SQL,
        "op10_chat": chat.OP10_SQL,
        "op12_clusters": lloyd.OP12_SQL,
        "op13_search": lexical.OP13_SQL,
    }
