"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldnotes.llm import alignment, conversations, decontaminate, langid, licenses, linededup, lmscore, mixing, pii, quality, simhash, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": topk.op1_topk,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_pii": pii.op5_pii,
    "op6_licenses": licenses.op6_licenses,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_lm_scoring": lmscore.op8_lm_scoring,
    "op9_simhash": simhash.op9_simhash,
    "op10_langid": langid.op10_langid,
    "op11_alignment": alignment.op11_alignment,
    "op12_quality": quality.op12_quality,
    "op13_prefix_trie": conversations.op13_prefix_trie,
}

SQL: dict[str, Callable[[], str]] = {
    "op1_topk": topk.op1_sql,
    "op2_mixing": mixing.op2_sql,
    "op4_decontaminate": decontaminate.op4_sql,
    "op6_licenses": licenses.op6_sql,
    "op13_prefix_trie": conversations.op13_sql,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql() for name, sql in SQL.items()}
