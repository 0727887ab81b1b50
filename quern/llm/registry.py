"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import alignment, best_fit, chat, exact_dedup, html_text, line_dedup, mixing, near_dedup, packing, quality, search, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_mixing": mixing.op2_mixing,
        "op3_chat": chat.op3_chat,
        "op4_quality": quality.op4_quality,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_html_text": html_text.op7_html_text,
        "op8_warc": warc.op8_warc,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_packing": packing.op10_packing,
        "op11_best_fit": best_fit.op11_best_fit,
        "op12_alignment": alignment.op12_alignment,
        "op13_search": search.op13_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE_SQL,
        "op2_mixing": mixing.ORACLE_SQL,
        "op3_chat": chat.ORACLE_SQL,
        "op8_warc": warc.ORACLE_SQL,
        "op13_search": search.ORACLE_SQL,
    }
