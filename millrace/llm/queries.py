"""The registered corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import chat, filteraudit, jaccard, langid, licenses, lzprint, mixing, packing, quality, spelling, tokencount, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_chat": chat.op2_chat,
        "op3_licenses": licenses.op3_licenses,
        "op4_warc": warc.op4_warc,
        "op5_packing": packing.op5_packing,
        "op6_quality": quality.op6_quality,
        "op7_language": langid.op7_language,
        "op8_token_counts": tokencount.op8_token_counts,
        "op9_fingerprints": lzprint.op9_fingerprints,
        "op10_jaccard": jaccard.op10_jaccard,
        "op11_filter_audit": filteraudit.op11_filter_audit,
        "op12_spelling": spelling.op12_spelling,
        "op13_toxicity": toxicity.op13_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.OP1_SQL, "op2_chat": chat.OP2_SQL, "op4_warc": warc.OP4_SQL, "op6_quality": quality.OP6_SQL, "op10_jaccard": jaccard.OP10_SQL, "op11_filter_audit": filteraudit.OP11_SQL, "op12_spelling": spelling.OP12_SQL}
