"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prismlake.llm import chat, decontamination, fingerprints, hardnegatives, licenses, linededup, lmscore, minhash, packing, simhash, tokencounts, toxicity, vectorcodes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        linededup.op1_line_dedup,
        lmscore.op2_lm_scoring,
        minhash.op3_minhash_near_dedup,
        chat.op4_chat_formatting,
        toxicity.op5_toxicity,
        decontamination.op6_benchmark_decontamination,
        fingerprints.op7_document_fingerprints,
        tokencounts.op8_token_counts,
        licenses.op9_license_scan,
        packing.op10_best_fit_packing,
        hardnegatives.op11_hard_negative_mining,
        vectorcodes.op12_vector_code_compression,
        simhash.op13_simhash_near_dedup,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": chat.OP4_SQL, "op6_benchmark_decontamination": decontamination.OP6_SQL, "op9_license_scan": licenses.OP9_SQL, "op11_hard_negative_mining": hardnegatives.OP11_SQL, "op12_vector_code_compression": vectorcodes.OP12_SQL}
