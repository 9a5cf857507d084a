"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embeddings, licences, mixing, packing, phrases, pii, repair, rules, simhash, tokens, transcripts, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        pii.op1_pii,
        embeddings.op2_embeddings,
        transcripts.op3_transcripts,
        urls.op4_url_filters,
        tokens.op5_token_counts,
        simhash.op6_simhash,
        licences.op7_licences,
        mixing.op8_mixing,
        decontaminate.op9_decontamination,
        rules.op10_quality,
        packing.op11_packing,
        repair.op12_repair,
        phrases.op13_phrases,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": mixing.OP8_SQL, "op13_phrases": phrases.OP13_SQL}
