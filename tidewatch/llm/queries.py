"""The registered queries of the corpus operators, and reference SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, centroids, chat, decontaminate, fingerprints, katz, language, ngram_join, packing, quality, secrets, sequences, spelling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_join.op1,
    "op2_token_sequences": sequences.op2,
    "op3_language_id": language.op3,
    "op4_secret_scans": secrets.op4,
    "op5_benchmark_decontamination": decontaminate.op5,
    "op6_quality_classifier": quality.op6,
    "op7_lm_scoring": katz.op7,
    "op8_chat_formatting": chat.op8,
    "op9_best_fit_packing": packing.op9,
    "op10_document_fingerprints": fingerprints.op10,
    "op11_bpe_round_trip": bpe.op11,
    "op12_centroid_clustering": centroids.op12,
    "op13_spelling_variants": spelling.op13,
}

ORACLES: dict[str, str] = {"op8_chat_formatting": chat.OP8_SQL, "op12_centroid_clustering": centroids.op12_sql()}
