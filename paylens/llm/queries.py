"""Registered queries of the subpackage, one per dealt operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paylens.llm import (bpe, langid, lengths, licenses, minhash, oracles, packing, pieces, quality, runs, sharding, toxicity,
                         vectors, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": minhash.op1,
    "op2_license_scan": licenses.op2,
    "op3_byte_bpe": bpe.op3,
    "op4_quality_rules": quality.op4,
    "op5_toxicity": toxicity.op5,
    "op6_language_id": langid.op6,
    "op7_packing": packing.op7,
    "op8_embedding_near_dedup": vectors.op8,
    "op9_sharding": sharding.op9,
    "op10_token_counts": lengths.op10,
    "op11_sentencepiece": pieces.op11,
    "op12_periodic_runs": runs.op12,
    "op13_embedding_whitening": whitening.op13,
}

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": oracles.MINHASH,
    "op2_license_scan": oracles.LICENSES,
    "op4_quality_rules": oracles.QUALITY,
    "op8_embedding_near_dedup": oracles.VECTORS,
}
