"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from copyledger.llm import (
    bpe, divergence, embeddings, imatch, lines, minhash, neighbours, packing, phrases, quality, substrings, token_counts,
    urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_urls": urls.op1_urls,
    "op2_lines": lines.op2_lines,
    "op3_quality": quality.op3_quality,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_packing": packing.op5_packing,
    "op6_embeddings": embeddings.op6_embeddings,
    "op7_substrings": substrings.op7_substrings,
    "op8_imatch": imatch.op8_imatch,
    "op9_minhash": minhash.op9_minhash,
    "op10_bpe": bpe.op10_bpe,
    "op11_phrases": phrases.op11_phrases,
    "op12_neighbours": neighbours.op12_neighbours,
    "op13_divergence": divergence.op13_divergence,
}

ORACLES: dict[str, str] = {
    "op1_urls": urls.OP1_SQL,
    "op2_lines": lines.OP2_SQL,
    "op11_phrases": phrases.OP11_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
