"""The registered queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import decontaminate, embeddings, language, licences, lines, minhash, passages, pieces, quality, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": minhash.op1_minhash,
    "op2_passages": passages.op2_passages,
    "op3_sharding": sharding.op3_sharding,
    "op4_quality": quality.op4_quality,
    "op5_pieces": pieces.op5_pieces,
    "op6_licences": licences.op6_licences,
    "op7_language": language.op7_language,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_lines": lines.op9_lines,
    "op10_embeddings": embeddings.op10_embeddings,
}

ORACLES: dict[str, str] = {
    "op1_minhash": minhash.ORACLE_SQL,
    "op2_passages": passages.ORACLE_SQL,
    "op6_licences": licences.ORACLE_SQL,
    "op8_decontaminate": decontaminate.ORACLE_SQL,
    "op9_lines": lines.ORACLE_SQL,
    "op10_embeddings": embeddings.ORACLE_SQL,
}
