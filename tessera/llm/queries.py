"""The operators as queries over the driver's tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, licenses, minhash, packed, secrets, separators, toolcalls, toxicity, vectors


def _over(f: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": _over(decontaminate.op1_decontaminate, "documents", "benchmark"),
    "op2_secret_scan": _over(secrets.op2_secrets, "documents"),
    "op3_byte_bpe": _over(bpe.op3_bpe, "documents"),
    "op4_embedding_dedup": _over(vectors.op4_near_vectors, "embeddings"),
    "op5_minhash_dedup": _over(minhash.op5_near_documents, "documents"),
    "op6_packed_tokens": _over(packed.op6_token_files, "documents"),
    "op7_license_scan": _over(licenses.op7_licenses, "documents"),
    "op8_tool_calls": _over(toolcalls.op8_tool_calls, "conversations"),
    "op9_toxicity": _over(toxicity.op9_toxicity, "documents", "labels"),
    "op10_token_counts": _over(separators.op10_token_counts, "documents"),
}
SQL: dict[str, str] = {
    "op1_decontamination": decontaminate.OP1_SQL, "op4_embedding_dedup": vectors.OP4_SQL, "op5_minhash_dedup": minhash.OP5_SQL, "op8_tool_calls": toolcalls.OP8_SQL,
}
