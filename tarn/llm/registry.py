"""Queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import oracles
from tarn.llm.branch_merge import op13_merge
from tarn.llm.chat import op2_chat
from tarn.llm.embedding_dedup import op9_embeddings
from tarn.llm.fingerprints import op8_fingerprints
from tarn.llm.line_dedup import op6_line_dedup
from tarn.llm.minhash import op10_minhash
from tarn.llm.packing import op5_packing
from tarn.llm.pii import op7_pii
from tarn.llm.quality import op3_quality
from tarn.llm.sentencepiece_codec import op1_sentencepiece
from tarn.llm.sharding import op4_sharding
from tarn.llm.substrings import op11_substrings
from tarn.llm.vector_codes import op12_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_chat": op2_chat,
    "op3_quality": op3_quality,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_pii": op7_pii,
    "op8_fingerprints": op8_fingerprints,
    "op9_embeddings": op9_embeddings,
    "op10_minhash": op10_minhash,
    "op11_substrings": op11_substrings,
    "op12_vector_codes": op12_vector_codes,
    "op13_merge": op13_merge,
}

ORACLE_SQL: dict[str, str] = {"op2_chat": oracles.CHAT, "op9_embeddings": oracles.VECTORS, "op10_minhash": oracles.NEAR, "op11_substrings": oracles.REPEATS, "op12_vector_codes": oracles.CODES, "op13_merge": oracles.MERGED}
