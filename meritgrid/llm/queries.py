"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meritgrid.llm import oracles
from meritgrid.llm.best_fit_packing import op8_best_fit_packing
from meritgrid.llm.byte_bpe import op5_byte_bpe
from meritgrid.llm.embedding_dedup import op7_embedding_dedup
from meritgrid.llm.filter_audit import op12_filter_audit
from meritgrid.llm.fingerprints import op6_fingerprints
from meritgrid.llm.language_id import op4_language_id
from meritgrid.llm.line_dedup import op1_line_dedup
from meritgrid.llm.lm_scoring import op3_lm_scoring
from meritgrid.llm.ngram_jaccard import op2_ngram_jaccard
from meritgrid.llm.periodic_runs import op13_periodic_runs
from meritgrid.llm.quality_classifier import op10_quality_classifier
from meritgrid.llm.sharding import op9_sharding
from meritgrid.llm.token_files import op11_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_language_id": op4_language_id,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_fingerprints": op6_fingerprints,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_sharding": op9_sharding,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_token_files": op11_token_files,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": oracles.LINE_DEDUP,
    "op2_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op3_lm_scoring": oracles.LM_SCORING,
    "op7_embedding_dedup": oracles.EMBEDDING_DEDUP,
    "op12_filter_audit": oracles.FILTER_AUDIT,
}
