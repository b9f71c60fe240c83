"""The query of each operator, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from . import chat_format, decontaminate, importance_resampling, jaccard_join, knn_join, substring_dedup
from .bpe import op7_query
from .chat_format import op8_query
from .context_mixing import op12_query
from .decontaminate import op4_query
from .importance_resampling import op13_query
from .jaccard_join import op2_query
from .knn_join import op5_query
from .language_id import op3_query
from .licences import op9_query
from .quality import op1_query
from .substring_dedup import op6_query
from .token_alignment import op11_query
from .token_counts import op10_query

QUERIES = {
    "op1_quality_classifier": op1_query,
    "op2_ngram_jaccard_join": op2_query,
    "op3_language_id": op3_query,
    "op4_decontamination": op4_query,
    "op5_exact_top_k": op5_query,
    "op6_substring_dedup": op6_query,
    "op7_byte_level_bpe": op7_query,
    "op8_chat_formatting": op8_query,
    "op9_licence_scan": op9_query,
    "op10_token_counts": op10_query,
    "op11_token_alignment": op11_query,
    "op12_lm_scoring": op12_query,
    "op13_importance_resampling": op13_query,
}
#: None for the others: SQL can express no training, no tokenizer and no compressor.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
    "op4_decontamination": decontaminate.ORACLE_SQL,
    "op5_exact_top_k": knn_join.ORACLE_SQL,
    "op6_substring_dedup": substring_dedup.ORACLE_SQL,
    "op8_chat_formatting": chat_format.ORACLE_SQL,
    "op13_importance_resampling": importance_resampling.ORACLE_SQL,
}
