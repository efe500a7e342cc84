"""The queries of this package and, where SQL can express them, the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import OP12_SQL, op12_collocations
from .contamination import OP13_SQL, op13_decontamination
from .html_text import op3_html_extraction
from .language_id import op9_language_id
from .media import op2_media_columns
from .near_dedup import op6_near_dedup
from .packing import op5_best_fit_packing
from .pieces import op7_sentencepiece
from .repeats import op10_suffix_array_dedup
from .resampling import OP11_SQL, op11_importance_resampling
from .retrieval import OP4_SQL, op4_top_products
from .token_counts import op1_token_counts
from .url_filters import OP8_SQL, op8_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_media_columns": op2_media_columns,
    "op3_html_extraction": op3_html_extraction,
    "op4_top_products": op4_top_products,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_near_dedup": op6_near_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_url_filters": op8_url_filters,
    "op9_language_id": op9_language_id,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_collocations": op12_collocations,
    "op13_decontamination": op13_decontamination,
}
SQL: dict[str, str] = {"op4_top_products": OP4_SQL, "op8_url_filters": OP8_SQL, "op11_importance_resampling": OP11_SQL, "op12_collocations": OP12_SQL, "op13_decontamination": OP13_SQL}
