"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm.divergence import OP11_SQL, op11_source_divergence
from corvane.llm.language_id import op3_language_id
from corvane.llm.lm_scoring import op10_lm_scoring
from corvane.llm.mixing import op4_source_mixing
from corvane.llm.near_dedup import op9_near_dedup
from corvane.llm.oracles import OP3_SQL, OP9_SQL
from corvane.llm.packing import op1_best_fit_packing
from corvane.llm.quality_rules import op2_quality_rules
from corvane.llm.spelling import OP12_SQL, op12_spelling_variants
from corvane.llm.substring_dedup import op7_substring_dedup
from corvane.llm.token_counts import op13_token_counts
from corvane.llm.topk_search import OP8_SQL, op8_exact_topk
from corvane.llm.url_filter import OP5_SQL, op5_url_filter
from corvane.llm.warc import OP6_SQL, op6_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_rules, op3_language_id, op4_source_mixing, op5_url_filter, op6_warc, op7_substring_dedup, op8_exact_topk, op9_near_dedup, op10_lm_scoring, op11_source_divergence, op12_spelling_variants, op13_token_counts)}

ORACLE_SQL: dict[str, str] = {"op3_language_id": OP3_SQL, "op5_url_filter": OP5_SQL, "op6_warc": OP6_SQL, "op8_exact_topk": OP8_SQL, "op9_near_dedup": OP9_SQL, "op11_source_divergence": OP11_SQL, "op12_spelling_variants": OP12_SQL}
