"""The queries of this subpackage, by name."""

from __future__ import annotations

from streamloom.llm.ann import op4_nearest_neighbours
from streamloom.llm.decontaminate import SQL as DECONTAMINATION_SQL
from streamloom.llm.decontaminate import op8_decontamination
from streamloom.llm.language_id import op1_language_id
from streamloom.llm.lm_score import op5_lm_score
from streamloom.llm.near_dedup import SQL as NEAR_DEDUP_SQL
from streamloom.llm.near_dedup import op6_near_dedup
from streamloom.llm.packing import op10_packing
from streamloom.llm.quality import op3_quality
from streamloom.llm.secret_scan import op2_secret_scan
from streamloom.llm.token_counts import op9_token_counts
from streamloom.llm.url_filter import SQL as URL_FILTER_SQL
from streamloom.llm.url_filter import op7_url_filter

QUERIES = {f.__name__: f for f in (op1_language_id, op2_secret_scan, op3_quality, op4_nearest_neighbours, op5_lm_score, op6_near_dedup, op7_url_filter, op8_decontamination, op9_token_counts, op10_packing)}

#: Models and tokenizers can't be told in SQL; the other queries are held against brute force in the tests.
ORACLE_SQL: dict[str, str] = {"op6_near_dedup": NEAR_DEDUP_SQL, "op7_url_filter": URL_FILTER_SQL, "op8_decontamination": DECONTAMINATION_SQL}
