"""Queries of the training-data operators and the SQL that states them, where SQL can."""

from __future__ import annotations

from .chat import op7_chat_format
from .decontaminate import op4_decontamination
from .embedding_dedup import op8_embedding_near_dedup
from .html_extract import op6_html_extraction
from .language import op5_language_id
from .minhash import op1_minhash_near_dedup
from .mixing import OP9_SQL, op9_source_mixing
from .periodic import op13_periodic_runs
from .pii import op10_pii
from .spelling import op12_spelling_variants
from .suffix_dedup import op2_suffix_dedup
from .token_counts import op11_token_counts
from .tokens import op3_token_output

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_token_output": op3_token_output,
    "op4_decontamination": op4_decontamination,
    "op5_language_id": op5_language_id,
    "op6_html_extraction": op6_html_extraction,
    "op7_chat_format": op7_chat_format,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_pii": op10_pii,
    "op11_token_counts": op11_token_counts,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL = {"op9_source_mixing": OP9_SQL}
