"""Queries of this folder and their SQL."""

from __future__ import annotations

from .op10_decontaminate import op10_decontamination
from .op1_audio import op1_media_columns
from .op2_jaccard import op2_jaccard_join
from .op3_private import op3_private_data
from .op4_lines import OP4_SQL, op4_line_dedup
from .op5_urls import OP5_SQL, op5_url_filters
from .op6_secrets import OP6_SQL, op6_secret_scan
from .op7_language import op7_language_id
from .op8_pieces import op8_sentencepiece
from .op9_quality import op9_quality

QUERIES = {
    "op1_media_columns": op1_media_columns,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_private_data": op3_private_data,
    "op4_line_dedup": op4_line_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_secret_scan": op6_secret_scan,
    "op7_language_id": op7_language_id,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
}
SQL = {"op4_line_dedup": OP4_SQL, "op5_url_filters": OP5_SQL, "op6_secret_scan": OP6_SQL}
