"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontamination import op4_decontamination
from .html import op9_html_extraction
from .langid import op10_language_id
from .lines import op3_line_dedup
from .media import op2_media_columns
from .minhash import op5_minhash_near_dedup
from .mixing import mixing_sql, op6_mixing
from .pii import op8_personal_data
from .quality import op7_quality
from .urls import OP1_SQL, op1_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_media_columns, op3_line_dedup, op4_decontamination, op5_minhash_near_dedup,
        op6_mixing, op7_quality, op8_personal_data, op9_html_extraction, op10_language_id,
    )
}
ORACLE_SQL = {"op1_url_filters": OP1_SQL, "op6_mixing": mixing_sql()}
