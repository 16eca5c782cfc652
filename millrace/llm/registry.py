"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat_format import OP8_SQL, op8_chat_format
from .decontamination import OP9_SQL, op9_decontamination
from .embedding_dedup import OP2_SQL, op2_embedding_dedup
from .packing import op4_packing
from .pane_revisions import OP11_SQL, op11_pane_revisions
from .pii import op1_pii
from .quality import op7_quality_classifier
from .simhash_dedup import op6_simhash_dedup
from .substring_dedup import OP3_SQL, op3_substring_dedup
from .suffix_dedup import op5_suffix_dedup
from .url_filters import OP10_SQL, op10_url_filters
from .vector_codes import OP13_SQL, op13_vector_codes
from .warc import OP12_SQL, op12_warc


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_embedding_dedup, op3_substring_dedup, op4_packing, op5_suffix_dedup, op6_simhash_dedup, op7_quality_classifier, op8_chat_format, op9_decontamination, op10_url_filters, op11_pane_revisions, op12_warc, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_dedup": OP2_SQL,
        "op3_substring_dedup": OP3_SQL,
        "op8_chat_format": OP8_SQL,
        "op9_decontamination": OP9_SQL,
        "op10_url_filters": OP10_SQL,
        "op11_pane_revisions": OP11_SQL,
        "op12_warc": OP12_SQL,
        "op13_vector_codes": OP13_SQL,
    }
