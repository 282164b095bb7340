"""Queries of this subpackage and their SQL, for the driver contract."""

from __future__ import annotations

from .chat_format import OP6_SQL, op6_chat_format
from .embedding_dedup import OP4_SQL, op4_embedding_dedup
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .html_extract import op8_html_extract
from .jaccard_join import op7_jaccard_join
from .language_id import op5_language_id
from .packing import op1_packing
from .sentencepieces import op2_sentencepiece
from .substring_dedup import op9_substring_dedup
from .warc import OP3_SQL, op3_warc


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_warc": op3_warc,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_language_id": op5_language_id,
        "op6_chat_format": op6_chat_format,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_html_extract": op8_html_extract,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict:
    return {"op3_warc": OP3_SQL, "op4_embedding_dedup": OP4_SQL, "op6_chat_format": OP6_SQL, "op10_exact_dedup": OP10_SQL}
