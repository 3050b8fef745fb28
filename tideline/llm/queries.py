"""Queries of this subpackage by name, and the SQL that DuckDB can hold against them."""

from __future__ import annotations

from .chat import OP3_SQL, op3_chat_formatting
from .codes import op12_token_codes
from .divergence import OP13_SQL, op13_divergence
from .forest import op2_ngram_join
from .jpeg import op4_media
from .neighbours import op10_neighbours
from .ordinal import op5_toxicity
from .packing import op1_packing
from .passages import op9_quality
from .pieces import op6_sentencepiece
from .repeats import op7_substring_dedup
from .resampling import OP11_SQL, op11_resampling
from .url_lists import OP8_SQL, op8_url_filters

QUERIES = {
    "op1_packing": op1_packing,
    "op2_ngram_join": op2_ngram_join,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_media": op4_media,
    "op5_toxicity": op5_toxicity,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_quality": op9_quality,
    "op10_neighbours": op10_neighbours,
    "op11_resampling": op11_resampling,
    "op12_token_codes": op12_token_codes,
    "op13_divergence": op13_divergence,
}
ORACLE_SQL = {"op3_chat_formatting": OP3_SQL, "op8_url_filters": OP8_SQL, "op11_resampling": OP11_SQL, "op13_divergence": OP13_SQL}
