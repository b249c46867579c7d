"""Queries of this folder, by name, and the SQL of those that SQL can say."""

from __future__ import annotations

from corvane.llm.bpe import op1_bpe
from corvane.llm.decontamination import op9_decontamination
from corvane.llm.html_text import op6_html_text
from corvane.llm.jaccard import op8_jaccard
from corvane.llm.langid import op3_language_id
from corvane.llm.neighbours import op2_neighbours
from corvane.llm.quality import op10_quality
from corvane.llm.sharding import op5_sharding
from corvane.llm.token_files import op4_token_files
from corvane.llm.warc import op7_warc

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_neighbours": op2_neighbours,
    "op3_language_id": op3_language_id,
    "op4_token_files": op4_token_files,
    "op5_sharding": op5_sharding,
    "op6_html_text": op6_html_text,
    "op7_warc": op7_warc,
    "op8_jaccard": op8_jaccard,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {}
