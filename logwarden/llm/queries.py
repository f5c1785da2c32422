"""Queries of this folder and the SQL that expresses them."""

from __future__ import annotations

from logwarden.llm.op1_topk import OP1_SQL, op1_topk
from logwarden.llm.op2_jaccard import OP2_SQL, op2_jaccard
from logwarden.llm.op3_html import op3_html
from logwarden.llm.op4_merkle import op4_merkle
from logwarden.llm.op5_language import op5_language
from logwarden.llm.op6_mixing import op6_mixing
from logwarden.llm.op7_pii import op7_pii
from logwarden.llm.op8_bpe import op8_bpe
from logwarden.llm.op9_quality import op9_quality
from logwarden.llm.op10_lm import op10_lm
from logwarden.llm.op11_spelling import op11_spelling
from logwarden.llm.op12_simhash import op12_simhash
from logwarden.llm.op13_resampling import op13_resampling

LLM_QUERIES = {
    "op1_topk": op1_topk,
    "op2_jaccard": op2_jaccard,
    "op3_html": op3_html,
    "op4_merkle": op4_merkle,
    "op5_language": op5_language,
    "op6_mixing": op6_mixing,
    "op7_pii": op7_pii,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_lm": op10_lm,
    "op11_spelling": op11_spelling,
    "op12_simhash": op12_simhash,
    "op13_resampling": op13_resampling,
}

#: The others are fitted models, or results that SQL cannot express; their tests compare them with plain versions.
LLM_ORACLES: dict[str, str] = {"op1_topk": OP1_SQL, "op2_jaccard": OP2_SQL}
