"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from quillgraph.llm.divergence import OP13_SQL, op13_divergence
from quillgraph.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from quillgraph.llm.html_text import op1_html_text
from quillgraph.llm.importance import OP11_SQL, op11_importance
from quillgraph.llm.mixing import OP7_SQL, op7_mixing
from quillgraph.llm.pii import op9_pii
from quillgraph.llm.ppm import op4_ppm
from quillgraph.llm.quality_rules import op6_quality_rules
from quillgraph.llm.sentence_pieces import op2_sentence_pieces
from quillgraph.llm.simhash import op8_simhash
from quillgraph.llm.substring_dedup import op3_substring_dedup
from quillgraph.llm.token_files import op5_token_files
from quillgraph.llm.toxicity import op12_toxicity

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_sentence_pieces": op2_sentence_pieces,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_ppm": op4_ppm,
    "op5_token_files": op5_token_files,
    "op6_quality_rules": op6_quality_rules,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_pii": op9_pii,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_importance": op11_importance,
    "op12_toxicity": op12_toxicity,
    "op13_divergence": op13_divergence,
}

ORACLES = {
    "op7_mixing": OP7_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_importance": OP11_SQL,
    "op13_divergence": OP13_SQL,
}
