"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from stackloom.llm import hard_negatives, line_dedup, timestamps
from stackloom.llm.common import ready
from stackloom.llm.decontaminate import op10_decontaminate
from stackloom.llm.embedding_dedup import op9_embeddings
from stackloom.llm.html_text import op2_html
from stackloom.llm.quality import op1_quality
from stackloom.llm.sentencepiece_bpe import op5_sentencepiece
from stackloom.llm.simhash import op6_simhash
from stackloom.llm.substring import op4_substring
from stackloom.llm.suffix_dedup import op7_suffix
from stackloom.llm.token_file import op12_tokens
from stackloom.llm.toxicity import op8_toxicity

_QUERIES = {
    "op1_quality": op1_quality,
    "op2_html": op2_html,
    "op3_lines": line_dedup.op3_lines,
    "op4_substring": op4_substring,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_simhash": op6_simhash,
    "op7_suffix": op7_suffix,
    "op8_toxicity": op8_toxicity,
    "op9_embeddings": op9_embeddings,
    "op10_decontaminate": op10_decontaminate,
    "op11_timestamps": timestamps.op11_timestamps,
    "op12_tokens": op12_tokens,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}


def queries():
    return {k: (lambda spark, sf_dir, f=f: f(ready(spark), sf_dir)) for k, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op3_lines": line_dedup.SQL, "op11_timestamps": timestamps.SQL, "op13_hard_negatives": hard_negatives.SQL}
