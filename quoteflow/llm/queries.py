"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from quoteflow.llm import conversation_repair, exact_dedup
from quoteflow.llm.chat_windows import op12_chat_windows
from quoteflow.llm.conversation_repair import op11_conversation_repair
from quoteflow.llm.exact_dedup import op4_exact_dedup
from quoteflow.llm.html_text import op3_html_text
from quoteflow.llm.merge_dropout import op10_merge_dropout
from quoteflow.llm.minhash import op8_minhash
from quoteflow.llm.packing import op2_packing
from quoteflow.llm.resampling import op13_importance_resampling
from quoteflow.llm.sharding import op9_sharding
from quoteflow.llm.token_counts import op7_token_counts
from quoteflow.llm.token_files import op1_token_files
from quoteflow.llm.toxicity import op6_toxicity
from quoteflow.llm.vectors import op5_vectors

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_packing": op2_packing,
    "op3_html_text": op3_html_text,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_vectors": op5_vectors,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_minhash": op8_minhash,
    "op9_sharding": op9_sharding,
    "op10_merge_dropout": op10_merge_dropout,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_chat_windows": op12_chat_windows,
    "op13_importance_resampling": op13_importance_resampling,
}

#: SQL texts; the other queries are tested against brute force or round trips.
ORACLE = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op11_conversation_repair": conversation_repair.ORACLE,
}
