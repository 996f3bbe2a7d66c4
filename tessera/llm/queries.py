"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm.ann import OP8_SQL, op8_nearest
from tessera.llm.bpe import op11_bpe
from tessera.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from tessera.llm.jaccard_join import OP7_SQL, op7_jaccard_join
from tessera.llm.langid import op10_language_id
from tessera.llm.packing import op3_packing
from tessera.llm.pii import op4_pii
from tessera.llm.pieces import op9_pieces
from tessera.llm.quality import op2_quality
from tessera.llm.token_counts import op6_token_counts
from tessera.llm.urls import OP5_SQL, op5_url_filter
from tessera.llm.vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_url_filter": op5_url_filter,
    "op6_token_counts": op6_token_counts,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_nearest": op8_nearest,
    "op9_pieces": op9_pieces,
    "op10_language_id": op10_language_id,
    "op11_bpe": op11_bpe,
    "op12_vector_codes": op12_vector_codes,
}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op5_url_filter": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op8_nearest": OP8_SQL, "op12_vector_codes": OP12_SQL}
