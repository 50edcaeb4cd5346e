"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestone.llm.bpe import op10_byte_bpe
from lodestone.llm.chat import OP8_SQL, op8_chat_snapshot_collapse
from lodestone.llm.decontaminate import OP4_SQL, op4_benchmark_decontamination
from lodestone.llm.html_text import op7_html_extraction
from lodestone.llm.image import op6_image_copies
from lodestone.llm.language import op5_language_id
from lodestone.llm.near_dup import OP9_SQL, op9_minhash_near_dedup
from lodestone.llm.packing import op12_best_fit_packing
from lodestone.llm.pii import op3_feistel_pseudonyms
from lodestone.llm.quality import op1_quality_classifier
from lodestone.llm.search import OP11_SQL, op11_ranked_search
from lodestone.llm.shard import op2_hilbert_sharding
from lodestone.llm.trie import OP13_SQL, op13_prefix_trie

QUERIES = (
    op1_quality_classifier,
    op2_hilbert_sharding,
    op3_feistel_pseudonyms,
    op4_benchmark_decontamination,
    op5_language_id,
    op6_image_copies,
    op7_html_extraction,
    op8_chat_snapshot_collapse,
    op9_minhash_near_dedup,
    op10_byte_bpe,
    op11_ranked_search,
    op12_best_fit_packing,
    op13_prefix_trie,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_benchmark_decontamination": OP4_SQL, "op8_chat_snapshot_collapse": OP8_SQL, "op9_minhash_near_dedup": OP9_SQL, "op11_ranked_search": OP11_SQL, "op13_prefix_trie": OP13_SQL}
