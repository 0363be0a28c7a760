"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP6_SQL, op6_prefix_tree
from .conversation_trie import OP13_SQL, op13_conversation_trie
from .decontamination import op5_decontamination
from .html_text import op7_html_extraction
from .language import op8_language_id
from .merkle import OP11_SQL, op11_merkle_manifest
from .packing import op2_best_fit_packing
from .piece_codec import op12_sentencepiece
from .quality import op4_compression_bands
from .simhash import op9_simhash_near_dedup
from .token_counts import op1_token_counts
from .toxicity import op3_toxicity
from .url_rules import OP10_SQL, op10_url_reputation

QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_best_fit_packing, op3_toxicity, op4_compression_bands, op5_decontamination,
    op6_prefix_tree, op7_html_extraction, op8_language_id, op9_simhash_near_dedup, op10_url_reputation, op11_merkle_manifest, op12_sentencepiece,
    op13_conversation_trie)}

#: The others need tokenizers, zstandard, fitted models, XXH64 or alignment, which SQL has not; tests hold them against brute force.
ORACLES = {"op6_prefix_tree": OP6_SQL, "op10_url_reputation": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op13_conversation_trie": OP13_SQL}
