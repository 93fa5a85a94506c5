"""Queries of this folder, one for each operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from attestor.llm.bpe import op6_bpe_trie
from attestor.llm.conversations import OP12_SQL, op12_conversation_repair
from attestor.llm.fingerprints import op2_fingerprints
from attestor.llm.importance import OP13_SQL, op13_importance
from attestor.llm.language import op5_language_id
from attestor.llm.licences import op10_licence_scan
from attestor.llm.neardup import op4_jaccard_join
from attestor.llm.packing import op1_packing
from attestor.llm.pii import op7_pii_pseudonyms
from attestor.llm.quality import OP9_SQL, op9_quality_rules
from attestor.llm.suffixes import op3_suffix_dedup
from attestor.llm.toxicity import op11_toxicity
from attestor.llm.wavelet import op8_wavelet_shards

QUERIES = {
    "op1_packing": op1_packing,
    "op2_fingerprints": op2_fingerprints,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_language_id": op5_language_id,
    "op6_bpe_trie": op6_bpe_trie,
    "op7_pii_pseudonyms": op7_pii_pseudonyms,
    "op8_wavelet_shards": op8_wavelet_shards,
    "op9_quality_rules": op9_quality_rules,
    "op10_licence_scan": op10_licence_scan,
    "op11_toxicity": op11_toxicity,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_importance": op13_importance,
    "pipeline": corpus_pipeline.run,
}

#: The other operators have no form in SQL: sketches, tries, automata and trained weights stand in every result.
#: Tests compare them with brute force, a library or held-out labels.
ORACLE_SQL: dict[str, str] = {"op9_quality_rules": OP9_SQL, "op12_conversation_repair": OP12_SQL, "op13_importance": OP13_SQL} | ({} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL})
