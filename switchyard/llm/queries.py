"""Registered queries of this package and their SQL."""

from __future__ import annotations

from switchyard.llm.embedding_dedup import PLANTED_SQL, embedding_dedup_planted, links_sql, op7_embedding_dedup
from switchyard.llm.fingerprints import op13_fingerprints
from switchyard.llm.language import op2_language_id
from switchyard.llm.licenses import license_notices, licenses_sql, notices_sql, op5_licenses
from switchyard.llm.media import op4_media
from switchyard.llm.mixing import mixing_sql, op10_mixing
from switchyard.llm.packing import op8_packing
from switchyard.llm.prefix_trie import PREFIX_TRIE_SQL, op11_prefix_trie
from switchyard.llm.quality import op1_quality
from switchyard.llm.repair import op12_conversation_repair, repair_sql
from switchyard.llm.simhash import op6_simhash
from switchyard.llm.token_counts import OP3_SQL, op3_token_counts
from switchyard.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_media": op4_media,
    "op5_licenses": op5_licenses,
    "op6_simhash": op6_simhash,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_fingerprints": op13_fingerprints,
    "license_notices": license_notices,  # op 5 with short forms and further licenses
    "embedding_dedup_planted": embedding_dedup_planted,  # op 7 where there are links to find
}

#: Learned scores (1, 2, 9), stored files (4), XXH64 prints (6, 13), and greedy plans (8) are tested otherwise.
ORACLE_SQL = {"op7_embedding_dedup": links_sql(), "embedding_dedup_planted": PLANTED_SQL, "op3_token_counts": OP3_SQL, "op5_licenses": licenses_sql(), "license_notices": notices_sql(), "op10_mixing": mixing_sql(), "op11_prefix_trie": PREFIX_TRIE_SQL, "op12_conversation_repair": repair_sql()}
