"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from .decontam import op1_spaced_seed_leaks
from .linededup import op10_segment_line_dedup
from .quality import op4_fourier_quality
from .sentencepiece import op7_maxplus_sentencepiece
from .sharding import op5_feistel_shards
from .simhash import op9_golay_simhash
from .spotsigs import op8_spotsigs
from .tokenstore import op2_token_store
from .toxicity import op3_subword_toxicity
from .unigram import op6_trie_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_spaced_seed_leaks, op2_token_store, op3_subword_toxicity, op4_fourier_quality, op5_feistel_shards,
        op6_trie_token_counts, op7_maxplus_sentencepiece, op8_spotsigs, op9_golay_simhash, op10_segment_line_dedup,
    )
}

#: Hashes (XXH64 seeds, CRC-32), trained models and tokenizers are not in the SQL of the oracle.
ORACLES: dict[str, str] = {}
