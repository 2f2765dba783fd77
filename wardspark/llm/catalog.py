"""Every query of this package and its SQL."""

from __future__ import annotations

from wardspark.llm import (q_divergence, q_fingerprint, q_jaccard, q_language, q_mixing, q_pieces, q_prefixtrie,
                           q_quality, q_secrets, q_substring, q_topk, q_toxicity, q_warc)

_MODULES = (q_jaccard, q_topk, q_mixing, q_language, q_warc, q_secrets, q_fingerprint, q_pieces, q_toxicity, q_quality,
            q_substring, q_prefixtrie, q_divergence)


def queries():
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
