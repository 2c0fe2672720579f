"""Queries of the corpus operators and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from radiolake.llm.importance import OP11_SQL, op11_importance_resampling
from radiolake.llm.linededup import OP2_SQL, op2_line_chunks
from radiolake.llm.media import op7_image_copies
from radiolake.llm.mixing import op4_source_mix
from radiolake.llm.pieces import op8_nbest_pieces
from radiolake.llm.pii import op5_bootstrapped_pii
from radiolake.llm.quality import op6_pu_quality
from radiolake.llm.recurrent import op13_recurrent_scores
from radiolake.llm.rules import op9_divergence_rules
from radiolake.llm.sharding import op3_feistel_sharding
from radiolake.llm.simhash import op10_simhash_bktree
from radiolake.llm.warc import op1_warc
from radiolake.llm.whitening import op12_embedding_whitening

QUERIES = {
    "op1_warc": op1_warc,
    "op2_line_chunks": op2_line_chunks,
    "op3_feistel_sharding": op3_feistel_sharding,
    "op4_source_mix": op4_source_mix,
    "op5_bootstrapped_pii": op5_bootstrapped_pii,
    "op6_pu_quality": op6_pu_quality,
    "op7_image_copies": op7_image_copies,
    "op8_nbest_pieces": op8_nbest_pieces,
    "op9_divergence_rules": op9_divergence_rules,
    "op10_simhash_bktree": op10_simhash_bktree,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_recurrent_scores": op13_recurrent_scores,
}

OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((
      (instr('0123456789abcdef', substr(h, CAST((5 * k) // 4 + 1 AS INTEGER), 1)) - 1) * 16
      + instr('0123456789abcdef', substr(h, CAST((5 * k) // 4 + 2 AS INTEGER), 1)) - 1)
      >> CAST(3 - (5 * k) % 4 AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

ORACLE_SQL = {
    "op1_warc": OP1_SQL,
    "op2_line_chunks": OP2_SQL,
    "op11_importance_resampling": OP11_SQL,
}
