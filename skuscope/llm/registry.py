"""Queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

import corpus_pipeline

from .bpe_transducer import op1_byte_bpe
from .chat_format import op2_chat_format
from .embedding_dedup import op10_embedding_dedup
from .language_id import op5_language_id
from .lexical_search import SQL as SEARCH_SQL
from .lexical_search import op12_lexical_search
from .line_dedup import op6_line_dedup
from .ngram_jaccard import op3_ngram_jaccard
from .packing import op8_packing
from .simhash import op4_simhash
from .suffix_dedup import SQL as SUFFIX_SQL
from .suffix_dedup import op11_suffix_dedup
from .token_counts import op9_token_counts
from .token_shards import op7_token_shards
from .vector_codes import SQL as CODES_SQL
from .vector_codes import op13_vector_codes


def queries() -> dict:
    found = (op1_byte_bpe, op2_chat_format, op3_ngram_jaccard, op4_simhash, op5_language_id, op6_line_dedup, op7_token_shards, op8_packing, op9_token_counts, op10_embedding_dedup, op11_suffix_dedup, op12_lexical_search, op13_vector_codes)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


#: Every turn and digest is plain text work, which SQL can state; the other operators
#: (tokenizers, learnt models, exact set joins at this size) are tested by brute force.
CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), f AS (
  SELECT *, replace(replace(text, '\', '\b'), '<', '\l') AS body,
         replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'), chr(10), '\n') AS head
  FROM t
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(6 + length(head) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": CHAT_SQL, "op11_suffix_dedup": SUFFIX_SQL, "op12_lexical_search": SEARCH_SQL, "op13_vector_codes": CODES_SQL}
