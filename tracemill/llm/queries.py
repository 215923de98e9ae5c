"""Registered queries of the training-data operators."""

from .op1_topk import op1_topk
from .op2_token_counts import op2_token_counts
from .op3_bpe_chunks import op3_bpe_chunks
from .op4_quality import op4_quality
from .op5_mix import op5_mix
from .op6_minhash import op6_minhash
from .op7_shards import op7_shards
from .op8_suffix_dedup import op8_suffix_dedup
from .op9_pii import op9_pii
from .op10_token_files import op10_token_files
from .op11_merkle import op11_merkle
from .op12_embedding_join import SQL as op12_sql
from .op12_embedding_join import op12_embedding_join
from .op13_conversation_repair import op13_conversation_repair

QUERIES = {f.__name__: f for f in (op1_topk, op2_token_counts, op3_bpe_chunks, op4_quality, op5_mix, op6_minhash, op7_shards, op8_suffix_dedup, op9_pii, op10_token_files, op11_merkle, op12_embedding_join, op13_conversation_repair)}
ORACLES: dict[str, str] = {"op12_embedding_join": op12_sql}
