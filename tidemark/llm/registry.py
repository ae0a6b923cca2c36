"""Queries of this subpackage and their SQL, as the entry module registers them."""

from __future__ import annotations

from .bit_sliced import OP6_SQL, op6_bit_sliced_top_k
from .byte_bpe import op9_duckdb_byte_bpe
from .conversations import OP11_SQL, op11_conversation_repair
from .hard_negatives import OP13_SQL, op13_shared_list_negatives
from .language_model import op12_attention_scores
from .minhash import OP1_SQL, op1_minhash_near_dedup
from .packing import op4_min_slack_packing
from .pii import OP3_SQL, op3_disclosure_pii
from .quality_classifier import op5_ftrl_quality
from .quality_rules import OP10_SQL, op10_quality_ledger
from .sharding import OP2_SQL, op2_jump_sharding
from .toxicity import op8_noisy_channel_toxicity
from .warc import OP7_SQL, op7_zip_warc

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_jump_sharding": op2_jump_sharding,
    "op3_disclosure_pii": op3_disclosure_pii,
    "op4_min_slack_packing": op4_min_slack_packing,
    "op5_ftrl_quality": op5_ftrl_quality,
    "op6_bit_sliced_top_k": op6_bit_sliced_top_k,
    "op7_zip_warc": op7_zip_warc,
    "op8_noisy_channel_toxicity": op8_noisy_channel_toxicity,
    "op9_duckdb_byte_bpe": op9_duckdb_byte_bpe,
    "op10_quality_ledger": op10_quality_ledger,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_attention_scores": op12_attention_scores,
    "op13_shared_list_negatives": op13_shared_list_negatives,
}
ORACLE_SQL = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op2_jump_sharding": OP2_SQL,
    "op3_disclosure_pii": OP3_SQL,
    "op6_bit_sliced_top_k": OP6_SQL,
    "op7_zip_warc": OP7_SQL,
    "op10_quality_ledger": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op13_shared_list_negatives": OP13_SQL,
}
