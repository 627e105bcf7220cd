"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat import OP4_SQL, op4_chat
from .embed_dedup import OP8_SQL, op8_embeddings
from .filter_audit import OP11_SQL, op11_filter_audit
from .fingerprint import op1_fingerprint
from .host_rules import OP13_SQL, op13_host_rules
from .langid import op9_langid
from .packing import op2_packing
from .quality import op5_quality
from .repair import OP12_SQL, op12_repair
from .simhash import op3_simhash
from .sp_sampling import op10_sp_sampling
from .token_files import op6_token_files
from .toxicity import op7_toxicity

QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_chat": op4_chat,
    "op5_quality": op5_quality,
    "op6_token_files": op6_token_files,
    "op7_toxicity": op7_toxicity,
    "op8_embeddings": op8_embeddings,
    "op9_langid": op9_langid,
    "op10_sp_sampling": op10_sp_sampling,
    "op11_filter_audit": op11_filter_audit,
    "op12_repair": op12_repair,
    "op13_host_rules": op13_host_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat": OP4_SQL,
    "op8_embeddings": OP8_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_repair": OP12_SQL,
    "op13_host_rules": OP13_SQL,
}
