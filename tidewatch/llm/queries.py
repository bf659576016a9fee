"""The registered queries of this folder, and DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, embed_dedup, middle, pii, secret_scan, sharding
from .bpe import op2_bpe
from .chat import op13_chat_format
from .collocations import op11_collocations
from .decontaminate import op6_decontaminate
from .embed_dedup import op4_embed_dedup
from .language import op5_language_id
from .middle import op12_fill_in_middle
from .pii import op1_pii
from .secret_scan import op9_secrets
from .sharding import op10_sharding
from .simhash import op7_simhash
from .token_store import op3_token_files
from .toxicity import op8_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_bpe": op2_bpe,
    "op3_token_files": op3_token_files,
    "op4_embed_dedup": op4_embed_dedup,
    "op5_language_id": op5_language_id,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_secrets": op9_secrets,
    "op10_sharding": op10_sharding,
    "op11_collocations": op11_collocations,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_chat_format": op13_chat_format,
}

ORACLES: dict[str, str] = {
    "op1_pii": pii.ORACLE,
    "op4_embed_dedup": embed_dedup.ORACLE,
    "op9_secrets": secret_scan.ORACLE,
    "op10_sharding": sharding.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_fill_in_middle": middle.ORACLE,
    "op13_chat_format": chat.ORACLE,
}
