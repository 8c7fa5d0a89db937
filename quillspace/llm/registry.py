"""The training-data queries and their SQL."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat_formatting
from .decontam import op7_decontamination
from .packing import op8_sum_of_squares_packing
from .quality import OP1_SQL, op1_quality_rules
from .sharding import op2_sharding
from .suffix import op9_suffix_array_dedup
from .tokenfile import op10_token_files
from .simhash import op3_simhash
from .toxicity import op6_toxicity
from .warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_sum_of_squares_packing": op8_sum_of_squares_packing,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_token_files": op10_token_files,
}
SQL = {"op1_quality_rules": OP1_SQL, "op4_warc": OP4_SQL, "op5_chat_formatting": OP5_SQL}
