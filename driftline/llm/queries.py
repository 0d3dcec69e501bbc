"""Queries of the text operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .decontamination import OP9_SQL, op9_decontamination
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .language import op6_language
from .line_dedup import OP10_SQL, op10_line_dedup
from .near_duplicates import OP3_SQL, op3_near_duplicates
from .packing import op4_packing
from .passages import op7_passages
from .private_data import op2_private_data
from .quality_model import op1_quality_model
from .quality_rules import OP8_SQL, op8_quality_rules
from .token_alignment import op11_token_alignment
from .toxicity import op5_toxicity
from .url_filters import OP12_SQL, op12_url_filters

QUERIES = {
    "op1_quality_model": op1_quality_model,
    "op2_private_data": op2_private_data,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_passages": op7_passages,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_url_filters": op12_url_filters,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {"op3_near_duplicates": OP3_SQL, "op8_quality_rules": OP8_SQL, "op9_decontamination": OP9_SQL, "op10_line_dedup": OP10_SQL, "op12_url_filters": OP12_SQL, "op13_hard_negatives": OP13_SQL}
