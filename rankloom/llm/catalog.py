"""Importing this module registers the queries of the operators."""

from rankloom.llm import (  # noqa: F401
    op1_decontamination,
    op2_sharding,
    op10_mixing,
    op11_periodic_runs,
    op12_resampling,
    op13_substrings,
    op3_chat,
    op4_html,
    op5_near_duplicates,
    op6_language_id,
    op7_secrets,
    op8_quality,
    op9_url_filter,
)
from rankloom.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
