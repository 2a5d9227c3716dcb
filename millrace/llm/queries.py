"""Queries of this subpackage and their SQL."""

from millrace.llm import (
    bpe,
    chat,
    conversation_repair,
    decontamination,
    hard_negatives,
    language_id,
    licenses,
    line_dedup,
    near_dedup,
    quality,
    secrets,
    substring_dedup,
    topk,
)

MODULES = (
    secrets,
    decontamination,
    topk,
    bpe,
    chat,
    substring_dedup,
    quality,
    licenses,
    near_dedup,
    language_id,
    hard_negatives,
    conversation_repair,
    line_dedup,
)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
