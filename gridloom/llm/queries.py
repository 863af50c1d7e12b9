"""The training-data queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES = ("op1_embeddings", "op2_bpe", "op3_licenses", "op4_jaccard", "op5_token_store", "op6_substrings", "op7_lines", "op8_pii", "op9_quality", "op10_decontaminate")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"gridloom.llm.{name}"), name) for name in _QUERIES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"gridloom.llm.{name}"), "ORACLE_SQL", None) for name in _QUERIES}
    return {name: sql for name, sql in found.items() if sql}
