"""All queries of this subpackage, by name, and their DuckDB SQL."""

from __future__ import annotations

import importlib

from pagelake.llm import common

MODULES = ["archives", "bpe", "exact_dedup", "licenses", "line_dedup", "merkle", "mixing", "ngram_join", "periodic",
           "pseudonyms", "quality", "substrings", "toxicity"]

for _m in MODULES:
    importlib.import_module(f"pagelake.llm.{_m}")

QUERIES, ORACLE = common.QUERIES, common.ORACLE
