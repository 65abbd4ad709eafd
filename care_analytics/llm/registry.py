"""Registered queries of the operators: ``QUERIES`` and, where SQL can say it, ``SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from care_analytics.llm.queries import ann, audit, bpe, chat, decontaminate, exact, language, lexical, licenses, line_dedup, pii, simhash, warc

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = [chat, warc, language, line_dedup, decontaminate, simhash, bpe, exact, licenses, pii, ann, audit, lexical]

QUERIES: dict[str, Query] = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL: dict[str, str] = {name: q for m in _MODULES for name, q in m.SQL.items()}
