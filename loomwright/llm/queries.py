"""Queries of the training-data problems, with their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from loomwright.registry import Registry

LLM = Registry()

from loomwright.llm import queries_records, queries_text  # noqa: E402, F401
