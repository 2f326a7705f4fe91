"""The core stands without the llm subpackage."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_llm():
    for p in (ROOT / "loomwright").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"loomwright\.llm|from \.llm|import llm", p.read_text()), p


def test_entry_lists_core_queries():
    import __spark_entry__ as entry

    assert {"p1_found", "p4_found", "p7_found"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
