"""The operators' queries: against DuckDB where SQL can express them, whole results otherwise."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from compare import rows_of, sql_rows

from emberline.llm.entries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    names, rows = rows_of(QUERIES[name](spark, sf_dir))
    want_names, want = sql_rows(sf_dir, ORACLE_SQL[name])
    assert names == want_names
    assert rows == want


def test_there_is_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES if n != "pipeline") == list(range(1, 11))
    assert "pipeline" in QUERIES


@pytest.mark.parametrize("name", ["op1_quality_classifier", "op3_packing", "op5_quality_rules", "op8_token_counts"])
def test_every_document_is_in_the_result(spark, sf_dir, name):
    docs = {r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in QUERIES[name](spark, sf_dir).collect()} == docs


def test_nothing_else_imports_the_package():
    root = Path(__file__).resolve().parent.parent.parent
    for p in (root / "emberline").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "emberline.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
