"""The queries of this subpackage against their SQL on a small table."""

from __future__ import annotations

import pytest
from check import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", ["op1_decontaminate", "op2_host_reputation", "op3_ngram_jaccard", "op4_secrets", "op7_embedding_dedup", "op8_warc", "op11_personal_data", "op13_merkle_manifest"])
def test_query_equals_sql(spark, con, key):
    assert compare(entry.queries()[key](spark, SF), con, entry.oracle_sql()[key]) is None


def test_all_operators_and_the_pipeline_are_registered():
    names = set(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
