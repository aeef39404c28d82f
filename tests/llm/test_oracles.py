from __future__ import annotations

import pytest

from scoremon.llm import queries
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [
    "op7_suffix_array_dedup", "op8_tool_call_linking", "op9_ngram_jaccard_join", "op10_benchmark_decontamination",
])
def test_query_matches_sql(spark, name):
    ok, note = compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])
    assert ok, note
