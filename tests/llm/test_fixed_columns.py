"""The operators' fixed columns against SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import compare  # noqa: E402

from tidemark.llm.queries import LLM_ORACLES, LLM_QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_fixed_columns(spark, sf, name):
    assert compare(spark, sf, LLM_QUERIES[name], LLM_ORACLES[name]) > 0
