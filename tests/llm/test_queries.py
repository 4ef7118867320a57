"""Queries of this part against their SQL."""

import os

import pytest

from funclab.llm.queries import ORACLE, QUERIES
from suite.compare import compare, connect

SF = os.environ.get("FUNCLAB_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLE[name], SF) is None
