"""Every registered query reads the given tables (or files Spark wrote from
them), so its work grows with the data."""

from __future__ import annotations

import pytest

from learnlens.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_reads_files(spark, name):
    files = QUERIES[name](spark, SF).inputFiles()
    assert files, name
    assert any("/root/testdata/" in f or "learnlens" in f for f in files), files[:3]
