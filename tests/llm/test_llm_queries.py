"""Every query for training data against its SQL, over the smallest tables; those without SQL must run."""

import pathlib

import pytest

from shoebox.llm.queries import MODULES
from tests.verify import compare

FOLDER = "/root/testdata/sf0.001"
QUERIES = {n: (q, m.SQL.get(n)) for m in MODULES for n, q in m.QUERIES.items()}


@pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test data")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    ok, said = compare(spark, FOLDER, *QUERIES[name])
    assert ok, said
