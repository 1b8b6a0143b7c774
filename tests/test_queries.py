"""Every registered query of the core against its SQL, over the smallest tables; those without SQL must run."""

import importlib
import pathlib

import pytest

from tests.verify import compare

FOLDER = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(f"shoebox.plans.{m}") for m in ("orphans", "records", "retrieval", "files")]
QUERIES = {n: (q, m.SQL.get(n)) for m in MODULES for n, q in m.QUERIES.items()}


@pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test data")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    ok, said = compare(spark, FOLDER, *QUERIES[name])
    assert ok, said


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
