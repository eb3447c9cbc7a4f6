"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import workload  # noqa: E402
from tools.check import compare, connect  # noqa: E402

workload.load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query_equals_sql(spark, duck, name):
    verdict = compare(spark, duck, SF, name, workload.QUERIES[name], workload.ORACLES[name])
    assert verdict.startswith(("ok", "EMPTY"))


def test_every_query_has_sql():
    assert set(workload.QUERIES) == set(workload.ORACLES)
