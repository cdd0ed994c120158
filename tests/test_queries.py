"""Every registered query against its SQL on the smallest driver tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from docloom.plans.oracles import ORACLES  # noqa: E402
from docloom.plans.queries import QUERIES  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def database():
    import check_oracles

    return check_oracles.database(str(DATA))


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries()) and set(QUERIES) == set(ORACLES)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 40 and max(r["matched_pages"] for r in rows) > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, database, name):
    import check_oracles

    assert check_oracles.compare(spark, database, str(DATA), name).startswith("ok")
