"""Every registered query against its SQL twin, and the driver contract."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from rollframe.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ONLY_ROWS: set[str] = set()  # every query has its SQL


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    assert compare(spark, con, SF, key) is None


def test_contract(spark):
    assert set(QUERIES) - set(ORACLES) == ONLY_ROWS
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["group_idx", "traj_idx", "turns", "trajectory_score", "advantage"]


def test_inventory_is_covered():
    counts = {"SRC": 9, "SNK": 4, "PRJ": 37, "JOIN": 19, "TRJ": 30, "GRP": 8, "PAR": 3, "EVA": 13, "FAI": 4, "STA": 21, "FIN": 13,
              "SPA": 27, "RES": 7, "SRT": 5, "SET": 6, "STR": 6, "EXT": 5}
    want = {f"{k}{i}" for k, n in counts.items() for i in range(1, n + 1)}
    assert want <= set(entry.queries())
