"""Every registered query against its oracle SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import verify
from clauselake.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return verify.connect(FOLDER)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_query_matches_oracle(spark, con, key):
    status, note = verify.compare(spark, con, FOLDER, key, entry.oracle_sql())
    assert status == "ok", note
