import pytest

import __spark_entry__ as entry
from registry.oracles import ORACLES
from registry.queries import QUERIES
from tests.compare import connect, differences

SF_DIR = entry.ENTRY_DIR


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert differences(got, want) is None


def test_no_training_word_is_unknown_and_no_id_is_outside(spark):
    """The vocabulary holds every word, and masked training draws from it alone."""
    ids = [int(i) for r in QUERIES["encode_tokens"](spark, SF_DIR).collect() for i in r.ids.split()]
    assert 1 not in ids
    masked = [int(i) for r in QUERIES["mlm_mask"](spark, SF_DIR).collect() for i in r.input_ids.split()]
    assert max(masked) <= max(ids) == len(set(ids)) + 2  # start, end, and words from 5 on
