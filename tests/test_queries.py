"""Every registered query of the inventory against its SQL."""

import pytest
from oracle import difference

from cipherscape.plans import queries


def test_each_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf_dir, name):
    assert difference(spark, queries.queries()[name], queries.oracle_sql()[name], sf_dir) is None


def test_the_comparison_notices_a_wrong_query(spark, sf_dir):
    wrong = queries.oracle_sql()["role_classification"].replace("'HASH' THEN 'HASH'", "'HASH' THEN 'UNKNOWN'", 1)
    assert difference(spark, queries.queries()["role_classification"], wrong, sf_dir) is not None


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and {r.algorithm for r in rows} >= {"RSA", "AES", "ECDH"}
