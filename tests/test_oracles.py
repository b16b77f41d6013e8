"""Every core query against its SQL."""

from __future__ import annotations

import pytest

from strandvote.oracles import ORACLE_SQL
from strandvote.queries import QUERIES
from tests.helpers import assert_same


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"tm_score_searched"}  # a search, see test_tm_search.py


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, duck, name):
    assert_same(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df())
