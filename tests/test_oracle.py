"""Every value-checkable query equals its independent DuckDB SQL (sf0.001)."""
import pytest

import __spark_entry__ as E
from conftest import SF_TINY
from helpers import norm, rows_of, same_rows

ORACLE = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    con = duck(SF_TINY)
    s_rows, s_cols = rows_of(E.queries()[name](spark, SF_TINY))
    res = con.execute(ORACLE[name])
    d_cols = [d[0] for d in res.description]
    d_rows = [tuple(norm(x) for x in r) for r in res.fetchall()]
    assert len(s_rows) == len(d_rows)
    assert same_rows(s_rows, s_cols, d_rows, d_cols)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 6
    assert {"target", "u_stat", "z", "p_value", "p_adjusted", "significant"} <= set(df.columns)
