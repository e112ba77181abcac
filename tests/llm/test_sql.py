"""Training data queries against their SQL on the given tables, and the shares that the splits reach."""

import pytest

from stepwright.llm import queries

from ..conftest import DATA
from ..test_queries import duck, rows_of  # noqa: F401

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    df = queries.queries()[name](spark, DATA)
    r = duck.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = [dict(zip(names, x)) for x in r.fetchall()]
    assert rows_of(sorted(names), df.collect()) == rows_of(sorted(names), want)


def test_split_shares_on_the_given_tables(spark):
    rows = queries.p2_shares(spark, DATA.replace("0.001", "0.01")).collect()
    whole = {r["split"]: r for r in rows if r["overall"]}
    total = sum(r["n"] for r in whole.values())
    assert total > 100 and all(abs(r["reached_share"] - r["target_share"]) <= 0.03 for r in whole.values())
    off = sum(abs(r["n"] - r["target_share"] * total_of) for r in rows if not r["overall"] for total_of in [sum(x["n"] for x in rows if not x["overall"] and x["class"] == r["class"])])
    assert off <= 0.25 * total
