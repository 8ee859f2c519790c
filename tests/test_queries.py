import os
import re

import duckdb
import pytest

from ebbtide import queries

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_against_sql(spark, con, name):
    df = queries.queries()[name](spark, D)
    got = sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)
    if (sql := queries.oracle_sql().get(name)) is None:
        assert got
        return
    out = con.execute(sql)
    names = [x[0] for x in out.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted((tuple(r[i] for i in order) for r in out.fetchall()), key=str)
    assert sorted(names) == sorted(df.columns) and got == want


def test_only_what_sql_cannot_say_is_without():
    assert set(queries.queries()) - set(queries.oracle_sql()) == set()


def test_entry_without_the_other_package(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 15
    assert set(queries.queries()) <= set(e.queries())


def test_nothing_else_imports_it():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "ebbtide")
    for at, dirs, files in os.walk(root):
        dirs[:] = [x for x in dirs if x != "llm"]
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"ebbtide\.llm|from ebbtide import .*llm", open(os.path.join(at, f)).read())
