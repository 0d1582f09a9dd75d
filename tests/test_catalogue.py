"""Every query of the catalogue against the same in SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from gridloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(rows, columns):
    def text(v):
        if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
            return "<null>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return repr(round(float(v), 6))
        return str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(text(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            out.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_same_as_sql(spark, sf_dir, con, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    cursor = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.collect(), df.columns) == plain(cursor.fetchall(), columns)
