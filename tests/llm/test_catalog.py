"""Every registered query of the subpackage runs, and agrees with its SQL twin where it has one."""

from pathlib import Path

import duckdb
import pytest

from quillon.llm import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, name):
    mine = catalog.queries()[name](spark, small).toPandas()
    if name not in SQL:
        return
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    twin = con.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(twin.columns)
    columns = sorted(mine.columns)
    tidy = lambda f: sorted(map(tuple, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False)), key=repr)
    assert tidy(mine) == tidy(twin)
