"""Every registered query of the engine against its SQL twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quillon.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    tidy = lambda v: round(float(v), 6) if isinstance(v, float) or hasattr(v, "dtype") else v
    return sorted((tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else tidy(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, small, name):
    mine = catalog.queries()[name](spark, small).toPandas()
    twin = con.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(twin.columns)
    assert rows(mine) == rows(twin)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, small, name):
    assert catalog.queries()[name](spark, small).count() >= 0


def test_entry(spark, small):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"qid", "cid", "rank", "score", "confidence"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_engine_does_not_need_its_optional_part():
    root = Path(catalog.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quillon.llm" not in p.read_text()
