"""Every query of the catalogue that has SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import os

import duckdb
import pytest
from emulsion.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(frame):
    names = sorted(frame.columns)
    clean = frame[names].astype(object).where(frame[names].notna(), None)
    show = lambda v: v if v is None or isinstance(v, str) else round(float(v), 7) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, (int, bool)) or hasattr(v, "__index__") else str(v)
    return names, sorted((tuple(show(v) for v in r) for r in clean.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    got, want = rows(catalog.QUERIES[name](spark, sf).toPandas()), rows(duck.sql(catalog.ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_others_give_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry_module_without_the_corpus_operators(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
    assert os.path.exists(__spark_entry__.__file__)
