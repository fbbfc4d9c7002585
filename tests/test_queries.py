"""Every query of the library against its SQL on DuckDB, over the same small tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from lodegraph.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, dict):
        return plain(list(v.values()))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str(v)


#: Closures over whole tables: no SQL, or too slow in it; tested by brute force in test_records.py, test_event_merge.py, test_people.py, test_titles.py and test_vector_index.py.
WITHOUT_SQL = {"er_components", "executive_titles", "event_merge_groups", "event_merge_timelines", "person_merge", "vector_index_topk"}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - WITHOUT_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted([plain(r[names.index(c)]) for c in columns] for r in result.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.queries()) - WITHOUT_SQL == set(catalogue.oracle_sql())


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
