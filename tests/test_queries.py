"""Every storage-analytics query against its SQL oracle, on the smallest tables."""

import json
import math
from pathlib import Path

import duckdb
import pytest

from shelfmark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value


def rows_of(table):
    names = sorted(table.column_names)
    return names, sorted(json.dumps([plain(r[n]) for n in names], default=str) for r in table.to_pylist())


@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_query_matches_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toArrow()
    assert rows_of(got) == rows_of(duck.execute(catalog.oracle_sql()[name]).to_arrow_table())


def test_entry_module_serves_all_catalog_queries():
    import __spark_entry__

    assert catalog.queries().keys() <= __spark_entry__.queries().keys()
    assert catalog.FLAGSHIP in __spark_entry__.oracle_sql()
