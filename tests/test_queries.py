"""Some registered queries against their SQL on the smallest tables; the driver's check runs all of them."""

import duckdb
import pytest

from loomgraph import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", ["scan_files_full", "scan_files_api", "scan_jar_entries", "scan_directories", "edit_union", "rule_report", "text_of_tree", "somecycles_exact", "shortest_path_orders"])
def test_query(spark, tables, name):
    df = queries.QUERIES[name](spark, SF)
    relation = tables.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    at = [relation.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=str)
