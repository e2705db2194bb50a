import duckdb
import pytest

from loomwright.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "benchmark", "conversations")


def shown(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_sql(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = got.select(columns).collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalogue.ORACLES[name])
    assert columns == sorted(want.columns)
    assert shown(rows) == shown(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
