"""Every analytics query with a SQL twin gives the twin's rows."""

import datetime
import math

import duckdb
import pytest

from tesserix.plans import registry
from tesserix.sources import TABLES

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    if name in registry.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        cur = con.execute(registry.ORACLES[name])
        assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_tables_are_whitelisted(spark):
    from tesserix.sources import table

    with pytest.raises(ValueError):
        table(spark, SF, "secrets")
