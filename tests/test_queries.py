"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from dispatchtext import registry

SF = "/root/testdata/sf0.001"


def rows(records, columns):
    def clean(v):
        if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
            v = float(v)
            return None if math.isnan(v) else round(v, 9)
        return v

    return sorted((tuple(clean(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, name):
    got = registry.queries()[name](spark, SF)
    got_rows = rows([tuple(r) for r in got.collect()], got.columns)
    sql = registry.oracle_sql().get(name)
    assert got_rows
    if sql:
        db = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            db.execute(f"create view {p.stem} as select * from '{p}'")
        cur = db.execute(sql)
        want_cols = [d[0] for d in cur.description]
        assert sorted(want_cols) == sorted(got.columns)
        assert got_rows == rows(cur.fetchall(), want_cols)
