"""Every registered query against its DuckDB oracle on the smallest driver tables, and
the driver entry point."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from threadlake.plans.catalog import load_all
from tools.check_oracle import TABLES, rows_of

# The library's own queries; the optional corpus operators have tests of their own.
QUERIES = {k: v for k, v in E.queries().items() if k in load_all()}
ORACLE = E.oracle_sql()
# The media-scan oracle reads the sf0.01 folder itself (the driver's check scale).
SF_FIXED = dict.fromkeys(("scan_media", "scan_again"), "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    cons = {}

    def get(sf):
        if sf not in cons:
            con = duckdb.connect()
            for t in TABLES:
                con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
            cons[sf] = con
        return cons[sf]
    return get


def test_every_query_has_an_oracle():
    missing = sorted(set(QUERIES) - set(ORACLE))
    assert missing == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sf = SF_FIXED.get(name, SF_SMALL)
    df = QUERIES[name](spark, sf)
    srows = [tuple(r) for r in df.collect()]
    res = duck(sf).execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, srows) == rows_of(dcols, res.fetchall())


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["cand_id", "ext", "size_mb", "md5_b64", "n_copies", "first_path", "is_new"]
