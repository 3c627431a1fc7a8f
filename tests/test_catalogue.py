"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quern.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


#: Answers that are written out for the larger tables.
SIZED = {"profile_types", "monitor_performance", "contract_missing_clause", "ml_linear"}


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - SIZED))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toArrow()
    duck.register("got", got)
    duck.execute(f"CREATE OR REPLACE TEMP TABLE want AS {ORACLE_SQL[name]}")
    types = {r[0]: r[1] for r in duck.execute("DESCRIBE want").fetchall()}
    assert types == {r[0]: r[1] for r in duck.execute("DESCRIBE SELECT * FROM got").fetchall()}
    cols = ", ".join(f'"{c}"' for c in sorted(types))
    left = duck.execute(f"SELECT {cols} FROM want EXCEPT ALL SELECT {cols} FROM got").fetchall()
    right = duck.execute(f"SELECT {cols} FROM got EXCEPT ALL SELECT {cols} FROM want").fetchall()
    assert (left[:3], right[:3]) == ([], [])


@pytest.mark.parametrize("name", ["dq_isolation", "eval_bootstrap", "ts_compare", "rel_agg_approx", "drift_ceiling"])
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
