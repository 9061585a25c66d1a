"""Every registered query against its DuckDB oracle on the smallest scale factor."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, digest  # noqa: E402

from conftest import SF_CHECK, SF_SMALL  # noqa: E402

#: These fit models, and the smallest tables leave no complete feature row to fit on.
FITTED = {"fc7_normal_equations", "fc8_forest_within_range", "fc9_boosting_fits", "fc10_subsampled_boosting_fits",
          "fc10_leaf_sums", "fc13_stack_of_out_of_fold", "fc14_every_model_ok", "api2_forecast_rows", "snk4_reloaded_run"}

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.fixture(scope="module")
def cons():
    return {sf: connect(sf) for sf in (SF_SMALL, SF_CHECK)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, cons, name):
    sf = SF_CHECK if name in FITTED else SF_SMALL
    got = digest(QUERIES[name](spark, sf).toPandas())
    exp = digest(cons[sf].sql(ORACLES[name]).df())
    assert got == exp


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["city", "date", "demand_pct_change"]
    assert df.count() >= 0
