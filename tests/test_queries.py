"""Every query with a check agrees with it; the others give rows of a stable shape."""

import pytest

import __spark_entry__ as entry
from conftest import SF
from tools.check import sorted_rows

CHECKS = entry.oracle_sql()
QUERIES = entry.queries()
ROWS_ONLY = ["score_with_defaults", "vif_prune", "nested_spec_trace"]


@pytest.mark.parametrize("name", list(CHECKS))
def test_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(CHECKS[name])
    want = sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    assert sorted_rows(df.columns, df.collect()) == want


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_projection_round_trip_and_origin(spark):
    from pyspark.sql import functions as F

    from estatelens.functions import geo

    rows = QUERIES["project_svy21"](spark, SF).agg(F.max(F.abs("lat_error")), F.max(F.abs("lon_error"))).first()
    assert rows[0] == 0 and rows[1] == 0
    x, y = geo.to_svy21(F.lit(geo.ORIGIN_LAT), F.lit(geo.ORIGIN_LON))
    at = spark.range(1).select(x, y).first()
    assert abs(at[0] - geo.FALSE_EASTING) < 1e-6 and abs(at[1] - geo.FALSE_NORTHING) < 1e-6
