from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from hubloom.functions.calendar import seasonal_terms, week_start, weeks_since
from hubloom.functions.draws import hash32, hash_unit
from hubloom.functions.geo import haversine_km
from hubloom.functions.numeric import non_negative, round_half_up, saving_pct
from hubloom.operators.costs import unit_cost


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_haversine_between_two_known_cities(spark):
    km = value(spark, haversine_km(*[F.lit(x) for x in (-23.55, -46.63, -22.91, -43.17)]))
    assert 330 < km < 390


def test_haversine_of_antipodes_is_half_the_circumference(spark):
    km = value(spark, haversine_km(*[F.lit(x) for x in (0.0, 0.0, 0.0, 180.0)]))
    assert km == pytest.approx(np.pi * 6371.0)


def test_unit_cost_grows_with_distance(spark):
    near, far = (value(spark, unit_cost(F.lit(14.3), F.lit(0.0105), F.lit(km))) for km in (100.0, 500.0))
    assert far > near


@pytest.mark.parametrize("ts, monday", [
    (datetime(2018, 8, 19, 23, 0), date(2018, 8, 13)),
    (datetime(2018, 8, 20, 0, 0), date(2018, 8, 20)),
    (datetime(2017, 1, 1, 12, 0), date(2016, 12, 26)),
])
def test_weeks_start_on_monday(spark, ts, monday):
    assert value(spark, week_start(F.lit(ts))) == monday
    assert value(spark, week_start(F.lit(ts).cast("timestamp_ntz"))) == monday


def test_seasonal_terms_use_the_iso_week(spark):
    terms = seasonal_terms(F.lit(date(2020, 12, 28)))  # ISO week 53
    assert list(terms) == ["sin1", "cos1", "sin2", "cos2"]
    assert value(spark, terms["sin1"]) == pytest.approx(np.sin(2 * np.pi * 53 / 52))
    assert value(spark, terms["cos2"]) == pytest.approx(np.cos(4 * np.pi * 53 / 52))
    assert value(spark, weeks_since(F.lit(date(2020, 1, 20)), F.lit(date(2020, 1, 6)))) == 2.0


def test_hash_draws_are_fixed(spark):
    key = [F.lit(7), F.lit(3), F.lit("BA"), F.lit("home")]
    assert value(spark, hash32(*key)) == 596932784
    assert value(spark, hash_unit(*key)) == 596932784 / 2 ** 32


def test_rounding_and_savings(spark):
    assert value(spark, round_half_up(F.lit(2.5), 0)) == 3.0
    assert value(spark, round_half_up(F.lit(0.12349), 3)) == 0.123
    assert value(spark, non_negative(F.lit(-2.0))) == 0.0
    assert value(spark, saving_pct(F.lit(200.0), F.lit(150.0))) == 25.0
    assert value(spark, saving_pct(F.lit(0.0), F.lit(0.0))) is None
