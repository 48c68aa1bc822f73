import pytest
from pyspark.sql import functions as F

from tidemark.functions import round_to


@pytest.mark.parametrize("value, digits, want", [
    (2.5, 0, 3.0), (-2.5, 0, -3.0), (-2.4, 0, -2.0), (-0.125, 2, -0.13), (0.125, 2, 0.13),
    (-7.0, 1, -7.0), (-0.001, 2, 0.0), (None, 1, None),
])
def test_ties_go_away_from_zero(spark, value, digits, want):
    row = spark.createDataFrame([(value,)], "v double").select(
        round_to(F.col("v"), digits).alias("r")).first()
    assert row["r"] == want
