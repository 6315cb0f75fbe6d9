"""How many leaders a node of any size is compared with."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinloom.llm import jaccard_join


@pytest.mark.parametrize("n", [60, 100, 195, 290, 1000])
def test_nodes_meet_about_as_many_leaders_as_stated(spark, n):
    groups = spark.range(n // 5 + 1).withColumnRenamed("id", "token").crossJoin(spark.range(200)).select("token", "id", F.lit(n).alias("n"), F.col("id").alias("component"))
    met = jaccard_join.led(groups, 0).count() / 200
    assert min(n // 5, 8) <= met <= min(n // 5 + 1, 1.5 * jaccard_join.LEADERS)
