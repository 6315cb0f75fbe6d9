"""The tables of candidate pairs: their plan, and their rows against the SQL."""

from __future__ import annotations

import re
from collections import Counter

import duckdb

from kinloom.plans import fixtures


def test_offers_meet_by_place_not_by_country_alone(spark):
    plan = fixtures.part(spark, "/root/testdata/sf0.001", "pairs")._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"Join \[co#\d+, i#\d+L\], \[co#\d+, i#\d+L\], Inner", plan)


def test_offers_equal_their_sql_with_odd_ids(spark, tmp_path):
    rows = [(i - 20, f"text {i % 31}", None if i == 7 else f"l{i % 3}", "s") for i in range(90)]
    rows += [(None, "text 1", "l0", "s"), (500, None, "l1", "s"), (501, "", "l1", "s"), (505, "alone", "l9", "s"), (3, "text 23", "l0", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("refs", "targets", "pairs"):
        got = fixtures.part(spark, str(tmp_path), name)
        want = con.execute(f"{fixtures.FX} SELECT {', '.join(got.columns)} FROM {name}").fetchall()
        assert Counter(map(tuple, got.collect())) == Counter(want)
