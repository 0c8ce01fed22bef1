"""No query has its whole table, or a whole group's rows, in one task."""

import pytest
from test_queries import SF

from ostraka.plans import registry


@pytest.mark.parametrize("name", ["museum_sort", "latest_records", "needs_revision"])
def test_nothing_is_gathered(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    assert "windowspecdefinition" not in plan or "windowspecdefinition(__range" in plan


@pytest.mark.parametrize("name", ["line_vectors", "overlap_scores"])
def test_line_vectors_gather_runs_only(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    gathers = [x for x in plan.splitlines() if "collect_list" in x]
    assert gathers and all("Aggregate [user_id#" in x and "run#" in x.split("],")[0] for x in gathers)


def test_change_log_where_keys_meet(spark, tmp_path):
    # keys beyond a million meet parts of other brands: only sizes are compared, as in the SQL
    import duckdb

    path = str(tmp_path / "part.parquet")
    duckdb.execute(f"COPY (SELECT CAST(k AS BIGINT) AS p_partkey, 'b' || (k % 7) AS p_brand, CAST(CASE WHEN k % 11 = 0 THEN NULL ELSE k % 10 END AS INTEGER) AS p_size FROM (SELECT unnest(range(40)) AS k UNION ALL SELECT unnest(range(1000003, 1000040))) t) TO '{path}' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{path}'")
    mine = sorted(tuple(map(str, r)) for r in registry.QUERIES["change_log"](spark, str(tmp_path)).collect())
    assert mine and mine == sorted(tuple(map(str, r)) for r in con.execute(registry.ORACLE_SQL["change_log"]).fetchall())


def test_a_place_reads_a_stored_key(spark):
    from pyspark.sql import functions as F

    from ostraka.functions import sortkeys
    from ostraka.operators import windows

    df = spark.createDataFrame([("b",), ("a",), ("c II",)], "w string")
    found = windows.placed(df, sortkeys.akkadian_key(F.col("w")), "place")
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString() and {r.w: r.place for r in found.collect()} == {"a": 1, "b": 2, "c II": 3}


def test_neighbours_of_one_value_are_dealt(spark, tmp_path):
    # 400 parts of one brand and size in one file, one key twice, nulls: the SQL's pairs, from more than one task
    import duckdb
    from pyspark.sql import functions as F

    path = str(tmp_path / "part.parquet")
    rows = "SELECT unnest(range(400)) AS k, 'x' AS b, 7 AS s UNION ALL SELECT * FROM (VALUES (5, 'x', 7), (900, 'x', 9), (901, 'x', 10), (902, 'x', 4), (903, 'x', 5), (904, NULL, 7), (905, 'x', NULL), (NULL, 'x', 7), (906, 'y', 7), (907, 'y', -1), (908, 'y', -3)) t(k, b, s)"
    duckdb.execute(f"COPY (SELECT CAST(k AS BIGINT) AS p_partkey, b AS p_brand, CAST(s AS INTEGER) AS p_size FROM ({rows})) TO '{path}' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{path}'")
    found = registry.QUERIES["range_neighbours"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.a, r.b, r.a_value, r.b_value) for r in found) == sorted(con.execute(registry.ORACLE_SQL["range_neighbours"]).fetchall())
    assert len({r.task for r in found}) > 1
