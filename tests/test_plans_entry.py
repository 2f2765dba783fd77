import pytest

import __spark_entry__ as ent
from tests.conftest import SF


def test_entry_runs(spark):
    df = ent.entry(spark)
    assert df.count() > 0 and len(df.columns) == 226


def test_every_oracle_has_a_query():
    q, o = ent.queries(), ent.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["w5_snapshot_by_hour", "t1_kruskal_wallis", "m7_roc_auc_by_hour",
                                  "w2_prior_snapshot", "t10_class_resample"])
def test_plans_have_no_cartesian_udf_or_single_partition(spark, name):
    df = ent.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    p = _plan(df)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    # a single-partition exchange is allowed only over bucket-count tables (at most ``buckets`` rows): the
    # prefix over bucket totals of the positional split; never over rows of the data
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = "\n".join(lines[i + 1:i + 3])
            assert "_b#" in child and "count(1)" in child, child


def test_scan_pruning(spark):
    df = ent.queries()["a1_hourly_aggregate_orders"](spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    # lineitem is read with only the columns the query needs, and the null filter reaches the scan
    scan = [l for l in p.splitlines() if "FileScan" in l and "lineitem" in l][0]
    cols = scan.split("[", 1)[1].split("]", 1)[0]
    assert [c.split("#")[0] for c in cols.split(",")] == ["l_orderkey", "l_suppkey", "l_quantity", "l_returnflag",
                                                          "l_shipdate"]
    assert "PushedFilters: [IsNotNull(l_quantity)" in scan


@pytest.mark.parametrize("name", ["w5_snapshot_by_hour", "w2_prior_snapshot", "w3_label_forward", "w4_label_previous"])
def test_hours_are_exploded_behind_the_shuffle(spark, name):
    """No exchange stands above a generator of hours: intervals are shuffled, never their hours."""
    plan = _plan(ent.queries()[name](spark, SF)).split("== Initial Plan ==")[-1]
    depth = [(len(line) - len(line.lstrip(" :+-*(0123456789)")), line) for line in plan.splitlines() if line.strip()]
    for i, (d, line) in enumerate(depth):
        if "Generate explode(sequence(lo" in line:
            above = d
            for e, other in reversed(depth[:i]):
                if e < above:
                    above = e
                    assert "Exchange" not in other or "BroadcastExchange" in other, (name, other, line)


def test_order_lines_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    from wardspark.operators import profile
    from wardspark.plans import q_profile
    d = str(tmp_path)
    spark.range(900).selectExpr("id % 300 AS l_orderkey", "if(id % 7 = 0, null, id % 5) AS l_partkey").write.parquet(
        f"{d}/lineitem.parquet")
    spark.range(250).selectExpr("id AS o_orderkey", "id % 10 AS o_custkey").write.parquet(f"{d}/orders.parquet")
    monkeypatch.setattr(q_profile, "LINES_PER_TASK", 100)
    lines = q_profile.line_items(spark, d)
    assert lines.rdd.getNumPartitions() == 9 and lines.count() == 750
    plan = profile.frequency_stats(lines, by=q_profile.VISIT, min_obs=120)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") == 1
    got = {r["itemid"]: r["count"] for r in profile.frequency_stats(lines, by=q_profile.VISIT, min_obs=120).collect()}
    want = {r["itemid"]: r["count"] for r in lines.groupBy("itemid").count().collect() if r["itemid"] is not None}
    assert got == {i: n for i, n in want.items() if n > 120}
