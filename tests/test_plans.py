import re

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark):
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "private_ip_flag")) == ["user_id:bigint,props:string"]
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "state_diff"))) == {"c_custkey:bigint,c_name:string,c_acctbal:double,c_mktsegment:string"}
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "first_wins_dedup"))[0].count(":") <= 4


def test_no_cartesian_products_and_no_python(spark):
    for name in ("state_diff", "change_events", "interval_session", "range_join_ports", "nearest_name", "under_directories", "owner_recovery_cascade", "attach_first_path", "link_discovery", "like_join_to_equi"):
        text = plan(spark, name)
        assert "CartesianProduct" not in text and not re.search(r"Python|Pandas|ArrowEval", text), name


def test_threshold_detection_aggregates_before_the_shuffle(spark):
    text = plan(spark, "detect_bruteforce_tumbling")
    assert "partial_count" in text
