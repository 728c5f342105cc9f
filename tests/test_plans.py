"""Plans that must hold at any size."""

import re

import pytest

import __spark_entry__ as entry_module
from flowlens.operators import incidents as I
from flowlens.operators import quality as Q
from flowlens.plans import bindings as B
from flowlens.session import shared_dir

SF = "/root/testdata/sf0.001"
QUERIES = entry_module.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["p1_dedupe", "p3_quality", "d1_time_split", "e8_transform", "m5_percentile", "i3_incidents", "i10_link",
                                  "i13_queue", "i15_fold", "i16_live", "a2_roc_auc", "a5_confusion", "r2_psi", "r5_rolling", "t3_guard"])
def test_no_pairwise_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"\+- Window .*\n.*Sort .*\n.*Exchange SinglePartition", text)


def test_sessions_fold_before_the_window(spark):
    text = plan(I.incident_aggregates(B.scored(spark, SF)))
    window, scan = text.index("Window"), text.index("FileScan")
    below = text[window:scan]
    assert below.count("partial_min") >= 1 and below.count("Exchange hashpartitioning") == 2


def test_scans_read_only_what_they_need(spark):
    text = plan(Q.column_quality(B.measures(spark, SF), ["l_tax"]))
    assert "ReadSchema: struct<l_tax:double>" in text
    text = plan(B.flows(spark, SF).where("tool = 'error'").select("f_value"))
    assert "ReadSchema: struct<event_type:string,value:double>" in text and "EqualTo(event_type,error)" in text


def test_shared_folder_comes_from_the_session():
    class Session:
        def __init__(self, named, master):
            self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: named)})
            self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": staticmethod(lambda: None)})

    assert shared_dir(Session("hdfs://cluster/shared", "yarn")) == "hdfs://cluster/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session(None, "yarn"))
