"""What grows with the input is not broadcast, however small Spark takes it to be: the driver would hold it whole."""

import pytest

from strandloom import catalog

SF = "/root/testdata/sf0.001"


def broadcasts(spark, run):
    """Rows of each broadcast of what `run` executes."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, rows = store.executionsCount(), []
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for at in range(before, store.executionsCount()):
        number = store.executionsList().apply(at).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            if "BroadcastExchange" in node.name():
                metrics = node.metrics().iterator()
                while metrics.hasNext():
                    metric = metrics.next()
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        rows.append((int(values.apply(metric.accumulatorId()).replace(",", "")), node.desc()))
    return rows


@pytest.mark.parametrize("name", ["phase_end_to_end_k5", "tangle_cut_graph", "topology_errors_k3"])
def test_what_grows_is_shuffled(spark, name):
    """With a threshold that all tables here are under, only lists of chromosomes, buckets, pieces and blocks are broadcast: 600 variants, 4 edges each, make none."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        found = broadcasts(spark, lambda: catalog.QUERIES[name](spark, SF).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert found and max(found)[0] <= 100, sorted(found)[-5:]
