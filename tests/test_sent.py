"""What the queries send to every executor: rows are made from fewer by explode, and Spark estimates them by what they were made from."""

import pytest

from voidframe import queries

SF = "/root/testdata/sf0.001"
NAMES = ["a9_void_volume", "g1_percolation", "g8_components_26", "j4_top_atoms", "g3_runs", "h1_octree", "a15_largest_cavity", "a13_volume_fractions", "a16_size_distribution", "k2_size_lines", "k3_centre_lines", "j13_ball_overlaps", "g10_centreline_edges", "g9_pruned_balls", "g11_pore_nodes", "j15_largest_ball", "a14_accessible_surface", "g8_parents", "g8_parents_26", "a18_block_means", "a21_percolates", "g12_limiting_diameter", "a8_leaf_volumes", "g5_octree_percolation"]


def each(seq):
    own = seq.iterator()
    while own.hasNext():
        yield own.next()


def most_sent(spark, run) -> int:
    """The rows of the largest broadcast of what `run` does."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = {x.executionId() for x in each(store.executionsList())}
    run()
    bus.waitUntilEmpty(30_000)
    most = 0
    for k in {x.executionId() for x in each(store.executionsList())} - before:
        told = {x._1(): x._2() for x in each(store.executionMetrics(k))}
        for node in each(store.planGraph(k).allNodes()):
            if node.name().startswith("BroadcastExchange"):
                most = max([most, *(int(told.get(m.accumulatorId(), "0").replace(",", "")) for m in each(node.metrics()) if m.name() == "number of output rows")])
    return most


@pytest.mark.parametrize("name", NAMES)
def test_no_voxels_are_sent(spark, name):
    """3125 voxels are made of 125 slabs; these fit the threshold, the voxels don't. a14 sends its 1000 directions."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        assert most_sent(spark, lambda: queries.QUERIES[name](spark, SF).collect()) < 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
