"""Steps that must stay small where the input grows."""

from edgeloom.operators.stored import BROADCAST_ROWS, cut_lineage


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_stored_table_of_many_rows_is_not_broadcast(spark):
    """Sequential numbers compress far below the planner's limit of 10 MB."""
    large = spark.range(1 << 24)
    assert "BroadcastHashJoin" not in _plan(cut_lineage(spark.range(BROADCAST_ROWS + 1)).join(large, "id"))
    assert "BroadcastHashJoin" in _plan(cut_lineage(spark.range(100)).join(large, "id"))


def test_component_reads_edges_compactly():
    """A component of half a million edges takes few bytes an edge in a task, whatever its names are."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from edgeloom.operators.groups import Component
    from edgeloom.operators.graph import peel

    rows = 500_000

    def batches():
        for lo in range(0, rows, 10_000):
            at = np.arange(lo, lo + 10_000)
            marks = lambda k: pa.array([f"a marker of a long name {v % k}" for v in at])
            yield pa.RecordBatch.from_pydict({"sample": pa.array(["a sample"] * 10_000), "umi1": at // 4 * 2, "umi2": at * 2 + 1, "marker_1": marks(8), "marker_2": marks(5)})

    tracemalloc.start()
    c = Component(("a sample",), batches(), True)
    core = peel(len(c), *c.edges())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(c) == rows // 4 + rows and (core == 1).all()
    assert most < 80 * rows


def test_layout_by_blocks_is_the_layout_at_once(monkeypatch):
    import numpy as np

    from edgeloom.operators import graph

    rng = np.random.default_rng(3)
    i, j = rng.integers(0, 300, 700), rng.integers(0, 400, 700)
    n = 420  # some nodes are out of reach
    once = graph.pivot_coordinates(n, i, j, 30, 3, 1)
    monkeypatch.setattr(graph.SquaredHops, "ROWS", 64)
    parts = graph.pivot_coordinates(n, i, j, 30, 3, 1)
    assert np.allclose(np.abs(once), np.abs(parts))  # a direction's sign is open



def test_wide_steps_build_no_map_of_distinct_values(spark):
    """Counts of distinct molecules expand no rows, and edge joins are cut by the size of the input."""
    from edgeloom.operators import edges, matrix, pixels
    from edgeloom.operators.stored import dealt, slices

    e = spark.createDataFrame([("s", "c", 2, 1, "a", "b", 1, 1), ("s", "c", 2, 3, "a", "b", 5, 1)], "sample string, component string, umi1 long, umi2 long, marker_1 string, marker_2 string, read_count long, uei_count long")
    old = e.select("component", e.umi1.alias("upia"), e.umi2.alias("upib"), e.uei_count.alias("umi"), e.marker_1.alias("marker"), e.read_count.alias("count"))
    for df in (edges.component_sizes(e), matrix.component_metrics(e, ["a"]), pixels.components_metrics(old)):
        assert "Expand" not in _plan(df)
    assert edges.component_sizes(e).collect() == [("s", "c", 3, 2)]
    assert matrix.component_metrics(e, ["a"]).select("n_umi1", "n_umi2", "n_edges", "reads_in_component").collect() == [(1, 2, 2, 6)]
    stored = cut_lineage(spark.range(10))
    assert dealt(stored, "id").rdd.getNumPartitions() == slices(stored)


def test_lists_of_neighbours_reach_as_far_as_hops(spark):
    """A path of five nodes: nodes within k hops, in all and without component keys."""
    from edgeloom.operators import spatial

    rows = [("c", a, b, "x", "y") for a, b in ((2, 1), (2, 3), (4, 3), (4, 5), (4, 5))]
    e = spark.createDataFrame(rows, "component string, umi1 long, umi2 long, marker_1 string, marker_2 string")
    for k, want in ((0, 5), (1, 13), (2, 19), (3, 23), (4, 25)):
        for df in (e, e.drop("component")):
            assert sum(r["value"] for r in spatial.hop_counts(df, k).collect()) == want


def test_edge_lists_meet_in_parts_of_their_size(spark, monkeypatch):
    """Joins under an edge list are cut by the files read, and a table larger than a part is not broadcast."""
    from edgeloom.operators import stored
    from edgeloom.plans.proxy import edgelist, table

    folder, key = "/root/testdata/sf0.01", ["umi1", "umi2", "read_count", "uei_count"]
    whole = sorted(edgelist(spark, folder).select(*key).collect())
    monkeypatch.setattr(stored, "SLICE_BYTES", 20_000)
    e = edgelist(spark, folder)
    n = stored.slices(table(spark, folder, "lineitem"))
    assert n > 12 and e.rdd.getNumPartitions() == n
    assert _plan(e).count("SortMergeJoin") == 2
    assert sorted(e.select(*key).collect()) == whole


def test_scans_dealt_widely_are_read_in_small_splits(spark, monkeypatch):
    """A scan task that sends its rows to over 200 partitions holds them: its share of a file is small, and the session is left alone."""
    from edgeloom.operators import edges, stored
    from edgeloom.plans.proxy import edgelist

    def scanned(df) -> int:
        leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
        return max(leaves.apply(i).inputRDD().getNumPartitions() for i in range(leaves.size()))

    folder, key = "/root/testdata/sf0.01", "spark.sql.files.maxPartitionBytes"
    kept = lambda: edges.filter_by_size(edgelist(spark, folder), 1000, 2200, inclusive=False)
    usual, before = spark.conf.get(key), sorted(kept().collect())
    assert kept().sparkSession is spark and len(before) == 51_153
    monkeypatch.setattr(stored, "SLICE_BYTES", 4_000)
    monkeypatch.setattr(stored, "SPLIT_BYTES", 200_000, raising=False)
    df = kept()
    assert scanned(df) >= 5
    assert sorted(df.collect()) == before
    assert spark.conf.get(key) == usual and df.sparkSession.conf.get("spark.sql.shuffle.partitions") == "4"


def _unsized(df) -> list[str]:
    """Shuffles cut by the session's number of partitions: nothing but tables of a row a key or a partition may go through one."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line and "ENSURE_REQUIREMENTS" in line]


def _edges(spark, rows):
    return cut_lineage(spark.createDataFrame(rows, "umi1 long, umi2 long"))


def test_pairs_of_communities_are_counted_in_parts_of_the_input(spark, monkeypatch):
    from edgeloom.operators import edges, graph, stored

    e = _edges(spark, [(1, 20), (1, 21), (2, 20), (3, 30), (30, 41), (31, 40), (2, 3)])
    of = edges.endpoints(e).selectExpr("umi", "umi div 10 AS community")
    assert not _unsized(edges.community_pairs(e, of, 2, None))
    assert sorted(edges.community_pairs(e, of, 2, None).collect()) == [(0, 2, 3), (3, 4, 2)]
    assert sorted(edges.community_pairs(e, of, 2, None, strict=True).collect()) == [(0, 2, 3)]
    assert sorted(edges.community_pairs(e, of, 1, 1.0).collect()) == [(0, 2, 3), (3, 4, 2)]
    whole = sorted(graph.merge_communities(e, of, 2).collect())
    assert whole == [(1, 0), (2, 0), (3, 0), (20, 0), (21, 0), (30, 3), (31, 3), (40, 3), (41, 3)]
    monkeypatch.setattr(stored, "SLICE_BYTES", 600)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 1)
    merged = graph.merge_communities(e, of, 2)
    assert not _unsized(merged) and sorted(merged.collect()) == whole


def test_sides_are_combined_in_parts_of_the_input(spark):
    from edgeloom.operators import reads

    keys = "marker_1 string, marker_2 string, original_umi1 long, original_umi2 long, uei long"
    base = [("a", "b", 1, 2, 7), ("a", "b", 1, 2, 8), ("a", "b", 3, 2, 7), ("a", "b", 5, 6, None)]
    first = cut_lineage(spark.createDataFrame([(*k, n, 1) for n, k in enumerate(base, 1)], f"{keys}, read_count long, corrected_umi1 long"))
    second = cut_lineage(spark.createDataFrame([(*k, 1, k[3]) for k in base], f"{keys}, read_count long, corrected_umi2 long"))
    got = reads.combine_collapsed(first, second)
    assert not _unsized(got)
    assert got.collect() == [("a", "b", 1, 2, 6, 2, 3)]


def test_identifiers_are_numbered_in_parts_of_the_input(spark, monkeypatch):
    from edgeloom.operators import edges, stored

    e = _edges(spark, [(k * 7 % 101, 200 + k * 5 % 97) for k in range(300)])
    monkeypatch.setattr(stored, "SLICE_BYTES", 600)
    ids = edges.dense_ids(e)
    assert stored.slices(e) > 4
    assert [line for line in _unsized(ids) if "part" not in line] == []
    assert ids.rdd.getNumPartitions() == stored.slices(e)
    assert sorted(ids.collect()) == [(u, n) for n, u in enumerate(sorted({*range(101), *range(200, 297)}))]
