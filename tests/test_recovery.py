"""Recovery, demultiplexing, dataset streams and stores beyond what SQL expresses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeloom.operators import demux, denoise, graph, recovery
from edgeloom.plans.dataset import Dataset
from edgeloom.sources import store


def clusters(seed=0, count=10, nodes=100, edges=800, large=200, crossing=0.004):
    """Bipartite clusters (one twice as large) with few crossing edges: even ids umi1, odd ids umi2."""
    rng = np.random.default_rng(seed)
    rows, base, sizes = [], 0, [nodes] * (count - 1) + [large]
    for n in sizes:
        a = base + 2 * rng.integers(0, n // 2, edges * n // nodes)
        b = base + 2 * rng.integers(0, n // 2, edges * n // nodes) + 1
        rows += zip(a.tolist(), b.tolist())
        base += n
    across = int(len(rows) * crossing)
    rows += zip((2 * rng.integers(0, base // 2, across)).tolist(), (2 * rng.integers(0, base // 2, across) + 1).tolist())
    truth = np.repeat(np.arange(count), sizes)
    return sorted(set(rows)), truth


def test_find_components_recovers_clusters(spark):
    rows, truth = clusters()
    assert len({truth[a] != truth[b] for a, b in rows}) == 2
    e = spark.createDataFrame([(a, b, f"M{a % 4}", f"M{b % 4}", 2, 1) for a, b in rows], "umi1 long, umi2 long, marker_1 string, marker_2 string, read_count long, uei_count long")
    assert graph.find_components(e, rounds=0).select("component").distinct().count() == 1
    for depth in (1, 2):
        got = graph.find_components(e, depth=depth, prune=20).select("umi1", "umi2", "component").collect()
        by = {}
        for r in got:
            by.setdefault(r["component"], set()).update((truth[r["umi1"]], truth[r["umi2"]]))
        assert len(by) == 10 and all(len(t) == 1 for t in by.values())
        assert len(got) >= 0.99 * sum(truth[a] == truth[b] for a, b in rows)


def test_communities_of_weighted_graphs():
    # Two heavy pairs, lightly joined.
    found = graph.communities_of(4, np.array([0, 2, 1]), np.array([1, 3, 2]), 1.0, 1, np.array([9.0, 9.0, 1.0]), np.array([5.0, 5.0, 5.0, 5.0]))
    assert found[0] == found[1] != found[2] == found[3]


def test_one_core_excess():
    # 10 of 40 nodes in core 1 have the marker, 6 of 60 above: expected round(40 * 6 / 60) = 4, excess ceil(1.5 * 6).
    assert denoise.one_core_excess(10, 6, 40, 60) == 9
    assert denoise.one_core_excess(3, 6, 40, 60) < 0
    assert denoise.one_core_excess(3, 0, 3, 0) == 5


def test_replace_strict(spark):
    df, mapping = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, known int"), spark.createDataFrame([("a", "x"), ("b", "y")], "old string, new string")
    assert sorted(recovery.replace_strict(df.select("k"), "k", mapping).collect(), key=str) == sorted([("x",), ("y",), (None,)], key=str)
    with pytest.raises(ValueError, match="no replacement"):
        recovery.replace_strict(df.select("k"), "k", mapping.where("old = 'a'"))
    assert {r["k"] for r in recovery.replace_strict(df.select("k"), "k", mapping.where("old = 'a'"), "").collect()} == {"x", "", None}


def test_even_groups():
    assert demux.even_groups({"a": 8, "b": 7, "c": 6, "d": 5, "e": 4}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 0}
    assert set(demux.even_groups({"a": 1}, 3).values()) == {0} and demux.even_groups({}, 2) == {}
    with pytest.raises(ValueError):
        demux.even_groups({"a": 1}, 0)


def test_strategy_of():
    assert demux.strategy_of(["m1-0", "m2-3"]) == "independent" and demux.strategy_of(["paired-1"]) == "paired"
    for names in (["m1", "paired"], ["other"], []):
        with pytest.raises(ValueError):
            demux.strategy_of(names)


@pytest.fixture
def small(spark):
    rows = [("s", f"c{k % 4}", 2 * k, 2 * k + 1, f"M{k % 2}", f"M{k % 3}", k, 1) for k in range(50)]
    return spark.createDataFrame(rows, "sample string, component string, umi1 long, umi2 long, marker_1 string, marker_2 string, read_count long, uei_count long")


def test_record_batches(small):
    batches = list(Dataset(small).record_batches(20))
    assert all(0 < b.num_rows <= 20 for b in batches) and sum(b.num_rows for b in batches) == 50
    assert batches[0].schema.names == small.columns and list(Dataset(small.limit(0)).record_batches()) == []
    assert sorted(r["umi1"] for b in batches for r in b.to_pylist()) == [2 * k for k in range(50)]


def test_iterate_components(small):
    found = {(s, c): e.count() for s, c, e in Dataset(small).filter(components=["c1", "c2"]).iterate_components()}
    assert found == {("s", "c1"): 13, ("s", "c2"): 12}


@pytest.mark.parametrize("most", [10_000, 3])
def test_partitioned_store(spark, small, tmp_path, most):
    store.write_partitioned(small, str(tmp_path / "p"), most)
    assert len(list((tmp_path / "p").glob("*=*"))) <= min(most, 4)
    back = store.read_partitioned(spark, str(tmp_path / "p"))
    assert sorted(map(str, back.select(*small.columns).collect())) == sorted(map(str, small.collect()))


def test_filter_sizes(small):
    kept, stats = recovery.filter_sizes(small, False)
    assert kept.count() == 50 and stats.first()["components_after"] == 4
    with pytest.raises(ValueError):
        recovery.filter_sizes(small, (1000, None))


def test_concat_needs_a_known_join(small):
    with pytest.raises(ValueError):
        recovery.concat_counts({"s": small}, "left")
    assert recovery.barcode_distances(small.select(F.lit(None).cast("int").alias("mismatches"))).count() == 0
