import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from edgeloom.functions import scalar
from edgeloom.operators import denoise, edges, graph, matrix, pixels, proximity, reads, sampling, spatial, stats
from edgeloom.plans.dataset import Dataset, aggregate_samples
from edgeloom.plans.tasks import ComponentTask, run_tasks
from edgeloom.sources import fastq, panel, store


def planted(clusters=4, nodes=40, links=320, crossing=6, seed=0):
    """Clusters of a bipartite graph: even ids one side, odd ids the other."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(clusters):
        a = (c * nodes + rng.integers(0, nodes // 2, links)) * 2
        b = (c * nodes + nodes // 2 + rng.integers(0, nodes // 2, links)) * 2 + 1
        rows += list(zip(a, b))
    for _ in range(crossing):
        x, y = rng.choice(clusters, 2, replace=False)
        rows.append(((x * nodes + rng.integers(0, nodes // 2)) * 2, (y * nodes + nodes // 2 + rng.integers(0, nodes // 2)) * 2 + 1))
    return [(int(a), int(b), f"M{a // 2 % 3}", f"M{b // 2 % 3}", 5, 1) for a, b in sorted(set(rows))]


def frame(spark, rows, component="c"):
    df = spark.createDataFrame(rows, "umi1 long, umi2 long, marker_1 string, marker_2 string, read_count long, uei_count long")
    return df.withColumn("component", F.lit(component)) if component else df


def test_normal_tail_matches_erfc(spark):
    zs = [0.0, 0.3, -1.0, 2.5, 6.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select("z", scalar.normal_two_sided(F.col("z")).alias("p"), scalar.normal_upper(F.col("z")).alias("u"))
    for r in df.collect():
        assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-6)
        assert r["u"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), rel=1e-6)


def test_benjamini_hochberg_keeps_nan(spark):
    p = [0.01, 0.04, float("nan"), 0.03, 0.5]
    got = stats.benjamini_hochberg(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double"), "p", "q").orderBy("i").collect()
    # ranks among numbers 1..4, n counts all five
    assert [r["q"] for r in got][:2] == pytest.approx([0.05, 0.04 * 5 / 3])
    assert got[2]["q"] is None
    assert got[4]["q"] == pytest.approx(0.5 * 5 / 4)


@pytest.mark.parametrize("method", ["bonferroni", "sidak", "holm", "hochberg", "fdr_bh", "fdr_by", "hommel"])
def test_adjusted_p_bounds(spark, method):
    p = [0.001, 0.01, 0.02, 0.04, 0.3]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    got = [r["p_adjusted"] for r in stats.adjust_p(df, "p", method).orderBy("p").collect()]
    assert all(a >= b - 1e-12 for a, b in zip(got, p)) and got == sorted(got)
    if method == "holm":
        assert got == pytest.approx([0.005, 0.04, 0.06, 0.08, 0.3])


def test_mann_whitney_against_pairs(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 8, 15), rng.integers(2, 10, 12)
    df = spark.createDataFrame([("k", "r", float(x)) for x in a] + [("k", "t", float(x)) for x in b], "k string, g string, v double")
    r = stats.mann_whitney(df, ["k"], "g", "r", "v").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r["u_stat"] == pytest.approx(u) and r["auc"] == pytest.approx(u / 180)
    assert r["median_diff"] == np.median(b) - np.median(a) and 0 < r["p_value"] < 1


def test_differential_wants_its_column(spark):
    with pytest.raises(ValueError):
        proximity.differential(spark.createDataFrame([("a", "b", 1.0)], "marker_1 string, marker_2 string, join_count_z double"), "condition", "x")


def test_permuted_agrees_with_analytical(spark):
    e = frame(spark, planted(1, 120, 2000, 0))
    keys = ["component", "marker_1", "marker_2"]
    both = proximity.permuted(e, 200).join(proximity.analytical(e).select(*keys, F.col("join_count_expected_mean").alias("m"), F.col("join_count").alias("n")), keys).toPandas()
    assert (both["join_count"] == both["n"]).all()
    assert np.corrcoef(both["join_count_expected_mean"], both["m"])[0, 1] > 0.98


def test_core_numbers(spark):
    # a complete bipartite 3 x 3 with a tail of two nodes
    rows = [(a * 2, b * 2 + 1, "M0", "M1", 1, 1) for a in range(3) for b in range(3)] + [(20, 1, "M0", "M1", 1, 1), (20, 41, "M0", "M1", 1, 1)]
    got = {r["umi"]: r["core"] for r in graph.core_numbers(frame(spark, rows)).collect()}
    assert got[0] == 3 and got[5] == 3 and got[20] == 1 and got[41] == 1


def test_components_of_a_path_and_names(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(pairs).collect()}
    assert set(got[i] for i in range(61)) == {0} and got[101] == 100
    members = spark.createDataFrame([(1, 7), (1, -1), (1, 3)], "component long, umi long")
    import xxhash

    expected = xxhash.xxh3_64(b"".join(x.to_bytes(8, "little") for x in [3, 7, 2**64 - 1])).hexdigest()
    assert graph.component_names(members).first()["name"] == expected
    assert graph.component_names(members.orderBy(F.desc("umi"))).first()["name"] == expected


def test_communities_recover_clusters(spark):
    e = frame(spark, planted())
    got = graph.modularity_communities(e).toPandas()
    got["cluster"] = got["umi"] // 2 // 40
    for _, part in got.groupby("cluster"):
        assert part["community"].nunique() == 1
    assert got["community"].nunique() == 4
    named = graph.find_components(e.drop("component"), resolution=0.3)
    assert named.select("component").distinct().count() == 4


def test_label_propagation_and_merge(spark):
    e = frame(spark, planted(2, 20, 200, 0), None)
    labels = graph.label_propagation(e, 3)
    assert labels.count() == edges.endpoints(e).count()
    two = labels.withColumn("community", F.col("umi") % 2)
    assert graph.merge_communities(e, two, least=1).select("community").distinct().count() == 1
    assert graph.merge_communities(e, two).select("community").distinct().count() == 2


def test_cycles(spark):
    square = [(0, 1), (0, 3), (2, 1), (2, 3)]
    bridge = [(2, 5), (4, 5), (4, 7), (6, 5), (6, 7)]
    rows = [(a, b, "M0", "M1", 1, 1) for a, b in square + bridge]
    kept = {(r["umi1"], r["umi2"]) for r in graph.cycle_edges(frame(spark, rows)).collect()}
    assert kept == set(square + bridge) - {(2, 5)}
    assert {(r["umi1"], r["umi2"]) for r in graph.square_edges(frame(spark, rows)).collect()} == set(square) | {(4, 5), (4, 7), (6, 5), (6, 7)}


def test_layout_and_variance(spark):
    e = frame(spark, planted(1, 30, 150, 0))
    xyz = graph.normalise_layout(graph.pivot_layout(e, 10)).toPandas()
    assert xyz[["x", "y", "z"]].notna().all().all()
    assert np.median(np.linalg.norm(xyz[["x", "y", "z"]], axis=1)) == pytest.approx(1)
    assert 0 < graph.distance_variance(e, 10).first()["explained"] <= 1.0 + 1e-9


def test_morans_and_denoise_run(spark):
    e = frame(spark, planted(2, 60, 500, 4))
    scores = spatial.permuted_morans_i(e, 10, min_count=5)
    plain = {r["marker"]: r["morans_i"] for r in spatial.morans_i(e, min_count=5).collect()}
    for r in scores.collect():
        assert r["morans_i"] == pytest.approx(plain[r["marker"]])
    for method in ("one_core", "core_expansion", "regression"):
        assert getattr(denoise, method)(e).count() >= 0
    clean, marked = denoise.denoise(e, ("one_core", "regression"))
    assert clean.count() <= e.count() and denoise.mark_summary(marked, []).count() >= 0
    assert denoise.hypergeometric_upper(0, 5, 5, 20) == pytest.approx(1)


def test_reads(spark):
    df = spark.createDataFrame([("ACGTNNAC", "IIII####"), ("AAAAAAAA", "IIIIIIII")], "sequence string, quality string")
    trimmed = [r["sequence"] for r in reads.trim_quality(df).collect()]
    assert trimmed == ["ACGT", "AAAAAAAA"]
    reasons = [r["reason"] for r in reads.filter_reads(df, (0, 4), (4, 8)).collect()]
    assert reasons == ["too_many_n", "low_complexity_umi"]
    share = reads.q30_share(df, {"a": (0, 4), "b": (4, 8)}).first()
    assert share["a"] == 1 and share["b"] == 0.5
    linkers = {"l": (4, "GATTACAGAT")}
    r = spark.createDataFrame([("x", "ACGTGATTACAGATTT", "GGAAATCTGTAATC"), ("y", "A" * 16, "C" * 10)], "name string, r1 string, r2 string")
    got = {x["name"]: x for x in reads.build_amplicons(r, linkers, {"umi": (0, 4)}, 18).collect()}
    assert got["x"]["amplicon"].startswith("ACGTGATTACAGATTT") and got["x"]["umi"] == "ACGT" and got["x"]["reason"] is None
    assert got["y"]["reason"] == "no_linker"


def test_amplicon_takes_the_better_base(spark):
    linkers = {"l": (4, "GATTACAGAT")}
    rows = [("low1", "TCGTGATTACAGATTT", "AAATCTGTAATCACGT", "#" + "I" * 15, "I" * 16), ("low2", "TCGTGATTACAGATTT", "AAATCTGTAATCACGT", "I" * 16, "I" * 15 + "#")]
    rows += [("tie", "TCGTGATTACAGATTT", "AAATCTGTAATCACGT", "I" * 16, "I" * 16), ("n", "TCGTGATTACAGATTT", "AAATCTGTAATCACGN", "#" * 16, "I" * 16), ("alone", "ACGTGATTACAGATTT", None, "5" * 16, None)]
    r = spark.createDataFrame(rows, "name string, r1 string, r2 string, q1 string, q2 string")
    got = {x["name"]: x for x in reads.build_amplicons(r, linkers, {"umi": (0, 4)}, 16).collect()}
    assert {k: x["umi"] for k, x in got.items()} == {"low1": "ACGT", "low2": "TCGT", "tie": "ACGT", "n": "TCGT", "alone": "ACGT"}
    assert all(x["quality"] == ("5" if k == "alone" else "I") * 16 and x["reason"] is None for k, x in got.items())


def test_barcodes_with_two_mismatches(spark):
    known = spark.createDataFrame([("AAAAAA", "a"), ("CCCCCC", "c")], "barcode string, marker string")
    r = spark.createDataFrame([("AAAAAA",), ("AACAAC",), ("CCGGGC",), (None,)], "barcode string")
    got = {x["barcode"]: (x["marker"], x["mismatches"]) for x in reads.identify_barcodes(r, known, "barcode", 2).collect()}
    assert got == {"AAAAAA": ("a", 0), "AACAAC": ("a", 2), "CCGGGC": (None, None), None: (None, None)}


def test_collapse_pixels_and_doublets(spark):
    rows = [("m", "AAAA", "CCCC", "GGGG")] * 3 + [("m", "AAAT", "CCCC", "GGGG"), ("m", "TTTT", "ACAC", "GTGT")]
    got = reads.collapse_pixels(spark.createDataFrame(rows, "marker string, upia string, upib string, umi string"), 1).collect()
    assert sorted((r["upia"], r["count"], r["unique_molecules"]) for r in got) == [("AAAA", 4, 2), ("TTTT", 1, 1)]
    c = spark.createDataFrame([("x", 1)] * 10 + [("x", 2)] * 3 + [("y", 1)] * 10, "component string, community int")
    assert {r["component"]: r["is_doublet"] for r in pixels.mark_doublets(c).collect()} == {"x": True, "y": False}


def test_sampling(spark):
    samples = spark.createDataFrame([("s1", 1), ("s2", 2)], "sample string, hash_index int")
    mapping = sampling.hash_mapping(samples, spark.createDataFrame([("B2M-1",), ("B2M-2",), ("B2M-3",)], "antibody string"))
    counts = spark.createDataFrame([("a", "B2M-1", 50), ("a", "B2M-2", 2), ("b", "B2M-1", 5), ("b", "B2M-2", 4), ("c", "B2M-3", 9), ("d", "CD3", 7)], "component string, marker string, count long")
    got = {r["component"]: (r["called_sample"], r["hash_enrichment_factor"]) for r in sampling.call_samples(counts, mapping).collect()}
    assert got == {"a": ("s1", 25.0), "b": ("undetermined", 1.25), "c": ("undetermined", 9.0), "d": ("undetermined", 0.0)}
    with pytest.raises(ValueError):
        sampling.hash_mapping(spark.createDataFrame([("s1", 1), ("s2", 1)], "sample string, hash_index int"), spark.createDataFrame([("B2M-1",)], "antibody string"))


def test_store_dataset_roundtrip(spark, tmp_path):
    one = frame(spark, planted(2), "c1")
    two = frame(spark, planted(1, crossing=0, seed=3), "c2")
    for name, df in (("s1", one), ("s2", two)):
        store.write_store(spark, str(tmp_path / name), df, {}, {"sample_name": name})
    data = Dataset.read(spark, [str(tmp_path / "s1"), str(tmp_path / "s2")])
    assert data.samples() == {"s1", "s2"}
    narrow = data.filter(samples="s1", markers=["M0", "M1"])
    assert narrow.edgelist().count() == one.count()  # markers never narrow edges
    assert {r["marker"] for r in narrow.counts().collect()} == {"M0", "M1"}
    assert set(narrow.proximity(from_edgelist=True).columns) >= {"log2_ratio", "min_count", "join_count_p"}
    assert data.filter(components=[]).edgelist().count() == one.count() + two.count()
    with pytest.raises(ValueError, match="unknown samples.*unknown markers"):
        data.filter(samples=["nope"], markers=["nope"])
    assert data.sql("SELECT count(*) AS n FROM edgelist WHERE sample = :s", s="s2").first()["n"] == two.count()
    data.save(str(tmp_path / "out"), "s2")
    assert store.read_metadata(spark, str(tmp_path / "out"))["sample_name"] == "s2"
    store.filter_store(spark, str(tmp_path / "s1"), ["c1"], str(tmp_path / "kept"))
    with pytest.raises(ValueError):
        store.filter_store(spark, str(tmp_path / "s1"), [], str(tmp_path / "none"))
    assert aggregate_samples({"x": one, "y": two}).select("component").distinct().count() == 2
    with pytest.raises(ValueError):
        aggregate_samples({"x": one})


def test_panel(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("# name: demo\n# version: 1.0.0\nmarker_id,control,sequence_1,sequence_2\nCD3,no,ACGT,ACG\nIgG,yes,TT,GG\n")
    table, header = panel.read_panel(spark, str(path))
    assert header["name"] == "demo" and [r["control"] for r in table.orderBy("marker_id").collect()] == [False, True]
    bad = tmp_path / "bad.csv"
    bad.write_text("marker_id,control,sequence_1,sequence_2\nCD_3,no,ACGX,ACG\n")
    with pytest.raises(ValueError, match="underscore.*ACGT"):
        panel.read_panel(spark, str(bad))
    kits = [dict(name="k", product="p", version="1.0.0"), dict(name="k", product="p", version="1.0.2"), dict(name="k", product="p", version="2.0.0", aliases=["old"])]
    assert panel.choose_panel(kits, "k==1.0")["version"] == "1.0.2"
    assert panel.choose_panel(kits, "p>=2")["version"] == "2.0.0"
    with pytest.raises(ValueError):
        panel.choose_panel(kits, "k")


def test_fastq(spark, tmp_path):
    (tmp_path / "s1_R1.fastq").write_text("@r1 x\nACGT\n+\nIIII\n@r2 x\nGGGG\n+\n@@@@\n")
    got = fastq.read_fastq(spark, str(tmp_path / "s1_R1.fastq")).orderBy("record").collect()
    assert [(r["name"], r["sequence"], r["quality"]) for r in got] == [("r1 x", "ACGT", "IIII"), ("r2 x", "GGGG", "@@@@")]
    df = spark.createDataFrame(got)
    assert df.select(fastq.sample_of(F.col("file")).alias("s")).first()["s"] == "s1"
    assert fastq.pair_reads(df, df).count() == 2
    fastq.write_fastq(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 8


def test_tasks(spark):
    e = frame(spark, planted(2))
    task = ComponentTask("n", lambda pdf: pd.DataFrame({"n": [len(pdf)]}), "n long", finish=lambda df: df.withColumn("double", F.col("n") * 2))
    r = run_tasks(e, [task])["n"].first()
    assert r["n"] == e.count() and r["double"] == 2 * r["n"]


def test_streaming(spark, tmp_path):
    from edgeloom.streaming.edges import distinct_molecules, edge_counts

    rows = [("a", "b", 1, 2, 9, "2024-01-01 00:00:00"), ("a", "b", 1, 2, 9, "2024-01-01 00:00:01"), ("a", "b", 1, 2, 8, "2024-01-01 00:00:02")]
    df = spark.createDataFrame(rows, "marker_1 string, marker_2 string, umi1 long, umi2 long, uei long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = edge_counts(stream).writeStream.format("memory").queryName("edges_out").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    r = spark.table("edges_out").first()
    assert r["read_count"] == 3 and r["uei_count"] == 2
    run = distinct_molecules(stream).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert spark.table("once").count() == 2


def test_unsigned_ids_and_empty(spark):
    empty = frame(spark, [])
    assert matrix.count_matrix(empty).count() == 0 and proximity.analytical(empty).count() == 0
    assert edges.count_statistics(empty.withColumn("sample", F.lit("s"))).first()["n_edges"] == 0
    assert edges.size_knee(edges.component_sizes(empty)) == 8000


def test_annotation_and_background(spark):
    from edgeloom.operators import annotate

    rng = np.random.default_rng(2)
    rows = []
    for c in range(40):
        high = "M0" if c < 20 else "M1"
        rows += [(f"c{c:02}", m, int(rng.poisson(80 if m == high else 6))) for m in ("M0", "M1", "M2", "iso")]
    counts = spark.createDataFrame(rows, "component string, marker string, count long")
    values = annotate.log_normalize(counts).groupBy("component").pivot("marker").agg(F.first("value")).toPandas().set_index("component").sort_index()
    labels = pd.Series(["a"] * 20 + ["b"] * 20)
    got = {r["component"]: r["cell_type"] for r in annotate.annotate_cells(counts, values, labels, 5, 3).collect()}
    assert all(got[f"c{c:02}"] == ("a" if c < 20 else "b") for c in range(40))
    dsb = annotate.dsb_normalize(counts, ["iso"]).toPandas()
    m0 = dsb[dsb["marker"] == "M0"].sort_values("component")["value"].to_numpy()
    assert m0[:20].min() > m0[20:].max() and abs(m0[20:].mean()) < 0.5


def test_colocalization_null_and_walks(spark):
    from edgeloom.functions.lines import simplify

    rng = np.random.default_rng(3)
    rows = [("c", r, m, float(rng.poisson(3 + 6 * (r % 2) * (m != "Z")))) for r in range(60) for m in ("X", "Y", "Z")]
    regions = spark.createDataFrame(rows, "component string, region int, marker string, value double")
    got = {(r["marker_1"], r["marker_2"]): r for r in spatial.permuted_colocalization(regions, ["component"], 30).collect()}
    plain = {(r["marker_1"], r["marker_2"]): r["pearson"] for r in spatial.colocalization(regions, ["component"]).collect()}
    assert got["X", "Y"]["pearson"] == pytest.approx(plain["X", "Y"]) and got["X", "Y"]["pearson_z"] > 3 > abs(got["X", "Z"]["pearson_z"])
    square = frame(spark, [(0, 1, "M0", "M1", 1, 1), (0, 3, "M0", "M1", 1, 1), (2, 1, "M0", "M1", 1, 1), (2, 3, "M0", "M1", 1, 1)])
    walked = {(r["umi"], r["target"]): r["p"] for r in spatial.walk_probabilities(square, 2).collect()}
    assert walked[0, 2] == pytest.approx(1.0) and (0, 0) not in walked
    assert simplify(np.array([[0, 0], [1, 0.01], [2, 0], [3, 2]]), 0.1).tolist() == [True, False, True, True]
    assert len(simplify(np.zeros((0, 2)), 1)) == 0


def test_differential_scores(spark):
    rows = [("X", "r", float(v)) for v in range(8)] + [("X", "t", float(v + 3)) for v in range(8)]
    df = spark.createDataFrame(rows, "marker string, condition string, morans_i double")
    r = spatial.differential_scores(df, ["marker"], "condition", "r", "t", "morans_i").first()
    assert r["median_difference"] == -3.0 and r["p_adjusted"] == r["p_value"] < 0.1


def test_whole_tables_reach_components_and_panels(spark):
    from edgeloom.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/customer.parquet").select("c_nationkey", "c_custkey").collect()
    parent: dict[int, int] = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for nation, key in rows:
        a, b = sorted((root(nation * 10**9 + key), root(nation * 10**9 + key // 3)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in QUERIES["connected_components_whole"](spark, folder).collect()}
    assert got == {v: root(v) for v in list(parent)} and len(set(got.values())) > 1
    assert {n * 10**9 + k for n, k in rows} <= set(got)

    keys = [r["p_partkey"] for r in spark.read.parquet(f"{folder}/part.parquet").collect()]
    change = {r["marker_id"]: r["change"] for r in QUERIES["panel_diff_whole"](spark, folder).collect()}
    expected = {k: "removed" for k in keys if k % 4 == 0} | {-1 - k: "added" for k in keys if k % 4 == 0} | {k: "changed" for k in keys if k % 5 == 0 and k % 4}
    assert change == expected


def test_seeded_queries_run_at_the_defaults(spark, monkeypatch):
    from edgeloom import queries

    seen = {}
    for module, name, key in ((queries.proximity, "permuted", "permutations"), (queries.spatial, "permuted_morans_i", "permutations"), (queries.graph, "pivot_layout", "pivots")):
        f = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, f=f, name=name, key=key, **b: (seen.update({name: b[key]}), f(*a, **b))[1])
    for name in ("proximity_permuted", "polarization_permuted", "pmds_layout"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == {"permuted": 100, "permuted_morans_i": 50, "pivot_layout": 50}
