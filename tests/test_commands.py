"""Read quality control and commands."""

import json

import pytest

from edgeloom.operators import readqc
from edgeloom.plans import commands


def reads_of(spark, rows):
    return spark.createDataFrame(rows, "name string, sequence string, quality string")


def test_quality_filter_and_trims(spark):
    found = reads_of(spark, [("a", "ACGT", "IIII"), ("b", "ANNT", "IIII"), ("c", "ACGT", "####"), ("d", "", ""), ("e", "A\nCG", "I\nII")])
    got = {r["name"]: r["reason"] for r in readqc.quality_filter(found, 1, 20, 1).collect()}
    assert got == {"a": None, "b": "too_many_n", "c": "low_quality", "d": "too_short", "e": None}
    cut = {r["name"]: (r["sequence"], r["quality"]) for r in readqc.trim_fixed(found, 1, 2).collect()}
    assert cut["a"] == ("C", "I") and cut["d"] == ("", "")
    g = readqc.trim_poly_g(reads_of(spark, [("a", "ACGGGG", "123456"), ("b", "ACGGG", "12345"), ("c", "GGGGA", "12345")]), 4)
    assert [tuple(r) for r in g.orderBy("name").collect()] == [("a", "AC", "12"), ("b", "ACGGG", "12345"), ("c", "GGGGA", "12345")]


def test_repeats_and_adapters(spark):
    found = reads_of(spark, [("b", "ACGT", "1111"), ("a", "ACGT", "2222"), ("c", "AAAA", "3333")])
    assert [tuple(r) for r in readqc.drop_repeats(found).orderBy("name").collect()] == [("a", "ACGT", "2222"), ("c", "AAAA", "3333")]
    linked = readqc.linked_adapters(reads_of(spark, [("a", "TTACXXGGTT", ""), ("b", "GGXXAC", ""), ("c", "ACGG", ""), ("d", "ACXX", "")]), "AC", "GG")
    assert {r["name"]: r["insert"] for r in linked.collect()} == {"a": "XX", "b": None, "c": "", "d": None}


def test_demux_and_collapse(spark):
    panel = spark.createDataFrame([("AAAA", "A"), ("CCCC", "C")], "barcode string, marker string")
    rows = [("AAAA", "CCCC", "TTTTTTTT", "GGGGGGGG", u) for u in "xxxyz"] + [("AAAT", "CCCC", "TTTTTTTA", "GGGGGGGG", "x"), ("GGGG", "CCCC", "T", "G", "x")]
    molecules = commands.run_command("demux", spark.createDataFrame(rows, "barcode_1 string, barcode_2 string, umi1 string, umi2 string, uei string"), panel)
    assert {(r["umi1"], r["uei"]): r["read_count"] for r in molecules.collect()} == {("TTTTTTTT", "x"): 3, ("TTTTTTTT", "y"): 1, ("TTTTTTTT", "z"): 1, ("TTTTTTTA", "x"): 1}
    got = commands.run_command("collapse", molecules).collect()
    assert [tuple(r) for r in got] == [("A", "C", "TTTTTTTT", "GGGGGGGG", 6, 3, 1)]
    with pytest.raises(ValueError):
        commands.collapse(molecules, algorithm="none")


def test_graph_denoise_and_defaults(spark, tmp_path):
    rows = [(b + i, b + 100 + j, f"M{i % 3}", f"M{j % 3}", 2, 1) for b in (0, 1000) for i in range(6) for j in range(6)] + [(5000, 5001, "M0", "M1", 2, 1)]
    e = spark.createDataFrame(rows, "umi1 long, umi2 long, marker_1 string, marker_2 string, read_count long, uei_count long")
    assert commands.defaults("graph") | {} == commands.defaults("graph") and commands.defaults("graph")["size_min"] == 8000
    (tmp_path / "p.json").write_text(json.dumps({"size_min": 5}))
    parts = commands.run_command("graph", e, parameters=str(tmp_path / "p.json"))
    assert parts.select("component").distinct().count() == 2 and parts.count() == 72
    again = commands.run_command("graph", e, parameters={"size_min": 5, "multiplet_recovery": True, "depth": 2})
    assert again.select("component").distinct().count() == 2 and again.count() == 72
    left, marked = commands.run_command("denoise", parts, parameters={"methods": ["one_core"], "ratio": 0.5})
    assert left.count() == 72 and marked.count() == 0
    assert commands.run_command("layout", parts, parameters={"pivots": 4}).count() == 24
    for bad in (("graph", {"threads": 3}), ("no-such", {})):
        with pytest.raises(ValueError):
            commands.run_command(bad[0], e, parameters=bad[1])


def test_older_generation_graph(spark):
    """Two complete bipartite parts that one edge joins; a second edge is too rare to count."""
    rows = [("M", f"a{s + i}", f"b{s + j}", "u", 2) for s in (0, 5) for i in range(3) for j in range(3)] + [("M", "a0", "b5", "u", 2), ("M", "a1", "b6", "u", 1)]
    e = spark.createDataFrame(rows, "marker string, upia string, upib string, umi string, count int")
    whole = commands.run_command("mpx-graph", e)
    assert whole.count() == 19 and whole.select("component").distinct().count() == 1
    parts = commands.run_command("mpx-graph", e, parameters={"multiplet_recovery": True, "max_edges": 1})
    assert sorted(r["count"] for r in parts.groupBy("component").count().collect()) == [9, 9]
