"""The steps of an analysis as commands: each a function of tables with the original's default parameters.

A command takes DataFrames first and its parameters by keyword. ``run_command`` looks one up
by name, takes parameters from a dict or a JSON file and refuses unknown ones. Parameters of
the original that nothing here would act on (chunk sizes, threads, strategies of the file
layout) are left out.
"""

from __future__ import annotations

import inspect
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators import denoise as noise
from edgeloom.operators import graph, pixels, proximity, readqc, reads, sampling, spatial


def demux(found: DataFrame, panel: DataFrame, *, mismatches: int = 1) -> DataFrame:
    """Reads (barcode_1, barcode_2, umi1, umi2, uei) to counted molecules of identified markers; others go."""
    for side in (1, 2):
        named = reads.identify_barcodes(found, panel, f"barcode_{side}", mismatches).where("marker IS NOT NULL")
        found = named.withColumnRenamed("marker", f"marker_{side}").drop("mismatches")
    return reads.read_counts(found.select("marker_1", "marker_2", "umi1", "umi2", "uei"))


def collapse(molecules: DataFrame, *, mismatches: int = 2, algorithm: str = "directional") -> DataFrame:
    """Molecules (marker_1, marker_2, umi1, umi2, uei, read_count) to edges, each side corrected on its own."""
    if algorithm not in ("directional", "cluster"):
        raise ValueError(f"unknown algorithm {algorithm!r}")
    named = molecules.withColumnsRenamed({"umi1": "original_umi1", "umi2": "original_umi2"})
    sides = []
    for side in (1, 2):
        own = molecules.select(F.col(f"marker_{side}").alias("marker"), F.col(f"umi{side}").alias("sequence"), "read_count")
        found = reads.collapse(own, ["marker"], mismatches if algorithm == "directional" else 2 * mismatches, algorithm == "directional")
        found = found.select(F.col("marker").alias(f"marker_{side}"), F.col("sequence").alias(f"original_umi{side}"), F.col("representative").alias(f"corrected_umi{side}"))
        sides.append(named.join(found, [f"marker_{side}", f"original_umi{side}"]))
    return reads.combine_collapsed(*sides)


def recover(
    edges: DataFrame,
    *,
    multiplet_recovery: bool = False,
    leiden_resolution: float = 1.0,
    refine_resolution: float = 0.01,
    min_count: int = 1,
    depth: int = 5,
    max_edges: int | None = None,
    max_edges_refine: int | None = 4,
    size_min: int | None = 8000,
    size_max: int | None = None,
) -> DataFrame:
    """Edges to named components within the size limits."""
    if not multiplet_recovery:
        return graph.find_components(edges, min_count, rounds=0, least=size_min, most=size_max)
    return graph.find_components(edges, min_count, 2, leiden_resolution, size_min, size_max, max_edges, depth, refine_resolution, refine_merge_least=max_edges_refine)


def call(counts: DataFrame, samples: DataFrame, antibodies: DataFrame, *, enrichment: float = 10.0, save_undetermined: bool = False) -> DataFrame:
    """Sample of each component; undetermined ones only where asked for."""
    found = sampling.call_samples(counts, sampling.hash_mapping(samples, antibodies), enrichment)
    return found if save_undetermined else found.where("called_sample <> 'undetermined'")


def denoise(
    edges: DataFrame,
    *,
    methods: tuple[str, ...] = ("one_core",),
    ratio: float = 0.9,
    p: float = 0.05,
    inflate: float = 1.5,
    k: int = 3,
    most_core: int = 4,
    parts: int = 5,
    score: float = -3.0,
) -> tuple[DataFrame, DataFrame]:
    """(cleaned edges, removed nodes with their methods)."""
    given = {"one_core": {"ratio": ratio, "p": p, "inflate": inflate}, "core_expansion": {"k": k, "most_core": most_core}, "regression": {"parts": parts, "cutoff": score}}
    return noise.denoise(edges, tuple(methods), given)


def analysis(edges: DataFrame, *, permutations: int = 100, pivots: int = 50, min_marker_count: int = 10) -> dict[str, DataFrame]:
    return {"proximity": proximity.permuted(edges, permutations, min_marker_count), "cores": graph.core_summary(edges), "variance": graph.distance_variance(edges, pivots)}


def layout(edges: DataFrame, *, pivots: int = 50, dimensions: int = 3) -> DataFrame:
    return graph.normalise_layout(graph.pivot_layout(edges, pivots, dimensions))


def mpx_preqc(found: DataFrame, *, trim_front: int = 0, trim_tail: int = 0, max_n: int = 0, average_quality: float = 20, dedup: bool = False, poly_g: bool = False) -> DataFrame:
    """Reads (name, sequence, quality) that pass, trimmed."""
    found = readqc.trim_fixed(found, trim_front, trim_tail)
    found = readqc.trim_poly_g(found) if poly_g else found
    found = readqc.quality_filter(found, max_n, average_quality).where("reason IS NULL").drop("reason")
    return readqc.drop_repeats(found) if dedup else found


def mpx_collapse(found: DataFrame, *, mismatches: int = 2, min_count: int = 1) -> DataFrame:
    return reads.collapse_pixels(found, mismatches, min_count)


def mpx_graph(edges: DataFrame, *, multiplet_recovery: bool = False, depth: int = 5, max_edges: int = 5, min_count: int = 2) -> DataFrame:
    """Pixel edges (marker, upia, upib, umi, count) with their component."""
    often = edges.where(F.col("count") >= min_count).drop("component")
    parts = graph.connected_components(often.select(F.concat(F.lit("a"), "upia").alias("a"), F.concat(F.lit("b"), "upib").alias("b")).distinct())
    placed = often.join(parts.where("node LIKE 'a%'").select(F.expr("substring(node, 2)").alias("upia"), "component"), "upia")
    if not multiplet_recovery:
        return placed
    found = graph.cut_lineage(pixels.recover_multiplets(placed, depth, max_edges))
    side = lambda c: found.select(F.col("umi").alias(c), F.col("part").alias(f"part_{c}")).distinct()
    kept = placed.join(side("upia"), "upia").join(side("upib"), "upib").where("part_upia = part_upib")
    return kept.withColumn("component", F.col("part_upia")).drop("part_upia", "part_upib")


def mpx_polarization(edges: DataFrame, *, transformation: str = "log1p", permutations: int = 50, min_count: int = 5) -> DataFrame:
    if transformation not in ("raw", "log1p"):
        raise ValueError(f"unknown transformation {transformation!r}")
    return spatial.permuted_morans_i(edges, permutations, transformation == "log1p", min_count)


COMMANDS = {
    "demux": demux, "collapse": collapse, "graph": recover, "sample-calling": call, "denoise": denoise, "analysis": analysis, "layout": layout,
    "mpx-preqc": mpx_preqc, "mpx-collapse": mpx_collapse, "mpx-graph": mpx_graph, "mpx-polarization": mpx_polarization,
}


def defaults(command: str) -> dict[str, object]:
    """Parameter names and default values of a command."""
    if command not in COMMANDS:
        raise ValueError(f"unknown command {command!r}: one of {sorted(COMMANDS)}")
    return {n: p.default for n, p in inspect.signature(COMMANDS[command]).parameters.items() if p.kind is p.KEYWORD_ONLY}


def run_command(command: str, *tables: DataFrame, parameters: dict | str | None = None):
    """The command's result over its tables, with parameters from a dict or the path of a JSON file."""
    if isinstance(parameters, str):
        with open(parameters, encoding="utf-8") as f:
            parameters = json.load(f)
    given = parameters or {}
    if unknown := set(given) - set(defaults(command)):
        raise ValueError(f"{command} has no parameter {sorted(unknown)}")
    return COMMANDS[command](*tables, **given)
