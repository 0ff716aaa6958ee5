"""Metrics of older-generation edge lists: one row per molecule between an A and a B pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.stored import dealt


def components_metrics(edges: DataFrame) -> DataFrame:
    """Fifteen metrics per component, among them means and exact medians over pixels."""
    base = edges.groupBy("component").agg(
        F.countDistinct("marker").alias("antibodies"),
        F.count("*").alias("molecules"),
        F.sum("count").alias("reads"),
        F.avg("count").alias("mean_reads_per_molecule"),
        F.median("count").alias("median_reads_per_molecule"),
    )
    a = dealt(edges.select("component", "upia", "upib", "umi"), "upia", like=edges).groupBy("component", "upia").agg(F.countDistinct("upib").alias("partners"), F.count("umi").alias("molecules"))
    a = a.groupBy("component").agg(
        F.count("upia").alias("a_pixels"),
        F.avg("partners").alias("mean_b_pixels_per_a_pixel"),
        F.median("partners").alias("median_b_pixels_per_a_pixel"),
        F.avg("molecules").alias("mean_molecules_per_a_pixel"),
        F.median("molecules").alias("median_molecules_per_a_pixel"),
    )
    b = dealt(edges.select("component", "upia", "upib"), "upib", like=edges).groupBy("component", "upib").agg(F.countDistinct("upia").alias("partners"))
    b = b.groupBy("component").agg(F.count("upib").alias("b_pixels"), F.avg("partners").alias("mean_a_pixels_per_b_pixel"), F.median("partners").alias("median_a_pixels_per_b_pixel"))
    first = ["a_pixels", "b_pixels"]
    joined = base.join(a, "component").join(b, "component")
    joined = joined.select("component", *first, *[c for c in joined.columns if c not in ("component", *first)])
    return joined.withColumn("pixels", F.col("a_pixels") + F.col("b_pixels")).withColumn("a_pixel_b_pixel_ratio", F.col("a_pixels") / F.col("b_pixels"))


def edgelist_metrics(edges: DataFrame) -> DataFrame:
    """One row of totals; of equally large components the first by name is the largest."""
    totals = edges.agg(
        F.countDistinct("upia").alias("a_pixel_count"),
        F.countDistinct("upib").alias("b_pixel_count"),
        F.countDistinct("marker").alias("marker_count"),
        F.count("*").alias("molecule_count"),
        F.sum("count").alias("read_count"),
    )
    per = edges.groupBy("component").agg(F.count("*").alias("m"), (F.countDistinct("upia") + F.countDistinct("upib")).alias("p"))
    big = per.agg(F.count("*").alias("component_count"), F.min(F.struct((-F.col("m")).alias("m"), "component", "p")).alias("top"), F.sum("m").alias("m"), F.sum("p").alias("p"))
    big = big.select("component_count", (-F.col("top.m") / F.col("m")).alias("fraction_molecules_in_largest_component"), (F.col("top.p") / F.col("p")).alias("fraction_pixels_in_largest_component"))
    return totals.crossJoin(big)  # one row with one row


def antibody_counts(edges: DataFrame) -> DataFrame:
    """Molecules per component and marker."""
    return edges.groupBy("component", "marker").agg(F.count("*").alias("count"))


def antibody_metrics(edges: DataFrame) -> DataFrame:
    per = edges.groupBy("marker").agg(F.sum("count").alias("antibody_count"), F.countDistinct("component").alias("components"))
    return per.withColumn("antibody_pct", F.col("antibody_count") / F.sum("antibody_count").over(Window.partitionBy()))


def filter_pixels(edges: DataFrame, components: list[str] | None = None) -> DataFrame:
    return edges.where(F.col("component").isin(components)) if components else edges


def mark_doublets(communities: DataFrame, share: float = 0.2) -> DataFrame:
    """(component, is_doublet): the second largest community exceeds ``share`` of the largest."""
    sizes = communities.groupBy("component", "community").agg(F.count("*").alias("n"))
    order = Window.partitionBy("component").orderBy(F.col("n").desc(), "community")
    top = sizes.withColumn("r", F.row_number().over(order)).where("r <= 2")
    both = top.groupBy("component").agg(F.max(F.when(F.col("r") == 1, F.col("n"))).alias("n1"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("n"))), F.lit(0)).alias("n2"))
    return both.select("component", (F.col("n2") > share * F.col("n1")).alias("is_doublet"))


def recover_multiplets(edges: DataFrame, depth: int = 5, most_crossing: int = 5) -> DataFrame:
    """(component, umi, part): communities found again and again inside parts, the first pass at
    resolution 1, later ones at 0.01; parts with more than ``most_crossing`` crossing edges stay whole."""
    from edgeloom.operators.edges import nodes
    from edgeloom.operators.graph import cut_lineage, merge_communities, modularity_communities

    work = edges.select("component", F.col("upia").alias("umi1"), F.col("upib").alias("umi2")).distinct()
    work = work.withColumn("marker_1", F.lit("")).withColumn("marker_2", F.lit(""))
    whole = work
    for turn in range(depth):
        found = modularity_communities(work, 1.0 if turn == 0 else 0.01)
        flat = found.select("umi", "community")
        merged = cut_lineage(merge_communities(work, flat, most_crossing, strict=True))
        first, second = (merged.withColumnsRenamed({"umi": f"umi{i}", "community": f"c{i}"}) for i in (1, 2))
        cut = work.join(first, "umi1").join(second, "umi2").where("c1 = c2")
        cut = cut_lineage(cut.select(F.col("c1").cast("string").alias("component"), "umi1", "umi2", "marker_1", "marker_2"))
        if cut.count() == work.count() and turn:
            work = cut
            break
        work = cut
    return nodes(whole).select("component", "umi").join(nodes(work).select(F.col("component").alias("part"), "umi"), "umi").select("component", "umi", "part")
