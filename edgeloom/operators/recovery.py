"""Around component recovery: statistics, maps back to identifiers, size filters, strict lookups, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.edges import component_sizes, filter_by_size, keys_of


def recovery_statistics(edges: DataFrame) -> DataFrame:
    """One row: components, nodes, edges, and the share of nodes in the largest component."""
    sizes = component_sizes(edges)
    return sizes.agg(
        F.count("*").alias("component_count"),
        F.coalesce(F.sum("n_umi"), F.lit(0)).alias("node_count"),
        F.coalesce(F.sum("n_edges"), F.lit(0)).alias("edge_count"),
        (F.max("n_umi") / F.sum("n_umi")).alias("fraction_nodes_in_largest_component"),
    )


def replace_strict(df: DataFrame, column: str, mapping: DataFrame, default: object = None) -> DataFrame:
    """``column`` replaced through mapping(old, new). A value that the mapping lacks takes
    ``default``, or raises where there is none. Nulls stay null."""
    joined = df.join(mapping.select(F.col("old").alias(column), "new", F.lit(True).alias("known")), column, "left")
    missing = F.col(column).isNotNull() & F.col("known").isNull()
    if default is None:
        bad = [str(r[0]) for r in joined.where(missing).select(column).distinct().limit(5).collect()]
        if bad:
            raise ValueError(f"no replacement for {column} in {sorted(bad)}")
        value = F.col("new")
    else:
        value = F.when(missing, F.lit(default)).otherwise(F.col("new"))
    return joined.select(*[value.alias(c) if c == column else F.col(c) for c in df.columns])


def identifiers_back(numbered: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (node1, node2) with the identifiers ids(umi, node) names; raises where one is unknown."""
    for side in (1, 2):
        numbered = replace_strict(numbered, f"node{side}", ids.select(F.col("node").alias("old"), F.col("umi").alias("new")))
    return numbered.withColumnsRenamed({"node1": "umi1", "node2": "umi2"})


def filter_sizes(edges: DataFrame, limits: bool | tuple[int | None, int | None], floor: int = 8000) -> tuple[DataFrame, DataFrame]:
    """(edges within the limits, one row of statistics). True finds a lower limit from the sizes
    (``edges.size_knee``), False keeps all; raises where no component is left."""
    from edgeloom.operators.edges import size_knee

    least, most = (size_knee(component_sizes(edges), floor), None) if limits is True else (None, None) if limits is False else limits
    kept = filter_by_size(edges, least, most)
    before, after = component_sizes(edges).agg(F.count("*").alias("components_before")), component_sizes(kept).agg(F.count("*").alias("components_after"), F.min("n_umi").alias("smallest"), F.max("n_umi").alias("largest"))
    stats = before.crossJoin(after).withColumn("lower_limit", F.lit(least).cast("long")).withColumn("upper_limit", F.lit(most).cast("long"))  # a row each
    if not kept.limit(1).count():
        raise ValueError("no component is within the size limits")
    return kept, stats


def prune_small(edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(edges of components with at least ``least`` nodes, sizes of those that go)."""
    gone = component_sizes(edges).where(F.col("n_umi") < least)
    return edges.join(gone.select(*keys_of(edges)), keys_of(edges), "left_anti").select(*edges.columns), gone


def collapse_totals(combined: DataFrame) -> DataFrame:
    return combined.agg(F.sum("uei_count").alias("molecule_count"), F.sum("read_count").alias("read_count"), F.sum("corrected_read_count").alias("corrected_read_count"))


def merge_statistics(reports: list[DataFrame], by: list[str]) -> DataFrame:
    """Counters of several partial reports added up: every number column, by key."""
    whole = reduce(lambda a, b: a.unionByName(b), reports)
    sums = [F.sum(c).alias(c) for c in whole.columns if c not in by]
    return whole.groupBy(*by).agg(*sums) if by else whole.agg(*sums)


def graph_statistics(obs: DataFrame) -> DataFrame:
    """One row over components: cells, and totals and medians of nodes, edges and reads."""
    named = {"n_umi": "umis", "n_edges": "edges", "reads_in_component": "reads"}
    return obs.agg(
        F.count("*").alias("cells"),
        *[F.sum(c).alias(f"total_{n}") for c, n in named.items()],
        *[F.percentile(c, F.lit(0.5)).alias(f"median_{n}") for c, n in named.items()],
    )


def concat_counts(samples: dict[str, DataFrame], how: str = "inner") -> DataFrame:
    """Count matrices of several samples as one: with the markers of all (inner) or any (outer)."""
    if how not in ("inner", "outer"):
        raise ValueError(f"unknown join {how!r}")
    long = reduce(lambda a, b: a.unionByName(b), [df.drop("sample").withColumn("sample", F.lit(n)) for n, df in samples.items()])
    if how == "outer":
        return long
    shared = long.groupBy("marker").agg(F.countDistinct("sample").alias("n")).where(F.col("n") == len(samples)).select("marker")
    return long.join(shared, "marker", "left_semi")


def union_graphs(graphs: dict[str, DataFrame]) -> DataFrame:
    """Edge lists side by side, nodes and components told apart by their graph's name."""
    marked = [df.select(*[F.concat_ws("_", F.lit(n), F.col(c).cast("string")).alias(c) if c in ("umi1", "umi2", "component") else F.col(c) for c in df.columns]) for n, df in graphs.items()]
    return reduce(lambda a, b: a.unionByName(b), marked)


def top_by_effect(scores: DataFrame, effect: str, n: int, by: list[str]) -> DataFrame:
    """The n rows of largest absolute effect; ties by name."""
    return scores.orderBy(F.abs(F.col(effect)).desc(), *by).limit(n)


def barcode_distances(identified: DataFrame) -> DataFrame:
    """(mismatches, n): how many barcodes were corrected over each distance."""
    return identified.where("mismatches IS NOT NULL").groupBy("mismatches").agg(F.count("*").alias("n"))


def as_json(row: DataFrame) -> DataFrame:
    """Each row as one JSON text, keys in column order."""
    return row.select(F.to_json(F.struct(*row.columns)).alias("value"))


def filter_layouts(layouts: DataFrame, **wanted) -> DataFrame:
    """Layout rows whose component, projection, method... are among those wanted (None: any)."""
    for column, values in wanted.items():
        if values is not None:
            layouts = layouts.where(F.col(column).isin([values] if isinstance(values, str) else list(values)))
    return layouts


def aggregate_layouts(samples: dict[str, DataFrame], markers: list[str]) -> DataFrame:
    """Layouts of several samples; components carry their sample, absent marker columns are 0."""
    from edgeloom.plans.dataset import aggregate_samples

    whole = aggregate_samples(samples)
    return whole.select(*[c for c in whole.columns if c not in markers], *[F.coalesce(F.col(m), F.lit(0)).cast("long").alias(m) if m in whole.columns else F.lit(0).cast("long").alias(m) for m in markers])
