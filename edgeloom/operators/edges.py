"""Edge-list operators: statistics, clashes, filters, sizes, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.stored import dealt, finely, slices

CELL = ["sample", "component"]


def keys_of(edges: DataFrame) -> list[str]:
    """The columns that name a component in this edge list."""
    return [c for c in CELL if c in edges.columns]


def endpoints(edges: DataFrame, *extra: str) -> DataFrame:
    """Distinct (umi, *extra) over both sides."""
    sides = [edges.select(*extra, F.col(c).alias("umi")) for c in ("umi1", "umi2")]
    return dealt(sides[0].unionByName(sides[1]), "umi", like=edges).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    """Distinct molecules: component keys, umi, marker, side (A or B)."""
    keys = keys_of(edges)
    a = edges.select(*keys, F.col("umi1").alias("umi"), F.col("marker_1").alias("marker"), F.lit("A").alias("side"))
    b = edges.select(*keys, F.col("umi2").alias("umi"), F.col("marker_2").alias("marker"), F.lit("B").alias("side"))
    return a.unionByName(b).distinct()


def count_statistics(edges: DataFrame) -> DataFrame:
    """One row: n_edges, n_umi (distinct over both sides), n_reads, n_molecules."""
    totals = edges.agg(F.count("*").alias("n_edges"), F.sum("read_count").alias("n_reads"), F.sum("uei_count").alias("n_molecules"))
    return totals.crossJoin(endpoints(edges).agg(F.count("*").alias("n_umi")))  # one row with one row


def marker_clashes(edges: DataFrame, side: int) -> DataFrame:
    """Identifiers of one side that come with several markers."""
    return edges.groupBy(F.col(f"umi{side}").alias("umi")).agg(F.countDistinct(f"marker_{side}").alias("markers")).where("markers > 1").select("umi")


def side_clashes(edges: DataFrame) -> DataFrame:
    """Identifiers that stand on both sides."""
    return edges.select(F.col("umi1").alias("umi")).intersect(edges.select(F.col("umi2").alias("umi")))


def clashing(edges: DataFrame) -> DataFrame:
    """Identifiers with any of the three clashes, once each."""
    return marker_clashes(edges, 1).unionByName(marker_clashes(edges, 2)).unionByName(side_clashes(edges)).distinct()


def remove_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges neither end of which is in gone(umi)."""
    left = edges.join(gone.select(F.col("umi").alias("umi1")), "umi1", "left_anti")
    return left.join(gone.select(F.col("umi").alias("umi2")), "umi2", "left_anti").select(*edges.columns)


def min_reads(edges: DataFrame, least: int) -> DataFrame:
    return edges.where(F.col("read_count") >= least)


def side_totals(edges: DataFrame) -> DataFrame:
    """n_umi1, n_umi2 (distinct molecules), n_edges and, of edges with read counts, n_reads per component.

    Molecules meet by themselves before they are counted: no task holds a map of its share of the input.
    """
    keys, reads = keys_of(edges), "read_count" in edges.columns
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"umi{s}").alias("umi"))
    rows = edges.select(*keys, *(["read_count"] if reads else []), F.inline(F.array(side(1), side(2))))
    per = dealt(rows, "umi", like=edges).groupBy(*keys, "side", "umi").agg(F.count("*").alias("e"), *([F.sum("read_count").alias("r")] if reads else []))
    of = lambda s, c: F.when(F.col("side") == s, F.col(c))
    return per.groupBy(*keys).agg(
        *[F.count(of(s, "umi")).alias(f"n_umi{s}") for s in (1, 2)], F.sum(of(1, "e")).alias("n_edges"), *([F.sum(of(1, "r")).alias("n_reads")] if reads else [])
    )


def component_sizes(edges: DataFrame) -> DataFrame:
    """n_umi per component: distinct A molecules plus distinct B molecules."""
    keys = keys_of(edges)
    return side_totals(edges).select(*keys, (F.col("n_umi1") + F.col("n_umi2")).alias("n_umi"), "n_edges")


def size_histogram(edges: DataFrame) -> DataFrame:
    return component_sizes(edges).groupBy("n_umi").agg(F.count("*").alias("n_components"))


def degree_distribution(edges: DataFrame, column: str) -> DataFrame:
    """How many identifiers of a side have each degree (distinct partners)."""
    pairs = edges.select("umi1", "umi2").distinct()
    return pairs.groupBy(column).agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n_umi"))


def filter_by_size(edges: DataFrame, least: int | None = None, most: int | None = None, inclusive: bool = True) -> DataFrame:
    """Edges of components within the limits; raises nothing and keeps all without limits."""
    size = F.col("n_umi")
    keep = F.lit(True)
    if least is not None:
        keep = keep & (size >= least if inclusive else size > least)
    if most is not None:
        keep = keep & (size <= most if inclusive else size < most)
    keys = keys_of(edges)
    return edges.join(component_sizes(edges).where(keep).select(*keys), keys, "left_semi").select(*edges.columns)


def size_knee(sizes: DataFrame, floor: int = 8000) -> int:
    """Lower size limit at the sharpest bend of the log-log rank-size curve.

    Only the distinct sizes and their counts reach the driver.
    """
    import numpy as np

    rows = sizes.where(F.col("n_umi") > 0).groupBy("n_umi").agg(F.count("*").alias("n")).orderBy(F.col("n_umi").desc()).collect()
    if len(rows) < 5:
        return floor
    x = np.log10(np.cumsum([r["n"] for r in rows]))
    y = np.log10([r["n_umi"] for r in rows])
    grid = np.linspace(x[0], x[-1], 200)
    smooth = np.convolve(np.interp(grid, x, y), np.ones(9) / 9, mode="valid")
    bend = np.gradient(np.gradient(smooth))
    return max(floor, int(10 ** smooth[int(np.argmin(bend))]))


def dense_ids(edges: DataFrame) -> DataFrame:
    """(umi, node): identifiers numbered from 0 in order.

    A range partitioning by umi, cut by the size of the input, then a number within the
    partition plus the partitions before it: no single task sees all identifiers.
    """
    spread = endpoints(edges).repartitionByRange(slices(edges), "umi")
    placed = spread.sortWithinPartitions("umi").withColumn("at", F.monotonically_increasing_id())  # partition << 33 | row
    placed = placed.select("umi", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    # Numbered from the values' own ranges, so a repeated run gives the same ids.
    heads = spread.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.count("*").alias("n"), F.min("umi").alias("low"))
    before = F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select("part", F.coalesce(before, F.lit(0)).alias("head"))
    return placed.join(F.broadcast(heads), "part").select("umi", (F.col("head") + F.col("at")).alias("node"))  # a row a partition


def _both_ends(edges: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Edges joined to first(umi1, ...) and second(umi2, ...)."""
    joined = edges.select("umi1", "umi2")
    for column, other in (("umi1", first), ("umi2", second)):
        joined = dealt(joined, column, like=edges).join(dealt(other, column, like=edges), column)
    return joined


def working_edgelist(edges: DataFrame) -> DataFrame:
    """Edges with dense ids in place of identifiers: (node1, node2)."""
    ids = dense_ids(edges)
    first = ids.select(F.col("umi").alias("umi1"), F.col("node").alias("node1"))
    second = ids.select(F.col("umi").alias("umi2"), F.col("node").alias("node2"))
    return _both_ends(edges, first, second).select("node1", "node2")


def crossing_edges(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Edges with the communities of their ends: (umi1, umi2, c1, c2, crossing)."""
    first = communities.select(F.col("umi").alias("umi1"), F.col("community").alias("c1"))
    second = communities.select(F.col("umi").alias("umi2"), F.col("community").alias("c2"))
    joined = _both_ends(edges, first, second).select("umi1", "umi2", "c1", "c2")
    return joined.withColumn("crossing", F.col("c1") != F.col("c2"))


def community_pairs(edges: DataFrame, communities: DataFrame, least: int | None, share: float | None, strict: bool = False) -> DataFrame:
    """Pairs of communities with many crossing edges: at least (or more than) the larger
    of ``least`` and ``share`` of the smaller community. Without limits, none."""
    crossing = crossing_edges(edges, communities).where("crossing").select(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b"))
    pairs = dealt(crossing, "a", "b", like=edges).groupBy("a", "b").agg(F.count("*").alias("n_crossing"))
    if least is None and share is None:
        return pairs.limit(0)
    reaches = lambda limit: F.col("n_crossing") > limit if strict else F.col("n_crossing") >= limit
    pairs = pairs.where(reaches(F.lit(float(least or 0))))
    if not share:
        return pairs
    sizes = communities.groupBy("community").agg(F.count("*").alias("size"))
    for end in "ab":
        of = sizes.select(F.col("community").alias(end), F.col("size").alias(f"size_{end}"))
        pairs = finely(pairs, end, like=edges).join(finely(of, end, like=edges), end)
    return pairs.where(reaches(F.lit(float(share)) * F.least("size_a", "size_b"))).select("a", "b", "n_crossing")


def normalize_edgelist(edges: DataFrame) -> DataFrame:
    """Columns of older files under their present names."""
    renamed = {"marker1": "marker_1", "marker2": "marker_2"}
    return edges.withColumnsRenamed({old: new for old, new in renamed.items() if old in edges.columns})
