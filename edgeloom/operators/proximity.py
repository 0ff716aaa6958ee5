"""Marker-pair proximity: join counts, analytical and permutation nulls, contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.scalar import log2_ratio, normal_two_sided
from edgeloom.operators.edges import keys_of, nodes
from edgeloom.operators.matrix import count_matrix, dense


def _ordered(a: str, b: str) -> list[F.Column]:
    return [F.least(a, b).alias("marker_1"), F.greatest(a, b).alias("marker_2")]


def observed(edges: DataFrame) -> DataFrame:
    """Edges per unordered marker pair that has any."""
    return edges.groupBy(*keys_of(edges), *_ordered("marker_1", "marker_2")).agg(F.count("*").alias("join_count"))


def join_counts(edges: DataFrame) -> DataFrame:
    """Edges per unordered marker pair, zeros for pairs of markers that occur in the component."""
    keys = keys_of(edges)
    present = edges.select(*keys, F.explode(F.array("marker_1", "marker_2")).alias("marker")).distinct()
    a, b = (present.withColumnRenamed("marker", f"marker_{i}") for i in (1, 2))
    pairs = a.join(b, keys).where("marker_1 <= marker_2")
    return pairs.join(observed(edges), [*keys, "marker_1", "marker_2"], "left").withColumn("join_count", F.coalesce("join_count", F.lit(0)))


def markers_with(edges: DataFrame, least: int) -> DataFrame:
    """Markers of a component with at least ``least`` distinct molecules over both sides."""
    return count_matrix(edges).where(F.col("count") >= least)


def _shares(edges: DataFrame, side: int) -> DataFrame:
    """Share of each marker among a component's distinct molecules of one side."""
    keys = keys_of(edges)
    per = edges.groupBy(*keys, F.col(f"marker_{side}").alias(f"m{side}")).agg(F.countDistinct(f"umi{side}").alias("n"))
    return per.select(*keys, f"m{side}", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias(f"f{side}"))


def analytical(edges: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """Join counts against the null in which both ends draw markers independently.

    Over ordered pairs p = f1 x f2: mean = sum of p x edges, variance = sum of
    p (1 - p) x edges, summed over both orders. Every marker on either side of a
    component takes part, a missing share counting 0. A marker filter acts on
    the pairs, never on the shares.
    """
    keys = keys_of(edges)
    total = edges.groupBy(*keys).agg(F.count("*").alias("e"))
    present = edges.select(*keys, F.explode(F.array("marker_1", "marker_2")).alias("marker")).distinct()
    if markers:
        present = present.where(F.col("marker").isin(markers))
        edges_seen = edges.where(F.col("marker_1").isin(markers) & F.col("marker_2").isin(markers))
    else:
        edges_seen = edges
    first = present.withColumnRenamed("marker", "m1").join(_shares(edges, 1), [*keys, "m1"], "left").fillna(0.0, ["f1"])
    second = present.withColumnRenamed("marker", "m2").join(_shares(edges, 2), [*keys, "m2"], "left").fillna(0.0, ["f2"])
    p = F.col("f1") * F.col("f2")
    cells = first.join(second, keys).join(total, keys).select(*keys, *_ordered("m1", "m2"), (p * F.col("e")).alias("mean"), (p * (1 - p) * F.col("e")).alias("var"))
    null = cells.groupBy(*keys, "marker_1", "marker_2").agg(F.sum("mean").alias("join_count_expected_mean"), F.sqrt(F.sum("var")).alias("sd"))
    # Every observed pair is among the pairs of present markers, so a left join is whole.
    both = null.join(observed(edges_seen), [*keys, "marker_1", "marker_2"], "left").withColumn("join_count", F.coalesce("join_count", F.lit(0)))
    both = both.withColumn("join_count_expected_sd", F.greatest("sd", F.lit(1e-6)))
    z = (F.col("join_count") - F.col("join_count_expected_mean")) / F.col("join_count_expected_sd")
    both = both.withColumn("join_count_z", z).withColumn("join_count_p", normal_two_sided(F.col("join_count_z")))
    return both.select(*keys, "marker_1", "marker_2", "join_count", "join_count_expected_mean", "join_count_expected_sd", "join_count_z", "join_count_p")


def permuted(edges: DataFrame, permutations: int = 100, min_count: int = 0, seed: int = 42) -> DataFrame:
    """Join counts against seeded shuffles of markers over the molecules of each side.

    A component's edges go to one Arrow group: memory is that of one component.
    """
    import zlib

    import numpy as np

    from edgeloom.operators.groups import Component, per_component

    names = ["marker_1", "marker_2", "join_count", "join_count_expected_mean", "join_count_expected_sd", "join_count_z"]

    def run(c: Component) -> dict:
        rng = np.random.default_rng([seed, zlib.crc32("/".join(map(str, c.key)).encode())])
        m = len(c.names)
        # Ranks within each side: a node on both sides has a marker on each.
        sides = [np.zeros(len(c), bool) for _ in range(2)]
        for on, at in zip(sides, (c.at1, c.at2)):
            on[at] = True
        at_a, at_b = (np.cumsum(on, dtype=np.int32)[at] - 1 for on, at in zip(sides, (c.at1, c.at2)))
        of_a, of_b = (c.side[k][on] for k, on in enumerate(sides))
        c.at1 = c.at2 = c.side = None

        def table(x, y):
            flat = np.zeros(m * m, np.int64)
            for lo in range(0, len(at_a), 1 << 20):
                flat += np.bincount(x[at_a[lo : lo + (1 << 20)]].astype(np.int64) * m + y[at_b[lo : lo + (1 << 20)]], minlength=m * m)
            flat = flat.reshape(m, m)
            return flat + flat.T - np.diag(np.diag(flat))

        seen = table(of_a, of_b)
        total = square = np.zeros((m, m))
        for _ in range(permutations):
            t = table(rng.permutation(of_a), rng.permutation(of_b)).astype(float)
            total, square = total + t, square + t * t
        mean = total / permutations
        sd = np.sqrt(np.maximum(square - permutations * mean**2, 0) / max(permutations - 1, 1))
        sd = np.maximum(sd, 1.0)
        often = np.bincount(of_a, minlength=m) + np.bincount(of_b, minlength=m) >= min_count
        i, j = np.triu_indices(m)
        keep = often[i] & often[j]
        i, j = i[keep], j[keep]
        return dict(zip(names, [c.names[i].astype(str), c.names[j].astype(str), seen[i, j], mean[i, j], sd[i, j], (seen[i, j] - mean[i, j]) / sd[i, j]]))

    kinds = ["string", "string", "long", "double", "double", "double"]
    result = per_component(edges, run, dict(zip(names, kinds)), marked=True)
    return result.withColumn("join_count_p", normal_two_sided(F.col("join_count_z")))


def with_marker_counts(proximity: DataFrame, edges: DataFrame) -> DataFrame:
    """Proximity with each marker's count and share in the component, and the smaller count."""
    keys = keys_of(edges)
    counts = dense(count_matrix(edges))
    counts = counts.withColumn("freq", F.col("count") / F.sum("count").over(Window.partitionBy(*keys)))
    out = proximity
    for i in (1, 2):
        one = counts.select(*keys, F.col("marker").alias(f"marker_{i}"), F.col("count").alias(f"marker_{i}_count"), F.col("freq").alias(f"marker_{i}_freq"))
        out = out.join(one, [*keys, f"marker_{i}"], "left")
    return out.withColumn("min_count", F.least("marker_1_count", "marker_2_count"))


def with_log2_ratio(proximity: DataFrame) -> DataFrame:
    return proximity.withColumn("log2_ratio", log2_ratio(F.col("join_count"), F.col("join_count_expected_mean")))


def proximity_length(edges: DataFrame) -> DataFrame:
    """One row: pairs that the proximity table will have, m (m + 1) / 2 per component."""
    keys = keys_of(edges)
    per = edges.select(*keys, F.explode(F.array("marker_1", "marker_2")).alias("marker")).groupBy(*keys).agg(F.countDistinct("marker").alias("m"))
    return per.agg(F.coalesce(F.sum((F.col("m") * (F.col("m") + 1) / 2).cast("long")), F.lit(0)).alias("n_pairs"))


def differential(proximity: DataFrame, contrast: str, reference: str, metric: str = "join_count_z", metric_type: str = "all", min_n_obs: int = 0, adjust: str = "bonferroni") -> DataFrame:
    """Mann-Whitney U of each target against the reference, per marker pair."""
    from edgeloom.operators.stats import adjust_p, mann_whitney

    if contrast not in proximity.columns:
        raise ValueError(f"{contrast} must be a column in the data.")
    rows = proximity
    if metric_type == "self":
        rows = rows.where("marker_1 = marker_2")
    elif metric_type == "co":
        rows = rows.where("marker_1 <> marker_2")
    elif metric_type != "all":
        raise ValueError(f"unknown metric_type {metric_type}")
    found = mann_whitney(rows, ["marker_1", "marker_2"], contrast, reference, metric)
    if min_n_obs > 0:
        found = found.where((F.col("n_ref") > min_n_obs) & (F.col("n_tgt") > min_n_obs))
    return adjust_p(found, "p_value", adjust)


def node_pairs(edges: DataFrame) -> DataFrame:
    """Distinct molecules per component and side: input to shuffles of one's own."""
    return nodes(edges)
