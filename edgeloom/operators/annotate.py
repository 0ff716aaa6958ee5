"""Cell-type annotation and background-corrected normalisation of count matrices (long form)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.edges import keys_of
from edgeloom.operators.matrix import dense

#: A reference atlas is broadcast only up to this many cells x markers.
REFERENCE_CELLS = 20_000_000


def log_normalize(counts: DataFrame, scale: float = 10_000.0) -> DataFrame:
    """log1p of counts scaled to the same total per component."""
    cells = dense(counts)
    total = F.sum("count").over(Window.partitionBy(*keys_of(counts)))
    return cells.withColumn("value", F.log1p(F.when(total > 0, F.col("count") / total * scale).otherwise(0.0)))


def annotate_cells(counts: DataFrame, reference: pd.DataFrame, labels: pd.Series, neighbours: int = 30, axes: int = 30) -> DataFrame:
    """(component keys, cell_type, share): labels of the nearest reference cells, weighted by
    inverse L1 distance, after log-normalising and projecting on the reference's principal axes.

    reference: cells x markers of log-normalised values. Markers missing on either side are left out.
    """
    if reference.size > REFERENCE_CELLS:
        raise ValueError(f"reference of {reference.size} values; thin it out to {REFERENCE_CELLS}")
    keys = keys_of(counts)
    markers = [m for m in reference.columns if m]
    x = reference.to_numpy(dtype=float)
    mean = x.mean(axis=0)
    _, _, right = np.linalg.svd(x - mean, full_matrices=False)
    right = right[:axes]
    placed = (x - mean) @ right.T
    names, code = np.unique(labels.to_numpy().astype(str), return_inverse=True)
    shared = counts.sparkSession.sparkContext.broadcast((mean, right, placed, code, names))
    values = log_normalize(counts.where(F.col("marker").isin(markers))).groupBy(*keys).pivot("marker", markers).agg(F.first("value")).fillna(0.0)

    def run(batches):
        mean, right, placed, code, names = shared.value
        for pdf in batches:
            at = (pdf[markers].to_numpy(dtype=float) - mean) @ right.T
            found, share = [], []
            for row in at:
                distance = np.abs(placed - row).sum(axis=1)
                near = np.argpartition(distance, min(neighbours, len(distance)) - 1)[:neighbours]
                votes = np.bincount(code[near], weights=1.0 / np.maximum(distance[near], 1e-9), minlength=len(names))
                found.append(str(names[int(votes.argmax())]))
                share.append(float(votes.max() / votes.sum()))
            yield pdf[keys].assign(cell_type=found, share=share)

    schema = f"{', '.join(f'{k} string' for k in keys)}, cell_type string, share double"
    return values.mapInPandas(run, schema)


def summary_label(annotated: DataFrame, cluster: str) -> DataFrame:
    """The most frequent cell type of each cluster (ties: first by name)."""
    tally = annotated.groupBy(cluster, "cell_type").agg(F.count("*").alias("n"))
    order = Window.partitionBy(cluster).orderBy(F.col("n").desc(), "cell_type")
    return tally.withColumn("r", F.row_number().over(order)).where("r = 1").select(cluster, "cell_type")


def background_means(values: DataFrame, rounds: int = 50) -> DataFrame:
    """(marker, background): lower mean of a two-part normal mixture of each marker's values.

    Expectation-maximisation on one marker's values over components, in an Arrow group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["value"].to_numpy()
        low, high = np.quantile(v, [0.25, 0.75])
        spread = np.full(2, max(v.std(), 1e-3))
        mean, weight = np.array([low, high]), np.array([0.5, 0.5])
        for _ in range(rounds):
            density = weight / spread * np.exp(-0.5 * ((v[:, None] - mean) / spread) ** 2) + 1e-300
            share = density / density.sum(axis=1, keepdims=True)
            n = share.sum(axis=0) + 1e-12
            mean = (share * v[:, None]).sum(axis=0) / n
            spread = np.maximum(np.sqrt((share * (v[:, None] - mean) ** 2).sum(axis=0) / n), 1e-3)
            weight = n / len(v)
        return pd.DataFrame({"marker": [pdf["marker"].iloc[0]], "background": [float(mean.min())]})

    return values.select("marker", "value").groupBy("marker").applyInPandas(run, "marker string, background double")


def dsb_normalize(counts: DataFrame, isotypes: list[str]) -> DataFrame:
    """log1p counts less each marker's background mean, less what each component's noise level
    explains: noise is the mean of its isotype controls after background removal, taken out of
    every marker by least squares."""
    keys = keys_of(counts)
    cells = dense(counts).withColumn("value", F.log1p("count"))
    clean = cells.join(F.broadcast(background_means(cells)), "marker").withColumn("value", F.col("value") - F.col("background"))  # one row a marker
    noise = F.avg(F.when(F.col("marker").isin(isotypes), F.col("value"))).over(Window.partitionBy(*keys))
    clean = clean.withColumn("noise", F.coalesce(noise, F.lit(0.0)))
    w = Window.partitionBy("marker")
    slope = F.covar_pop("value", "noise").over(w) / F.var_pop("noise").over(w)
    fit = F.when(F.var_pop("noise").over(w) > 0, slope).otherwise(0.0)
    value = F.col("value") - fit * (F.col("noise") - F.avg("noise").over(w))
    return clean.select(*keys, "marker", "count", value.alias("value"))
