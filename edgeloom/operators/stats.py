"""Statistics: p-value adjustment, rank tests, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions.scalar import normal_two_sided


def benjamini_hochberg(df: DataFrame, p: str = "p_value", out: str = "p_adjusted") -> DataFrame:
    """q = least of p x n / rank over this and all larger p, at most 1; a NaN or null p stays so
    and counts in n. Tests are one row per marker pair, far fewer than edges."""
    value = F.nanvl(F.col(p), F.lit(None).cast("double"))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    # Ascending rank: null values come last there, so ranks of numbers start at 1.
    rank = F.row_number().over(Window.orderBy(value.asc_nulls_last()))
    ranked = df.withColumn("_v", value).withColumn("_q", value * n / rank).withColumn("_rank", rank)
    least = F.min("_q").over(Window.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn(out, F.when(F.col("_v").isNotNull(), F.least(least, F.lit(1.0)))).drop("_v", "_q", "_rank")


def adjust_p(df: DataFrame, p: str, method: str = "bonferroni", out: str = "p_adjusted") -> DataFrame:
    """bonferroni, sidak, holm, hochberg, fdr_bh, fdr_by or hommel over all rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    if method == "bonferroni":
        return df.withColumn(out, F.least(F.col(p) * n, F.lit(1.0)))
    if method == "sidak":
        return df.withColumn(out, -F.expm1(n * F.log1p(-F.col(p))))
    if method == "fdr_bh":
        return benjamini_hochberg(df, p, out)
    rank = F.row_number().over(Window.orderBy(p))
    ranked = df.withColumn("_n", n).withColumn("_rank", rank)
    up = Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if method == "holm":
        value = F.max((F.col("_n") - F.col("_rank") + 1) * F.col(p)).over(up)
    elif method == "hochberg":
        value = F.min((F.col("_n") - F.col("_rank") + 1) * F.col(p)).over(down)
    elif method == "fdr_by":
        harmonic = F.sum(1.0 / F.col("_rank")).over(Window.partitionBy())
        ranked = ranked.withColumn("_c", harmonic)
        value = F.min(F.col(p) * F.col("_n") * F.col("_c") / F.col("_rank")).over(down)
    elif method == "hommel":
        return _hommel(df, p, out)
    else:
        raise ValueError(f"unknown method {method}")
    return ranked.withColumn(out, F.least(value, F.lit(1.0))).drop("_n", "_rank", "_c")


def _hommel(df: DataFrame, p: str, out: str) -> DataFrame:
    """Hommel's closed test. Its recursion is over the sorted list, which goes to one Arrow group."""
    import numpy as np
    import pandas as pd

    schema = f"{', '.join(f'{n} {t}' for n, t in df.dtypes)}, {out} double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf[p].to_numpy()
        n, order = len(values), np.argsort(values)
        a = values[order].copy()
        for m in range(n, 1, -1):
            top = np.arange(n - m, n)
            bound = m * values[order][top] / np.arange(1, m + 1)
            least = bound.min()
            a[top] = np.maximum(a[top], least)
            low = np.arange(n - m)
            a[low] = np.maximum(a[low], np.minimum(least, m * values[order][low]))
        back = np.empty(n)
        back[order] = np.minimum(a, 1.0)
        return pdf.drop(columns="_all").assign(**{out: back})

    return df.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, schema)


def mann_whitney(df: DataFrame, by: list[str], contrast: str, reference: str, metric: str) -> DataFrame:
    """U of the reference, two-sided p (normal, tie and continuity corrected), AUC and medians
    per group and target. Ranks are average ranks within group and target."""
    targets = df.where(F.col(contrast) != reference).select(F.col(contrast).alias("target")).distinct()
    ref = df.where(F.col(contrast) == reference).select(*by, F.col(metric).alias("v"), F.lit(True).alias("is_ref"))
    ref = ref.crossJoin(targets)  # a few target names: each sees the reference rows
    tgt = df.where(F.col(contrast) != reference).select(*by, F.col(metric).alias("v"), F.lit(False).alias("is_ref"), F.col(contrast).alias("target"))
    both = ref.unionByName(tgt)
    group = [*by, "target"]
    tied = both.groupBy(*group, "v").agg(F.count("*").alias("t"), F.count_if("is_ref").alias("t_ref"))
    before = Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2)
    sums = tied.groupBy(*group).agg(
        F.sum("t_ref").alias("n_ref"), (F.sum("t") - F.sum("t_ref")).alias("n_tgt"), F.sum(F.col("rank") * F.col("t_ref")).alias("r_ref"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties")
    )
    medians = both.groupBy(*group).agg(F.median(F.when(F.col("is_ref"), F.col("v"))).alias("ref_median"), F.median(F.when(~F.col("is_ref"), F.col("v"))).alias("tgt_median"))
    n1, n2 = F.col("n_ref"), F.col("n_tgt")
    n = n1 + n2
    u = F.col("r_ref") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(F.col("u_stat") - n1 * n2 / 2.0) - 0.5, F.lit(0.0)) / sd
    return (
        sums.where("n_ref > 0 AND n_tgt > 0")
        .withColumn("u_stat", u)
        .withColumn("p_value", F.when(sd > 0, normal_two_sided(z)).otherwise(1.0))
        .withColumn("auc", F.col("u_stat") / (n1 * n2))
        .join(medians, group)
        .withColumn("median_diff", F.col("tgt_median") - F.col("ref_median"))
        .withColumn("reference", F.lit(reference))
        .select(*by, "reference", "target", "u_stat", "p_value", "auc", "median_diff", "tgt_median", "ref_median", "n_ref", "n_tgt")
    )


def hodges_lehmann(df: DataFrame, by: list[str], contrast: str, reference: str, target: str, metric: str) -> DataFrame:
    """Median of all reference-minus-target differences per group: values are paired within a group."""
    ref = df.where(F.col(contrast) == reference).select(*by, F.col(metric).alias("a"))
    tgt = df.where(F.col(contrast) == target).select(*by, F.col(metric).alias("b"))
    return ref.join(tgt, by).groupBy(*by).agg(F.median(F.col("a") - F.col("b")).alias("median_difference"))


def summary(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """mean, population std, min, quartiles (linear), max, count, iqr."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*(by or [])).agg(
        F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), q.alias("q"), F.max(column).alias("max"), F.count(column).alias("count")
    )
    return out.select(*(by or []), "mean", "std", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "max", "count", (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def rank_size(sizes: DataFrame, size: str, by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Rank 1 for the largest; ties in the order of the given columns."""
    order = Window.partitionBy(*(by or [])).orderBy(F.col(size).desc(), *(ties or []))
    return sizes.withColumn("rank", F.row_number().over(order))
