"""Count matrix in long form, component and marker metrics, transformations.

Zero cells matter to means over markers: ``dense`` lays out every component x
marker cell first. The number of markers is small (a panel), so the skeleton
is components x panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.edges import keys_of, side_totals
from edgeloom.operators.stored import dealt

TAU_HARD, TAU_UPPER_IQR, TAU_LOWER_IQR = 0.995, 2.0, 5.0  # fixed values


def count_matrix(edges: DataFrame, panel: list[str] | None = None) -> DataFrame:
    """(component keys, marker, count): distinct molecules of a marker on both sides."""
    keys = keys_of(edges)
    sides = [
        dealt(edges.select(*keys, F.col(f"marker_{s}").alias("marker"), F.col(f"umi{s}").alias("umi")), "umi", like=edges).distinct().groupBy(*keys, "marker").agg(F.count("umi").alias("count")) for s in (1, 2)
    ]
    both = sides[0].unionByName(sides[1]).groupBy(*keys, "marker").agg(F.sum("count").alias("count"))
    return both.where(F.col("marker").isin(panel)) if panel else both


def dense(counts: DataFrame) -> DataFrame:
    """Every component x marker cell, zeros included."""
    keys = keys_of(counts)
    cells = counts.select(*keys).distinct().crossJoin(F.broadcast(counts.select("marker").distinct()))  # a panel of markers
    return cells.join(counts, [*keys, "marker"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def wide(counts: DataFrame, markers: list[str]) -> DataFrame:
    return counts.groupBy(*keys_of(counts)).pivot("marker", markers).agg(F.sum("count")).fillna(0)


def component_metrics(edges: DataFrame, isotypes: list[str]) -> DataFrame:
    """n_umi1, n_umi2, n_edges, reads_in_component, n_umi, n_antibodies, isotype_fraction per component."""
    keys = keys_of(edges)
    base = side_totals(edges).withColumnRenamed("n_reads", "reads_in_component")
    per_marker = count_matrix(edges).groupBy(*keys).agg(
        F.count_if(F.col("count") > 0).alias("n_antibodies"),
        (F.sum(F.when(F.col("marker").isin(isotypes), F.col("count")).otherwise(0)) / F.sum("count")).alias("isotype_fraction"),
    )
    return base.withColumn("n_umi", F.col("n_umi1") + F.col("n_umi2")).join(per_marker, keys)


def antibody_metrics(counts: DataFrame) -> DataFrame:
    """Per marker: antibody_count, antibody_pct of all, components that have it."""
    per = counts.groupBy("marker").agg(F.sum("count").alias("antibody_count"), F.count_if(F.col("count") > 0).alias("components"))
    return per.withColumn("antibody_pct", F.col("antibody_count") / F.sum("antibody_count").over(Window.partitionBy()))


def tau(counts: DataFrame) -> DataFrame:
    """Specificity of each component: sum of (1 - count / largest) over markers - 1; 0 without counts."""
    cells, keys = dense(counts), keys_of(counts)
    per = cells.groupBy(*keys).agg(F.sum("count").alias("s"), F.max("count").alias("m"), F.count("*").alias("n"))
    return per.select(*keys, F.when(F.col("m") > 0, (F.col("n") - F.col("s") / F.col("m")) / (F.col("n") - 1)).otherwise(0.0).alias("tau"))


def call_aggregates(counts: DataFrame) -> DataFrame:
    """tau with tau_type: high, low or normal against median and interquartile range."""
    scores = tau(counts)
    q = scores.agg(F.percentile("tau", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    spread = F.col("q")[2] - F.col("q")[0]
    limits = q.select((F.col("q")[1] + TAU_UPPER_IQR * spread).alias("upper"), (F.col("q")[1] - TAU_LOWER_IQR * spread).alias("lower"))
    judged = scores.crossJoin(limits)  # with one row of limits
    kind = F.when(F.col("tau") <= F.col("lower"), "low").when((F.col("tau") >= TAU_HARD) | (F.col("tau") >= F.col("upper")), "high").otherwise("normal")
    return judged.select(*keys_of(counts), "tau", kind.alias("tau_type"))


def _over(counts: DataFrame, by_component: bool) -> Window:
    return Window.partitionBy(*(keys_of(counts) if by_component else ["marker"]))


def clr(counts: DataFrame, by_component: bool = True, non_negative: bool = True) -> DataFrame:
    """Centred log ratio with a pseudocount of one, per component or per marker."""
    cells = dense(counts)
    centre = F.avg(F.log1p("count")).over(_over(counts, by_component))
    value = F.log1p(F.col("count") / F.exp(centre)) if non_negative else F.log1p("count") - centre
    return cells.withColumn("value", value)


def log1p(counts: DataFrame) -> DataFrame:
    return dense(counts).withColumn("value", F.log1p("count"))


def relative(counts: DataFrame, by_component: bool = False) -> DataFrame:
    """Share of the marker's (or the component's) total."""
    return dense(counts).withColumn("value", F.col("count") / F.sum("count").over(_over(counts, by_component)))


def rate_diff(counts: DataFrame) -> DataFrame:
    """Count less what the component's total times the marker's overall share would give."""
    cells = dense(counts)
    per_component = F.sum("count").over(_over(counts, True)).cast("double")
    totals = counts.groupBy("marker").agg(F.sum("count").alias("of_marker"))
    totals = totals.withColumn("rate", F.col("of_marker") / F.sum("of_marker").over(Window.partitionBy()))
    return cells.join(totals, "marker").withColumn("value", F.col("count") - per_component * F.col("rate")).drop("of_marker", "rate")


def regress_out(values: DataFrame, value: Column, confounder: Column, by: list[str]) -> DataFrame:
    """Residuals of a least-squares line of value on confounder within each group."""
    w = Window.partitionBy(*by)
    x, y = confounder, value
    slope = F.covar_pop(x, y).over(w) / F.var_pop(x).over(w)
    return values.withColumn("residual", y - F.avg(y).over(w) - F.coalesce(slope, F.lit(0.0)) * (x - F.avg(x).over(w)))
