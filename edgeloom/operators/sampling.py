"""Sample calling from hashing antibodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.edges import nodes, remove_nodes
from edgeloom.operators.graph import stranded_nodes


def hash_mapping(samples: DataFrame, antibodies: DataFrame) -> DataFrame:
    """(antibody, sample): an antibody belongs to the sample whose ``-hash_index`` ends its name; null
    where none. Raises where one antibody fits two samples."""
    # Every ending after a dash, so that the match is an equality join.
    parts = F.split("antibody", "-")
    endings = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat_ws("-", F.slice(parts, i, F.size(parts))))
    ended = antibodies.select("antibody", F.explode_outer(F.when(F.size(parts) > 1, endings)).alias("hash_index"))
    joined = ended.join(samples.select("sample", F.col("hash_index").cast("string").alias("hash_index")), "hash_index", "left").select("antibody", "sample").distinct()
    known = joined.where("sample IS NOT NULL")
    joined = known.unionByName(joined.join(known, "antibody", "left_anti"))
    twice = joined.groupBy("antibody").agg(F.count("sample").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"antibodies of several samples: {sorted(r['antibody'] for r in twice)}")
    return joined


def call_samples(counts: DataFrame, mapping: DataFrame, threshold: float = 10.0, undetermined: str = "undetermined") -> DataFrame:
    """(component, called_sample, hash_enrichment_factor).

    Hash counts are summed per sample, unmapped antibodies as undetermined. The
    factor is the largest over the second largest (the largest where the second
    is 0; 0 where all are). Ties go to the sample first by name, undetermined last.
    """
    mapped = mapping.select(F.col("antibody").alias("marker"), F.coalesce("sample", F.lit(undetermined)).alias("called"))
    names = mapped.select("called").distinct().unionByName(mapped.sparkSession.createDataFrame([(undetermined,)], "called string")).distinct()
    sums = counts.join(mapped, "marker").groupBy("component", "called").agg(F.sum("count").alias("n"))
    cells = counts.select("component").distinct().crossJoin(names)  # a few sample names
    cells = cells.join(sums, ["component", "called"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("component").orderBy(F.col("n").desc(), F.col("called") == undetermined, "called")
    ranked = cells.withColumn("r", F.row_number().over(order)).where("r <= 2")
    top = ranked.groupBy("component").agg(
        F.max(F.when(F.col("r") == 1, F.col("called"))).alias("best"), F.max(F.when(F.col("r") == 1, F.col("n"))).alias("n1"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("n"))), F.lit(0)).alias("n2")
    )
    factor = F.when(F.col("n1") == 0, 0.0).when(F.col("n2") == 0, F.col("n1").cast("double")).otherwise(F.col("n1") / F.col("n2"))
    top = top.withColumn("hash_enrichment_factor", factor)
    return top.select("component", F.when(F.col("hash_enrichment_factor") < threshold, undetermined).otherwise(F.col("best")).alias("called_sample"), "hash_enrichment_factor")


def dehash(edges: DataFrame, hashing: list[str]) -> DataFrame:
    """Edges whose known hashing markers lose their ``-number`` ending; others keep theirs."""
    out = edges
    for c in ("marker_1", "marker_2"):
        out = out.withColumn(c, F.when(F.col(c).isin(hashing), F.regexp_replace(c, r"-\d+$", "")).otherwise(F.col(c)))
    return out


def incompatible_nodes(edges: DataFrame, hashing: list[str], own: list[str]) -> DataFrame:
    """(umi, cause): nodes with hashing markers of other samples, and nodes stranded without them."""
    other = [m for m in hashing if m not in own]
    wrong = nodes(edges).where(F.col("marker").isin(other)).select("umi").distinct()
    left = remove_nodes(edges, wrong)
    stranded = stranded_nodes(left).select("umi").distinct()
    return wrong.withColumn("cause", F.lit("incompatible_hash")).unionByName(stranded.withColumn("cause", F.lit("stranded")))


def removal_summary(removed: DataFrame) -> DataFrame:
    """Removed nodes per component, one column a cause."""
    return removed.groupBy("component").pivot("cause", ["incompatible_hash", "stranded"]).count().fillna(0)
