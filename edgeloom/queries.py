"""Registered queries of the core operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.functions import scalar
from edgeloom.functions.scalar import ERFC
from edgeloom.operators import denoise, edges, graph, matrix, proximity, reads, sampling, spatial, stats
from edgeloom.operators.stored import dealt
from edgeloom.plans.proxy import EDGELIST_SQL, PIXEL_SQL, RAW_SQL, edgelist, pixel_edgelist, raw_edgelist, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CELL = "sample, component"
ISOTYPES = ["M0", "M1"]


def query(sql: str | None = None, name: str | None = None):
    """Register a function under its own name, with its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places (both engines), -0.0 to 0.0."""
    return df.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def as_long(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in columns else F.col(c) for c in df.columns])


WITH_EDGES = "WITH " + EDGELIST_SQL
WITH_RAW = "WITH " + RAW_SQL
WITH_PIXELS = "WITH " + PIXEL_SQL

COUNTS_SQL = """, counts AS (
  SELECT sample, component, marker, sum(n)::BIGINT AS count FROM (
    SELECT sample, component, marker_1 AS marker, count(DISTINCT umi1) AS n FROM edgelist GROUP BY ALL
    UNION ALL SELECT sample, component, marker_2, count(DISTINCT umi2) FROM edgelist GROUP BY ALL) GROUP BY ALL
), cells AS (
  SELECT c.sample, c.component, m.marker, coalesce(x.count, 0)::BIGINT AS count
  FROM (SELECT DISTINCT sample, component FROM counts) c CROSS JOIN (SELECT DISTINCT marker FROM counts) m
  LEFT JOIN counts x ON x.sample = c.sample AND x.component = c.component AND x.marker = m.marker
)"""


def counts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.count_matrix(edgelist(spark, sf_dir))


# ---- edges ----------------------------------------------------------------


@query(WITH_EDGES + """ SELECT count(*) AS n_edges, sum(read_count)::BIGINT AS n_reads, sum(uei_count)::BIGINT AS n_molecules,
  (SELECT count(DISTINCT umi) FROM (SELECT umi1 AS umi FROM edgelist UNION ALL SELECT umi2 FROM edgelist)) AS n_umi FROM edgelist""")
def edge_count_statistics(spark, sf_dir):
    return edges.count_statistics(edgelist(spark, sf_dir))


@query(WITH_EDGES + f" SELECT {CELL}, count(DISTINCT umi1) + count(DISTINCT umi2) AS n_umi, count(*) AS n_edges FROM edgelist GROUP BY ALL")
def component_sizes(spark, sf_dir):
    return edges.component_sizes(edgelist(spark, sf_dir))


@query(WITH_EDGES + f" SELECT n_umi, count(*) AS n_components FROM (SELECT {CELL}, count(DISTINCT umi1) + count(DISTINCT umi2) AS n_umi FROM edgelist GROUP BY ALL) GROUP BY n_umi")
def size_histogram(spark, sf_dir):
    return edges.size_histogram(edgelist(spark, sf_dir))


def _clash_sql(side: int) -> str:
    return WITH_RAW + f" SELECT umi{side} AS umi FROM edgelist GROUP BY 1 HAVING count(DISTINCT marker_{side}) > 1"


@query(_clash_sql(1))
def umi1_marker_clashes(spark, sf_dir):
    return edges.marker_clashes(raw_edgelist(spark, sf_dir), 1)


@query(_clash_sql(2))
def umi2_marker_clashes(spark, sf_dir):
    return edges.marker_clashes(raw_edgelist(spark, sf_dir), 2)


@query(WITH_RAW + " SELECT umi1 AS umi FROM edgelist INTERSECT SELECT umi2 FROM edgelist")
def umi_side_intersection(spark, sf_dir):
    return edges.side_clashes(raw_edgelist(spark, sf_dir))


@query(WITH_RAW + """, bad AS (SELECT umi1 AS umi FROM edgelist GROUP BY 1 HAVING count(DISTINCT marker_1) > 3)
  SELECT * FROM edgelist WHERE umi1 NOT IN (SELECT umi FROM bad) AND umi2 NOT IN (SELECT umi FROM bad)""")
def remove_clashing_umis(spark, sf_dir):
    e = raw_edgelist(spark, sf_dir)
    often = e.groupBy(F.col("umi1").alias("umi")).agg(F.countDistinct("marker_1").alias("n")).where("n > 3").select("umi")
    return edges.remove_nodes(e, often)


@query(WITH_RAW + """ SELECT umi FROM (SELECT umi1 AS umi FROM edgelist GROUP BY 1 HAVING count(DISTINCT marker_1) > 1
  UNION SELECT umi2 FROM edgelist GROUP BY 1 HAVING count(DISTINCT marker_2) > 1
  UNION (SELECT umi1 FROM edgelist INTERSECT SELECT umi2 FROM edgelist))""")
def clashing_umis(spark, sf_dir):
    return edges.clashing(raw_edgelist(spark, sf_dir))


@query(WITH_EDGES + " SELECT * FROM edgelist WHERE read_count >= 25")
def read_count_filter(spark, sf_dir):
    return edges.min_reads(edgelist(spark, sf_dir), 25)


@query(WITH_EDGES + f""", ids AS (SELECT umi, row_number() OVER (ORDER BY umi) - 1 AS node FROM (SELECT umi1 AS umi FROM edgelist UNION SELECT umi2 FROM edgelist))
  SELECT a.node AS node1, b.node AS node2 FROM edgelist JOIN ids a ON a.umi = umi1 JOIN ids b ON b.umi = umi2""")
def working_edgelist(spark, sf_dir):
    return edges.working_edgelist(edgelist(spark, sf_dir))


def _degree_sql(side: int) -> str:
    return WITH_EDGES + f" SELECT degree, count(*) AS n_umi FROM (SELECT umi{side}, count(*) AS degree FROM (SELECT DISTINCT umi1, umi2 FROM edgelist) GROUP BY 1) GROUP BY degree"


@query(_degree_sql(1))
def degree_distribution_umi1(spark, sf_dir):
    return edges.degree_distribution(edgelist(spark, sf_dir), "umi1")


@query(_degree_sql(2))
def degree_distribution_umi2(spark, sf_dir):
    return edges.degree_distribution(edgelist(spark, sf_dir), "umi2")


SIZED = f", s AS (SELECT {CELL}, count(DISTINCT umi1) + count(DISTINCT umi2) AS n FROM edgelist GROUP BY ALL), m AS (SELECT min(n) AS lo, max(n) AS hi FROM s)"


@query(WITH_EDGES + SIZED + " SELECT e.* FROM edgelist e JOIN s USING (sample, component) WHERE n >= 1000 AND n <= 2200")
def component_filter_inclusive(spark, sf_dir):
    return edges.filter_by_size(edgelist(spark, sf_dir), 1000, 2200)


@query(WITH_EDGES + SIZED + " SELECT e.* FROM edgelist e JOIN s USING (sample, component) WHERE n > 1000 AND n < 2200")
def component_filter_exclusive(spark, sf_dir):
    return edges.filter_by_size(edgelist(spark, sf_dir), 1000, 2200, inclusive=False)


COMMUNITY = ", com AS (SELECT umi, umi // 1000 AS community FROM (SELECT umi1 AS umi FROM edgelist UNION SELECT umi2 FROM edgelist))"


def _communities(e: DataFrame) -> DataFrame:
    return edges.endpoints(e).withColumn("community", F.floor(F.col("umi") / 1000).cast("long"))


CROSSED = " FROM edgelist JOIN com a ON a.umi = umi1 JOIN com b ON b.umi = umi2"


@query(WITH_EDGES + COMMUNITY + " SELECT umi1, umi2, a.community AS c1, b.community AS c2, a.community <> b.community AS crossing" + CROSSED)
def crossing_edges(spark, sf_dir):
    e = edgelist(spark, sf_dir)
    return edges.crossing_edges(e, _communities(e))


@query(WITH_EDGES + COMMUNITY + f""", z AS (SELECT community, count(*) AS n FROM com GROUP BY 1),
  p AS (SELECT least(a.community, b.community) AS a, greatest(a.community, b.community) AS b, count(*) AS n_crossing {CROSSED} WHERE a.community <> b.community GROUP BY 1, 2)
  SELECT p.a, p.b, n_crossing FROM p JOIN z x ON x.community = p.a JOIN z y ON y.community = p.b WHERE n_crossing >= greatest(3.0, 0.01 * least(x.n, y.n))""")
def community_pair_counts(spark, sf_dir):
    e = edgelist(spark, sf_dir)
    return edges.community_pairs(e, _communities(e), 3, 0.01)


@query(WITH_EDGES + " SELECT sample, component, umi1, umi2, marker_1, marker_2, read_count, uei_count FROM edgelist")
def sample_union(spark, sf_dir):
    from edgeloom.plans.dataset import union_samples

    full = edgelist(spark, sf_dir)
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return union_samples({s: full.where(F.col("sample") == s).drop("sample") for s in names}).select(*full.columns)


@query(WITH_EDGES + " SELECT component || '_' || sample AS component, sample, umi1, umi2, marker_1, marker_2, read_count, uei_count FROM edgelist")
def sample_aggregate(spark, sf_dir):
    from edgeloom.plans.dataset import aggregate_samples

    e = edgelist(spark, sf_dir)
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return aggregate_samples({s: e.where(F.col("sample") == s).drop("sample") for s in names})


@query(WITH_EDGES + " SELECT * FROM edgelist WHERE sample IN ('ASIA', 'EUROPE') AND component IN ('NATION_2', 'NATION_7', 'NATION_12')")
def dataset_filter_edgelist(spark, sf_dir):
    from edgeloom.plans.dataset import Dataset

    return Dataset(edgelist(spark, sf_dir)).filter(samples=["ASIA", "EUROPE"], components=["NATION_2", "NATION_7", "NATION_12"], markers=["M1"]).edgelist()


# ---- matrix ---------------------------------------------------------------


@query(WITH_EDGES + COUNTS_SQL + " SELECT * FROM counts")
def count_matrix(spark, sf_dir):
    return counts_of(spark, sf_dir)


@query(WITH_EDGES + COUNTS_SQL + f" SELECT {CELL}, " + ", ".join(f"sum(count) FILTER (marker = 'M{i}')::BIGINT AS M{i}" for i in range(8)) + " FROM cells GROUP BY ALL")
def count_matrix_wide(spark, sf_dir):
    return matrix.wide(counts_of(spark, sf_dir), [f"M{i}" for i in range(8)])


@query(WITH_EDGES + COUNTS_SQL + f""", b AS (SELECT {CELL}, count(DISTINCT umi1) AS n_umi1, count(DISTINCT umi2) AS n_umi2, count(*) AS n_edges, sum(read_count)::BIGINT AS reads_in_component FROM edgelist GROUP BY ALL)
  SELECT sample, component, n_umi1, n_umi2, n_edges, reads_in_component, n_umi1 + n_umi2 AS n_umi, n_antibodies, isotype_fraction FROM b JOIN
  (SELECT {CELL}, count(*) AS n_antibodies, {r6("sum(CASE WHEN marker IN ('M0', 'M1') THEN count ELSE 0 END) / sum(count)::DOUBLE")} AS isotype_fraction FROM counts GROUP BY ALL) USING (sample, component)""")
def component_metrics(spark, sf_dir):
    return rounded(matrix.component_metrics(edgelist(spark, sf_dir), ISOTYPES))


@query(WITH_EDGES + COUNTS_SQL + f" SELECT marker, sum(count)::BIGINT AS antibody_count, count(*) AS components, {r6('sum(count) / (sum(sum(count)) OVER ())::DOUBLE')} AS antibody_pct FROM counts GROUP BY marker")
def antibody_metrics(spark, sf_dir):
    return rounded(matrix.antibody_metrics(counts_of(spark, sf_dir)))


TAU_SQL = ", tau AS (SELECT sample, component, (count(*) - sum(count) / max(count)::DOUBLE) / (count(*) - 1) AS tau FROM cells GROUP BY ALL)"


@query(WITH_EDGES + COUNTS_SQL + TAU_SQL + f" SELECT {CELL}, {r6('tau')} AS tau FROM tau")
def tau_specificity(spark, sf_dir):
    return rounded(matrix.tau(counts_of(spark, sf_dir)))


@query(WITH_EDGES + COUNTS_SQL + TAU_SQL + f""", q AS (SELECT median(tau) AS m, quantile_cont(tau, 0.75) - quantile_cont(tau, 0.25) AS i FROM tau)
  SELECT {CELL}, {r6('tau')} AS tau, CASE WHEN tau <= m - 5 * i THEN 'low' WHEN tau >= 0.995 OR tau >= m + 2 * i THEN 'high' ELSE 'normal' END AS tau_type FROM tau, q""")
def call_aggregates(spark, sf_dir):
    return rounded(matrix.call_aggregates(counts_of(spark, sf_dir)))


def _cells_sql(value: str) -> str:
    return WITH_EDGES + COUNTS_SQL + f" SELECT {CELL}, marker, count, {r6(value)} AS value FROM cells"


@query(_cells_sql("ln(1 + count / exp(avg(ln(1 + count)) OVER (PARTITION BY sample, component)))"))
def clr_rows(spark, sf_dir):
    return rounded(matrix.clr(counts_of(spark, sf_dir)))


@query(_cells_sql("ln(1 + count) - avg(ln(1 + count)) OVER (PARTITION BY marker)"))
def clr_centered(spark, sf_dir):
    return rounded(matrix.clr(counts_of(spark, sf_dir), by_component=False, non_negative=False))


@query(_cells_sql("ln(1 + count)"))
def log1p_counts(spark, sf_dir):
    return rounded(matrix.log1p(counts_of(spark, sf_dir)))


@query(_cells_sql("count / (sum(count) OVER (PARTITION BY marker))::DOUBLE"))
def rel_normalize(spark, sf_dir):
    return rounded(matrix.relative(counts_of(spark, sf_dir)))


@query(_cells_sql("count - (sum(count) OVER (PARTITION BY sample, component))::DOUBLE * ((sum(count) OVER (PARTITION BY marker))::DOUBLE / (sum(count) OVER ())::DOUBLE)"))
def rate_diff(spark, sf_dir):
    return rounded(matrix.rate_diff(counts_of(spark, sf_dir))).select("sample", "component", "marker", "count", "value")


# ---- proximity ------------------------------------------------------------

PRESENT_SQL = ", present AS (SELECT sample, component, marker_1 AS marker FROM edgelist UNION SELECT sample, component, marker_2 FROM edgelist)"
OBSERVED_SQL = ", observed AS (SELECT sample, component, least(marker_1, marker_2) AS marker_1, greatest(marker_1, marker_2) AS marker_2, count(*) AS join_count FROM edgelist GROUP BY ALL)"


@query(WITH_EDGES + PRESENT_SQL + OBSERVED_SQL + """ SELECT a.sample, a.component, a.marker AS marker_1, b.marker AS marker_2, coalesce(join_count, 0) AS join_count
  FROM present a JOIN present b ON a.sample = b.sample AND a.component = b.component AND a.marker <= b.marker
  LEFT JOIN observed o ON o.sample = a.sample AND o.component = a.component AND o.marker_1 = a.marker AND o.marker_2 = b.marker""")
def join_counts(spark, sf_dir):
    return proximity.join_counts(edgelist(spark, sf_dir))


@query(WITH_EDGES + COUNTS_SQL + " SELECT * FROM counts WHERE count >= 200")
def min_count_markers(spark, sf_dir):
    return proximity.markers_with(edgelist(spark, sf_dir), 200)


def _erfc_sql(z: str) -> str:
    series = str(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        series = f"({c} + t * {series})"
    return f"(SELECT t * exp(-x * x + {series}) FROM (SELECT 1.0::DOUBLE / (1.0 + 0.5 * x) AS t, x FROM (SELECT abs({z}) / sqrt(2.0::DOUBLE) AS x)))"


def _analytical_sql(markers: str = "") -> str:
    one = f" WHERE marker IN ({markers})" if markers else ""
    both = f" WHERE marker_1 IN ({markers}) AND marker_2 IN ({markers})" if markers else ""
    return (
        WITH_EDGES
        + PRESENT_SQL
        + f""", e AS (SELECT {CELL}, count(*) AS e FROM edgelist GROUP BY ALL),
  f1 AS (SELECT {CELL}, marker, n / (sum(n) OVER (PARTITION BY {CELL}))::DOUBLE AS f FROM (SELECT {CELL}, marker_1 AS marker, count(DISTINCT umi1) AS n FROM edgelist GROUP BY 1, 2, 3)),
  f2 AS (SELECT {CELL}, marker, n / (sum(n) OVER (PARTITION BY {CELL}))::DOUBLE AS f FROM (SELECT {CELL}, marker_2 AS marker, count(DISTINCT umi2) AS n FROM edgelist GROUP BY 1, 2, 3)),
  a AS (SELECT p.*, coalesce(f, 0) AS f FROM present p LEFT JOIN f1 USING (sample, component, marker){one}),
  b AS (SELECT p.*, coalesce(f, 0) AS f FROM present p LEFT JOIN f2 USING (sample, component, marker){one}),
  null_model AS (SELECT a.sample, a.component, least(a.marker, b.marker) AS marker_1, greatest(a.marker, b.marker) AS marker_2,
    sum(a.f * b.f * e) AS mean, greatest(sqrt(sum(a.f * b.f * (1 - a.f * b.f) * e)), 1e-6) AS sd
    FROM a JOIN b ON a.sample = b.sample AND a.component = b.component JOIN e ON e.sample = a.sample AND e.component = a.component GROUP BY ALL),
  observed AS (SELECT {CELL}, least(marker_1, marker_2) AS marker_1, greatest(marker_1, marker_2) AS marker_2, count(*) AS n FROM edgelist{both} GROUP BY 1, 2, 3, 4),
  prox AS (SELECT sample, component, marker_1, marker_2, coalesce(n, 0) AS join_count, mean AS join_count_expected_mean, sd AS join_count_expected_sd,
    (coalesce(n, 0) - mean) / sd AS join_count_z FROM null_model LEFT JOIN observed USING (sample, component, marker_1, marker_2))"""
    )


PROX_COLUMNS = f"{CELL}, marker_1, marker_2, join_count, {r6('join_count_expected_mean')} AS join_count_expected_mean, {r6('join_count_expected_sd')} AS join_count_expected_sd, {r6('join_count_z')} AS join_count_z, {r6(_erfc_sql('join_count_z'))} AS join_count_p"


@query(_analytical_sql() + f" SELECT {PROX_COLUMNS} FROM prox")
def proximity_analytical(spark, sf_dir):
    return rounded(proximity.analytical(edgelist(spark, sf_dir)))


@query(_analytical_sql("'M1', 'M2', 'M5'") + f" SELECT {PROX_COLUMNS} FROM prox")
def proximity_analytical_marker_filter(spark, sf_dir):
    return rounded(proximity.analytical(edgelist(spark, sf_dir), ["M1", "M2", "M5"]))


@query(WITH_EDGES + PRESENT_SQL + f" SELECT sum(m * (m + 1) // 2)::BIGINT AS n_pairs FROM (SELECT {CELL}, count(*) AS m FROM present GROUP BY ALL)")
def proximity_len(spark, sf_dir):
    return proximity.proximity_length(edgelist(spark, sf_dir))


@query(_analytical_sql() + COUNTS_SQL + f""", fr AS (SELECT *, count / (sum(count) OVER (PARTITION BY {CELL}))::DOUBLE AS f FROM cells)
  SELECT p.sample, p.component, p.marker_1, p.marker_2, join_count, a.count AS marker_1_count, {r6('a.f')} AS marker_1_freq, b.count AS marker_2_count, {r6('b.f')} AS marker_2_freq, least(a.count, b.count) AS min_count
  FROM prox p JOIN fr a ON a.sample = p.sample AND a.component = p.component AND a.marker = p.marker_1 JOIN fr b ON b.sample = p.sample AND b.component = p.component AND b.marker = p.marker_2""")
def proximity_with_counts(spark, sf_dir):
    e = edgelist(spark, sf_dir)
    found = proximity.with_marker_counts(proximity.join_counts(e), e)
    return rounded(found).select("sample", "component", "marker_1", "marker_2", "join_count", "marker_1_count", "marker_1_freq", "marker_2_count", "marker_2_freq", "min_count")


@query(_analytical_sql() + f" SELECT {CELL}, marker_1, marker_2, {r6('log2(greatest(join_count, 1)::DOUBLE / greatest(join_count_expected_mean, 1))')} AS log2_ratio FROM prox")
def proximity_log2_ratio(spark, sf_dir):
    return rounded(proximity.with_log2_ratio(proximity.analytical(edgelist(spark, sf_dir)))).select("sample", "component", "marker_1", "marker_2", "log2_ratio")


@query(_analytical_sql() + f""", v AS (SELECT sample, marker_1, marker_2, round(join_count_z, 6) AS v FROM prox), g AS (
    SELECT t.sample AS target, v.marker_1, v.marker_2, v.v, v.sample = 'ASIA' AS is_ref FROM v JOIN (SELECT DISTINCT sample FROM v WHERE sample <> 'ASIA') t ON v.sample IN ('ASIA', t.sample)),
  k AS (SELECT *, rank() OVER (PARTITION BY target, marker_1, marker_2 ORDER BY v) + (count(*) OVER (PARTITION BY target, marker_1, marker_2, v) - 1) / 2.0 AS rk FROM g)
  SELECT marker_1, marker_2, 'ASIA' AS reference, target, (sum(rk) FILTER (is_ref) - count(*) FILTER (is_ref) * (count(*) FILTER (is_ref) + 1) / 2.0)::DOUBLE AS u_stat,
    {r6("(sum(rk) FILTER (is_ref) - count(*) FILTER (is_ref) * (count(*) FILTER (is_ref) + 1) / 2.0)::DOUBLE / (count(*) FILTER (is_ref) * count(*) FILTER (NOT is_ref))")} AS auc,
    {r6("median(v) FILTER (NOT is_ref) - median(v) FILTER (is_ref)")} AS median_diff, {r6("median(v) FILTER (NOT is_ref)")} AS tgt_median, {r6("median(v) FILTER (is_ref)")} AS ref_median,
    count(*) FILTER (is_ref) AS n_ref, count(*) FILTER (NOT is_ref) AS n_tgt FROM k GROUP BY target, marker_1, marker_2""")
def differential_proximity(spark, sf_dir):
    scores = proximity.analytical(edgelist(spark, sf_dir)).withColumn("join_count_z", F.round("join_count_z", 6))
    return rounded(proximity.differential(scores, "sample", "ASIA")).drop("p_value", "p_adjusted")


@query(_analytical_sql() + f""", p AS (SELECT {CELL}, marker_1, marker_2, {_erfc_sql('join_count_z')} AS p FROM prox), k AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS q FROM p)
  SELECT {CELL}, marker_1, marker_2, {r6('least(1.0, min(q) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))')} AS p_adjusted FROM k""")
def bh_adjust(spark, sf_dir):
    scores = proximity.analytical(edgelist(spark, sf_dir))
    return rounded(stats.benjamini_hochberg(scores, "join_count_p")).select("sample", "component", "marker_1", "marker_2", "p_adjusted")


@query(_analytical_sql() + f""", v AS (SELECT sample, marker_1, marker_2, round(join_count_z, 6) AS v FROM prox)
  SELECT a.marker_1, a.marker_2, {r6('median(a.v - b.v)')} AS median_difference FROM v a JOIN v b ON a.marker_1 = b.marker_1 AND a.marker_2 = b.marker_2 AND a.sample = 'ASIA' AND b.sample = 'EUROPE' GROUP BY ALL""")
def wilcoxon_hl(spark, sf_dir):
    scores = proximity.analytical(edgelist(spark, sf_dir)).withColumn("join_count_z", F.round("join_count_z", 6))
    return rounded(stats.hodges_lehmann(scores, ["marker_1", "marker_2"], "sample", "ASIA", "EUROPE", "join_count_z"))


@query(WITH_EDGES + f""" SELECT {r6('avg(read_count)')} AS mean, {r6('stddev_pop(read_count)')} AS std, min(read_count) AS min, quantile_cont(read_count, 0.25)::DOUBLE AS q1, quantile_cont(read_count, 0.5)::DOUBLE AS q2,
  quantile_cont(read_count, 0.75)::DOUBLE AS q3, max(read_count) AS max, count(*) AS count, (quantile_cont(read_count, 0.75) - quantile_cont(read_count, 0.25))::DOUBLE AS iqr FROM edgelist""")
def summary_statistics(spark, sf_dir):
    return rounded(stats.summary(edgelist(spark, sf_dir), "read_count"))


@query(WITH_EDGES + SIZED + " SELECT sample, component, n AS n_umi, row_number() OVER (PARTITION BY sample ORDER BY n DESC, component) AS rank FROM s")
def rank_size(spark, sf_dir):
    sizes = edges.component_sizes(edgelist(spark, sf_dir)).drop("n_edges")
    return as_long(stats.rank_size(sizes, "n_umi", ["sample"], ["component"]), "rank")


# ---- older generation -----------------------------------------------------


@query(WITH_PIXELS + f""", a AS (SELECT component, upia, count(DISTINCT upib) AS d, count(*) AS m FROM edgelist GROUP BY ALL), b AS (SELECT component, upib, count(DISTINCT upia) AS d FROM edgelist GROUP BY ALL),
  x AS (SELECT component, count(DISTINCT upia) AS a_pixels, count(DISTINCT upib) AS b_pixels, count(DISTINCT marker) AS antibodies, count(*) AS molecules, sum(count)::BIGINT AS reads,
    {r6('avg(count)')} AS mean_reads_per_molecule, median(count)::DOUBLE AS median_reads_per_molecule FROM edgelist GROUP BY component),
  y AS (SELECT component, {r6('avg(d)')} AS mean_b_pixels_per_a_pixel, median(d)::DOUBLE AS median_b_pixels_per_a_pixel, {r6('avg(m)')} AS mean_molecules_per_a_pixel, median(m)::DOUBLE AS median_molecules_per_a_pixel FROM a GROUP BY component),
  z AS (SELECT component, {r6('avg(d)')} AS mean_a_pixels_per_b_pixel, median(d)::DOUBLE AS median_a_pixels_per_b_pixel FROM b GROUP BY component)
  SELECT *, a_pixels + b_pixels AS pixels, {r6('a_pixels / b_pixels::DOUBLE')} AS a_pixel_b_pixel_ratio FROM x JOIN y USING (component) JOIN z USING (component)""")
def mpx_components_metrics(spark, sf_dir):
    from edgeloom.operators.pixels import components_metrics

    return rounded(components_metrics(pixel_edgelist(spark, sf_dir)))


@query(WITH_PIXELS + f""", c AS (SELECT component, count(*) AS m, count(DISTINCT upia) + count(DISTINCT upib) AS p FROM edgelist GROUP BY 1), l AS (SELECT * FROM c ORDER BY m DESC, component LIMIT 1)
  SELECT (SELECT count(DISTINCT upia) FROM edgelist) AS a_pixel_count, (SELECT count(DISTINCT upib) FROM edgelist) AS b_pixel_count, (SELECT count(DISTINCT marker) FROM edgelist) AS marker_count,
   (SELECT count(*) FROM edgelist) AS molecule_count, (SELECT sum(count)::BIGINT FROM edgelist) AS read_count, (SELECT count(*) FROM c) AS component_count,
   {r6('l.m / (SELECT sum(m) FROM c)::DOUBLE')} AS fraction_molecules_in_largest_component, {r6('l.p / (SELECT sum(p) FROM c)::DOUBLE')} AS fraction_pixels_in_largest_component FROM l""")
def mpx_edgelist_metrics(spark, sf_dir):
    from edgeloom.operators.pixels import edgelist_metrics

    return rounded(edgelist_metrics(pixel_edgelist(spark, sf_dir)))


@query(WITH_PIXELS + f" SELECT marker, sum(count)::BIGINT AS antibody_count, count(DISTINCT component) AS components, {r6('sum(count) / (sum(sum(count)) OVER ())::DOUBLE')} AS antibody_pct FROM edgelist GROUP BY marker")
def mpx_antibody_metrics(spark, sf_dir):
    from edgeloom.operators.pixels import antibody_metrics

    return rounded(antibody_metrics(pixel_edgelist(spark, sf_dir)))


@query(WITH_PIXELS + " SELECT component, marker, count(*) AS count FROM edgelist GROUP BY ALL")
def mpx_component_antibody_counts(spark, sf_dir):
    from edgeloom.operators.pixels import antibody_counts

    return antibody_counts(pixel_edgelist(spark, sf_dir))


# ---- sample calling -------------------------------------------------------

HASHES = [("M0", "one"), ("M1", "one"), ("M2", "two"), ("M3", None)]


@query(WITH_EDGES + COUNTS_SQL + """, h AS (SELECT component, CASE WHEN marker IN ('M0', 'M1') THEN 'one' WHEN marker = 'M2' THEN 'two' ELSE 'undetermined' END AS called, sum(count) AS n FROM cells WHERE marker IN ('M0', 'M1', 'M2', 'M3') GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, called = 'undetermined', called) AS r FROM h),
  t AS (SELECT component, max(called) FILTER (r = 1) AS best, max(n) FILTER (r = 1) AS a, coalesce(max(n) FILTER (r = 2), 0) AS b FROM k GROUP BY 1),
  f AS (SELECT component, best, CASE WHEN a = 0 THEN 0.0 WHEN b = 0 THEN a::DOUBLE ELSE a / b::DOUBLE END AS f FROM t)
  SELECT component, CASE WHEN f < 1.9 THEN 'undetermined' ELSE best END AS called_sample, round(f, 6) + 0.0 AS hash_enrichment_factor FROM f""")
def sample_calling(spark, sf_dir):
    mapping = spark.createDataFrame(HASHES, "antibody string, sample string")
    return rounded(sampling.call_samples(counts_of(spark, sf_dir), mapping, 1.9))


@query(WITH_EDGES + " SELECT sample, component, umi1, umi2, CASE WHEN marker_1 IN ('M0', 'M1') THEN 'M' ELSE marker_1 || '-2' END AS marker_1, CASE WHEN marker_2 IN ('M0', 'M1') THEN 'M' ELSE marker_2 || '-2' END AS marker_2, read_count, uei_count FROM edgelist")
def dehash_markers(spark, sf_dir):
    e = edgelist(spark, sf_dir)
    for c in ("marker_1", "marker_2"):
        e = e.withColumn(c, F.when(F.col(c).isin("M0", "M1"), F.concat(F.lit("M-"), F.substring(c, 2, 1))).otherwise(F.concat(c, F.lit("-2"))))
    return sampling.dehash(e, ["M-0", "M-1"])


# ---- spatial and graph ----------------------------------------------------

NODES_SQL = ", nd AS (SELECT DISTINCT sample, component, umi1 AS umi, marker_1 AS marker FROM edgelist UNION SELECT DISTINCT sample, component, umi2, marker_2 FROM edgelist)"
LINKS_SQL = ", u AS (SELECT DISTINCT sample, component, umi1, umi2 FROM edgelist), lk AS (SELECT sample, component, umi1 AS umi, umi2 AS other FROM u UNION ALL SELECT sample, component, umi2, umi1 FROM u)"


@query(WITH_EDGES + NODES_SQL + LINKS_SQL + f""" SELECT r.sample, r.component, r.umi, n.marker, count(*) AS value FROM
  (SELECT sample, component, umi, other FROM lk UNION SELECT sample, component, umi, umi FROM nd) r JOIN nd n ON n.sample = r.sample AND n.component = r.component AND n.umi = r.other GROUP BY ALL""")
def khop_counts(spark, sf_dir):
    return spatial.hop_counts(edgelist(spark, sf_dir), 1)


DEGREE_SQL = ", dg AS (SELECT sample, component, umi, count(*) AS d FROM lk GROUP BY ALL)"


@query(WITH_EDGES + NODES_SQL + LINKS_SQL + DEGREE_SQL + f""", mk AS (SELECT sample, component, marker, count(*) AS k FROM nd GROUP BY ALL), sz AS (SELECT sample, component, count(*) AS n FROM nd GROUP BY ALL),
  x AS (SELECT c.sample, c.component, c.umi, m.marker, CASE WHEN c.marker = m.marker THEN ln(2.0::DOUBLE) ELSE 0 END - ln(2.0::DOUBLE) * m.k / sz.n AS x FROM nd c JOIN mk m ON m.sample = c.sample AND m.component = c.component JOIN sz ON sz.sample = c.sample AND sz.component = c.component),
  num AS (SELECT a.sample, a.component, a.marker, sum(a.x * b.x / d.d) AS s FROM lk JOIN dg d ON d.sample = lk.sample AND d.component = lk.component AND d.umi = lk.other
    JOIN x a ON a.sample = lk.sample AND a.component = lk.component AND a.umi = lk.umi JOIN x b ON b.sample = lk.sample AND b.component = lk.component AND b.umi = lk.other AND b.marker = a.marker GROUP BY ALL),
  den AS (SELECT sample, component, marker, sum(x * x) AS q FROM x GROUP BY ALL), w AS (SELECT lk.sample, lk.component, sum(1.0::DOUBLE / d) AS w FROM lk JOIN dg d ON d.sample = lk.sample AND d.component = lk.component AND d.umi = lk.other GROUP BY ALL)
  SELECT num.sample, num.component, num.marker, {r6('n / w * s / q')} AS morans_i FROM num JOIN den USING (sample, component, marker) JOIN w USING (sample, component) JOIN sz USING (sample, component)""")
def morans_i(spark, sf_dir):
    return rounded(spatial.morans_i(edgelist(spark, sf_dir)))


REGION_SQL = ", rg AS (SELECT sample, component, umi1 AS region, marker_2 AS marker, count(*) AS value FROM edgelist GROUP BY ALL), ng AS (SELECT sample, component, count(DISTINCT region) AS n FROM rg GROUP BY ALL), mk AS (SELECT DISTINCT sample, component, marker FROM rg)"


def _regions(spark, sf_dir) -> DataFrame:
    return edgelist(spark, sf_dir).groupBy("sample", "component", F.col("umi1").alias("region"), F.col("marker_2").alias("marker")).agg(F.count("*").alias("value"))


GRID_SQL = ", grid AS (SELECT r.sample, r.component, r.region, m.marker, coalesce(v.value, 0) AS v FROM (SELECT DISTINCT sample, component, region FROM rg) r JOIN mk m ON m.sample = r.sample AND m.component = r.component LEFT JOIN rg v ON v.sample = r.sample AND v.component = r.component AND v.region = r.region AND v.marker = m.marker)"
PAIRED = "FROM grid a JOIN grid b ON a.sample = b.sample AND a.component = b.component AND a.region = b.region AND a.marker < b.marker GROUP BY a.sample, a.component, a.marker, b.marker"


@query(WITH_EDGES + REGION_SQL + GRID_SQL + f" SELECT a.sample AS sample, a.component AS component, a.marker AS marker_1, b.marker AS marker_2, {r6('corr(a.v, b.v)')} AS pearson {PAIRED}")
def coloc_pearson(spark, sf_dir):
    return rounded(spatial.colocalization(_regions(spark, sf_dir), ["sample", "component"])).drop("jaccard")


@query(WITH_EDGES + REGION_SQL + GRID_SQL + f" SELECT a.sample AS sample, a.component AS component, a.marker AS marker_1, b.marker AS marker_2, {r6('count(*) FILTER (a.v > 0 AND b.v > 0) / (count(*) FILTER (a.v > 0 OR b.v > 0))::DOUBLE')} AS jaccard {PAIRED}")
def coloc_jaccard(spark, sf_dir):
    return rounded(spatial.colocalization(_regions(spark, sf_dir), ["sample", "component"])).drop("pearson")


@query(WITH_EDGES + REGION_SQL + """, big AS (SELECT sample, component, region FROM rg GROUP BY ALL HAVING sum(value) > 4), kp AS (SELECT rg.* FROM rg JOIN big USING (sample, component, region)), n AS (SELECT sample, component, count(*) AS n FROM big GROUP BY ALL),
  g AS (SELECT sample, component, marker FROM kp JOIN n USING (sample, component) GROUP BY ALL HAVING sum(value) > 5 AND count(DISTINCT value) + (count(*) < any_value(n))::INT >= 2) SELECT kp.* FROM kp JOIN g USING (sample, component, marker)""")
def region_filters(spark, sf_dir):
    return spatial.filter_regions(_regions(spark, sf_dir), ["sample", "component"], min_region=4, min_marker=5)


@query(WITH_EDGES + NODES_SQL + LINKS_SQL + DEGREE_SQL + f""", w AS (SELECT lk.*, 1.0::DOUBLE / d AS w FROM lk JOIN dg d ON d.sample = lk.sample AND d.component = lk.component AND d.umi = lk.other),
  s AS (SELECT sample, component, umi, sum(w) AS w1, sum(w * w) AS w2 FROM w GROUP BY ALL), lag AS (SELECT w.sample, w.component, w.umi, nd.marker, sum(w) AS lag FROM w JOIN nd ON nd.sample = w.sample AND nd.component = w.component AND nd.umi = w.other GROUP BY ALL),
  mk AS (SELECT sample, component, marker, count(*) AS k FROM nd GROUP BY ALL), sz AS (SELECT sample, component, count(*) - 1.0::DOUBLE AS m FROM nd GROUP BY ALL),
  j AS (SELECT lag.sample, lag.component, lag.umi, lag.marker, lag, w1, w2, m, (k - (own.marker = lag.marker)::INT) / m AS mean FROM lag JOIN s USING (sample, component, umi) JOIN mk USING (sample, component, marker) JOIN sz USING (sample, component) JOIN nd own ON own.sample = lag.sample AND own.component = lag.component AND own.umi = lag.umi)
  SELECT sample, component, umi, marker, {r6('(lag - mean * w1) / sqrt((mean - mean * mean) * (m * w2 - w1 * w1) / (m - 1))')} AS local_g FROM j""")
def local_g(spark, sf_dir):
    return rounded(spatial.local_g(edgelist(spark, sf_dir)))


@query(WITH_EDGES + LINKS_SQL + " SELECT DISTINCT x.sample, x.component, x.umi1 AS a, y.umi1 AS b FROM u x JOIN u y ON x.sample = y.sample AND x.component = y.component AND x.umi2 = y.umi2 AND x.umi1 < y.umi1")
def a_node_projection(spark, sf_dir):
    return spatial.a_projection(edgelist(spark, sf_dir))


FOREST_SQL = """WITH RECURSIVE g AS (SELECT c_nationkey * 1000000000::BIGINT + c_custkey AS a, c_nationkey * 1000000000::BIGINT + c_custkey // 3 AS b FROM customer), l AS (SELECT a, b FROM g UNION ALL SELECT b, a FROM g),
  reach(v, c) AS (SELECT a, a FROM l UNION SELECT l.b, r.c FROM reach r JOIN l ON l.a = r.v)"""


@query(FOREST_SQL + " SELECT v AS node, min(c) AS component FROM reach GROUP BY v")
def connected_components_whole(spark, sf_dir):
    """Every customer is an edge; keys within nations give many components."""
    key = lambda number: F.col("c_nationkey") * F.lit(1_000_000_000).cast("long") + number
    c = table(spark, sf_dir, "customer")
    return graph.connected_components(c.select(key(F.col("c_custkey")).alias("a"), key(F.floor(F.col("c_custkey") / 3).cast("long")).alias("b")))


@query("""WITH RECURSIVE e AS (SELECT n_name AS component, c_custkey * 2 AS umi1, (c_custkey // 40) * 2 + 1 AS umi2 FROM customer JOIN nation ON c_nationkey = n_nationkey),
  n AS (SELECT component, umi1 AS umi FROM e UNION SELECT component, umi2 FROM e), g AS (SELECT DISTINCT umi1, umi2 FROM e), l AS (SELECT umi1 AS a, umi2 AS b FROM g UNION ALL SELECT umi2, umi1 FROM g),
  reach(v, c) AS (SELECT a, a FROM l UNION SELECT l.b, r.c FROM reach r JOIN l ON l.a = r.v), p AS (SELECT v AS umi, min(c) AS part FROM reach GROUP BY v),
  s AS (SELECT component, part, count(*) AS k FROM n JOIN p USING (umi) GROUP BY ALL), m AS (SELECT component, part FROM s QUALIFY row_number() OVER (PARTITION BY component ORDER BY k DESC, part) = 1)
  SELECT component, umi FROM n JOIN p USING (umi) WHERE (component, part) NOT IN (SELECT (component, part) FROM m)""")
def stranded_nodes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    e = c.select(F.col("n_name").alias("component"), (F.col("c_custkey") * 2).alias("umi1"), (F.floor(F.col("c_custkey") / 40).cast("long") * 2 + 1).alias("umi2"))
    return graph.stranded_nodes(e.withColumn("marker_1", F.lit("x")).withColumn("marker_2", F.lit("y")))


@query()
def kcore_summary(spark, sf_dir):
    return rounded(graph.core_summary(edgelist(spark, sf_dir)))


@query(WITH_EDGES + LINKS_SQL + """, wd AS (SELECT x.umi1, y.umi1 AS o, x.umi2 FROM (SELECT DISTINCT umi1, umi2 FROM u) x JOIN (SELECT DISTINCT umi1, umi2 FROM u) y ON x.umi2 = y.umi2 AND x.umi1 <> y.umi1), t AS (SELECT umi1, o FROM wd GROUP BY ALL HAVING count(*) >= 2)
  SELECT DISTINCT umi1, umi2 FROM wd JOIN t USING (umi1, o)""")
def square_edges(spark, sf_dir):
    return graph.square_edges(edgelist(spark, sf_dir))


# ---- reads ----------------------------------------------------------------


def _dna(key: str, length: int) -> Column:
    return F.substring(F.translate(F.upper(F.md5(F.col(key).cast("string").cast("binary"))), "0123456789ABCDEF", "ACGTACGTACGTACGT"), 1, length)


def dna_sql(key: str, length: int) -> str:
    return f"substr(translate(upper(md5({key}::VARCHAR)), '0123456789ABCDEF', 'ACGTACGTACGTACGT'), 1, {length})"


@query(f"SELECT c_custkey, reverse(translate({dna_sql('c_custkey', 28)}, 'ACGTN', 'TGCAN')) AS sequence FROM customer")
def reverse_complement(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.reverse_complement(_dna("c_custkey", 28)).alias("sequence"))


@query(f"SELECT c_custkey, list_sum(list_transform(range(0, 28), lambda i: ((strpos('ACGT', substr({dna_sql('c_custkey', 28)}, i::INT + 1, 1)) - 1)::BIGINT << (2 * i::INT))))::BIGINT AS packed FROM customer")
def two_bit_pack(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.pack_two_bits(_dna("c_custkey", 28)).alias("packed"))


@query(f"""WITH s AS (SELECT c_custkey, {dna_sql('c_custkey', 12)} AS s FROM customer)
  SELECT c_custkey, greatest(12 - length(replace(s, 'A', '')), 12 - length(replace(s, 'C', '')), 12 - length(replace(s, 'G', '')), 12 - length(replace(s, 'T', ''))) >= 0.5 * 12 AS low, (length(s) - length(replace(s, 'T', '')))::INTEGER AS n_t FROM s""")
def low_complexity(spark, sf_dir):
    s = _dna("c_custkey", 12)
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.low_complexity(s, 0.5).alias("low"), scalar.count_base(s, "T").cast("int").alias("n_t"))


@query(f"""WITH p AS (SELECT n_name AS marker, {dna_sql('n_nationkey', 6)} AS barcode FROM nation), r AS (SELECT c_custkey, {dna_sql('c_custkey', 6)} AS barcode FROM customer),
  d AS (SELECT c_custkey, r.barcode, marker, hamming(r.barcode, p.barcode) AS d FROM r CROSS JOIN p), b AS (SELECT c_custkey, marker, d FROM d WHERE d <= 1 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d, marker) = 1)
  SELECT c_custkey, barcode, b.marker, b.d::INTEGER AS mismatches FROM r LEFT JOIN b USING (c_custkey)""")
def barcode_identify(spark, sf_dir):
    panel = table(spark, sf_dir, "nation").select(F.col("n_name").alias("marker"), _dna("n_nationkey", 6).alias("barcode"))
    r = table(spark, sf_dir, "customer").select("c_custkey", _dna("c_custkey", 6).alias("barcode"))
    return reads.identify_barcodes(r, panel, "barcode", 1).select("c_custkey", "barcode", "marker", "mismatches")


@query(f"""WITH s AS (SELECT DISTINCT c_nationkey AS grp, {dna_sql('c_custkey', 6)} AS sequence FROM customer)
  SELECT a.grp, a.sequence AS a, b.sequence AS b, hamming(a.sequence, b.sequence)::INTEGER AS d FROM s a JOIN s b ON a.grp = b.grp AND a.sequence < b.sequence WHERE hamming(a.sequence, b.sequence) <= 1""")
def hamming_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), _dna("c_custkey", 6).alias("sequence"))
    return reads.near_pairs(s, ["grp"], 1)


COLLAPSE_SQL = f"""WITH RECURSIVE s AS (SELECT c_nationkey AS grp, {dna_sql('c_custkey', 6)} AS sequence, sum(1 + c_custkey % 9) AS n FROM customer GROUP BY ALL),
  p AS (SELECT a.grp, a.sequence AS a, b.sequence AS b FROM s a JOIN s b ON a.grp = b.grp AND a.sequence < b.sequence WHERE hamming(a.sequence, b.sequence) <= 1 AND (a.n >= 2 * b.n - 1 OR b.n >= 2 * a.n - 1)),
  l AS (SELECT * FROM p UNION ALL SELECT grp, b, a FROM p), reach(grp, v, c) AS (SELECT grp, sequence, sequence FROM s UNION SELECT r.grp, l.b, r.c FROM reach r JOIN l ON l.grp = r.grp AND l.a = r.v),
  q AS (SELECT grp, v AS sequence, min(c) AS part FROM reach GROUP BY ALL)"""


@query(COLLAPSE_SQL + " SELECT grp, sequence, first_value(sequence) OVER (PARTITION BY grp, part ORDER BY n DESC, sequence) AS representative FROM q JOIN s USING (grp, sequence)")
def collapse_directional(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), _dna("c_custkey", 6).alias("sequence"), (1 + F.col("c_custkey") % 9).alias("read_count"))
    return reads.collapse(s, ["grp"], 1)


COMBINED = "SELECT l_orderkey % 5 AS g, l_orderkey AS o1, l_partkey AS o2, l_suppkey AS uei, l_quantity::BIGINT AS q, l_orderkey // 3 * 3 AS c1, l_partkey // 2 * 2 AS c2 FROM lineitem"


@query(f"""WITH m AS (SELECT 'M' || g AS marker_1, 'M' || (o2 % 4) AS marker_2, o1, o2, uei, sum(q) AS q, c1, c2 FROM ({COMBINED}) GROUP BY ALL)
  SELECT marker_1, marker_2, c1 AS umi1, c2 AS umi2, sum(q)::BIGINT AS read_count, count(DISTINCT uei) AS uei_count, coalesce(sum(q) FILTER (c1 <> o1 OR c2 <> o2), 0)::BIGINT AS corrected_read_count FROM m GROUP BY ALL""")
def combine_collapse(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    keys = {"marker_1": F.concat(F.lit("M"), (F.col("l_orderkey") % 5).cast("string")), "marker_2": F.concat(F.lit("M"), (F.col("l_partkey") % 4).cast("string")), "original_umi1": F.col("l_orderkey"), "original_umi2": F.col("l_partkey"), "uei": F.col("l_suppkey")}
    base = dealt(t, "l_orderkey").groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.sum(F.col("l_quantity").cast("long")).alias("read_count"))
    first = base.withColumn("corrected_umi1", F.floor(F.col("original_umi1") / 3).cast("long") * 3)
    second = base.withColumn("corrected_umi2", F.floor(F.col("original_umi2") / 2).cast("long") * 2)
    return reads.combine_collapsed(first, second)


@query("SELECT l_suppkey % 8 AS marker_1, l_partkey % 8 AS marker_2, l_orderkey AS molecule, count(*) AS read_count FROM lineitem GROUP BY ALL")
def demux_read_counts(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return reads.read_counts(t.select((F.col("l_suppkey") % 8).alias("marker_1"), (F.col("l_partkey") % 8).alias("marker_2"), F.col("l_orderkey").alias("molecule")))


@query("SELECT * FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) = 1")
def representative_top1(spark, sf_dir):
    return reads.most_common(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey")


@query("""WITH a AS (SELECT p_partkey AS marker_id, p_brand AS sequence FROM part), b AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN -1 - p_partkey ELSE p_partkey END AS marker_id, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_brand END AS sequence FROM part)
  SELECT coalesce(a.marker_id, b.marker_id) AS marker_id, CASE WHEN a.marker_id IS NULL THEN 'added' WHEN b.marker_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.marker_id = b.marker_id WHERE a.marker_id IS NULL OR b.marker_id IS NULL OR a.sequence IS DISTINCT FROM b.sequence""")
def panel_diff_whole(spark, sf_dir):
    """Both panels hold every part; one part in four has another key in the second."""
    from edgeloom.sources.panel import diff_panels

    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    a = p.select(key.alias("marker_id"), F.col("p_brand").alias("sequence"))
    b = p.select(F.when(key % 4 == 0, -1 - key).otherwise(key).alias("marker_id"), F.when(key % 5 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("sequence"))
    return diff_panels(a, b)


@query(WITH_EDGES + NODES_SQL + """, ly AS (SELECT DISTINCT sample, component, umi AS index, (umi % 97)::DOUBLE AS x FROM nd) SELECT ly.sample, ly.component, ly.index, ly.x, """ + ", ".join(f"count(*) FILTER (marker = 'M{i}') AS M{i}" for i in range(8)) + " FROM ly LEFT JOIN nd ON nd.sample = ly.sample AND nd.component = ly.component AND nd.umi = ly.index GROUP BY ALL")
def layouts_marker_counts(spark, sf_dir):
    from edgeloom.plans.dataset import layouts_with_markers

    e = edgelist(spark, sf_dir)
    layout = edges.nodes(e).select("sample", "component", F.col("umi").alias("index"), (F.col("umi") % 97).cast("double").alias("x")).distinct()
    return layouts_with_markers(layout, e, [f"M{i}" for i in range(8)])


# ---- seeded and per-component: rows only -----------------------------------


@query()
def proximity_permuted(spark, sf_dir):
    return rounded(proximity.permuted(edgelist(spark, sf_dir), permutations=100, min_count=10))


@query()
def polarization_permuted(spark, sf_dir):
    return rounded(spatial.permuted_morans_i(edgelist(spark, sf_dir), permutations=50))


@query()
def leiden_communities(spark, sf_dir):
    return graph.modularity_communities(edgelist(spark, sf_dir))


@query()
def pmds_layout(spark, sf_dir):
    return rounded(graph.pivot_layout(edgelist(spark, sf_dir), pivots=50, scaled=True), 3)


@query()
def one_core_denoise(spark, sf_dir):
    return denoise.one_core(edgelist(spark, sf_dir))


from edgeloom import catalog  # noqa: E402, F401  registers more of the same
