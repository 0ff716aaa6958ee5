"""More registered queries: stores, filters, recovery, reads, demultiplexing, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgeloom.functions import scalar
from edgeloom.operators import demux, edges, graph, matrix, pixels, reads, recovery, sampling, spatial
from edgeloom.plans import commands
from edgeloom.plans.dataset import Dataset
from edgeloom.plans.proxy import edgelist, pixel_edgelist, raw_edgelist, table
from edgeloom.queries import CELL, COMMUNITY, COMBINED, COUNTS_SQL, CROSSED, GRID_SQL, LINKS_SQL, NODES_SQL, PAIRED, REGION_SQL, WITH_EDGES, WITH_PIXELS, WITH_RAW, _communities, _dna, _regions, combine_collapse, counts_of, dna_sql, query, r6, rounded
from edgeloom.sources import store

SAMPLES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
COLUMNS = "sample, component, umi1, umi2, marker_1, marker_2, read_count, uei_count"


def _scratch(spark, name: str) -> str:
    import uuid

    return f"{graph.shared_folder(spark)}/edgeloom/{name}-{uuid.uuid4().hex}"


# ---- stores and the dataset facade ----------------------------------------


def _stored(spark, sf_dir) -> Dataset:
    """Every sample written as a store of its own and read back."""
    whole = Dataset(graph.cut_lineage(edgelist(spark, sf_dir)))
    names = sorted(whole.samples())
    paths = {n: _scratch(spark, "store") for n in names}
    for n, p in paths.items():
        whole.save(p, n)
    return Dataset.read(spark, [paths[n] for n in names])


@query(WITH_EDGES + f" SELECT {COLUMNS} FROM edgelist")
def store_roundtrip(spark, sf_dir):
    """save, write_edgelist (sorted, zstd), read with names from metadata, edge list scan."""
    return _stored(spark, sf_dir).edgelist().select(*COLUMNS.split(", "))


@query(WITH_EDGES + " SELECT DISTINCT sample, 'sample_name' AS key, sample AS value FROM edgelist")
def store_metadata(spark, sf_dir):
    return _stored(spark, sf_dir).uns().select("sample", "key", "value")


@query(WITH_EDGES + " SELECT sample, component, count(*) AS n_edges FROM edgelist GROUP BY ALL")
def partitioned_roundtrip(spark, sf_dir):
    """A folder per component, found again by partition discovery."""
    path = _scratch(spark, "hive")
    store.write_partitioned(edgelist(spark, sf_dir), path)
    return store.read_partitioned(spark, path).groupBy("sample", "component").agg(F.count("*").alias("n_edges"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def ordered_write_roundtrip(spark, sf_dir):
    path = _scratch(spark, "ordered")
    store.write_in_order(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", path)
    return spark.read.parquet(path)


@query(WITH_EDGES + " SELECT sample, component, umi1, umi2, marker_1, marker_2, read_count, uei_count FROM edgelist WHERE sample IN ('ASIA', 'EUROPE')")
def dataset_filter_samples(spark, sf_dir):
    return Dataset(edgelist(spark, sf_dir)).filter(samples={"ASIA", "EUROPE"}).edgelist()


@query(WITH_EDGES + COUNTS_SQL + " SELECT sample, component, marker, count FROM counts WHERE sample = 'ASIA' AND marker IN ('M1', 'M5')")
def dataset_filter_counts(spark, sf_dir):
    return Dataset(edgelist(spark, sf_dir)).filter(samples="ASIA", markers=["M1", "M5"]).counts()


@query(WITH_EDGES + " SELECT sample, count(*) AS n_edges, count(DISTINCT component) AS n_components FROM edgelist GROUP BY sample")
def dataset_counts(spark, sf_dir):
    return Dataset(edgelist(spark, sf_dir)).edgelist().groupBy("sample").agg(F.count("*").alias("n_edges"), F.countDistinct("component").alias("n_components"))


@query(WITH_EDGES + COUNTS_SQL + f""", c AS (SELECT * FROM counts WHERE sample = 'EUROPE')
  SELECT marker, sum(count)::BIGINT AS antibody_count, count(*) AS components, {r6('sum(count) / (sum(sum(count)) OVER ())::DOUBLE')} AS antibody_pct FROM c GROUP BY marker""")
def dataset_var(spark, sf_dir):
    return rounded(Dataset(edgelist(spark, sf_dir)).filter(samples="EUROPE").var())


@query(WITH_EDGES + COUNTS_SQL + f""", b AS (SELECT {CELL}, count(DISTINCT umi1) AS n_umi1, count(DISTINCT umi2) AS n_umi2, count(*) AS n_edges, sum(read_count)::BIGINT AS reads_in_component FROM edgelist WHERE sample = 'AFRICA' GROUP BY ALL)
  SELECT sample, component, n_umi1, n_umi2, n_edges, reads_in_component, n_umi1 + n_umi2 AS n_umi, n_antibodies, isotype_fraction FROM b JOIN
  (SELECT {CELL}, count(*) AS n_antibodies, {r6("sum(CASE WHEN marker IN ('M0', 'M1') THEN count ELSE 0 END) / sum(count)::DOUBLE")} AS isotype_fraction FROM counts GROUP BY ALL) USING (sample, component)""")
def dataset_obs(spark, sf_dir):
    return rounded(Dataset(edgelist(spark, sf_dir)).filter(samples="AFRICA").obs(["M0", "M1"]))


@query(WITH_EDGES + " SELECT marker_1, count(*) AS n, sum(read_count)::BIGINT AS reads FROM edgelist WHERE read_count > 10 GROUP BY marker_1")
def dataset_own_sql(spark, sf_dir):
    return Dataset(edgelist(spark, sf_dir)).sql("SELECT marker_1, count(*) AS n, sum(read_count) AS reads FROM edgelist WHERE read_count > :least GROUP BY marker_1", least=10)


# ---- recovery -------------------------------------------------------------

SIZES = f", s AS (SELECT {CELL}, count(DISTINCT umi1) + count(DISTINCT umi2) AS n_umi, count(*) AS n_edges FROM edgelist GROUP BY ALL)"


@query(WITH_EDGES + SIZES + f" SELECT count(*) AS component_count, sum(n_umi)::BIGINT AS node_count, sum(n_edges)::BIGINT AS edge_count, {r6('max(n_umi) / sum(n_umi)::DOUBLE')} AS fraction_nodes_in_largest_component FROM s")
def recovery_statistics(spark, sf_dir):
    return rounded(recovery.recovery_statistics(edgelist(spark, sf_dir)))


@query(WITH_EDGES + " SELECT umi1, umi2 FROM edgelist")
def identifiers_back(spark, sf_dir):
    """Dense numbers and back, by strict lookups."""
    e = edgelist(spark, sf_dir)
    ids = graph.cut_lineage(edges.dense_ids(e))
    first, second = (ids.withColumnsRenamed({"umi": f"umi{s}", "node": f"node{s}"}) for s in (1, 2))
    numbered = e.select("umi1", "umi2").join(first, "umi1").join(second, "umi2").select("node1", "node2")
    return recovery.identifiers_back(numbered, ids)


def _middle_size(e) -> int:
    return edges.component_sizes(e).agg(F.ceil(F.percentile("n_umi", F.lit(0.5))).alias("m")).first()["m"]


MIDDLE = ", m AS (SELECT ceil(median(n_umi))::BIGINT AS m FROM s)"


@query(WITH_EDGES + SIZES + MIDDLE + " SELECT (SELECT count(*) FROM s) AS components_before, count(*) AS components_after, min(n_umi) AS smallest, max(n_umi) AS largest, any_value(m) AS lower_limit, 1000000000::BIGINT AS upper_limit FROM s, m WHERE n_umi >= m")
def size_filter_statistics(spark, sf_dir):
    e = edgelist(spark, sf_dir)
    return recovery.filter_sizes(e, (_middle_size(e), 1_000_000_000))[1]


@query(WITH_EDGES + SIZES + ", m AS (SELECT median(n_umi) AS m FROM s) SELECT sample, component, n_umi, n_edges FROM s, m WHERE n_umi < ceil(m)")
def small_components(spark, sf_dir):
    e = edgelist(spark, sf_dir)
    return recovery.prune_small(e, _middle_size(e))[1]


@query(WITH_EDGES + SIZES + ", m AS (SELECT median(n_umi) AS m FROM s) SELECT e.* FROM edgelist e JOIN s USING (sample, component), m WHERE n_umi >= ceil(m)".replace("SELECT e.*", f"SELECT {', '.join('e.' + c for c in COLUMNS.split(', '))}"))
def pruned_edges(spark, sf_dir):
    e = edgelist(spark, sf_dir)
    return recovery.prune_small(e, _middle_size(e))[0]


@query(WITH_EDGES + f""", o AS (SELECT {CELL}, count(DISTINCT umi1) + count(DISTINCT umi2) AS u, count(*) AS e, sum(read_count)::BIGINT AS r FROM edgelist GROUP BY ALL)
  SELECT count(*) AS cells, sum(u)::BIGINT AS total_umis, sum(e)::BIGINT AS total_edges, sum(r)::BIGINT AS total_reads, median(u)::DOUBLE AS median_umis, median(e)::DOUBLE AS median_edges, median(r)::DOUBLE AS median_reads FROM o""")
def graph_statistics(spark, sf_dir):
    return recovery.graph_statistics(matrix.component_metrics(edgelist(spark, sf_dir), ["M0", "M1"]))


@query(f"""WITH m AS (SELECT 'M' || g AS marker_1, 'M' || (o2 % 4) AS marker_2, o1, o2, uei, sum(q) AS q, c1, c2 FROM ({COMBINED}) GROUP BY ALL),
  c AS (SELECT marker_1, marker_2, c1, c2, sum(q)::BIGINT AS r, count(DISTINCT uei) AS u, coalesce(sum(q) FILTER (c1 <> o1 OR c2 <> o2), 0)::BIGINT AS f FROM m GROUP BY ALL)
  SELECT sum(u)::BIGINT AS molecule_count, sum(r)::BIGINT AS read_count, sum(f)::BIGINT AS corrected_read_count FROM c""")
def collapse_totals(spark, sf_dir):
    return recovery.collapse_totals(combine_collapse(spark, sf_dir))


@query(f"""WITH m AS (SELECT 'M' || g AS marker_1, 'M' || (o2 % 4) AS marker_2, o1, o2, uei, sum(q) AS q, c1, c2 FROM ({COMBINED}) GROUP BY ALL),
  c AS (SELECT marker_1, marker_2, c1, c2, sum(q)::BIGINT AS r, count(DISTINCT uei) AS u FROM m GROUP BY ALL)
  SELECT marker_1, count(*) AS edges, sum(r)::BIGINT AS reads, sum(u)::BIGINT AS molecules FROM c GROUP BY marker_1""")
def collapse_statistics_merged(spark, sf_dir):
    """A report for each marker 2, added up by marker 1."""
    combined = graph.cut_lineage(combine_collapse(spark, sf_dir))
    parts = [
        combined.where(F.col("marker_2") == f"M{k}").groupBy("marker_1").agg(F.count("*").alias("edges"), F.sum("read_count").alias("reads"), F.sum("uei_count").alias("molecules")) for k in range(4)
    ]
    return recovery.merge_statistics(parts, ["marker_1"])


@query(WITH_EDGES + COUNTS_SQL + ", k AS (SELECT marker FROM counts WHERE (sample <> 'ASIA' OR marker <> 'M3') GROUP BY marker HAVING count(DISTINCT sample) = 5) SELECT counts.* FROM counts SEMI JOIN k USING (marker) WHERE sample <> 'ASIA' OR marker <> 'M3'")
def concat_counts_inner(spark, sf_dir):
    c = counts_of(spark, sf_dir).where("sample <> 'ASIA' OR marker <> 'M3'")
    return recovery.concat_counts({s: c.where(F.col("sample") == s) for s in SAMPLES}, "inner").select("sample", "component", "marker", "count")


@query(WITH_EDGES + COUNTS_SQL + " SELECT * FROM counts WHERE sample <> 'ASIA' OR marker <> 'M3'")
def concat_counts_outer(spark, sf_dir):
    c = counts_of(spark, sf_dir).where("sample <> 'ASIA' OR marker <> 'M3'")
    return recovery.concat_counts({s: c.where(F.col("sample") == s) for s in SAMPLES}, "outer").select("sample", "component", "marker", "count")


@query(WITH_EDGES + " SELECT sample || '_' || component AS component, sample || '_' || umi1 AS umi1, sample || '_' || umi2 AS umi2 FROM edgelist")
def graph_union(spark, sf_dir):
    e = edgelist(spark, sf_dir)
    return recovery.union_graphs({s: e.where(F.col("sample") == s).select("component", "umi1", "umi2") for s in SAMPLES})


@query(WITH_EDGES + REGION_SQL + GRID_SQL + f", p AS (SELECT a.sample AS sample, a.component AS component, a.marker AS marker_1, b.marker AS marker_2, {r6('corr(a.v, b.v)')} AS pearson {PAIRED}) SELECT * FROM p WHERE pearson IS NOT NULL ORDER BY abs(pearson) DESC, sample, component, marker_1, marker_2 LIMIT 20")
def top_pairs(spark, sf_dir):
    scores = rounded(spatial.colocalization(_regions(spark, sf_dir), ["sample", "component"])).drop("jaccard").where("pearson IS NOT NULL")
    return recovery.top_by_effect(scores, "pearson", 20, ["sample", "component", "marker_1", "marker_2"])


@query(WITH_EDGES + SIZES + " SELECT sample, component, n_umi FROM s ORDER BY n_umi DESC, sample, component LIMIT 10")
def largest_components(spark, sf_dir):
    return edges.component_sizes(edgelist(spark, sf_dir)).select("sample", "component", "n_umi").orderBy(F.col("n_umi").desc(), "sample", "component").limit(10)


@query(WITH_EDGES + REGION_SQL + ", g AS (SELECT sample, component, region, marker, ln(1 + value::DOUBLE) AS value FROM rg)" + GRID_SQL.replace("rg", "g") .replace(", 0) AS v", ", 0.0::DOUBLE) AS v") + f" SELECT a.sample AS sample, a.component AS component, a.marker AS marker_1, b.marker AS marker_2, {r6('corr(a.v, b.v)')} AS pearson {PAIRED}")
def coloc_pearson_log1p(spark, sf_dir):
    regions = _regions(spark, sf_dir).withColumn("value", F.log1p("value"))
    return rounded(spatial.colocalization(regions, ["sample", "component"])).drop("jaccard")


PAIRS_SQL = f", z AS (SELECT community, count(*) AS n FROM com GROUP BY 1), p AS (SELECT least(a.community, b.community) AS a, greatest(a.community, b.community) AS b, count(*) AS n_crossing {CROSSED} WHERE a.community <> b.community GROUP BY 1, 2), q AS (SELECT a, b FROM p WHERE n_crossing >= 4)"


@query(WITH_EDGES.replace("WITH ", "WITH RECURSIVE ", 1) + COMMUNITY + PAIRS_SQL + """, l AS (SELECT a, b FROM q UNION ALL SELECT b, a FROM q), reach(v, c) AS (SELECT community, community FROM z UNION SELECT l.b, r.c FROM reach r JOIN l ON l.a = r.v),
  f AS (SELECT v, min(c) AS c FROM reach GROUP BY v) SELECT umi, f.c AS community FROM com JOIN f ON f.v = com.community""")
def merge_communities(spark, sf_dir):
    e = edgelist(spark, sf_dir)
    return graph.merge_communities(e, _communities(e), 4)


@query(WITH_EDGES + """, u AS (SELECT DISTINCT umi1, umi2 FROM edgelist), w AS (SELECT x.umi1, x.umi2, y.umi1 AS o1 FROM u x JOIN u y ON x.umi2 = y.umi2 AND x.umi1 <> y.umi1),
  t AS (SELECT umi1, o1 FROM w GROUP BY ALL HAVING count(*) >= 2) SELECT DISTINCT umi1, umi2 FROM w SEMI JOIN t USING (umi1, o1)""")
def square_edges(spark, sf_dir):
    return graph.square_edges(edgelist(spark, sf_dir))


@query(WITH_EDGES + NODES_SQL + LINKS_SQL + """, r1 AS (SELECT sample, component, umi, other FROM lk UNION SELECT sample, component, umi, umi FROM nd),
  r2 AS (SELECT DISTINCT a.sample, a.component, a.umi, b.other FROM r1 a JOIN r1 b ON b.sample = a.sample AND b.component = a.component AND b.umi = a.other)
  SELECT r.sample, r.component, n.marker, count(*) AS value FROM r2 r JOIN nd n ON n.sample = r.sample AND n.component = r.component AND n.umi = r.other GROUP BY ALL""")
def khop_counts_2(spark, sf_dir):
    return spatial.hop_counts(edgelist(spark, sf_dir), 2).groupBy("sample", "component", "marker").agg(F.sum("value").alias("value"))


# ---- reads ----------------------------------------------------------------


def _with_n(key: str, length: int):
    return F.substring(F.translate(F.upper(F.md5(F.col(key).cast("string").cast("binary"))), "0123456789ABCDEF", "ACGTNACGTACGTACA"), 1, length)


def with_n_sql(key: str, length: int) -> str:
    return f"substr(translate(upper(md5({key}::VARCHAR)), '0123456789ABCDEF', 'ACGTNACGTACGTACA'), 1, {length})"


LOW = " OR ".join(f"greatest({', '.join(f'{n} - length(replace(substr(s, {lo}, {n}), {b!r}, {chr(39) * 2}))' for b in 'ACGT')}) >= 0.5 * {n}" for lo, n in ((1, 10), (19, 10)))


@query(f"WITH r AS (SELECT c_custkey, {with_n_sql('c_custkey', 28)} AS s FROM customer) SELECT c_custkey, s AS sequence, CASE WHEN length(s) - length(replace(s, 'N', '')) > 2 THEN 'too_many_n' WHEN {LOW} THEN 'low_complexity_umi' END AS reason FROM r")
def reads_filtered(spark, sf_dir):
    r = table(spark, sf_dir, "customer").select("c_custkey", _with_n("c_custkey", 28).alias("sequence"))
    return reads.filter_reads(r, (0, 10), (18, 28), most_n=2, share=0.5)


QUALITY = ("0123456789ABCDEF", "!(/49>?@ABCDEFGI")


@query(f"""WITH q AS (SELECT translate(upper(md5(c_custkey::VARCHAR)), '{QUALITY[0]}', '{QUALITY[1]}') AS q FROM customer), c AS (SELECT unnest(string_split(substr(q, 1, 10), '')) AS a, unnest(string_split(substr(q, 11, 10), '')) AS b FROM q)
  SELECT {r6("count(*) FILTER (a >= '?') / count(*)::DOUBLE")} AS umi, {r6("count(*) FILTER (b >= '?') / count(*)::DOUBLE")} AS pid FROM c""")
def q30_by_region(spark, sf_dir):
    r = table(spark, sf_dir, "customer").select(F.translate(F.upper(F.md5(F.col("c_custkey").cast("string").cast("binary"))), *QUALITY).alias("quality"))
    return rounded(reads.q30_share(r, {"umi": (0, 10), "pid": (10, 20)}))


IDENTIFIED = f"""WITH p AS (SELECT n_name AS marker, {dna_sql('n_nationkey', 6)} AS barcode FROM nation), r AS (SELECT c_custkey, {dna_sql('c_custkey', 6)} AS barcode FROM customer),
  d AS (SELECT c_custkey, marker, hamming(r.barcode, p.barcode) AS d FROM r CROSS JOIN p), b AS (SELECT c_custkey, marker, d FROM d WHERE d <= 1 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d, marker) = 1), i AS (SELECT r.c_custkey, b.marker, b.d FROM r LEFT JOIN b USING (c_custkey))"""


def _identified(spark, sf_dir):
    panel = table(spark, sf_dir, "nation").select(F.col("n_name").alias("marker"), _dna("n_nationkey", 6).alias("barcode"))
    return reads.identify_barcodes(table(spark, sf_dir, "customer").select("c_custkey", _dna("c_custkey", 6).alias("barcode")), panel, "barcode", 1)


@query(IDENTIFIED + " SELECT count(*) FILTER (d = 0) AS exact, count(*) FILTER (d > 0) AS corrected, count(*) FILTER (marker IS NULL) AS missing FROM i")
def barcode_statistics(spark, sf_dir):
    return reads.barcode_statistics(_identified(spark, sf_dir))


@query(IDENTIFIED + " SELECT d::INTEGER AS mismatches, count(*) AS n FROM i WHERE d IS NOT NULL GROUP BY 1")
def barcode_distances(spark, sf_dir):
    return recovery.barcode_distances(_identified(spark, sf_dir))


@query(f"SELECT c_custkey, levenshtein({dna_sql('c_custkey', 12)}, {dna_sql('c_nationkey', 12)})::INTEGER AS distance FROM customer")
def edit_distance(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.edit_distance(_dna("c_custkey", 12), _dna("c_nationkey", 12)).alias("distance"))


def _packed_sql(bits: int, alphabet: str, length: int) -> str:
    s = with_n_sql("c_custkey", length)
    return f"SELECT c_custkey, list_sum(list_transform(range(0, {length}), lambda i: ((strpos('{alphabet}', substr({s}, i::INT + 1, 1)) - 1)::BIGINT << ({bits} * i::INT))))::BIGINT AS packed, {s} AS unpacked FROM customer"


def _packed(spark, sf_dir, bits: int, alphabet: str, length: int):
    t = table(spark, sf_dir, "customer").select("c_custkey", scalar.pack_bits(_with_n("c_custkey", length), alphabet, bits).alias("packed"))
    return t.withColumn("unpacked", scalar.unpack_bits(F.col("packed"), alphabet, bits, length))


@query(_packed_sql(3, "ACGTN", 20))
def three_bit_pack(spark, sf_dir):
    return _packed(spark, sf_dir, 3, "ACGTN", 20)


@query(_packed_sql(4, "ACGTN", 15))
def four_bit_pack(spark, sf_dir):
    return _packed(spark, sf_dir, 4, "ACGTN", 15)


UNIT = "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'K' WHEN 2 THEN 'm' ELSE 'G' END"


@query(f"SELECT p_partkey, p_size || {UNIT} AS text, p_size * CASE p_partkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1e3::DOUBLE WHEN 2 THEN 1e6::DOUBLE ELSE 1e9::DOUBLE END AS size FROM part")
def size_strings(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.expr(UNIT)).alias("text"))
    return t.withColumn("size", scalar.parse_size(F.col("text")))


@query("SELECT o_orderkey, round(x / sqrt(x * x + y * y + z * z), 6) + 0.0 AS x, round(y / sqrt(x * x + y * y + z * z), 6) + 0.0 AS y, round(z / sqrt(x * x + y * y + z * z), 6) + 0.0 AS z FROM (SELECT o_orderkey, (o_orderkey % 7 - 3)::DOUBLE AS x, (o_custkey % 5)::DOUBLE AS y, (o_orderkey % 3 + 1)::DOUBLE AS z FROM orders)")
def sphere_normalisation(spark, sf_dir):
    t = table(spark, sf_dir, "orders")
    x, y, z = ((F.col("o_orderkey") % 7 - 3).cast("double"), (F.col("o_custkey") % 5).cast("double"), (F.col("o_orderkey") % 3 + 1).cast("double"))
    return rounded(t.select("o_orderkey", *[c.alias(n) for c, n in zip(scalar.unit_length(x, y, z), "xyz")]))


# ---- demultiplexing -------------------------------------------------------

ROUTED = "WITH m AS (SELECT 'M' || (l_suppkey % 8) AS marker_1, 'M' || (l_partkey % 8) AS marker_2, l_orderkey AS molecule FROM lineitem)"
GROUPS = {f"M{k}": k % 3 for k in range(8)}


def _molecules(spark, sf_dir):
    mark = lambda c: F.concat(F.lit("M"), (F.col(c) % 8).cast("string"))
    return table(spark, sf_dir, "lineitem").select(mark("l_suppkey").alias("marker_1"), mark("l_partkey").alias("marker_2"), F.col("l_orderkey").alias("molecule"))


def _written(spark, routed):
    path = _scratch(spark, "demux")
    demux.write_groups(routed, path)
    return spark.read.parquet(path).groupBy("part", "grp", "marker_1", "marker_2").agg(F.count("*").alias("n"))


@query(ROUTED + " SELECT part, substr(CASE part WHEN 'm1' THEN marker_1 ELSE marker_2 END, 2)::INTEGER % 3 AS grp, marker_1, marker_2, count(*) AS n FROM m, (VALUES ('m1'), ('m2')) v(part) GROUP BY ALL")
def demux_independent(spark, sf_dir):
    """Written by group, read back by partition discovery."""
    return _written(spark, demux.route(_molecules(spark, sf_dir), GROUPS))


@query(ROUTED + " SELECT 'paired' AS part, (substr(marker_1, 2)::INTEGER % 3 * 3 + substr(marker_2, 2)::INTEGER % 3)::INTEGER AS grp, marker_1, marker_2, count(*) AS n FROM m GROUP BY ALL")
def demux_paired(spark, sf_dir):
    return _written(spark, demux.route(_molecules(spark, sf_dir), GROUPS, "paired"))


# ---- samples, pixels, layouts ---------------------------------------------


@query("""WITH a AS (SELECT 'AB' || n_nationkey || '-' || (n_nationkey % 7) AS antibody FROM nation) SELECT antibody, r_name AS sample FROM a LEFT JOIN region ON ends_with(antibody, '-' || r_regionkey)""")
def hash_mapping(spark, sf_dir):
    key = F.col("n_nationkey")
    antibodies = table(spark, sf_dir, "nation").select(F.concat(F.lit("AB"), key.cast("string"), F.lit("-"), (key % 7).cast("string")).alias("antibody"))
    samples = table(spark, sf_dir, "region").select(F.col("r_name").alias("sample"), F.col("r_regionkey").alias("hash_index"))
    return sampling.hash_mapping(samples, antibodies)


@query("""SELECT 'C' || c_nationkey AS component, count(*) FILTER (c_custkey % 3 = 0) AS incompatible_hash, count(*) FILTER (c_custkey % 3 = 1) AS stranded FROM customer WHERE c_custkey % 3 < 2 GROUP BY 1""")
def removal_summary(spark, sf_dir):
    cause = F.when(F.col("c_custkey") % 3 == 0, "incompatible_hash").when(F.col("c_custkey") % 3 == 1, "stranded")
    removed = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("component"), cause.alias("cause")).where("cause IS NOT NULL")
    return sampling.removal_summary(removed)


@query("""WITH m AS (SELECT 'C' || c_nationkey AS component, c_custkey AS umi, unnest(CASE c_custkey % 4 WHEN 0 THEN ['one_core'] WHEN 1 THEN ['one_core', 'regression'] WHEN 2 THEN ['stranded'] ELSE ['one_core', 'regression', 'stranded'] END) AS method FROM customer),
  s AS (SELECT component, umi, string_agg(method, '+' ORDER BY method) AS methods FROM m GROUP BY ALL) SELECT component, methods, count(*) AS n_nodes FROM s GROUP BY ALL""")
def denoise_mark_summary(spark, sf_dir):
    from edgeloom.operators.denoise import mark_summary

    sets = F.expr("CASE c_custkey % 4 WHEN 0 THEN array('one_core') WHEN 1 THEN array('one_core', 'regression') WHEN 2 THEN array('stranded') ELSE array('one_core', 'regression', 'stranded') END")
    marked = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("component"), F.col("c_custkey").alias("umi"), F.explode(sets).alias("method"))
    return mark_summary(marked, ["one_core", "regression", "stranded"])


@query(WITH_PIXELS + " SELECT component, upia, upib, umi, marker, count FROM edgelist WHERE component IN ('NATION_1', 'NATION_4', 'NATION_7')")
def pixel_filter(spark, sf_dir):
    return pixels.filter_pixels(pixel_edgelist(spark, sf_dir), ["NATION_1", "NATION_4", "NATION_7"])


@query(WITH_PIXELS + """, z AS (SELECT component, upia % 5 AS community, count(*) AS n FROM edgelist GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, community) AS r FROM z)
  SELECT component, coalesce(max(n) FILTER (r = 2), 0) > 0.95 * max(n) FILTER (r = 1) AS is_doublet FROM r GROUP BY component""")
def doublet_marks(spark, sf_dir):
    p = pixel_edgelist(spark, sf_dir)
    return pixels.mark_doublets(p.select("component", (F.col("upia") % 5).alias("community")), 0.95)


LAYOUT_SQL = ", ly AS (SELECT sample, component, umi AS index, CASE umi % 2 WHEN 0 THEN '2d' ELSE '3d' END AS projection, CASE umi % 3 WHEN 0 THEN 'pmds' ELSE 'wpmds' END AS layout FROM nd)"


def _layouts(spark, sf_dir):
    u = F.col("umi")
    return edges.nodes(edgelist(spark, sf_dir)).select(
        "sample", "component", u.alias("index"), F.when(u % 2 == 0, "2d").otherwise("3d").alias("projection"), F.when(u % 3 == 0, "pmds").otherwise("wpmds").alias("layout")
    )


@query(WITH_EDGES + NODES_SQL + LAYOUT_SQL + " SELECT * FROM ly WHERE component IN ('NATION_2', 'NATION_3') AND projection = '3d' AND layout = 'wpmds'")
def layouts_filtered(spark, sf_dir):
    return recovery.filter_layouts(_layouts(spark, sf_dir), component=["NATION_2", "NATION_3"], projection="3d", layout=["wpmds"])


@query(WITH_EDGES + NODES_SQL + LAYOUT_SQL + " SELECT sample, component || '_' || sample AS component, index, projection, layout, CASE WHEN sample = 'ASIA' THEN 1 ELSE 0 END::BIGINT AS M1 FROM ly WHERE sample IN ('ASIA', 'EUROPE')")
def layouts_aggregated(spark, sf_dir):
    """One of the two samples has no column for the marker."""
    ly = _layouts(spark, sf_dir)
    parts = {s: ly.where(F.col("sample") == s).drop("sample") for s in ("ASIA", "EUROPE")}
    return recovery.aggregate_layouts({"ASIA": parts["ASIA"].withColumn("M1", F.lit(1)), "EUROPE": parts["EUROPE"]}, ["M1"])


@query(WITH_RAW + """ SELECT to_json({n_edges: count(*), n_reads: sum(read_count)::BIGINT, n_molecules: sum(uei_count)::BIGINT})::VARCHAR AS value FROM edgelist""")
def json_report(spark, sf_dir):
    e = raw_edgelist(spark, sf_dir)
    return recovery.as_json(e.agg(F.count("*").alias("n_edges"), F.sum("read_count").alias("n_reads"), F.sum("uei_count").alias("n_molecules")))


READS_SQL = f"""WITH r0 AS (SELECT o_orderkey AS name, substr(replace({dna_sql('o_custkey', 24)}, 'AA', 'NN'), 3, 21) AS sequence, substr(md5(o_orderkey::VARCHAR), 3, 21) AS quality FROM orders),
  r AS (SELECT *, list_avg([ascii(c) - 33 FOR c IN string_split(quality, '')]) AS mean, length(sequence) - length(replace(sequence, 'N', '')) AS n FROM r0)"""


@query(READS_SQL + " SELECT sequence, min(name) AS name, arg_min(quality, name) AS quality FROM r WHERE n <= 2 AND mean >= 38 GROUP BY sequence")
def read_quality(spark, sf_dir):
    """Reads trimmed by two bases in front and one behind, filtered by N and mean quality, one of each sequence."""
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.replace(_dna("o_custkey", 24), F.lit("AA"), F.lit("NN")).alias("sequence"), F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 24).alias("quality"))
    return commands.mpx_preqc(r, trim_front=2, trim_tail=1, max_n=2, average_quality=38, dedup=True)
