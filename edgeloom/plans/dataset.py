"""Lazily filtered view of several samples' tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators import matrix, proximity
from edgeloom.operators.edges import nodes, normalize_edgelist


def as_set(value) -> frozenset[str] | None:
    """None, a single name or many, as a set; an empty collection counts as no filter."""
    if value is None:
        return None
    names = frozenset([value] if isinstance(value, str) else value)
    return names or None


def union_samples(tables: dict[str, DataFrame]) -> DataFrame:
    """All rows with their sample's name. Filters on ``sample`` fold away whole branches."""
    named = [df.withColumn("sample", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def aggregate_samples(tables: dict[str, DataFrame]) -> DataFrame:
    """Union whose component names carry their sample; at least two samples."""
    if len(tables) < 2:
        raise ValueError("aggregation needs at least two samples")
    return union_samples(tables).withColumn("component", F.concat_ws("_", "component", "sample"))


def layouts_with_markers(layout: DataFrame, edges: DataFrame, markers: list[str]) -> DataFrame:
    """Layout rows with one count column a marker (0 where the node lacks it)."""
    keys = [c for c in ("sample", "component") if c in layout.columns]
    marked = nodes(edges).groupBy(*keys, F.col("umi").alias("index")).pivot("marker", markers).count()
    return layout.join(marked, [*keys, "index"], "left").fillna(0, markers)


@dataclass(frozen=True)
class Dataset:
    """Tables of one or more samples with pending filters. Nothing runs until a result is used.

    Marker filters act on counts and proximity, never on the edge list or layouts.
    """

    edges: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    active_samples: frozenset[str] | None = None
    active_components: frozenset[str] | None = None
    active_markers: frozenset[str] | None = None

    @classmethod
    def read(cls, spark: SparkSession, paths: str | list[str] | dict[str, str]) -> Dataset:
        """From stores on disk (see sources.store); a list takes sample names from their metadata."""
        from edgeloom.sources.store import read_metadata, read_table, table_names

        if isinstance(paths, str):
            paths = [paths]
        if not isinstance(paths, dict):
            named = [(read_metadata(spark, p).get("sample_name") or p.rstrip("/").rsplit("/", 1)[-1], p) for p in paths]
            if len({n for n, _ in named}) < len(named):
                raise ValueError("sample names are not unique")
            paths = dict(named)
        for name in paths:
            if not name or any(c in name for c in "'\";"):
                raise ValueError(f"not a usable sample name: {name!r}")
        every = {name: table_names(spark, p) for name, p in paths.items()}
        missing = [n for n, t in every.items() if "edgelist" not in t]
        if missing:
            raise ValueError(f"no edgelist table in {missing}")
        rest = set().union(*every.values()) - {"edgelist", "metadata"}
        tables = {t: union_samples({n: read_table(spark, p, t) for n, p in paths.items() if t in every[n]}) for t in rest}
        described = {n: p for n, p in paths.items() if "metadata" in every[n]}
        if described:
            pairs = F.explode(F.from_json("value", "map<string,string>")).alias("key", "value")
            tables["metadata"] = union_samples({n: read_table(spark, p, "metadata").select(pairs) for n, p in described.items()})
        edges = union_samples({n: normalize_edgelist(read_table(spark, p, "edgelist")) for n, p in paths.items()})
        return cls(edges, tables)

    def samples(self) -> set[str]:
        return {r["sample"] for r in self.edgelist().select("sample").distinct().collect()}

    def components(self) -> DataFrame:
        return self.edgelist().select("sample", "component").distinct()

    def markers(self) -> set[str]:
        return {r["m"] for r in self.edges.select(F.explode(F.array("marker_1", "marker_2")).alias("m")).distinct().collect()}

    def filter(self, samples=None, components=None, markers=None, validate: bool = True) -> Dataset:
        """A narrower dataset; unknown names are all reported in one error."""
        new = {"samples": as_set(samples), "components": as_set(components), "markers": as_set(markers)}
        if validate:
            errors = []
            if new["samples"] and (bad := new["samples"] - self.samples()):
                errors.append(f"unknown samples: {sorted(bad)}")
            if new["components"]:
                named = self.edges.sparkSession.createDataFrame([(c,) for c in sorted(new["components"])], "component string")
                bad = [r["component"] for r in named.join(self.components(), "component", "left_anti").collect()]
                if bad:
                    errors.append(f"unknown components: {sorted(bad)}")
            if new["markers"] and (bad := new["markers"] - self.markers()):
                errors.append(f"unknown markers: {sorted(bad)}")
            if errors:
                raise ValueError("; ".join(errors))
        return replace(
            self,
            active_samples=new["samples"] or self.active_samples,
            active_components=new["components"] or self.active_components,
            active_markers=new["markers"] or self.active_markers,
        )

    def _narrow(self, df: DataFrame, markers: list[str] = ()) -> DataFrame:
        if self.active_samples and "sample" in df.columns:
            df = df.where(F.col("sample").isin(*sorted(self.active_samples)))
        if self.active_components and "component" in df.columns:
            df = df.where(F.col("component").isin(*sorted(self.active_components)))
        for column in markers if self.active_markers else ():
            df = df.where(F.col(column).isin(*sorted(self.active_markers)))
        return df

    def edgelist(self) -> DataFrame:
        return self._narrow(self.edges)

    def counts(self) -> DataFrame:
        return self._narrow(matrix.count_matrix(self.edgelist()), ["marker"])

    def layouts(self, markers: bool = False) -> DataFrame:
        found = self._narrow(self.tables["layouts"])
        return layouts_with_markers(found, self.edgelist(), sorted(self.markers())) if markers else found

    def proximity(self, from_edgelist: bool = False, marker_counts: bool = True, log2_ratio: bool = True) -> DataFrame:
        """Stored scores, or analytical ones worked out now (shares over all markers)."""
        if from_edgelist:
            found = proximity.analytical(self.edgelist(), sorted(self.active_markers) if self.active_markers else None)
        else:
            found = self._narrow(self.tables["proximity"], ["marker_1", "marker_2"])
        if marker_counts:
            found = proximity.with_marker_counts(found, self.edgelist())
        return proximity.with_log2_ratio(found) if log2_ratio else found

    def obs(self, isotypes: list[str]) -> DataFrame:
        return matrix.component_metrics(self.edgelist(), isotypes)

    def var(self) -> DataFrame:
        """Marker table: counts, shares and components of each marker."""
        return matrix.antibody_metrics(self.counts())

    def uns(self, key: str | None = None) -> DataFrame:
        """The samples' metadata, as (sample, key, value)."""
        found = self._narrow(self.tables["metadata"])
        return found if key is None else found.where(F.col("key") == key)

    def obsm_names(self) -> list[str]:
        """Names of stored tables with one vector per component."""
        return sorted(n.removeprefix("obsm_") for n in self.tables if n.startswith("obsm_"))

    def obsm(self, name: str) -> DataFrame:
        return self._narrow(self.tables[f"obsm_{name}"])

    def record_batches(self, batch_size: int = 1_000_000):
        """The edge list as Arrow record batches of at most ``batch_size`` rows, a partition at a time."""
        import itertools

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        edges = self.edgelist()
        schema, rows = to_arrow_schema(edges.schema), edges.toLocalIterator(prefetchPartitions=True)
        while part := list(itertools.islice(rows, batch_size)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    def iterate_components(self):
        """(sample, component, edges) of each component in order; use groupBy where all are wanted at once."""
        for row in self.components().orderBy("sample", "component").toLocalIterator():
            yield row["sample"], row["component"], self.edgelist().where((F.col("sample") == row["sample"]) & (F.col("component") == row["component"]))

    def sql(self, text: str, **params) -> DataFrame:
        """A query of one's own over views ``edgelist`` and the other tables."""
        self.edgelist().createOrReplaceTempView("edgelist")
        for name, df in self.tables.items():
            self._narrow(df).createOrReplaceTempView(name)
        return self.edges.sparkSession.sql(text, args=params)

    def save(self, path: str, sample: str, mode: str = "errorifexists") -> None:
        """One sample, filtered, as a store of its own."""
        from edgeloom.sources.store import write_store

        one = self.filter(samples=[sample], validate=False)
        tables = {n: one._narrow(df).drop("sample") for n, df in self.tables.items() if n != "metadata"}
        write_store(self.edges.sparkSession, path, one.edgelist().drop("sample"), tables, {"sample_name": sample}, mode)
