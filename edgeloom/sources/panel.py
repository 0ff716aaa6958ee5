"""Antibody panels: CSV files under a commented header of ``key: value`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("marker_id", "control", "sequence_1", "sequence_2")


def read_panel(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(panel, header). ``control`` becomes boolean; a faulty panel raises one error with all faults."""
    raw = spark.read.option("header", True).option("comment", "#").csv(path)
    head = spark.read.text(path).where(F.col("value").startswith("# ") & F.contains("value", F.lit(":")))
    fields = [r["value"][2:].split(":", 1) for r in head.limit(200).collect()]
    header = {k.strip(): v.strip().strip("'\"") for k, v in fields}
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"panel lacks {missing}")
    faults = validate_panel(raw)
    if faults:
        raise ValueError("; ".join(faults))
    return raw.withColumn("control", F.lower("control").isin("yes", "true", "1")), header


def validate_panel(panel: DataFrame) -> list[str]:
    bad = panel.agg(
        F.count_if(F.col("marker_id").rlike(r"[_\s]") | F.col("marker_id").isNull()).alias("names"),
        F.count_if(~F.col("sequence_1").rlike("^[ACGT]*$") | ~F.col("sequence_2").rlike("^[ACGT]*$")).alias("sequences"),
        (F.count("marker_id") - F.countDistinct("marker_id")).alias("repeats"),
    ).first()
    texts = {"names": "marker ids that are empty or hold a blank or underscore", "sequences": "sequences with other letters than ACGT", "repeats": "repeated marker ids"}
    return [f"{bad[k]} {t}" for k, t in texts.items() if bad[k]]


def diff_panels(old: DataFrame, new: DataFrame, key: str = "marker_id") -> DataFrame:
    """(key, change): added, removed or changed markers; equal ones are left out."""
    columns = [c for c in old.columns if c != key and c in new.columns]
    a = old.select(F.col(key), F.struct(*columns).alias("a"))
    b = new.select(F.col(key), F.struct(*columns).alias("b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def choose_panel(panels: list[dict], wanted: str) -> dict:
    """Of panels with name, product, aliases and version, the one asked for as ``name``,
    ``name==1.1`` or ``name>=1``: by name, product, then alias; the newest patch.

    Raises where none fits, or several major or minor versions do.
    """
    import re

    m = re.fullmatch(r"\s*([^=<>!~\s]+)\s*(?:(==|>=|<=|>|<)\s*([\d.]+))?\s*", wanted)
    if not m:
        raise ValueError(f"cannot read panel request {wanted!r}")
    name, sign, version = m.groups()
    number = lambda v: tuple(int(x) for x in v.split("."))
    for key in (lambda p: p["name"] == name, lambda p: p.get("product") == name, lambda p: name in p.get("aliases", ())):
        found = [p for p in panels if key(p)]
        if found:
            break
    if sign:
        limit = number(version)
        test = {"==": lambda v: v[: len(limit)] == limit, ">=": lambda v: v >= limit, "<=": lambda v: v[: len(limit)] <= limit, ">": lambda v: v[: len(limit)] > limit, "<": lambda v: v < limit}[sign]
        found = [p for p in found if test(number(p["version"]))]
    if not found:
        raise ValueError(f"no panel fits {wanted!r}")
    if len({number(p["version"])[:2] for p in found}) > 1:
        raise ValueError(f"several versions fit {wanted!r}: {sorted(p['version'] for p in found)}")
    return max(found, key=lambda p: number(p["version"]))
