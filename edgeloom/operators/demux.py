"""Demultiplexing: markers dealt to groups of even size, molecules routed and written by group."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def even_groups(sizes: dict[str, int], groups: int) -> dict[str, int]:
    """Greedy number partitioning: the largest marker first, each to the group with least so far
    (ties: smallest group). A panel of markers, so this runs on the driver."""
    if groups < 1:
        raise ValueError("at least one group")
    heap = [(0, g) for g in range(groups)]
    out = {}
    for name in sorted(sizes, key=lambda m: (-sizes[m], m)):
        load, g = heapq.heappop(heap)
        out[name] = g
        heapq.heappush(heap, (load + sizes[name], g))
    return out


def route(molecules: DataFrame, mapping: dict[str, int], strategy: str = "independent") -> DataFrame:
    """molecules(marker_1, marker_2, ...) with ``part`` and ``grp``: by either marker on its own
    (independent: each molecule twice, for marker 1 and marker 2), or by both (paired: once)."""
    table = molecules.sparkSession.createDataFrame(sorted(mapping.items()), "marker string, grp int")
    hint = lambda side: F.broadcast(table.select(F.col("marker").alias(f"marker_{side}"), F.col("grp").alias(f"g{side}")))  # noqa: E731  a panel
    if strategy == "independent":
        sides = [molecules.join(hint(s), f"marker_{s}").select(*molecules.columns, F.lit(f"m{s}").alias("part"), F.col(f"g{s}").alias("grp")) for s in (1, 2)]
        return sides[0].unionByName(sides[1])
    if strategy != "paired":
        raise ValueError(f"unknown strategy {strategy!r}")
    n = max(mapping.values()) + 1
    both = molecules.join(hint(1), "marker_1").join(hint(2), "marker_2")
    return both.select(*molecules.columns, F.lit("paired").alias("part"), (F.col("g1") * n + F.col("g2")).alias("grp"))


def write_groups(routed: DataFrame, path: str) -> None:
    """One folder per part and group; several files where a group is large."""
    routed.write.partitionBy("part", "grp").option("compression", "zstd").parquet(path)


def strategy_of(names: list[str]) -> str:
    """Independent or paired, by the part names that ``write_groups`` used; raises on a mixture."""
    kinds = {"paired" if n.startswith("paired") else "independent" if n.startswith(("m1", "m2")) else "unknown" for n in names}
    if len(kinds) != 1 or "unknown" in kinds:
        raise ValueError(f"cannot tell the demultiplexing strategy from {sorted(names)[:5]}")
    return kinds.pop()
