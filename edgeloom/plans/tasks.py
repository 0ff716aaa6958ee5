"""Per-component tasks: a user's function over each component's edges, as a grouped map."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from edgeloom.operators.edges import keys_of


@dataclass(frozen=True)
class ComponentTask:
    """``run`` turns one component's edges (pandas) into rows of ``schema`` (without the
    component keys); ``finish``, if given, transforms all rows together afterwards."""

    name: str
    run: Callable[[pd.DataFrame], pd.DataFrame]
    schema: str
    columns: tuple[str, ...] = ("umi1", "umi2", "marker_1", "marker_2")
    finish: Callable[[DataFrame], DataFrame] | None = None


def run_tasks(edges: DataFrame, tasks: list[ComponentTask]) -> dict[str, DataFrame]:
    """Name to lazily planned result. One shuffle by component per task; Arrow in and out."""
    keys = keys_of(edges)
    out = {}
    for task in tasks:
        schema = ", ".join([*(f"{k} string" for k in keys), task.schema])
        found = edges.select(*keys, *task.columns).groupBy(*keys).applyInPandas(_per_component(task, keys), schema)
        out[task.name] = task.finish(found) if task.finish else found
    return out


def _per_component(task: ComponentTask, keys: list[str]):
    def per(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = task.run(pdf.drop(columns=keys)).copy()
        for k, v in reversed(list(zip(keys, key))):
            rows.insert(0, k, v)
        return rows

    return per
