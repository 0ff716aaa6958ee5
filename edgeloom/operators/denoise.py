"""Denoising: nodes to remove from components, by three methods, and their union."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.edges import keys_of, remove_nodes
from edgeloom.operators.graph import peel, stranded_nodes
from edgeloom.operators.groups import Component, per_component


def _grouped(edges: DataFrame, run) -> DataFrame:
    """run(ids, i, j, marker code, marker names) gives the identifiers to remove."""

    def per(c: Component) -> dict:
        i, j = c.edges()
        c.at1 = c.at2 = None
        return {"umi": run(c.ids, i, j, c.of, c.names)}

    return per_component(edges, per, {"umi": "long"}, marked=True)


def hypergeometric_upper(k: int, marked: int, drawn: int, total: int) -> float:
    """P(X >= k): X of ``drawn`` nodes are marked, of ``marked`` among ``total``."""
    from math import exp, lgamma

    log_choose = lambda n, r: lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1)
    top = min(marked, drawn)
    whole = log_choose(total, drawn)
    return min(1.0, sum(exp(log_choose(marked, x) + log_choose(total - marked, drawn - x) - whole) for x in range(max(k, drawn + marked - total), top + 1)))


def one_core_excess(seen: int, above: int, low: int, high: int, inflate: float = 1.5) -> int:
    """``inflate`` times what a marker has in core 1 beyond core 1's size times its share in higher cores."""
    expected = float(np.round(low * above / high)) if high else 0.0
    return int(np.ceil(inflate * (seen - expected)))


def one_core(edges: DataFrame, ratio: float = 0.9, p: float = 0.05, inflate: float = 1.5, seed: int = 0) -> DataFrame:
    """Nodes of core 1 to remove: for markers over-represented there (Fisher exact, greater),
    ``inflate`` times the excess over what the marker's share in higher cores lets expect
    (rounded), drawn at random. Components whose core-1 share exceeds ``ratio`` are left alone."""

    def run(ids, i, j, of, names):
        core = peel(len(ids), i, j)
        low = core <= 1
        if not low.any() or low.mean() > ratio:
            return ids[:0]
        rng = np.random.default_rng(seed)
        gone = []
        for m in range(len(names)):
            mine = of == m
            seen = int((mine & low).sum())
            excess = min(seen, one_core_excess(seen, int((mine & ~low).sum()), int(low.sum()), int((~low).sum()), inflate))
            if excess > 0 and hypergeometric_upper(seen, int(mine.sum()), int(low.sum()), len(ids)) < p:
                gone.append(rng.choice(np.flatnonzero(mine & low), excess, replace=False))
        return ids[np.sort(np.concatenate(gone))] if gone else ids[:0]

    return _grouped(edges, run)


def core_expansion(edges: DataFrame, k: int = 3, most_core: int = 4) -> DataFrame:
    """Nodes outside a core grown from the seed k-core: a node joins while the share of its walk
    that stays in the core passes a threshold; of the thresholds tried, the one whose core and
    rest differ most in markers (Bray-Curtis) stands."""

    def run(ids, i, j, of, names):
        core = peel(len(ids), i, j)
        seed = core >= min(most_core, max(k, 1), core.max(initial=0))
        if not seed.any() or seed.all():
            return ids[:0]
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        degree = np.maximum(np.bincount(a, minlength=len(ids)), 1)
        best, chosen = -1.0, seed
        for threshold in np.linspace(0.1, 0.9, 9):
            inside = seed.copy()
            while True:
                mass = np.bincount(a, weights=inside[b], minlength=len(ids)) / degree
                more = inside | (mass > threshold)
                if (more == inside).all():
                    break
                inside = more
            if inside.all():
                continue
            x, y = (np.bincount(of[m], minlength=len(names)) / m.sum() for m in (inside, ~inside))
            distance = np.abs(x - y).sum() / (x + y).sum()
            if distance > best:
                best, chosen = distance, inside
        return ids[~chosen]

    return _grouped(edges, run)


def regression(edges: DataFrame, parts: int = 5, cutoff: float = -3.0) -> DataFrame:
    """Nodes whose core number falls far below what their neighbourhood's markers predict: partial
    least squares (NIPALS) of core number on two-hop marker shares, standardised residual below
    ``cutoff``."""

    def run(ids, i, j, of, names):
        core = peel(len(ids), i, j).astype(float)
        if core.std() == 0:
            return ids[:0]
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        x = np.zeros((len(ids), len(names)))
        x[np.arange(len(ids)), of] = 1
        for _ in range(2):
            spread = x.copy()
            np.add.at(spread, a, x[b])
            x = spread
        x = x / x.sum(axis=1, keepdims=True)
        x, y = x - x.mean(axis=0), core - core.mean()
        predicted = np.zeros(len(ids))
        for _ in range(min(parts, x.shape[1])):
            w = x.T @ y
            norm = np.linalg.norm(w)
            if norm < 1e-12:
                break
            t = x @ (w / norm)
            tt = t @ t
            if tt < 1e-12:
                break
            q = (y @ t) / tt
            predicted += q * t
            y = y - q * t
            x = x - np.outer(t, (x.T @ t) / tt)
        rest = core - core.mean() - predicted
        score = rest / rest.std() if rest.std() > 0 else rest
        return ids[score < cutoff]

    return _grouped(edges, run)


def denoise(edges: DataFrame, methods: tuple[str, ...] = ("one_core",), parameters: dict[str, dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cleaned edges, removed nodes with their methods): the union of the methods (with
    the parameters given for each), then the nodes stranded without them."""
    known = {"one_core": one_core, "core_expansion": core_expansion, "regression": regression}
    marked = None
    for m in methods:
        one = known[m](edges, **(parameters or {}).get(m, {})).withColumn("method", F.lit(m))
        marked = one if marked is None else marked.unionByName(one)
    left = remove_nodes(edges, marked.select("umi").distinct())
    marked = marked.unionByName(stranded_nodes(left).withColumn("method", F.lit("stranded")))
    return remove_nodes(edges, marked.select("umi").distinct()), marked


def mark_summary(marked: DataFrame, methods: list[str]) -> DataFrame:
    """Per component: nodes marked by each exact combination of methods."""
    keys = keys_of(marked)
    sets = marked.groupBy(*keys, "umi").agg(F.array_join(F.array_sort(F.collect_set("method")), "+").alias("methods"))
    return sets.groupBy(*keys, "methods").agg(F.count("*").alias("n_nodes"))
