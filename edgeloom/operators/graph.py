"""Graph operators: components, k-core, communities, cycles, naming, layouts.

Whole-graph steps are DataFrame iterations written to the checkpoint folder;
per-component algebra runs in Arrow groups, whose size is one component.
"""

from __future__ import annotations

import tempfile
from array import array
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.edges import crossing_edges, endpoints, keys_of, nodes
from edgeloom.operators.groups import Component, distinct_pairs, per_component
from edgeloom.operators.spatial import links
from edgeloom.operators.stored import BROADCAST_ROWS, cut_lineage, finely, shared_folder  # noqa: F401  catalog takes the folder from here


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b): component is the smallest node.

    Labels spread as minima over neighbours, then each node takes its label's
    label, which halves paths; both repeat until nothing changes.
    """
    pairs = cut_lineage(pairs.select("a", "b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(finely(both, "a", "b").distinct())
    deal = lambda df, column: finely(df, column, like=both)
    labels = cut_lineage(deal(both, "a").groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).withColumnRenamed("a", "node"))
    while True:
        told = deal(both, "b").join(deal(labels.select(F.col("node").alias("b"), "l"), "b"), "b").select("a", "l")
        heard = deal(told, "a").groupBy("a").agg(F.min("l").alias("h"))
        near = deal(labels, "node").join(heard.withColumnRenamed("a", "node"), "node").select("node", "l", F.least("l", "h").alias("n"))
        jump = near.join(labels.select(F.col("node").alias("n"), F.col("l").alias("far")), "n").select("node", "l", F.least("n", "far").alias("n"))
        new = cut_lineage(jump)
        changed = new.where("l <> n").limit(1).count()
        labels = new.select("node", F.col("n").alias("l"))
        if not changed:
            return labels.withColumnRenamed("l", "component")


def edge_components(edges: DataFrame) -> DataFrame:
    """(umi, component) of an edge list."""
    return connected_components(edges.select(F.col("umi1").alias("a"), F.col("umi2").alias("b"))).withColumnRenamed("node", "umi")


def stranded_nodes(edges: DataFrame) -> DataFrame:
    """Nodes outside the largest connected part of their component (ties: smallest node)."""
    keys = keys_of(edges)
    parts = nodes(edges).select(*keys, "umi").distinct().join(edge_components(edges).withColumnRenamed("component", "part"), "umi")
    sizes = parts.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "part")
    main = sizes.withColumn("r", F.row_number().over(order)).where("r = 1").select(*keys, "part")
    return parts.join(main, [*keys, "part"], "left_anti").select(*keys, "umi")


def core_numbers(edges: DataFrame) -> DataFrame:
    """(keys, umi, core): largest k for which the node survives peeling. One component a group."""

    def run(c: Component) -> dict:
        n, ids, pairs = len(c), c.ids, c.edges()
        c.at1 = c.at2 = None
        return {"umi": ids, "core": peel(n, *pairs)}

    return per_component(edges, run, {"umi": edges.schema["umi1"].dataType.simpleString(), "core": "int"})


def local_edges(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(identifiers, ends of the distinct undirected edges, each once) of one component."""
    ids, at = np.unique(np.concatenate([pdf["umi1"], pdf["umi2"]]), return_inverse=True)
    n = len(pdf)
    low, high = np.minimum(at[:n], at[n:]), np.maximum(at[:n], at[n:])
    pair = np.unique(low * len(ids) + high)
    i, j = pair // len(ids), pair % len(ids)
    return ids, i[i != j], j[i != j]


def peel(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Core number of each node: in rounds, drop all nodes of degree below k."""
    core = np.zeros(n, np.int32)
    k = 1
    while len(i):
        degree = np.bincount(i, minlength=n).astype(np.int32)
        degree += np.bincount(j, minlength=n).astype(np.int32)
        low = degree < k
        del degree
        edge = low[i] | low[j]
        if edge.any():
            i, j = i[~edge], j[~edge]
            continue
        core[i] = k
        core[j] = k
        k += 1
    return core


def core_summary(edges: DataFrame) -> DataFrame:
    """Nodes per component and core number, with the average core number."""
    keys = keys_of(edges)
    cores = core_numbers(edges)
    per = cores.groupBy(*keys, "core").agg(F.count("*").alias("n_umi"))
    w = Window.partitionBy(*keys)
    return per.withColumn("average_k_core", F.sum(F.col("core") * F.col("n_umi")).over(w) / F.sum("n_umi").over(w))


def core_layer_counts(edges: DataFrame) -> DataFrame:
    """Per component and marker: nodes in core 1 and nodes in higher cores."""
    keys = keys_of(edges)
    marked = core_numbers(edges).join(nodes(edges).select(*keys, "umi", "marker"), [*keys, "umi"])
    return marked.groupBy(*keys, "marker").agg(F.count_if(F.col("core") <= 1).alias("in_core_1"), F.count_if(F.col("core") > 1).alias("above_core_1"))


def merge_communities(edges: DataFrame, communities: DataFrame, least: int | None = None, share: float | None = None, strict: bool = False) -> DataFrame:
    """Communities joined where many edges cross: (umi, community), the smallest name standing."""
    from edgeloom.operators.edges import community_pairs

    pairs = community_pairs(edges, communities, least, share, strict).select("a", "b")
    merged = connected_components(pairs).select(F.col("node").alias("community"), F.col("component").alias("merged"))
    if merged.count() > BROADCAST_ROWS:
        communities, merged = (finely(df, "community", like=edges) for df in (communities, merged))
    return communities.join(merged, "community", "left").select("umi", F.coalesce("merged", "community").alias("community"))


def label_propagation(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """(umi, community): in each round a node takes the most frequent label among its
    neighbours and itself (ties: smallest). Joins and aggregations only."""
    step = links(edges.select("umi1", "umi2"))
    labels = endpoints(edges.select("umi1", "umi2")).withColumn("community", F.col("umi"))
    for _ in range(rounds):
        votes = step.join(labels.withColumnRenamed("umi", "other"), "other").select("umi", "community").unionByName(labels)
        tally = votes.groupBy("umi", "community").agg(F.count("*").alias("n"))
        labels = cut_lineage(tally.groupBy("umi").agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("community")))
    return labels


def modularity_communities(edges: DataFrame, resolution: float = 1.0, seed: int = 1) -> DataFrame:
    """(keys, umi, community): Leiden-style local moves and aggregation within each component.

    Moves maximise modularity with the given resolution; every community is then
    split into its connected parts, and the graph of communities is moved again.
    Communities are named by their smallest node. One component a group.
    """
    kind = edges.schema["umi1"].dataType.simpleString()

    def run(c: Component) -> dict:
        n, ids, pairs = len(c), c.ids, c.edges()
        c.at1 = c.at2 = None
        found = communities_of(n, *pairs, resolution, seed)
        name = np.full(found.max(initial=0) + 1, n)
        np.minimum.at(name, found, np.arange(n))
        return {"umi": ids, "community": ids[name[found]]}

    return per_component(edges, run, {"umi": kind, "community": kind})


def communities_of(n: int, i: np.ndarray, j: np.ndarray, resolution: float, seed: int, weight: np.ndarray | None = None, inner: np.ndarray | None = None) -> np.ndarray:
    """Community of each of n nodes; ``weight`` of the edges (i, j) and ``inner`` weight of the nodes, where these are communities themselves."""
    rng = np.random.default_rng(seed)
    of = np.arange(n, dtype=np.int32)
    weight = np.ones(len(i)) if weight is None else weight.astype(float)
    size = n
    a, b = i.astype(np.int32), j.astype(np.int32)
    self_weight = np.zeros(n) if inner is None else inner.astype(float)
    while True:
        strength = np.bincount(a, weights=weight, minlength=size) + np.bincount(b, weights=weight, minlength=size) + 2 * self_weight
        total = strength.sum()
        if total == 0:
            return of
        label = _moved(size, a, b, weight, strength, total, resolution, rng)
        # Well-connected communities: each splits into its connected parts.
        inside = label[a] == label[b]
        label = _parts(size, a[inside], b[inside]).astype(np.int32)
        size_new = int(label.max(initial=-1)) + 1
        if size_new == size:
            return np.unique(of, return_inverse=True)[1]
        of = label[of]
        new_self = np.bincount(label, weights=self_weight, minlength=size_new)
        x, y = label[a], label[b]
        new_self += np.bincount(x[x == y], weights=weight[x == y], minlength=size_new)
        cross = x != y
        low, high = np.minimum(x, y)[cross].astype(np.int64), np.maximum(x, y)[cross]
        # Edges between the same communities become one.
        pair, back = np.unique(low * size_new + high, return_inverse=True)
        weight = np.bincount(back, weights=weight[cross], minlength=len(pair))
        a, b = (pair // size_new).astype(np.int32), (pair % size_new).astype(np.int32)
        self_weight, size = new_self, size_new


def _moved(size: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, strength: np.ndarray, total: float, resolution: float, rng) -> np.ndarray:
    """Labels after moves of single nodes, until none raises modularity.

    After one pass over all nodes only those are looked at again that a move touched; when none is
    left, all are, as the mass of a community also bears on nodes further off.
    """
    ends, other = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(ends, kind="stable")
    starts = array("q", np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=size))]).astype(np.int64).tobytes())
    near, weights = array("i", other[order].tobytes()), array("d", np.concatenate([weight, weight])[order].tobytes())
    del ends, other, order
    label, own_strength = array("i", np.arange(size, dtype=np.int32).tobytes()), array("d", strength.tobytes())
    mass, scale = array("d", strength.tobytes()), resolution / total
    while True:
        queue, waiting, moves = deque(array("i", rng.permutation(size).astype(np.int32).tobytes())), bytearray(b"\1") * size, 0
        while queue:
            v = queue.popleft()
            waiting[v] = 0
            lo, hi = starts[v], starts[v + 1]
            own, k = label[v], own_strength[v]
            mass[own] -= k
            gain = {own: 0.0}
            for u, w in zip(near[lo:hi], weights[lo:hi]):
                at = label[u]
                gain[at] = gain.get(at, 0.0) + w
            share = scale * k
            best, most = own, gain[own] - share * mass[own]
            least = most + 1e-12
            for at, g in gain.items():
                value = g - share * mass[at]
                if value > least and (value > most or value == most and at < best):
                    best, most = at, value
            mass[best] += k
            if best != own:
                label[v] = best
                moves += 1
                for u in near[lo:hi]:
                    if not waiting[u] and label[u] != best:
                        waiting[u] = 1
                        queue.append(u)
        if not moves:
            return np.frombuffer(label, np.int32).copy()


def _parts(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Connected parts, numbered densely."""
    root = np.arange(n)
    while len(i):
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return np.unique(root, return_inverse=True)[1]


def square_edges(edges: DataFrame) -> DataFrame:
    """Edges on a cycle of four: (umi1, umi2). Pairs of A nodes with two shared B nodes, by self-join."""
    pairs = edges.select("umi1", "umi2").distinct()
    other = pairs.withColumnRenamed("umi1", "o1")
    wedge = pairs.join(other, "umi2").where("umi1 <> o1")
    twice = wedge.groupBy("umi1", "o1").agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    return wedge.join(twice, ["umi1", "o1"], "left_semi").select("umi1", "umi2").distinct()


def cycle_edges(edges: DataFrame, longest: int = 13, frontier: int = 10_000) -> DataFrame:
    """Edges (umi1, umi2) on a cycle of at most ``longest`` + 1 edges, edges whose search meets more
    than ``frontier`` nodes, and edges outside the 2-core (which lie on no cycle). One component a group."""
    keys = keys_of(edges)
    schema = f"{', '.join(f'{k} string' for k in keys)}, umi1 long, umi2 long, kept boolean"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, i, j = local_edges(pdf)
        core = peel(len(ids), i, j)
        around: list[set[int]] = [set() for _ in ids]
        for x, y in zip(i.tolist(), j.tolist()):
            around[x].add(y)
            around[y].add(x)
        index = {v: k for k, v in enumerate(ids.tolist())}
        kept = []
        for x, y in zip(pdf["umi1"].map(index), pdf["umi2"].map(index)):
            kept.append(min(core[x], core[y]) < 2 or _returns(around, x, y, longest, frontier))
        out = pdf[["umi1", "umi2"]].assign(kept=kept)
        for k, v in reversed(list(zip(keys, key))):
            out.insert(0, k, v)
        return out

    pairs = edges.select(*keys, "umi1", "umi2").distinct()
    return pairs.groupBy(*keys).applyInPandas(run, schema).where("kept").drop("kept")


def _returns(around: list[set[int]], start: int, goal: int, longest: int, most: int) -> bool:
    seen, edge = {start}, (around[start] - {goal})
    for _ in range(longest - 1):
        if len(edge) > most:
            return True
        seen |= edge
        edge = set().union(*(around[v] for v in edge)) - seen if edge else set()
        if goal in edge:
            return True
        if not edge:
            return False
    return False


def component_names(members: DataFrame) -> DataFrame:
    """(component, name): xxh3 of the sorted node ids as little-endian 64-bit words, in hex.

    Ids of the upper half of the unsigned range arrive as negative longs and
    sort and hash as unsigned.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import xxhash

        ids = np.sort(pdf["umi"].to_numpy().astype(np.int64).view(np.uint64)).astype("<u8")
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "name": [xxhash.xxh3_64(ids.tobytes()).hexdigest()]})

    kind = dict(members.dtypes)["component"]
    return members.select("component", "umi").groupBy("component").applyInPandas(run, f"component {kind}, name string")


def hybrid_communities(edges: DataFrame, rounds: int = 2, resolution: float = 1.0, seed: int = 1) -> DataFrame:
    """(umi, community): labels propagated by joins first; the graph of the propagated communities,
    weighted by the edges between and within them, is then moved by modularity.

    Only that smaller graph is grouped, one connected part of it a group.
    """
    kind = edges.schema["umi1"].dataType.simpleString()
    labels = cut_lineage(label_propagation(edges, rounds))
    joined = crossing_edges(edges.select("umi1", "umi2").distinct(), labels)
    counted = cut_lineage(joined.groupBy(F.least("c1", "c2").alias("umi1"), F.greatest("c1", "c2").alias("umi2")).agg(F.count("*").alias("w")))
    parts = edge_components(counted.where("umi1 <> umi2"))
    placed = counted.join(parts.withColumnRenamed("umi", "umi1"), "umi1", "left").withColumn("component", F.coalesce("component", "umi1"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, back = np.unique(pdf[["umi1", "umi2"]].to_numpy(), return_inverse=True)
        i, j = back.reshape(-1, 2).T
        w, own = pdf["w"].to_numpy(), i == j
        inner = np.bincount(i[own], weights=w[own], minlength=len(ids))
        found = communities_of(len(ids), i[~own], j[~own], resolution, seed, w[~own], inner)
        name = np.full(found.max(initial=0) + 1, len(ids))
        np.minimum.at(name, found, np.arange(len(ids)))
        return pd.DataFrame({"community": ids, "wide": ids[name[found]]})

    wide = placed.select("component", "umi1", "umi2", "w").groupBy("component").applyInPandas(run, f"community {kind}, wide {kind}")
    return labels.join(wide, "community").select("umi", F.col("wide").alias("community"))


def _within(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """edges whose ends share a community, with ``component`` their connected part."""
    kept = crossing_edges(edges, communities).where("NOT crossing").select("umi1", "umi2").distinct()
    inside = cut_lineage(edges.drop("component").join(kept, ["umi1", "umi2"]))
    whole = edge_components(inside).select(F.col("umi").alias("umi1"), F.col("component").cast("string").alias("component"))
    return inside.join(whole, "umi1")


def find_components(
    edges: DataFrame,
    min_reads: int = 1,
    rounds: int = 2,
    resolution: float = 1.0,
    least: int | None = None,
    most: int | None = None,
    merge_least: int | None = None,
    depth: int = 1,
    refine_resolution: float = 0.01,
    prune: int = 0,
    refine_merge_least: int | None = None,
) -> DataFrame:
    """Edge list to named components.

    Clashes go and reads are filtered; labels are propagated and their communities joined by
    modularity (``hybrid_communities``); crossing edges are cut; parts below ``prune`` nodes go;
    ``depth`` - 1 rounds look for communities inside each part, which is the largest thing
    one task sees; communities with ``merge_least`` crossing edges stay joined (inside a part
    ``refine_merge_least``, where given); sizes are filtered; components are named by their nodes. ``rounds`` = 0 skips all communities.
    """
    from edgeloom.operators.edges import clashing, filter_by_size, remove_nodes
    from edgeloom.operators.edges import min_reads as at_least

    clean = cut_lineage(at_least(remove_nodes(edges, clashing(edges)), min_reads)).drop("component", "sample")
    join_up = lambda df, found, most: found if most is None else merge_communities(df, found, most)
    inside = merge_least if refine_merge_least is None else refine_merge_least
    if rounds:
        parted = _within(clean, join_up(clean, hybrid_communities(clean, rounds, resolution), merge_least))
    else:
        parted = _within(clean, endpoints(clean).withColumn("community", F.lit(0)))
    if prune:
        parted = filter_by_size(parted, prune, None)
    for _ in range(depth - 1):
        found = cut_lineage(modularity_communities(parted, refine_resolution).select("umi", "community"))
        parted = _within(parted, join_up(parted, found, inside))
    sized = filter_by_size(parted, least, most)
    names = component_names(endpoints(sized, "component"))
    return sized.join(names, "component").drop("component").withColumnRenamed("name", "component")


def pivot_layout(edges: DataFrame, pivots: int = 50, dimensions: int = 3, seed: int = 11, scaled: bool = False) -> DataFrame:
    """(keys, umi, x, y, z): pivot MDS - hop distances to pivots, squared, double-centred, then
    the leading right singular directions; ``scaled``: centred per component and divided by the
    median radius (unless that is 0). One component a group; of its distances a task holds one pivot's, then a block of nodes."""

    def run(c: Component) -> dict:
        n, ids, pairs = len(c), c.ids, c.edges()
        c.at1 = c.at2 = None
        xyz = pivot_coordinates(n, *pairs, min(pivots, n), dimensions, seed)
        if scaled:
            xyz -= xyz.mean(axis=0)
            middle = np.median(np.sqrt((xyz**2).sum(axis=1)))
            if middle > 0:
                xyz /= middle
        return {"umi": ids, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}

    kind = edges.schema["umi1"].dataType.simpleString()
    return per_component(edges, run, {"umi": kind, "x": "double", "y": "double", "z": "double"})


class Neighbours:
    """Neighbours of each node, from distinct edges sorted by their first end."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray):
        back = np.argsort(j, kind="stable")
        self.n = n
        self.sides = [(self._starts(n, i), j), (self._starts(n, j), i[back])]

    @staticmethod
    def _starts(n: int, ends: np.ndarray) -> np.ndarray:
        starts = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(ends, minlength=n), out=starts[1:])
        return starts

    def of(self, nodes: np.ndarray) -> np.ndarray:
        """Neighbours of all the nodes, with repeats."""
        found = []
        for starts, other in self.sides:
            first, size = starts[nodes], starts[nodes + 1] - starts[nodes]
            end = np.cumsum(size)
            if len(end) and end[-1]:
                found.append(other[np.repeat(first - (end - size), size) + np.arange(end[-1])])
        return np.concatenate(found) if found else np.zeros(0, np.int32)

    def hops(self, source: int) -> np.ndarray:
        """Hops from the source, -1 where unreachable: only what is reached is looked at."""
        out = np.full(self.n, -1, np.int32)
        out[source] = 0
        edge, step = np.array([source]), 0
        while len(edge):
            step += 1
            near = self.of(edge)
            edge = np.unique(near[out[near] < 0])
            out[edge] = step
        return out


def _sorted_edges(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return distinct_pairs(n, np.minimum(i, j), np.maximum(i, j))


def hop_distances(n: int, i: np.ndarray, j: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """(sources, n) hops, the largest found + 1 where unreachable."""
    near = Neighbours(n, *_sorted_edges(n, i, j))
    out = np.stack([near.hops(s) for s in sources]).astype(np.int64)
    out[out < 0] = out.max() + 1
    return out


class SquaredHops:
    """Squared, double-centred hop distances of every node to the pivots, block by block of nodes.

    A search gives one pivot's distances to all nodes; they wait in a file of the task (in memory
    below 32 MB), from which a block reads its nodes' distances to all pivots.
    """

    ROWS = 65_536

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray, sources: np.ndarray):
        self.n, self.file, self.places, most, sums = n, tempfile.SpooledTemporaryFile(32 << 20), [], 0, []
        near = Neighbours(n, *_sorted_edges(n, i, j))
        for s in sources:
            hops = near.hops(s)
            reached = hops[hops >= 0].astype(np.int64)
            sums.append((int((reached**2).sum()), n - len(reached)))
            most = max(most, int(hops.max()))
            kind = np.int8 if hops.max() < 127 else np.int16 if hops.max() < 32_767 else np.int32
            self.places.append((self.file.tell(), np.dtype(kind)))
            self.file.write(hops.astype(kind).data)
        self.far = most + 1
        column = [own + lost * self.far**2 for own, lost in sums]
        self.column_mean = np.array(column) / n
        self.mean = sum(column) / (n * len(sources))

    def blocks(self):
        for lo in range(0, self.n, self.ROWS):
            rows = min(self.ROWS, self.n - lo)
            square = np.empty((rows, len(self.places)))
            for at, (start, kind) in enumerate(self.places):
                self.file.seek(start + lo * kind.itemsize)
                square[:, at] = np.frombuffer(self.file.read(rows * kind.itemsize), kind)
            square[square < 0] = self.far
            square **= 2
            yield slice(lo, lo + rows), -0.5 * (square - self.column_mean - square.mean(axis=1, keepdims=True) + self.mean)

    def svd(self) -> tuple[np.ndarray, np.ndarray]:
        """Singular values and right singular directions, by the triangular factor of the blocks so far."""
        factor = None
        for _, block in self.blocks():
            factor = block if factor is None else np.linalg.qr(np.concatenate([factor, block]), mode="r")
        _, values, right = np.linalg.svd(factor, full_matrices=False)
        return values, right


def pivot_coordinates(n: int, i: np.ndarray, j: np.ndarray, pivots: int, dimensions: int, seed: int) -> np.ndarray:
    chosen = np.random.default_rng(seed).permutation(n)[:pivots]
    hops = SquaredHops(n, i, j, np.sort(chosen))
    turn = hops.svd()[1][:dimensions].T
    xyz = np.zeros((n, max(3, turn.shape[1])))
    for rows, block in hops.blocks():
        xyz[rows, : turn.shape[1]] = block @ turn
    return xyz


def distance_variance(edges: DataFrame, pivots: int = 50, seed: int = 11) -> DataFrame:
    """(keys, explained): share of the centred pivot distances' variance in three directions."""

    def run(c: Component) -> dict:
        n = len(c)
        chosen = np.random.default_rng(seed).permutation(n)[: min(pivots, n)]
        values = SquaredHops(n, *c.edges(), np.sort(chosen)).svd()[0] ** 2
        return {"explained": np.array([values[:3].sum() / values.sum() if values.sum() else 0.0])}

    return per_component(edges, run, {"explained": "double"})


def normalise_layout(layout: DataFrame) -> DataFrame:
    """Coordinates centred per component and divided by the median radius."""
    keys = keys_of(layout)
    w = Window.partitionBy(*keys)
    centred = layout.select(*[c for c in layout.columns if c not in "xyz"], *[(F.col(c) - F.avg(c).over(w)).alias(c) for c in "xyz"])
    radius = F.sqrt(sum((F.col(c) * F.col(c) for c in "xyz"), F.lit(0.0)))
    middle = F.median(radius).over(w)
    return centred.select(*[c for c in layout.columns if c not in "xyz"], *[(F.col(c) / middle).alias(c) for c in "xyz"])
