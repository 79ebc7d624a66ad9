"""Density clustering of vectors with a noise label, and connected components."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors as vx
from ..session import broadcast_if_small, cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable along the (a, b) edges.

    Each round takes the smallest label among neighbours (map-side minimum, so a hub costs one row per
    task), then jumps to that label's own label, so rounds grow with the logarithm of the path length.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut_lineage(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("_m"))
        lower = labels.join(near, labels["id"] == near["a"], "left").select(
            "id", "component", F.least("component", "_m").alias("_new")
        )
        jump = labels.select(F.col("id").alias("_j"), F.col("component").alias("_jc"))
        moved = lower.join(jump, lower["_new"] == jump["_j"], "left").select(
            "id", F.least("_new", "_jc").alias("component"), (F.least("_new", "_jc") < F.col("component")).alias("_moved")
        )
        moved = cut_lineage(moved)
        labels = moved.select("id", "component")
        if moved.filter("_moved").limit(1).count() == 0:
            return labels


TILE_ROWS = 2048  # a task compares so many rows of a block with as many of the other at a time


def _blocks(points: DataFrame, pivots: list[np.ndarray], eps: float, block_rows: int) -> DataFrame:
    """Rows placed for the neighbour search, so that two points that may lie within ``eps`` meet in one group.

    A cell is the tuple of distances to the pivots in steps of ``eps``: points within ``eps`` differ by at
    most one step on every pivot. A crowded cell is cut into blocks of about ``block_rows`` on both sides, so
    no group grows with the data. Groups (cell, own, hb, vb) hold two blocks of one cell, hb <= vb (``own``; no
    guests if they are the same), or a block of a cell and one of its visitors, which come from the neighbouring
    cells on one side only: every pair meets once.
    """
    steps = [
        F.floor(vx.norm(F.zip_with("v", F.array(*[F.lit(float(x)) for x in p]), lambda x, y: x - y)) / (eps * (1 + 1e-9))).cast("int")
        for p in pivots
    ]
    placed = points.select("id", "v", "w", "core", F.array(*steps).alias("cell"))
    shifts = [list(s) for s in itertools.product((-1, 0, 1), repeat=len(pivots)) if s > (0,) * len(pivots)]
    reach = F.array(*[F.array(*[F.lit(x) for x in s]) for s in shifts]).cast("array<array<int>>")

    def shifted(df: DataFrame) -> DataFrame:
        return df.withColumn("_shift", F.explode(reach)).withColumn("cell", F.zip_with("cell", "_shift", lambda c, s: c + s))

    def block(count: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(count)).cast("int")

    every = lambda low, high: F.explode(F.sequence(low, high - 1))
    blocks = lambda n: F.ceil(F.col(n) / block_rows).cast("int")
    # Cells are counted once, and few: the points are not moved to learn how their cell is cut.
    cells = cut_lineage(placed.groupBy("cell").agg(F.count("*").alias("n")))
    guests = shifted(cells).groupBy("cell").agg(F.sum("n").alias("g"))
    sizes = broadcast_if_small(cut_lineage(cells.join(guests, "cell", "left").select("cell", blocks("n").alias("nh"), blocks("g").alias("nv"))))
    homes, visitors = placed.join(sizes, "cell").withColumn("_b", block("nh")), shifted(placed).join(sizes, "cell")
    kinds = [
        (homes, True, True, {"hb": F.col("_b"), "vb": every(F.col("_b"), F.col("nh"))}),
        (homes.filter("_b > 0"), True, False, {"vb": F.col("_b"), "hb": every(F.lit(0), F.col("_b"))}),
        (homes.filter("nv > 0"), False, True, {"hb": F.col("_b"), "vb": every(F.lit(0), F.col("nv"))}),
        (visitors, False, False, {"vb": block("nv"), "hb": every(F.lit(0), F.col("nh"))}),
    ]
    columns = ["cell", "own", "hb", "vb", "home", "id", "v", "w", "core"]
    parts = [df.withColumns({"own": F.lit(own), "home": F.lit(home)} | at).select(*columns) for df, own, home, at in kinds]
    # Dealt by the whole key: a union of joins by cell counts as dealt by cell, and one task would get all blocks of it.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return functools.reduce(DataFrame.unionByName, parts).repartition(tasks, "cell", "own", "hb", "vb")


def _near(rows: pd.DataFrame, alone: bool, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the rows of a group that lie within ``eps``, tile by tile: i at home and j a guest, or i <= j in a
    block ``alone``. ``rows`` has those at home first."""
    homes, n = int(rows["home"].sum()), len(rows)
    if not homes or not (alone or homes < n):
        return
    v = np.stack(rows["v"].to_numpy()).astype(np.float64)
    square = (v * v).sum(1)
    for i in range(0, homes, TILE_ROWS):
        a = slice(i, min(i + TILE_ROWS, homes))
        for j in range(i if alone else homes, n, TILE_ROWS):
            b = slice(j, min(j + TILE_ROWS, n))
            squares = v[a] @ v[b].T
            squares *= -2.0
            squares += square[a, None]
            squares += square[None, b]
            at = np.flatnonzero(squares <= eps * eps + 1e-12)
            x, y = i + at // (b.stop - j), j + at % (b.stop - j)
            yield (x[x <= y], y[x <= y]) if alone and i == j else (x, y)


def _together(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the smallest place of each place's component) after linking the places ``a`` with ``b``."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def density_clusters(
    df: DataFrame,
    id: str,
    vector: str,
    eps: float,
    min_samples: int = 3,
    min_size: int = 10,
    pivots: int = 3,
    block_rows: int = 8192,
) -> DataFrame:
    """(id, cluster): cluster = smallest core id of the cluster, -1 for noise and for clusters under ``min_size``.

    A row is core when at least ``min_samples`` rows (itself included) lie within ``eps``; cores within
    ``eps`` share a cluster; another row joins the cluster of its smallest core neighbour. Equal vectors are
    one weighted point, so copies never meet each other. Tasks return neighbour counts and spanning links
    (at most one per point and group), never the neighbour pairs.
    """
    rows = df.select(F.col(id).cast("bigint").alias("row"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    points = cut_lineage(rows.groupBy("v").agg(F.min("row").alias("id"), F.count("*").alias("w")))
    chosen = [np.array(r["v"]) for r in points.orderBy("id").limit(pivots).select("v").collect()]

    def neighbours(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("home", ascending=False)
        w = pdf["w"].to_numpy(dtype=np.float64)
        counts = np.zeros(len(pdf))
        for i, j in _near(pdf, key[1] and key[2] == key[3], eps):
            counts += np.bincount(i, w[j], len(pdf))
            other = i != j
            counts += np.bincount(j[other], w[i[other]], len(pdf))
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "n": counts.astype(np.int64)})

    def links(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("home", ascending=False)
        ids, core = pdf["id"].to_numpy(), pdf["core"].to_numpy(dtype=bool)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)  # in the order of ids
        place[order] = np.arange(len(ids))
        top = np.iinfo(np.int64).max
        root, first = np.arange(len(ids)), np.full(len(ids), top)
        for i, j in _near(pdf, key[1] and key[2] == key[3], eps):
            solid = core[i] & core[j]
            root = _together(root, place[i[solid]], place[j[solid]])
            for a, b in ((i, j), (j, i)):
                border = ~core[a] & core[b]
                np.minimum.at(first, a[border], ids[b[border]])
        joins, a, b = first < top, ids[order], ids[order][root]
        return pd.concat([
            pd.DataFrame({"a": ids[joins], "b": first[joins], "joins": True}),
            pd.DataFrame({"a": a[a != b], "b": b[a != b], "joins": False}),
        ])

    plain = points.withColumn("core", F.lit(False))
    counts = (
        _blocks(plain, chosen, eps, block_rows)
        .groupBy("cell", "own", "hb", "vb")
        .applyInPandas(neighbours, "id bigint, n bigint")
        .groupBy("id")
        .agg(F.sum("n").alias("n"))
    )
    flagged = cut_lineage(
        points.join(counts, "id").select("id", "v", "w", (F.col("n") >= min_samples).alias("core"))
    )
    found = cut_lineage(
        _blocks(flagged, chosen, eps, block_rows)
        .groupBy("cell", "own", "hb", "vb")
        .applyInPandas(links, "a bigint, b bigint, joins boolean")
    )
    cores = flagged.filter("core").select("id")
    components = connected_components(cores, found.filter(~F.col("joins")).select("a", "b"))
    borders = found.filter("joins").groupBy("a").agg(F.min("b").alias("b"))
    attached = borders.join(components, borders["b"] == components["id"]).select(F.col("a").alias("id"), "component")
    members = components.select("id", "component").unionByName(attached)
    weights = members.join(points.select("id", "w"), "id")
    large = weights.groupBy("component").agg(F.sum("w").alias("_size")).filter(F.col("_size") >= min_size)
    named = members.join(large.select("component"), "component", "left_semi")
    per_vector = points.join(named, "id", "left").select("v", F.coalesce("component", F.lit(-1)).alias("cluster"))
    return rows.join(per_vector, "v").select(F.col("row").alias(id), "cluster")
