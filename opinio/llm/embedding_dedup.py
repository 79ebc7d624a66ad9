"""Near-duplicate embeddings by product quantisation.

A coarse k-means puts unit vectors into inverted lists; the residual to the list's centre is coded by subspace
codebooks. A query looks distances up in a table per list (asymmetric: the query itself is not quantised), and
what may be near is compared exactly. No limit is guessed: with r the distance that the cosine threshold allows,

* a vector within r of the query can lie in another list only if the query is within r of the plane between
  the two centres, so exactly those lists are probed;
* a vector whose code is off by e can be near only if its table distance is at most r + e.

So candidates hold every pair of the threshold, whatever sample the index was fitted on.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.density import connected_components
from ..session import collect_bounded, store
from .registry import query
from .tables import keyed, least_by_hash

COSINE = 0.98
SAMPLE = 20_000  # vectors that the index is fitted on, those of least hash; every vector is indexed
LISTS = 256  # most lists; smaller tables get fewer. Longer lists are cut into blocks
SUBSPACES = 8
CODES = 64
BLOCK_MEMBERS = 1024
BLOCK_QUERIES = 4096


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, dtype=int)])


class Index:
    """Centres of the lists and one codebook per subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int = SUBSPACES, codes: int = CODES):
        self.centres = _kmeans(sample, lists)
        residual = sample - self.centres[_nearest(sample, self.centres)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))
        self.books = [_kmeans(residual[:, p], codes) for p in self.parts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and distance between the vector and what its code stands for."""
        home = _nearest(x, self.centres)
        residual = x - self.centres[home]
        codes = np.column_stack([_nearest(residual[:, p], b) for p, b in zip(self.parts, self.books)]).astype(np.uint8)
        for s, (p, b) in enumerate(zip(self.parts, self.books)):
            residual[:, p] -= b[codes[:, s]]
        return home, codes, np.linalg.norm(residual, axis=1)

    def probes(self, x: np.ndarray, home: np.ndarray, reach: float) -> list[np.ndarray]:
        """For each vector, the lists that can hold a vector within ``reach`` of it."""
        squares = (self.centres * self.centres).sum(axis=1)
        far = squares - 2 * x @ self.centres.T
        apart = np.sqrt(np.maximum(squares[:, None] + squares - 2 * self.centres @ self.centres.T, 0))
        over = far - far[np.arange(len(x)), home][:, None]
        return [np.flatnonzero(o <= 2 * apart[h] * reach + 1e-9) for o, h in zip(over, home)]

    def table_distances(self, queries: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        residual = queries - self.centres[home]
        total = np.zeros((len(queries), len(codes)))
        for s, (p, b) in enumerate(zip(self.parts, self.books)):
            part = residual[:, p]
            table = (part * part).sum(axis=1)[:, None] - 2 * part @ b.T + (b * b).sum(axis=1)
            total += table[:, codes[:, s]]
        return np.sqrt(np.maximum(total, 0))


def _doubles(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype=np.float64) for v in column])


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Doubles of the comparable vectors and a key of (label, vector); null for all others."""
    for batch in batches:
        keys, vectors = [], []
        for label, vector in zip(batch["label"], batch["embedding"]):
            x = None
            if label is not None and label == label and vector is not None and len(vector) and not any(e is None for e in vector):
                x = np.asarray(vector, dtype=np.float64) + 0.0
                x = x if np.isfinite(x).all() and x.any() else None
            vectors.append(None if x is None else x.tobytes())
            keys.append(None if x is None else hashlib.blake2b(f"{label}|".encode() + x.tobytes(), digest_size=16).digest())
        yield pd.DataFrame({"rid": batch["rid"], "vec_id": batch["vec_id"].astype("Int64"), "label": batch["label"], "key": keys, "vector": vectors})


def _linked(index: Index, threshold: float):
    reach = math.sqrt(2 - 2 * threshold) + 1e-6

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(dtype=bool)
        members, queries = pdf[~asks], pdf[asks]
        if not len(members) or not len(queries):
            return pd.DataFrame({"node": [], "n": [], "root": []})
        home = int(members["list"].iloc[0])
        m, q = _units(_doubles(members["vector"])), _units(_doubles(queries["vector"]))
        codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in members["codes"]])
        slack = reach + members["error"].to_numpy()
        mid, qid = members["node"].to_numpy(), queries["node"].to_numpy()
        weight, counts = members["weight"].to_numpy(), np.zeros(len(q), dtype=np.int64)
        label_m, label_q = mid.copy(), qid.copy()
        pairs = []
        for at in range(0, len(q), 256):
            i, j = np.nonzero(index.table_distances(q[at : at + 256], home, codes) <= slack)
            i += at
            near = (np.einsum("ij,ij->i", q[i], m[j]) >= threshold) & (qid[i] != mid[j])
            i, j = i[near], j[near]
            np.add.at(counts, i, weight[j])
            pairs.append((i, j))
        i, j = (np.concatenate([p[k] for p in pairs]) for k in range(2))
        while True:  # least number over the links met here: a spanning link for each vector, not all pairs
            before = label_q.copy(), label_m.copy()
            np.minimum.at(label_q, i, label_m[j])
            np.minimum.at(label_m, j, label_q[i])
            if (label_q == before[0]).all() and (label_m == before[1]).all():
                break
        out = pd.DataFrame({"node": np.r_[qid, mid], "n": np.r_[counts, np.zeros_like(mid)], "root": np.r_[label_q, label_m]})
        return out[(out["n"] > 0) | (out["node"] != out["root"])]

    return link


def _links(points: DataFrame, threshold: float, lists: int, sample: int) -> DataFrame:
    """(node, n, root) from each block that a vector met: weights of its links there, and a node it is connected with."""
    fitted = least_by_hash(points, sample, "node").select("vector").collect()
    index = Index(_units(_doubles([r["vector"] for r in fitted])), max(1, min(lists, math.isqrt(points.count()) // 2)))
    reach = math.sqrt(2 - 2 * threshold) + 1e-6

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _units(_doubles(batch["vector"]))
                home, codes, error = index.encode(x)
                batch["list"], batch["codes"], batch["error"] = home, [c.tobytes() for c in codes], error
                batch["probes"] = index.probes(x, home, reach)
                yield batch[["node", "label", "weight", "vector", "list", "codes", "error", "probes"]]

    kind = points.schema["label"].dataType.simpleString()
    schema = f"node bigint, label {kind}, weight bigint, vector binary, list int, codes binary, error double, probes array<int>"
    coded = store(points.select("node", "label", "weight", "vector").mapInPandas(code, schema), "codes")
    asked = coded.select("node", "label", "vector", F.explode("probes").alias("list"))
    cell = ["label", "list"]
    held = coded.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    cells = store(held.join(asked.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("turns")), cell), "cells")
    # A crowded list is cut into blocks, its queries into turns: each block meets each turn in a task of bounded size.
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*cell, "block", "turn", "asks", "node", "weight", "vector", "codes", "error"]
    members = coded.drop("probes").join(cells, cell).withColumn("block", part("blocks")).withColumn("turn", every("turns")).withColumn("asks", F.lit(False))
    queries = (
        asked.join(cells, cell).withColumn("turn", part("turns")).withColumn("block", every("blocks")).withColumn("asks", F.lit(True))
        .withColumn("weight", F.lit(None).cast("bigint")).withColumn("codes", F.lit(None).cast("binary")).withColumn("error", F.lit(None).cast("double"))
    )
    meeting = members.select(columns).unionByName(queries.select(columns))
    return meeting.groupBy(*cell, "block", "turn").applyInPandas(_linked(index, threshold), "node bigint, n bigint, root bigint")


def near_embeddings(vectors: DataFrame, threshold: float = COSINE, lists: int = LISTS, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): every row of ``vectors`` (vec_id, embedding, label).

    Two rows are linked when their labels are equal and their cosine, in double precision, is at least
    ``threshold``. Rows whose label or vector is null, whose vector is empty or zero or holds null or non-finite
    parts, and vectors of another length link with nothing. ``component_id`` is the smallest vec_id that links
    lead to. Equal vectors are one weighted point: n copies count n - 1 links each without meeting. Repeated ids
    stay separate rows. An empty table gives no rows; other columns are ignored.
    """
    kind = vectors.schema["label"].dataType.simpleString()
    rows = store(
        keyed(vectors, "vec_id", "embedding", "label").mapInPandas(_checked, f"rid bigint, vec_id bigint, label {kind}, key binary, vector binary"), "vectors"
    )
    points = store(
        rows.filter("key is not null")
        .groupBy("key")
        .agg(F.min("rid").alias("node"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector")),
        "points",
    )
    lengths = collect_bounded(points.select(F.octet_length("vector").alias("n")).distinct(), 1000, "lengths of vectors")
    found = [_links(points.filter(F.octet_length("vector") == r["n"]), threshold, lists, sample) for r in lengths]
    weights = points.select("key", "node", "weight")
    if found:
        met = found[0]
        for more in found[1:]:
            met = met.unionByName(more)
        met = store(met, "links")
        edges = met.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
        touched = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
        joined = connected_components(touched, edges).select(F.col("id").alias("node"), "component")
        linked = weights.join(met.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(joined, "node", "left")
    else:
        linked = weights.select("*", F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("component"))
    linked = store(
        linked.select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("bigint").alias("n_links"), F.coalesce("component", "node").alias("class")),
        "linked",
    )
    placed = store(
        rows.select("rid", "vec_id", "key").join(linked, "key", "left").select("rid", "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class", "rid").alias("class")),
        "placed",
    )
    heads = store(placed.groupBy("class").agg(F.min("vec_id").alias("component_id")), "heads")
    return placed.join(heads, "class").select(
        "vec_id", F.col("n_links").cast("bigint").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(vec_id, c) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a
)
SELECT r.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.c) AS component_id, r.vec_id = min(r.c) AS kept
FROM r LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON r.vec_id = n.a GROUP BY r.vec_id
"""


@query("op2_product_quantisation", ORACLE)
def op2_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
