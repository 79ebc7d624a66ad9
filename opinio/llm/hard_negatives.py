"""Hard negatives by threshold joins in the manner of L2AP.

Anchors meet blocks of rows in tasks. In a task, dimensions are ordered by their energy and taken in groups; the
inverted index lists a row under a group only as long as the row's norm over that and all later groups could still
lift some anchor to its threshold. Scores are accumulated group by group, and a pair is dropped once its partial
score and the product of the remaining norms (Cauchy-Schwarz) stay under the anchor's threshold. Survivors are
finished exactly. An anchor starts with a high threshold, lowered until its windows are full or searched to their
lower end; so what a block returns are its best rows of each window, and nothing can be lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import store
from .registry import query
from .tables import keyed

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a negative's score in percent of the positive's
BLOCK_ROWS, BLOCK_ENTRIES = 8192, 1 << 22  # most rows of a block, and most entries of their vectors
TURN_ANCHORS = 2048
SIDE_BY_SIDE = 128  # anchors that walk through a block together
GROUP = 8  # dimensions of a group
LOWERED = 0.7  # a threshold to the next
PART = 32  # a search over more blocks than this first learns thresholds from one row in so many
_LEAST, _MOST = -(1 << 62), 1 << 62


class Block:
    """Rows of integers with an inverted index by groups of dimensions."""

    def __init__(self, x: np.ndarray):
        self.whole = x
        self.order = np.argsort(-np.square(x, dtype=np.float64).sum(axis=0), kind="stable")
        self.x = x[:, self.order].astype(np.float64)
        self.starts = list(range(0, x.shape[1], GROUP))
        self.remaining = _suffix_norms(self.x, self.starts)

    def join(self, whole: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, score) of all pairs of a vector of ``whole`` and a row whose inner product is at least ``least[i]``."""
        q = whole[:, self.order].astype(np.float64)
        ahead = _suffix_norms(q, self.starts)
        # Sums of doubles are exact below 2**53; products of norms get a little more, for they are rounded.
        exact = ahead[:, 0].max() * self.remaining[:, 0].max() < 1 << 52
        slack = 1e-9 * ahead[:, 0] * self.remaining[:, 0].max() + 1e-3
        reach = least - slack
        # The index: a row is listed under groups before ``listed``; what it holds from there on cannot reach a threshold alone.
        listed = (self.remaining * ahead.max(axis=0) >= reach.min()).sum(axis=1) if reach.min() > 0 else np.full(len(self.x), len(self.starts) + 1)
        score, alive = np.zeros((len(q), len(self.x))), np.ones((len(q), len(self.x)), dtype=bool)
        rows = np.flatnonzero(listed > 0)
        alive[:, listed == 0] = False
        for g, a in enumerate(self.starts):
            rows = rows[listed[rows] > g]
            if not len(rows):
                break
            part = score[:, rows] + q[:, a : a + GROUP] @ self.x[rows, a : a + GROUP].T
            near = alive[:, rows] & (part + ahead[:, g + 1, None] * self.remaining[rows, g + 1] >= reach[:, None])
            score[:, rows], alive[:, rows] = part, near
            rows = rows[near.any(axis=0)]
        i, j = np.nonzero(alive)
        found = np.empty(len(i), dtype=np.int64)
        done = listed[j] >= len(self.starts) if exact else np.zeros(len(j), dtype=bool)
        found[done] = score[i[done], j[done]].astype(np.int64)
        rest = np.flatnonzero(~done)
        for at in range(0, len(rest), 1 << 14):
            k = rest[at : at + (1 << 14)]
            found[k] = np.einsum("ij,ij->i", whole[i[k]], self.whole[j[k]])
        keep = found >= least[i]
        return i[keep], j[keep], found[keep]


def _suffix_norms(x: np.ndarray, starts: list[int]) -> np.ndarray:
    """Norms over each group and all that follow, and 0 after the last."""
    squares = np.add.reduceat(x * x, starts, axis=1)
    return np.sqrt(np.column_stack([np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], np.zeros(len(x))]))


def search(block: Block, ids: np.ndarray, rids: np.ndarray, fits, anchors: np.ndarray, asks: list[list[tuple[int, int, int, int]]], k: int) -> list[tuple]:
    """(anchor, window, row, score): the ``k`` best rows of the block in each window.

    ``asks`` has (window, lowest, highest, floor) for each anchor; rows under the floor are not asked for.
    ``fits(anchor)`` says which rows may be taken.
    """
    out: list[tuple] = []
    top = np.sqrt(np.square(anchors, dtype=np.float64).sum(axis=1)) * block.remaining[:, 0].max()
    waiting = {i: [(w, max(lo, floor), hi) for w, lo, hi, floor in a] for i, a in enumerate(asks) if a}
    bottom = {i: min(lo for _, lo, _ in a) for i, a in waiting.items()}
    level = {i: max(bottom[i], math.floor(LOWERED * min(top[i], max(hi for _, _, hi in a)))) for i, a in waiting.items()}
    while waiting:
        at = np.array(list(waiting))
        i, j, score = block.join(anchors[at], np.array([level[a] for a in at], dtype=np.float64))
        cuts = np.searchsorted(i, np.arange(len(at) + 1))
        for n, anchor in enumerate(at.tolist()):
            rows, scores = j[cuts[n] : cuts[n + 1]], score[cuts[n] : cuts[n + 1]]
            may = fits(anchor, rows)
            rows, scores = rows[may], scores[may]
            order = np.lexsort((rids[rows], ids[rows], -scores))
            rows, scores = rows[order], scores[order]
            open_, last = [], level[anchor] <= bottom[anchor]
            for w, lo, hi in waiting[anchor]:
                # Scores fall: the window is a run of them.
                a, b = np.searchsorted(-scores, [-hi, -lo], side="left")[0], np.searchsorted(-scores, -lo, side="right")
                if b - a >= k or last or level[anchor] <= lo:
                    out += [(anchor, w, r, s) for r, s in zip(rows[a : min(b, a + k)].tolist(), scores[a : min(b, a + k)].tolist())]
                else:
                    open_.append((w, lo, hi))
            if open_:
                waiting[anchor], bottom[anchor] = open_, min(lo for _, lo, _ in open_)
                lower = math.floor(min(LOWERED * level[anchor], LOWERED * max(hi for _, _, hi in open_))) if level[anchor] > 1 else -1
                # Under zero there is nothing left to prune by.
                level[anchor] = max(bottom[anchor], lower) if lower > 0 else bottom[anchor]
            else:
                del waiting[anchor]
    return out


def _integers(scale: int):
    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = []
            for vector in batch["vector"]:
                x = None
                if vector is not None and len(vector) and not any(e is None for e in vector):
                    x = np.floor(scale * np.asarray(vector, dtype=np.float64))
                    x = x if np.isfinite(x).all() and np.square(x / (1 << 31)).sum() < 1 else None
                vectors.append(None if x is None else x.astype("<i8").tobytes())
            out = batch.assign(x=vectors)[["rid", "id", "label", "anchor", "x"]]
            yield out[out["x"].notna()]

    return checked


def _vectors(column) -> np.ndarray:
    return np.stack([np.frombuffer(v, dtype="<i8") for v in column])


_FOUND = "anchor bigint, w int, other bigint, score bigint"


def _met(same: bool, k: int):
    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].notna().to_numpy()
        rows, anchors = pdf[~asks], pdf[asks]
        found: list[tuple] = []
        if len(rows) and len(anchors):
            block = Block(_vectors(rows["x"]))
            ids, rids, labels = (rows[c].to_numpy() for c in ("id", "rid", "label"))
            for at in range(0, len(anchors), SIDE_BY_SIDE):
                part = anchors.iloc[at : at + SIDE_BY_SIDE]
                names, own = part["rid"].to_numpy(), part["label"].to_numpy()

                def fits(a: int, j: np.ndarray) -> np.ndarray:
                    return (rids[j] != names[a]) & ((labels[j] == own[a]) == same)

                wanted = [[(int(e["w"]), int(e["lo"]), int(e["hi"]), int(e["floor"])) for e in listed] for listed in part["asks"]]
                found += [(names[a], w, rids[r], s) for a, w, r, s in search(block, ids, rids, fits, _vectors(part["x"]), wanted, k)]
        return pd.DataFrame(found, columns=["anchor", "w", "other", "score"])

    return meet


def _best(rows: DataFrame, asks: DataFrame, same: bool, k: int) -> DataFrame:
    """Stored (anchor, w, other, other_id, score, rank): the ``k`` best rows for each window of ``asks`` (rid, asks),
    among rows of the same label or of others. Vectors of unequal lengths are not compared."""
    # Only rows of the anchor's own label can be its positives, so a label is a cell of its own then.
    cell = ["dims", "label"] if same else ["dims"]
    size = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_ENTRIES) / F.col("dims"))))
    part = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    anchors = store(rows.join(asks, "rid"), "asking")

    def meetings(members: DataFrame, asking: DataFrame) -> DataFrame:
        held = members.groupBy(cell).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
        turns = asking.groupBy(cell).agg(F.ceil(F.count("*") / TURN_ANCHORS).cast("int").alias("turns"))
        cells = store(held.join(turns, cell), "cells")
        kind = f"array<{_ASK}>"
        columns = [*cell, "block", "turn", "rid", "id", *([] if same else ["label"]), "x", "asks"]
        there = members.join(cells, cell).withColumn("block", part("blocks")).withColumn("turn", every("turns")).withColumn("asks", F.lit(None).cast(kind))
        here = asking.join(cells, cell).withColumn("turn", part("turns")).withColumn("block", every("blocks"))
        return there.select(columns).unionByName(here.select(columns)).groupBy(*cell, "block", "turn").applyInPandas(_met(same, k), _FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        named = store(found, "met").join(rows.select(F.col("rid").alias("other"), F.col("id").alias("other_id")), "other")
        order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "other_id", "other")
        return store(named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")

    most = rows.groupBy(cell).count().agg(F.max(F.ceil(F.col("count") / size))).first()[0] or 0
    for level in range(max(0, math.ceil(math.log(max(1, most), PART)) - 1), 0, -1):
        # What some rows give is a floor for all: later levels return little more than PART times k rows a window.
        some = rows.filter(F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(PART**level)) == 0)
        floors = ranked(meetings(some, anchors)).filter(F.col("rank") == k).groupBy(F.col("anchor").alias("rid")).agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("_floors"))
        raised = F.transform("asks", lambda e: e.withField("floor", F.greatest(e["floor"], F.coalesce(F.col("_floors")[e["w"]], F.lit(_LEAST).cast("bigint")))))
        anchors = store(anchors.join(floors, "rid", "left").withColumn("asks", F.when(F.col("_floors").isNull(), F.col("asks")).otherwise(raised)).drop("_floors"), "asking")
    return ranked(meetings(rows, anchors))


_ASK = "struct<w:int,lo:bigint,hi:bigint,floor:bigint>"


def hard_negatives(
    vectors: DataFrame,
    label: Column,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``vectors`` (vec_id, embedding).

    Vectors become integers, floor(scale * entry); the score of two rows is their inner product; higher ones come
    first, on a tie the smaller vec_id. The positives of a row that ``anchor`` marks are the best rows of its own
    ``label``; for each, the negatives are the best rows of other labels that score from ``low`` to ``high`` percent
    of it. Rows take no part whose vec_id, label or vector is null, whose vector is empty or holds null or non-finite
    entries, or has a squared norm of 2**62 or more as integers, for then scores do not fit a long. Vectors of unequal
    lengths are not compared. Equal vectors and repeated ids are rows of their own. An anchor with no positive, and a
    positive without negatives, give no rows; so does an empty table. Other columns are ignored.
    """
    kind = "bigint"
    taken = keyed(vectors, F.col("vec_id").cast(kind).alias("id"), label.cast(kind).alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").alias("vector"))
    taken = taken.filter("id is not null and label is not null and vector is not null")
    rows = store(taken.mapInPandas(_integers(scale), "rid bigint, id bigint, label bigint, anchor boolean, x binary").withColumn("dims", (F.octet_length("x") / 8).cast("int")), "integers")
    marked = rows.filter("anchor").select("rid")
    rows = rows.drop("anchor")
    ask = lambda w, lo, hi: F.struct(w.cast("int").alias("w"), lo.alias("lo"), hi.alias("hi"), F.lit(_LEAST).cast("bigint").alias("floor"))
    least, most = F.lit(_LEAST).cast("bigint"), F.lit(_MOST).cast("bigint")
    good = _best(rows, marked.select("rid", F.array(ask(F.lit(0), least, most)).alias("asks")), True, positives)
    score = F.col("score").cast("decimal(20,0)")
    lo, hi = F.ceil(score * low / 100).cast("bigint"), F.floor(score * high / 100).cast("bigint")
    windows = good.filter(lo <= hi).groupBy(F.col("anchor").alias("rid")).agg(F.collect_list(ask(F.col("rank"), lo, hi)).alias("asks"))
    bad = _best(rows, windows, False, negatives)
    names = rows.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = good.select("anchor", F.col("rank").alias("w"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        bad.select("anchor", "w", "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(pairs, ["anchor", "w"])
        .join(names, "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), n AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query("op11_threshold_join", ORACLE)
def op11_threshold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label, F.col("vec_id") % 50 == 0)
