"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a tuple of part sizes. Differencing takes the two partial partitions with the largest
spread and joins them in opposite order, largest part with smallest, until one is left. Groups are first
differenced in buckets of bounded size, one per task; the buckets' partial partitions are then differenced
among themselves, in as many rounds as it takes, so no task and no driver sees all groups.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import store
from .registry import query
from .tables import documents, keyed, numbered_slots

GROUPS_PER_BUCKET = 20_000


def difference(items: list[list[int]], parts: int) -> list[list[int]]:
    """For each item, a tuple of ``parts`` sizes, the part of the joint partition that each of its sizes goes to."""
    nodes: list[tuple[int, int, list[int]]] = []
    heap, order = [], []
    for i, sizes in enumerate(items):
        rank = sorted(range(parts), key=lambda j: -sizes[j])
        order.append(rank)
        ranked = [sizes[j] for j in rank]
        heap.append((ranked[-1] - ranked[0], i, ranked))
    heapq.heapify(heap)
    n = len(items)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        joint = [x + y for x, y in zip(left, reversed(right))]
        rank = sorted(range(parts), key=lambda j: -joint[j])
        nodes.append((a, b, rank))
        ranked = [joint[j] for j in rank]
        heapq.heappush(heap, (ranked[-1] - ranked[0], n + len(nodes) - 1, ranked))
    # From the last join back to the items: where each position of a partial partition ends up.
    ends: list[list[int] | None] = [None] * (n + len(nodes))
    if ends:
        ends[-1] = list(range(parts))
    for k in range(len(nodes) - 1, -1, -1):
        a, b, rank = nodes[k]
        place, target = [0] * parts, ends[n + k]
        for position, j in enumerate(rank):
            place[j] = target[position]
        ends[a], ends[b] = place, place[::-1]
        ends[n + k] = None
    out = []
    for i in range(n):
        where = [0] * parts
        for position, j in enumerate(order[i]):
            where[j] = ends[i][position]
        out.append(where)
    return out


def assign_groups(groups: DataFrame, parts: int, per_bucket: int = GROUPS_PER_BUCKET) -> DataFrame:
    """(group, shard) for a stored table (group, bytes) of distinct groups."""

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group")
        ends = difference([[int(b)] + [0] * (parts - 1) for b in pdf["bytes"]], parts)
        return pd.DataFrame({"group": pdf["group"], "bucket": pdf["bucket"], "part": [e[0] for e in ends], "bytes": pdf["bytes"]})

    def joins(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot(index="bucket", columns="part", values="bytes").reindex(columns=range(parts)).fillna(0).astype("int64").sort_index()
        ends = difference([[int(x) for x in row] for row in table.to_numpy()], parts)
        above = int(pdf["above"].iloc[0])
        rows = [(int(b), j, above, e[j], int(size[j])) for b, e, size in zip(table.index, ends, table.to_numpy()) for j in range(parts)]
        return pd.DataFrame(rows, columns=["bucket", "part", "above", "joint", "bytes"])

    buckets = max(1, math.ceil(groups.count() / per_bucket))
    dealt = groups.select("group", "bytes", F.pmod(F.xxhash64("group"), F.lit(buckets)).alias("bucket"))
    placed = store(dealt.groupBy("bucket").applyInPandas(leaves, "group binary, bucket bigint, part int, bytes bigint"), "leaves")
    sizes = placed.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    while buckets > 1:
        fewer = math.ceil(buckets / per_bucket)
        joined = store(
            sizes.withColumn("above", F.pmod(F.col("bucket"), F.lit(fewer)))
            .groupBy("above")
            .applyInPandas(joins, "bucket bigint, part int, above bigint, joint int, bytes bigint"),
            "joins",
        )
        moves = joined.select(F.col("bucket").alias("_b"), F.col("part").alias("_p"), "above", "joint")
        here = (F.col("bucket") == F.col("_b")) & (F.col("part") == F.col("_p"))
        placed = placed.join(moves, here).select("group", F.col("above").alias("bucket"), F.col("joint").alias("part"))
        sizes = joined.groupBy(F.col("above").alias("bucket"), F.col("joint").alias("part")).agg(F.sum("bytes").alias("bytes"))
        buckets = fewer
    return placed.select("group", F.col("part").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8, per_bucket: int = GROUPS_PER_BUCKET) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): every row of ``docs`` in one of the shards.

    Rows with equal texts share a shard; the law is ``bytes``: the shards' total sizes are as near to equal as
    the largest group of equal texts allows. A row's size is its text's UTF-8 bytes plus 1; a null text has no
    bytes and counts as the empty text. ``slot`` numbers the rows of a shard from 0. ``grown_shard`` is null,
    as this law says nothing of more shards. Repeated rows are placed each; an empty table gives no rows;
    other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = store(
        keyed(
            docs.select(
                "doc_id",
                (F.octet_length(text) + 1).cast("bigint").alias("size"),
                F.crc32(text.cast("binary")).alias("text_crc32"),
                F.unhex(F.sha2(text, 256)).alias("group"),
            ),
            "doc_id", "size", "text_crc32", "group",
        ),
        "sizes",
    )
    groups = store(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    placed = store(rows.join(assign_groups(groups, shards, per_bucket), "group").drop("group"), "placed")
    return numbered_slots(placed, "shard", ["doc_id", "rid"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op1_karmarkar_karp")
def op1_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
