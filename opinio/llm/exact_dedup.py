"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and get integer names; then
the names of adjacent blocks are paired, pairs are named in the same way, and so on until each document has
one name. Names stand for contents one to one, so equal (level, name) means equal text: nothing rests on a
hash being free of collisions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import store
from .registry import query
from .tables import Rows, documents, keyed, numbered

BLOCK_BYTES = 4096


def _blocks(text: str | None, size: int) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + size] for i in range(0, len(data), size)] or [b""]


def _first_places(batch: pd.DataFrame, size: int):
    """(row, text bytes' blocks, place of the first equal block in this batch) for each row of a batch."""
    first: dict[bytes, tuple[int, int]] = {}
    for rid, text in zip(batch["rid"], batch["text"]):
        cut = _blocks(text, size)
        yield rid, cut, [first.setdefault(b, (rid, i)) for i, b in enumerate(cut)]


_CUT = "rid bigint, doc_id bigint, text_sha256 string, fresh array<struct<fpos:int,block:binary>>, places array<struct<frid:bigint,fpos:int>>"


def _cut(size: int):
    """Each row's references and the blocks that its batch sees first, from one look at the batch: a second scan may
    cut its batches at other rows."""

    def cut_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (rid, cut, places), key in zip(_first_places(batch, size), batch["doc_id"]):
                out.append(
                    {
                        "rid": rid,
                        "doc_id": None if pd.isna(key) else int(key),
                        "text_sha256": hashlib.sha256(b"".join(cut)).hexdigest(),
                        "fresh": [{"fpos": i, "block": b} for i, (b, place) in enumerate(zip(cut, places)) if place == (rid, i)],
                        "places": [{"frid": r, "fpos": p} for r, p in places],
                    }
                )
            yield pd.DataFrame(out, columns=["rid", "doc_id", "text_sha256", "fresh", "places"])

    return cut_batches


def _check(found: int, wanted: int, what: str) -> None:
    if found != wanted:
        raise RuntimeError(f"exact_dedup: {found} {what} instead of {wanted}")


def text_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(rid, doc_id, text_sha256, level, name): one collision-free name per row of ``docs``."""
    return _names(keyed(docs, "doc_id", "text"), block_bytes)


def _names(rows: DataFrame, block_bytes: int) -> DataFrame:
    """``text_names`` of rows (rid, doc_id, text).

    Each task first looks blocks up among those of its own batch, so a block shared by a third of all rows is
    shuffled once per batch. Blocks and references come from one scan, which is stored; that every reference
    found its block, and every row its name, is checked. A null text counts as empty.
    """
    refs = store(rows.mapInPandas(_cut(block_bytes), _CUT), "block-places")
    fresh = refs.select(F.col("rid").alias("frid"), F.explode("fresh").alias("new")).select("frid", "new.fpos", "new.block")
    named = numbered(fresh, F.col("block"), ["block"], "name").select("frid", "fpos", "name")
    single = refs.select("rid", F.posexplode("places").alias("pos", "place")).select("rid", "pos", "place.frid", "place.fpos")
    state = store(_by_row(single.join(named, ["frid", "fpos"])), "block-names")
    blocks = lambda df, column: df.agg(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0]
    _check(blocks(state, "names"), blocks(refs, "places"), "named blocks")
    finished, level = [], 0
    while True:
        finished.append(state.filter(F.size("names") == 1).select("rid", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        longer = state.filter(F.size("names") > 1)
        if longer.limit(1).count() == 0:
            break
        pairs = longer.select("rid", F.posexplode(_pairs("names")).alias("pos", "pair")).select("rid", "pos", "pair.l", "pair.r")
        names = numbered(pairs.select("l", "r").distinct(), F.struct("l", "r"), ["l", "r"], "name")
        level += 1
        state = store(_by_row(pairs.join(names, ["l", "r"])), f"names-{level}")
    ids = finished[0]
    for more in finished[1:]:
        ids = ids.unionByName(more)
    ids = store(ids.join(refs.select("rid", "doc_id", "text_sha256"), "rid"), "text-names")
    _check(ids.count(), refs.count(), "named rows")
    return ids


def _pairs(names: str):
    """Adjacent names two by two; an odd last one is paired with -1, which is no name."""
    last = F.floor((F.size(names) - 1) / 2).cast("int")
    at = lambda i: F.coalesce(F.get(F.col(names), i), F.lit(-1).cast("bigint"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(at(2 * i).alias("l"), at(2 * i + 1).alias("r")))


def _by_row(named: DataFrame) -> DataFrame:
    gathered = named.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("_n"))
    return gathered.select("rid", F.transform("_n", lambda x: x["name"]).alias("names"))


def _decided(rows: DataFrame, block_bytes: int) -> DataFrame:
    ids = _names(rows, block_bytes)
    best = F.max(F.struct("doc_id", "rid"))
    groups = store(ids.groupBy("level", "name").agg(best.alias("_best"), F.count("*").alias("group_size")), "text-groups")
    return ids.join(groups, ["level", "name"]).select(
        "rid",
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("_best.rid")).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of ``docs``, dropped ones too.

    Rows with equal texts form a group and the one with the largest doc_id stays; of repeated rows with that
    doc_id, one stays. Null texts count as empty, null ids as smaller than any. An empty table gives no rows;
    other columns are ignored. Groups are totals with map-side combining, joined back under adaptive skew
    handling.
    """
    return _decided(keyed(docs, "doc_id", "text"), block_bytes).drop("rid")


def drop_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops; all columns stay."""
    rows = Rows(docs)
    return rows.join(_decided(rows.keyed("doc_id", "text"), block_bytes).filter("kept").select("rid"), "left_semi")


@query(
    "op6_block_naming",
    """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
              doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def op6_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))
