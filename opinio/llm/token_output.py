"""Token ids as files of shuffled planes.

Ids are laid out in ascending doc_id order and cut into fixed-size blocks. A block is transposed into planes, one
per byte or per bit of an id, so that similar bits lie together; each plane is compressed with zstandard. The files
are Parquet tables in one folder, so any store that Spark reaches will do: ``blocks`` holds the planes of each block,
``index`` says for each block which ids it holds and how long its planes are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_folder, store
from .registry import query
from .tables import documents
from .tokens import encoder

BLOCK_IDS = 1 << 18
END_ID = 0
_DOC = "doc_no:bigint,doc_id:bigint,begin:bigint,n:bigint"
_BLOCK = f"shard int, block bigint, first bigint, n_ids int, id_bytes int, plane string, plane_bytes array<int>, planes binary, docs array<struct<{_DOC}>>"


def to_planes(ids: np.ndarray, id_bytes: int, plane: str) -> list[bytes]:
    """The compressed planes of a block, lowest byte (or bit) first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :id_bytes]
    if plane == "byte":
        parts = [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(id_bytes)]
    else:
        parts = [np.packbits((raw[:, k // 8] >> (k % 8)) & 1).tobytes() for k in range(8 * id_bytes)]
    return [zstandard.ZstdCompressor(level=1).compress(p) for p in parts]


def from_planes(planes: bytes, plane_bytes: list[int], n: int, id_bytes: int, plane: str) -> np.ndarray:
    raw, at = np.zeros((n, 4), dtype=np.uint8), 0
    for k, size in enumerate(plane_bytes):
        part = np.frombuffer(zstandard.ZstdDecompressor().decompress(planes[at : at + size]), dtype=np.uint8)
        if plane == "byte":
            raw[:, k] = part
        else:
            raw[:, k // 8] |= np.unpackbits(part, count=n) << (k % 8)
        at += size
    return raw.reshape(-1).view("<u4")


def _encode(tokenizer: str, end_id: int, block_ids: int, plane: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, "leading")
        id_bytes = 2 if max(encode.width - 1, end_id) < 1 << 16 else 4
        end, shard = np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        waiting, docs = bytearray(), []
        first = block = doc_no = total = 0

        def cut(n: int) -> pd.DataFrame:
            nonlocal first, block, docs
            planes = to_planes(np.frombuffer(bytes(waiting[: 4 * n]), dtype="<u4"), id_bytes, plane)
            row = (shard, block, first, n, id_bytes, plane, [len(p) for p in planes], b"".join(planes), docs)
            del waiting[: 4 * n]
            first, block = first + n, block + 1
            docs = [d for d in docs[-1:] if d["begin"] + d["n"] > first]
            return pd.DataFrame([row], columns=["shard", "block", "first", "n_ids", "id_bytes", "plane", "plane_bytes", "planes", "docs"])

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], encode.encode_all(batch["text"])):
                ids += end
                docs.append({"doc_no": doc_no, "doc_id": None if pd.isna(doc_id) else int(doc_id), "begin": total, "n": len(ids) // 4})
                doc_no, total = doc_no + 1, total + len(ids) // 4
                waiting += ids
                while len(waiting) >= 4 * block_ids:
                    yield cut(block_ids)
        if waiting:
            yield cut(len(waiting) // 4)

    return write


def write_token_planes(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, plane: str = "byte"
) -> None:
    """Write the ids of every whole text, each followed by ``end_id``, in ascending doc_id order.

    ``tokenizer`` is the path of a byte-level BPE file that every machine has. A null text counts as empty, so
    each row has one id at least; null doc_ids come first; rows with equal ids follow each other by text. An empty
    table gives empty tables. Tasks hold one block and one document at a time.
    """
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInPandas(_encode(tokenizer, end_id, block_ids, plane), _BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")
    spark = docs.sparkSession
    index = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks").drop("planes", "docs")
    index.write.parquet(f"{folder}/index")


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            ids = from_planes(r.planes, list(r.plane_bytes), r.n_ids, r.id_bytes, r.plane)
            raw, out = memoryview(ids.tobytes()), []
            for d in r.docs:
                a, b = max(d["begin"], r.first), min(d["begin"] + d["n"], r.first + r.n_ids)
                if a < b:
                    out.append((r.shard, d["doc_no"], d["doc_id"], d["begin"], d["n"], a, bytes(raw[4 * (a - r.first) : 4 * (b - r.first)])))
            yield pd.DataFrame(out, columns=["shard", "doc_no", "doc_id", "begin", "n", "at", "ids"]).astype({"doc_id": "Int64"})


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("at")
    out = pdf.head(1).copy()
    out["ids"] = [b"".join(pdf["ids"])]
    return out.astype({"doc_id": "Int64"})


def read_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's ids as little-endian unsigned 32-bit bytes, read from the
    files; ``start`` is the number of ids of all documents before it."""
    blocks = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks")
    index = spark.read.parquet(f"{folder}/index")
    earlier = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = index.groupBy(F.col("shard").alias("_s")).agg(F.sum("n_ids").alias("_n"))
    starts = store(totals.select("_s", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")), "shard-starts")
    schema = "shard int, doc_no bigint, doc_id bigint, begin bigint, n bigint, at bigint, ids binary"
    pieces = blocks.mapInPandas(_pieces, schema)
    whole = F.octet_length("ids") == 4 * F.col("n")
    # Only documents that cross a block's border, about one per block, are put together again.
    crossing = pieces.filter(~whole).groupBy("shard", "doc_no").applyInPandas(_joined, schema)
    found = pieces.filter(whole).unionByName(crossing)
    return found.join(starts, found["shard"] == starts["_s"]).select(
        "doc_id", (F.col("_start") + F.col("begin")).alias("start"), F.col("n").alias("n_tokens"), "ids"
    )


@query("op10_plane_shuffle")
def op10_plane_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/token-planes-{uuid.uuid4().hex}"
    write_token_planes(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_planes(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
