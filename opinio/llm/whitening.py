"""Whitened embeddings by distributed block matrices.

Vectors become fixed-point integers, so that sums do not depend on the order of rows. Centred rows are indexed into
an MLlib ``BlockMatrix``; its transpose times itself is the scatter matrix, whose eigenvectors (dimensions x
dimensions) are found on the driver; the blocks times the whitening matrix are the projected rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import broadcast_if_small, store
from .registry import query
from .tables import keyed

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
BLOCK_ROWS, BLOCK_COLUMNS = 1024, 1024
BLOCKS_PER_TASK = 16  # row blocks that meet in one task of a scatter product
ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row in it below


@dataclass
class Whitened:
    """``rows`` is a stored table (index, key, x, whitened), one row per vector; the rest describes the fit."""

    rows: DataFrame
    n: int
    sums: list[int]
    eigenvalues: np.ndarray  # of the returned components, falling
    components: np.ndarray  # unit vectors, one per column
    explained: np.ndarray  # share of each in the whole variance
    identity_error: float | None

    def deviation(self) -> Column:
        """Sum over dimensions of (n * x - S) ** 2, exact; null if it does not fit a long."""
        whole, rest = _mean(self.n, self.sums)
        apart = F.zip_with(
            F.zip_with("x", whole, lambda x, m: x - m), rest, lambda x, r: F.try_subtract(F.try_multiply(F.lit(self.n).cast("bigint"), x), r)
        )
        return F.aggregate(apart, F.lit(0).cast("bigint"), lambda total, a: F.try_add(total, F.try_multiply(a, a)))


def _mean(n: int, sums: list[int]) -> tuple[Column, Column]:
    """The mean S / n as whole numbers and remainders in [0, n), so that no large doubles are subtracted."""
    return F.array(*[F.lit(s // n).cast("bigint") for s in sums]), F.array(*[F.lit(s % n).cast("bigint") for s in sums])


def usable(vectors: DataFrame, key: str, vector: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(rid, key, x): rows whose vector can be used, x = floor(scale * entry) + offset, with a stored row number."""
    entries = F.transform(F.col(vector), lambda e: e.cast("double"))
    limit = float((1 << 53) // scale)
    rows = vectors.select(F.col(key).alias("key"), entries.alias("c"))
    # NaN is larger than any number, so the limit drops it with the infinities.
    fit = rows.filter(F.coalesce((F.size("c") > 0) & F.forall("c", lambda e: e.isNotNull() & (F.abs(e) < limit)), F.lit(False)))
    x = F.transform("c", lambda e: F.floor(e * scale).cast("bigint") + F.lit(offset).cast("bigint"))
    return store(keyed(fit, "key", x.alias("x")), "fixed-point")


def indexed(rows: DataFrame) -> tuple[DataFrame, int]:
    """Stored ``rows`` with ``index`` from 0 in place of ``rid``, and how many there are.

    No row is shuffled: each task that wrote the table numbered its rows, and those of earlier tasks are added.
    """
    part = F.shiftright("rid", ROW_BITS)
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    starts = store(counts.select("_p", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")), "starts")
    place = F.col("_start") + F.col("rid").bitwiseAND(F.lit((1 << ROW_BITS) - 1).cast("bigint"))
    total = starts.agg(F.sum("_n")).first()[0] or 0
    return rows.join(broadcast_if_small(starts), part == F.col("_p")).withColumn("index", place).drop("_p", "_n", "_start", "rid"), total


def to_blocks(rows: DataFrame, vector: Column, n: int, dimensions: int, block_rows: int = BLOCK_ROWS) -> BlockMatrix:
    """A block matrix of ``vector`` (array of doubles) by ``index`` below ``n``; an index that is left out is a row of zeros."""
    table = rows.select("index", array_to_vector(vector).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(table, "vector"), n, dimensions).toBlockMatrix(block_rows, BLOCK_COLUMNS)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times itself.

    The middle dimension is split, so a task multiplies ``BLOCKS_PER_TASK`` pairs of blocks, and only sums of the
    result's size (dimensions x dimensions) meet. MLlib lists the numbers of the blocks, one for ``BLOCK_ROWS``
    rows and no entries, on the driver.
    """
    splits = math.ceil(blocks.numRowBlocks / BLOCKS_PER_TASK)
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, BLOCK_COLUMNS, BLOCK_COLUMNS).toLocalMatrix().toArray()


def project(spark: SparkSession, blocks: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """(index, whitened): each row of ``blocks`` times ``matrix``."""
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(matrix)], "index bigint, v array<double>")
    product = blocks.multiply(to_blocks(rows, F.col("v"), *matrix.shape, block_rows=BLOCK_COLUMNS))
    found = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return found.select("index", vector_to_array("vector").alias("whitened"))


def _totals(rows: DataFrame, vector: str, kind: str) -> list:
    """Sum of each dimension of an array column; one row per dimension comes back."""
    cells = rows.select(F.posexplode(vector).alias("d", "e"))
    return [r["s"] for r in cells.groupBy("d").agg(F.sum(F.col("e").cast(kind)).alias("s")).orderBy("d").collect()]


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET
) -> Whitened | None:
    """Whitening of all usable rows of ``vectors``, fitted on all of them, by at most ``components`` eigenvectors.

    Rows are left out whose vector is null or empty, holds null or non-finite entries or one of 2**53 / scale or
    more, or has another length than most vectors (on a tie the longer ones stay). Repeated keys and null keys are
    rows of their own; other columns are ignored. Without usable rows the result is None. Components without
    variance (to rounding) have null in ``whitened``, and the identity error, the largest entry of the whitened rows'
    covariance less the identity, is over the others (None without any).
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector, scale, offset)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None
    dimensions, n = lengths
    rows, total = indexed(rows)
    rows = rows.filter(F.size("x") == dimensions)
    sums = [int(s) for s in _totals(rows, "x", "decimal(20,0)")]
    whole, rest = _mean(n, sums)
    centred = F.zip_with(F.zip_with("x", whole, lambda x, m: (x - m).cast("double")), rest, lambda x, r: x - r / F.lit(float(n)))
    blocks = to_blocks(rows, centred, total, dimensions)
    covariance = scatter(blocks) / n
    values, vectors_ = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    values, directions = np.maximum(values[order], 0.0), vectors_[:, order]
    trace = float(np.trace(covariance))
    lively = values > max(trace, 0.0) * dimensions * np.finfo(float).eps
    matrix = directions / np.sqrt(np.where(lively, values, 1.0))
    found = project(spark, blocks, matrix)
    if not lively.all():
        found = found.withColumn("whitened", F.zip_with("whitened", F.array(*[F.lit(bool(v)) for v in lively]), lambda w, v: F.when(v, w)))
    table = store(rows.join(found, "index").select("index", "key", "x", "whitened"), "whitened")
    return Whitened(table, n, sums, values, directions, values / trace if trace > 0 else np.zeros_like(values), identity_error(table, total, lively))


def identity_error(table: DataFrame, total: int, lively: np.ndarray) -> float | None:
    """Largest absolute entry of the covariance of the whitened rows less the identity, from the stored rows."""
    kept = [i for i, v in enumerate(lively) if v]
    if not kept:
        return None
    live = F.array(*[F.col("whitened")[i] for i in kept])
    part = table.select("index", live.alias("w"))
    n = table.count()
    means = F.array(*[F.lit(s / n) for s in _totals(part, "w", "double")])
    again = to_blocks(part, F.zip_with("w", means, lambda w, m: w - m), total, len(kept))
    return float(np.abs(scatter(again) / n - np.eye(len(kept))).max())


_RESULT = "vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@query("op13_block_whitening")
def op13_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    fit = whiten(vectors)
    if fit is None:
        return spark.createDataFrame([], _RESULT.format(kind=vectors.schema["vec_id"].dataType.simpleString()))
    explained = F.array(*[F.lit(float(e)) for e in fit.explained])
    cells = fit.rows.select("key", fit.deviation().alias("deviation"), F.posexplode("whitened").alias("c", "whitened"))
    return cells.select(
        F.col("key").alias("vec_id"), (F.col("c") + 1).alias("component"), F.lit(fit.n).cast("bigint").alias("n"), "deviation", "whitened",
        explained[F.col("c")].alias("explained"), F.lit(fit.identity_error).cast("double").alias("identity_error"),
    )
