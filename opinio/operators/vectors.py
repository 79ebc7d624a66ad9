"""Dense vectors: encoders, Word2Vec, means of word vectors, cosines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import HashingTF, Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vectors as vx
from ..session import store

Encoder = Callable[[list[str]], np.ndarray]


def l2_normalize(df: DataFrame, vector: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or vector, vx.l2_normalize(vector))


def hashing_encoder(dimensions: int = 64) -> Encoder:
    """Bag of hashed words as a dense vector, for use where no trained model is at hand."""
    import re
    import zlib

    word = re.compile(r"\w\w+")

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), dtype=np.float32)
        for row, text in enumerate(texts):
            slots = [zlib.crc32(w.encode()) % dimensions for w in word.findall(text.lower())]
            np.add.at(out[row], slots, 1.0)
        return out

    return encode


def embed_texts(
    df: DataFrame,
    encoder: Callable[[], Encoder],
    text: str = "clean_comment",
    id: str = "comment_id",
    batch_size: int = 256,
    normalize: bool = True,
) -> DataFrame:
    """(id, embedding) from a caller-supplied encoder.

    ``encoder`` is a factory: it is called once per task, so a model is loaded on the executor and never
    shipped per row. Texts arrive in Arrow batches and are encoded ``batch_size`` at a time.
    """
    id_type = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start : start + batch_size]
                vectors = encode(part["_text"].tolist())
                yield pd.DataFrame({id: part[id].to_numpy(), "embedding": list(np.asarray(vectors, dtype=np.float32))})

    rows = df.select(id, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    vectors = rows.mapInPandas(run, f"{id} {id_type}, embedding array<float>")
    if normalize:
        unit = vx.l2_normalize("embedding").cast("array<float>")
        vectors = vectors.withColumn("embedding", unit)
    return vectors


def hashed_vectors(df: DataFrame, tokens: Column, id: str = "comment_id", dimensions: int = 64) -> DataFrame:
    """(id, embedding): hashed term counts of unit length, computed inside the JVM."""
    rows = df.select(id, tokens.alias("_tokens"))
    hashed = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions).transform(rows)
    return hashed.select(id, vx.l2_normalize(vector_to_array("_tf")).alias("embedding"))


def word2vec_train(
    df: DataFrame, tokens: str, dimensions: int = 300, min_count: int = 5, window: int = 5, seed: int = 42, partitions: int | None = None
) -> Word2VecModel:
    """Skip-gram vectors. Each partition of the input trains on its own texts and the results are averaged;
    ``partitions`` sets another number than the input has, 1 for one undivided training."""
    partitions = partitions or max(1, df.rdd.getNumPartitions())
    model = Word2Vec(
        vectorSize=dimensions, minCount=min_count, windowSize=window, seed=seed, numPartitions=partitions,
        inputCol=tokens, outputCol="_w2v",
    )
    return model.fit(df.select(tokens))


def word_vectors(model: Word2VecModel) -> DataFrame:
    """(term, vector) of a trained model."""
    return model.getVectors().select(F.col("word").alias("term"), vector_to_array("vector").alias("vector"))


def mean_vector(grouped: DataFrame, keys: list[str], vector: str, out: str) -> DataFrame:
    """Mean vector per key, dimension by dimension: map-side sums, so a hot key costs one row per task and
    dimension and no list of vectors is ever gathered."""
    dims = grouped.select(*keys, F.posexplode(vector).alias("_d", "_x"))
    means = dims.groupBy(*keys, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_d", "_m")))["_m"].alias(out))


BLOCK_CELLS = 8_000_000  # pairs of a document and one of its words, in a block of documents
CELLS = 100_000  # of them at a time


def _block(number: int, held: list[tuple]) -> pa.RecordBatch:
    """Documents as one row of flat arrays; ``held`` has (ids, words, words of each document, their places, counts)."""
    ids, words = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
    own = words.dictionary_encode()
    before = np.cumsum([0, *[len(h[1]) for h in held]])
    place = own.indices.to_numpy()
    codes = np.concatenate([place[n + h[3]] for n, h in zip(before, held)])
    one = lambda array: pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)
    flat = [pa.array([a.astype(np.int32).tobytes()], pa.binary()) for a in (np.concatenate([h[2] for h in held]), codes, np.concatenate([h[4] for h in held]))]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(ids), one(own.dictionary), *flat], names=["block", "ids", "names", "sizes", "codes", "ns"])


def _blocks(cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            lists = batch["_t"]
            document = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            if flat.null_count:
                document, flat = document[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
            coded = flat.dictionary_encode()
            wide = max(1, len(coded.dictionary))
            pairs, counts = np.unique(document * wide + coded.indices.to_numpy(), return_counts=True)
            held.append((batch["_id"], coded.dictionary, np.bincount(pairs // wide, minlength=len(lists)), pairs % wide, counts))
            size += len(pairs)
            if size >= cells:
                yield _block(number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield _block(number, held)

    return pack


def _block_sums(dimensions: int):
    """Sums of the vectors of a block's documents and the numbers of their known words."""

    def sums(block: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(known):
            return pd.DataFrame(columns=["_id", "_n", "_s"])
        body = block.iloc[0]
        size, code, times = (np.frombuffer(body[c], np.int32) for c in ("sizes", "codes", "ns"))
        at, vector = known["at"].to_numpy(), np.stack(known["vector"].to_numpy())[:, :dimensions]
        often = np.bincount(at, minlength=body["wide"])
        if often.max() > 1:  # a word with several vectors counts with each
            table = np.zeros((body["wide"], dimensions))
            np.add.at(table, at, vector)
        else:
            table = np.zeros((body["wide"], dimensions), vector.dtype)
            table[at] = vector
        ends = np.cumsum(size)
        n, out, low = np.zeros(len(size)), np.zeros((len(size), dimensions)), 0
        while low < len(size):  # documents of about CELLS words at a time
            first = ends[low] - size[low]
            high = max(low + 1, int(np.searchsorted(ends, first + CELLS, side="right")))
            cells = slice(first, ends[high - 1])
            filled = low + np.flatnonzero(size[low:high])
            if len(filled):
                starts = ends[filled] - size[filled] - first
                n[filled] = np.add.reduceat(times[cells] * often[code[cells]], starts)
                out[filled] = np.add.reduceat(table[code[cells]].astype(np.float64) * times[cells, None], starts, axis=0)
            low = high
        found = n > 0
        return pd.DataFrame({"_id": np.asarray(body["ids"])[found], "_n": n[found], "_s": pd.Series(list(out[found]), dtype=object)})

    return sums


def doc_vector_mean(
    df: DataFrame, word_vecs: DataFrame, tokens: Column, id: str = "comment_id", dimensions: int | None = None
) -> DataFrame:
    """(id, embedding): mean of the vectors of a document's known tokens, then unit length; a document
    without known tokens gets zeros. ``word_vecs`` is (term, vector): trained or pretrained alike.

    Documents become blocks of numbered words where they are. A vector moves once to each block with its word, and a
    document is summed in one task: no row a word and document, and no sums from every part of the vocabulary.
    """
    if dimensions is None:
        dimensions = word_vecs.select(F.size("vector").alias("n")).first()["n"]
    id_type = df.schema[id].dataType.simpleString()
    documents = df.filter(F.col(id).isNotNull()).select(F.col(id).alias("_id"), tokens.alias("_t"))
    schema = f"block bigint, ids array<{id_type}>, names array<string>, sizes binary, codes binary, ns binary"
    blocks = store(documents.mapInArrow(_blocks(BLOCK_CELLS), schema), "document-blocks")
    words = blocks.select(F.col("block").alias("to"), F.posexplode("names").alias("at", "term"))
    zero = F.array_repeat(F.lit(0.0), dimensions)
    whole = F.coalesce(F.transform("vector", lambda x: F.coalesce(x, F.lit(0).cast(word_vecs.schema["vector"].dataType.elementType))), zero)
    met = words.join(word_vecs.select("term", whole.cast(word_vecs.schema["vector"].dataType).alias("vector")), "term").select("to", "at", "vector")
    bodies = blocks.select("block", "ids", F.size("names").alias("wide"), "sizes", "codes", "ns")
    found = bodies.groupBy("block").cogroup(met.groupBy("to")).applyInPandas(_block_sums(dimensions), f"_id {id_type}, _n double, _s array<double>")
    sums = [(F.sum(F.col("_s")[d]) / F.sum("_n")).alias(f"_d{d}") for d in range(dimensions)]
    means = found.groupBy("_id").agg(*sums).select(F.col("_id").alias(id), F.array(*[f"_d{d}" for d in range(dimensions)]).alias("_mean"))
    return df.select(id).join(means, id, "left").select(
        id, F.coalesce(vx.l2_normalize("_mean"), zero).alias("embedding")
    )


def pretrained_vectors(spark, path: str) -> DataFrame:
    """(term, vector) from a table, or from text lines ``word x1 x2 ...``."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("term", "vector")
    parts = F.split("value", " ")
    lines = spark.read.text(path).filter(F.size(parts) > 2)
    return lines.select(
        parts[0].alias("term"), F.slice(parts, 2, F.size(parts) - 1).cast("array<double>").alias("vector")
    )


def cosine_pairs(word_vecs: DataFrame, words: list[str]) -> DataFrame:
    """Cosine matrix (term_a, term_b, cosine) of a named word list.

    The list is a parameter, so the matrix has ``len(words)`` squared cells by construction; the table of
    all vectors is only filtered.
    """
    chosen = word_vecs.filter(F.col("term").isin(words)).select("term", vx.l2_normalize("vector").alias("u"))
    block = chosen.agg(F.collect_list(F.struct("term", "u"))).scalar()
    cells = chosen.select("term", "u", F.explode(block).alias("o"))
    return cells.select(
        F.col("term").alias("term_a"), F.col("o.term").alias("term_b"), F.round(vx.dot("u", "o.u"), 6).alias("cosine")
    )
