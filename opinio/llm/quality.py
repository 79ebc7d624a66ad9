"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Each word has a fixed sparse index vector of a few +1 and -1. A word's vector is the sum of the index vectors of
its neighbours over the whole corpus, so words of like contexts get like vectors. A document is the mean and the
spread of its words' vectors. The network is trained with numpy on a bounded sample of labelled documents, and its
probabilities are calibrated by a temperature fitted on labelled documents that it was not trained on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import store
from .registry import query
from .tables import Rows, documents, keyed, least_by_hash

BUCKETS = 1 << 13  # words are hashed to so many vectors: the model has one size for any corpus
DIMENSIONS = 32
SIGNS = 2  # so many +1 and so many -1 in an index vector
WINDOW = 2
SAMPLE = 20_000  # most labelled rows that the network is fitted on; they are chosen by hash
HIDDEN = 32
THRESHOLD = 0.7
CACHED_WORDS = 300_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Words(dict):
    """Bucket numbers of a piece between blanks: its runs of letters and digits, and its runs of symbols."""

    def __missing__(self, piece: str) -> bytes:
        ids = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in _TOKEN.findall(piece)]
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[piece] = found = np.array(ids, dtype=np.int32).tobytes()
        return found


_words = _Words()


def word_ids(text: str | None) -> np.ndarray:
    return np.frombuffer(b"".join(map(_words.__getitem__, (text or "").split())), dtype=np.int32)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions of the +1 and of the -1 of each bucket's index vector; one more row stands for no word."""
    picks = np.random.default_rng(7).permuted(np.tile(np.arange(DIMENSIONS), (BUCKETS, 1)), axis=1)
    return picks[:, :SIGNS].astype(np.int64), picks[:, SIGNS : 2 * SIGNS].astype(np.int64)


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    plus, minus = index_vectors()
    total = np.zeros(BUCKETS * DIMENSIONS, dtype=np.int64)

    def add(texts: list[np.ndarray]) -> None:
        ids = np.concatenate(texts).astype(np.int64)
        document = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        for step in range(1, WINDOW + 1):
            same = document[step:] == document[:-step]
            left, right = ids[:-step][same], ids[step:][same]
            for word, near in ((left, right), (right, left)):
                for k in range(SIGNS):
                    total[:] += np.bincount(word * DIMENSIONS + plus[near, k], minlength=len(total))
                    total[:] -= np.bincount(word * DIMENSIONS + minus[near, k], minlength=len(total))

    waiting, size = [], 0
    for batch in batches:
        for text in batch["text"]:
            waiting.append(word_ids(text))
            size += len(waiting[-1])
            if size >= 1 << 20:
                add(waiting)
                waiting, size = [], 0
    if waiting:
        add(waiting)
    table = total.reshape(BUCKETS, DIMENSIONS)
    seen = np.flatnonzero(table.any(axis=1))
    yield pd.DataFrame(np.column_stack([seen, table[seen]]), columns=["bucket", *_columns()])


def _columns() -> list[str]:
    return [f"c{i}" for i in range(DIMENSIONS)]


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all word buckets, from every neighbour pair of every document.

    Each task sends one sum per bucket that it met; the driver gets ``BUCKETS`` rows, whatever the corpus.
    """
    schema = ", ".join(["bucket int", *[f"{c} bigint" for c in _columns()]])
    sums = docs.select("text").mapInPandas(_contexts, schema).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in _columns()])
    found = sums.toPandas()
    table = np.zeros((BUCKETS, DIMENSIONS))
    table[found["bucket"].to_numpy()] = found[_columns()].to_numpy()
    scaled = np.sign(table) * np.log1p(np.abs(table))
    length = np.linalg.norm(scaled, axis=1, keepdims=True)
    return (scaled / np.maximum(length, 1e-9)).astype(np.float32)


def pooled(rows: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(rid, doc_id, pooled) of rows (rid, doc_id, text): mean and deviation of the word vectors of each; zeros for no words."""
    shared = rows.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for batch in batches:
            out = np.zeros((len(batch), 2 * DIMENSIONS), dtype=np.float32)
            for i, text in enumerate(batch["text"]):
                ids = word_ids(text)
                if len(ids):
                    mean = np.zeros(DIMENSIONS)
                    square = np.zeros(DIMENSIONS)
                    for at in range(0, len(ids), 1 << 16):
                        x = table[ids[at : at + (1 << 16)]]
                        mean += x.sum(axis=0)
                        square += (x * x).sum(axis=0)
                    mean /= len(ids)
                    out[i, :DIMENSIONS] = mean
                    out[i, DIMENSIONS:] = np.sqrt(np.maximum(square / len(ids) - mean * mean, 0))
            yield pd.DataFrame({"rid": batch["rid"], "doc_id": batch["doc_id"].astype("Int64"), "pooled": list(out)})

    return rows.mapInPandas(pool, "rid bigint, doc_id bigint, pooled array<float>")


class Network:
    """Two layers: tanh units, then a sigmoid, with a temperature that divides the last sum."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 1 / np.sqrt(inputs), (inputs, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.mean, self.scale, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.w
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-3) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x, rng = (x - self.mean) / self.scale, np.random.default_rng(13)
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                a, b, c, d = self.w
                xs, step = x[part], step + 1
                h = np.tanh(xs @ a + b)
                error = (1 / (1 + np.exp(-np.clip(h @ c + d[0], -30, 30))) - y[part]) / len(part)
                back = np.outer(error, c) * (1 - h * h)
                slopes = [xs.T @ back + decay * a, back.sum(axis=0), h.T @ error + decay * c, np.array([error.sum()])]
                for k, g in enumerate(slopes):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least log loss on rows that were not fitted."""
        margin = self.margin(x)

        def loss(t: float) -> float:
            p = 1 / (1 + np.exp(-np.clip(margin / t, -30, 30)))
            return float(-np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)))

        self.temperature = min(np.exp(np.linspace(-2, 2, 81)), key=loss)


def train(features: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Network | float:
    """A network from the labelled rows that may be learned from: those whose crc32(doc_id as text) mod 4 is not 2.

    At most ``sample`` rows are fitted, those of least hash; a fifth of them serves for the temperature. Rows with
    a null id or label are left out. With labels of one kind only, or none, the share of 1 among them (or 0.5)
    is returned and is every text's score.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("double").alias("y"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    chosen = least_by_hash(features.join(known, "doc_id"), sample, "doc_id", "y").select("pooled", "y").collect()
    y = np.array([r["y"] for r in chosen])
    if len(y) < 10 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    x = np.array([r["pooled"] for r in chosen])
    held = np.arange(len(y)) % 5 == 4
    network = Network(x.shape[1])
    network.fit(x[~held], y[~held])
    network.calibrate(x[held], y[held])
    return network


def _scored(rows: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    features = store(pooled(rows, word_vectors(rows)), "pooled")
    model = train(features, labels, label, sample)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if isinstance(model, float):
                scores = np.full(len(batch), model)
            else:
                scores = model.score(np.stack(batch["pooled"].to_list())) if len(batch) else np.zeros(0)
            yield pd.DataFrame({"rid": batch["rid"], "doc_id": batch["doc_id"].astype("Int64"), "score": scores})

    return features.mapInPandas(score, "rid bigint, doc_id bigint, score double")


def score_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE
) -> DataFrame:
    """(doc_id, held_out, score, predicted): every row of ``docs`` with the calibrated probability that it is good.

    Only the text is looked at. Null and blank texts have no words and get the score of the zero vector;
    repeated rows get equal scores; an empty table gives no rows; other columns are ignored. ``held_out`` is
    null for a null doc_id.
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return _scored(keyed(docs, "doc_id", "text"), labels, label, sample).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns stay."""
    rows = Rows(docs)
    return rows.join(_scored(rows.keyed("doc_id", "text"), labels, label, sample).filter(F.col("score") >= threshold).select("rid"), "left_semi")


@query("op7_random_indexing")
def op7_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
