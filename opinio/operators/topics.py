"""Topic models and what is read off them: words, sizes, vectors, assignments."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.clustering import LDA, BisectingKMeans, KMeans, LDAModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, ElementwiseProduct, IDF, NGram, Normalizer, SQLTransformer, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as tx, vectors as vx
from ..session import broadcast_if_small, collect_bounded, cut_lineage, store
from . import relational, vectors
from .rows import explode_rows

MAX_TOPICS = 20_000


def _terms(tokens: str, low: int, high: int, stops: Sequence[str]) -> tuple[list[Transformer], str]:
    """Stages from tokens to the terms to be counted, and their column."""
    stages, source = [], tokens
    if stops:
        stages.append(StopWordsRemover(inputCol=tokens, outputCol="_kept", stopWords=list(stops), caseSensitive=True))
        source = "_kept"
    if (low, high) == (1, 1):
        return stages, source
    grams = [f"_g{n}" for n in range(low, high + 1)]
    stages += [NGram(n=n, inputCol=source, outputCol=f"_g{n}") for n in range(low, high + 1)]
    stages.append(SQLTransformer(statement=f"SELECT *, concat({', '.join(grams)}) AS _terms FROM __THIS__"))
    return stages, "_terms"


def tfidf_model(
    df: DataFrame, tokens: str, min_df: float = 1, max_df: float = 1.0, low: int = 1, high: int = 1, stops: Sequence[str] = ()
) -> PipelineModel:
    """Fitted vectoriser (``tokens`` to sparse ``features``): tf * (ln((1+n)/(1+df)) + 1), unit length.

    Terms are the n-grams of ``low`` to ``high`` tokens that are left without ``stops``. Every term within the document
    frequencies is kept: the vocabulary's size is counted first, not limited.
    """
    before, terms = _terms(tokens, low, high, stops)
    counted = PipelineModel(before).transform(df)
    # For MLlib a limit of 1 or more is a number of documents; "all of them" is its own default.
    top = {"maxDF": max_df} if max_df < 1.0 else {}
    size = max(1, counted.select(F.explode(terms).alias("t")).agg(F.countDistinct("t")).first()[0])
    counter = CountVectorizer(inputCol=terms, outputCol="_tf", vocabSize=size, minDF=min_df, **top).fit(counted)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counter.transform(counted))
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol="_tf", outputCol="_w")
    return PipelineModel([*before, counter, scale, Normalizer(p=2.0, inputCol="_w", outputCol="features")])


def vocabulary_of(vectoriser: PipelineModel) -> list[str]:
    """Terms of a fitted vectoriser, by index."""
    return next(s.vocabulary for s in vectoriser.stages if isinstance(s, CountVectorizerModel))


def lda_fit(df: DataFrame, k: int = 20, seed: int = 42, passes: int = 10, batch_share: float = 0.2, features: str = "features") -> LDAModel:
    """Online LDA on weighted terms: ``passes`` over all texts, in mini-batches of ``batch_share`` of them."""
    steps = math.ceil(passes / batch_share)
    return LDA(k=k, optimizer="online", seed=seed, maxIter=steps, subsamplingRate=batch_share, featuresCol=features).fit(df)


def lda_topic_words(model: LDAModel, vocabulary: Sequence[str], n: int = 20) -> DataFrame:
    """(topic, rank, term, weight) of a fitted LDA; topics times ``n`` rows."""
    spread = model.describeTopics(n).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "e")
    )
    table = spread.sparkSession.createDataFrame(list(enumerate(vocabulary)), "i int, term string")
    joined = spread.join(table, F.col("e.termIndices") == F.col("i"))
    return joined.select("topic", (F.col("pos") + 1).alias("rank"), "term", F.col("e.termWeights").alias("weight"))


def topic_distribution(model: LDAModel, df: DataFrame, id: str) -> DataFrame:
    return model.transform(df).select(id, vector_to_array("topicDistribution").alias("topic_dist"))


def topic_top_words(weights: DataFrame, n: int = 20) -> DataFrame:
    """(topic, rank, term, weight): the ``n`` heaviest terms of each topic."""
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))
    return weights.withColumn("rank", rank).filter(F.col("rank") <= n).select("topic", "rank", "term", "weight")


def dominant_topic(df: DataFrame, dist: str = "topic_dist") -> DataFrame:
    """Topic of greatest share (the first on a tie) and that share."""
    top = F.array_max(dist)
    return df.withColumns(
        {"topic_id": (F.array_position(dist, top) - 1).cast("int"), "topic_confidence": top.cast("double")}
    )


def topic_sizes(df: DataFrame, topic: str = "topics") -> DataFrame:
    return df.groupBy(topic).agg(F.count("*").alias("n"))


def topic_share(df: DataFrame, topic: str = "topics") -> DataFrame:
    sizes = topic_sizes(df, topic)
    return sizes.withColumn("share", F.round(F.col("n") / sizes.agg(F.sum("n")).scalar(), 6))


def cluster_embeddings(
    df: DataFrame, ks: Sequence[int], vector: str = "embedding", seed: int = 42, bisecting: bool = False, out: str = "topics"
) -> DataFrame:
    """Hard clusters of vectors by cosine; of several ``ks`` the one with the best silhouette.

    Null and zero vectors have no direction: they are set aside as topic -1.
    """
    apart = F.coalesce(vx.norm(vector), F.lit(0.0)) == 0
    aside = df.filter(apart).withColumn(out, F.lit(-1))
    rows = df.filter(~apart).withColumn("_vec", array_to_vector(vx.l2_normalize(vector)))
    make = BisectingKMeans if bisecting else KMeans
    evaluator = ClusteringEvaluator(featuresCol="_vec", predictionCol="_p", distanceMeasure="cosine")
    best, best_score = None, -2.0
    for k in ks:
        fitted = make(k=k, seed=seed, distanceMeasure="cosine", featuresCol="_vec", predictionCol="_p").fit(rows)
        score = evaluator.evaluate(fitted.transform(rows)) if len(ks) > 1 else 0.0
        if score > best_score:
            best, best_score = fitted, score
    return best.transform(rows).withColumn(out, F.col("_p").cast("int")).drop("_p", "_vec").unionByName(aside)


def ctfidf(
    df: DataFrame, tokens: str, topic: str = "topics", stops: Sequence[str] = (), low: int = 1, high: int = 3, max_df: float = 0.95
) -> DataFrame:
    """(topic, term, weight): share of a term in its class times ln(1 + A / f), A the floored mean class size.

    ``max_df`` is the largest share of classes a term may occur in. N-grams stay inside one text.
    """
    rows = df.select(F.col(topic).alias("topic"), tx.drop_words(F.col(tokens), stops).alias("_t"))
    # The empty term stands for the text itself: it counts the classes in the same pass.
    terms = F.concat(F.array(F.lit("")), tx.ngrams(F.col("_t"), low, high))
    grams = explode_rows(rows, terms, "term", "topic")
    # Kept on storage: the number of classes and the terms' rows read these counts.
    stored = store(grams.groupBy("topic", "term").agg(F.count("*").alias("tf")), "class-counts")
    # A term's rows, one a class at most, meet once; sizes and weights both read what is found there.
    same = Window.partitionBy("term")
    kept = stored.filter(F.col("term") != "").withColumns({"f": F.sum("tf").over(same), "classes": F.count("*").over(same)})
    if max_df < 1.0:
        classes = stored.filter(F.col("term") == "").agg(F.count("*")).scalar()
        kept = kept.filter(F.col("classes") <= max_df * classes)
    kept = store(kept.select("topic", "term", "tf", "f"), "class-terms")
    sizes = cut_lineage(kept.groupBy("topic").agg(F.sum("tf").alias("size")))
    mean_size = F.floor(sizes.agg(F.avg("size")).scalar())
    weighed = kept.join(broadcast_if_small(sizes), "topic")
    return weighed.select(
        "topic", "term", ((F.col("tf") / F.col("size")) * F.log(F.lit(1.0) + mean_size / F.col("f"))).alias("weight")
    )


FIRST_TERMS = 200  # of each topic, by document frequency: among them are its heaviest, as a rule


def topic_tfidf_words(
    df: DataFrame, id: str, tokens: str, topic: str = "topics", stops: Sequence[str] = (), low: int = 1, high: int = 3, n: int = 10
) -> DataFrame:
    """(topic, rank, word, score): per topic, TF-IDF among its own texts, weights summed, top ``n``. ``id`` is unique.

    N-grams move once, to find how many texts share them; those of one text have one idf per topic, and only add to the
    length of its vector. A weight is 1 at most, so a sum is at most the number of texts: n-grams of fewer texts than the
    n-th best sum found among some are not summed. Exact; all are summed where that bound says nothing.
    """
    texts = store(
        df.filter(F.col(topic) != -1).select(id, F.col(topic).alias("topic"), tx.drop_words(F.col(tokens), stops).alias("_t")), "topic-texts"
    )
    documents = broadcast_if_small(cut_lineage(texts.groupBy("topic").agg(F.count("*").cast("double").alias("_n"))))
    grams = explode_rows(texts.repartition(id), tx.ngrams(F.col("_t"), low, high), "term", id, "topic")
    counts = grams.groupBy(id, "topic", "term").agg(F.count("*").alias("tf"))
    counted = counts.withColumn("df", F.count("*").over(Window.partitionBy("topic", "term")))
    shared = store(counted.filter(F.col("df") > 1), "shared-terms")
    idf = lambda f: F.log((F.lit(1.0) + F.col("_n")) / (F.lit(1.0) + f)) + 1
    single, own = idf(F.lit(1)), idf(F.col("df"))
    squares = F.col("tf") * F.col("tf")
    alone = counts.groupBy(id, "topic").agg(F.sum(squares).alias("_q")).join(documents, "topic").select(id, (F.col("_q") * single * single).alias("_q"))
    more = shared.join(documents, "topic").select(id, (squares * (own * own - single * single)).alias("_q")).groupBy(id).agg(F.sum("_q").alias("_q"))
    lengths = store(alone.unionByName(more).groupBy(F.col(id).alias("_id")).agg(F.sqrt(F.sum("_q")).alias("_l")), "topic-lengths")

    def summed(rows: DataFrame) -> DataFrame:
        weighed = rows.join(documents, "topic").join(lengths, F.col(id).eqNullSafe(F.col("_id")))
        sums = weighed.groupBy("topic", "term").agg(F.round(F.sum(F.col("tf") * own / F.col("_l")), 6).alias("weight"))
        return cut_lineage(topic_top_words(sums, n))

    terms = store(shared.groupBy("topic", "term").agg(F.first("df").alias("weight")), "topic-terms")
    first = cut_lineage(topic_top_words(terms, FIRST_TERMS).select("topic", "term", "weight"))
    found = summed(shared.join(broadcast_if_small(first.select("topic", "term")), ["topic", "term"], "left_semi"))
    # A topic without n found sums: its bound is nothing. Left out are n-grams of ``least`` texts at most.
    ends = found.groupBy("topic").agg(F.when(F.count("*") == n, F.min("weight")).alias("_bound"))
    least = first.groupBy("topic").agg(F.when(F.count("*") == FIRST_TERMS, F.min("weight")).otherwise(1).alias("_least"))
    bounds = cut_lineage(
        documents.join(ends, "topic", "left").join(least, "topic", "left").select("topic", F.coalesce("_bound", F.lit(0.0)).alias("_bound"), F.coalesce("_least", F.lit(1)).alias("_least"))
    )
    if not bounds.filter(F.col("_bound") <= F.col("_least")).isEmpty():
        if bounds.filter(F.col("_bound") <= 1).isEmpty():
            found = summed(shared.join(broadcast_if_small(bounds), "topic").filter(F.col("df") >= F.col("_bound")).select(shared.columns))
        else:
            found = summed(counted)
    return found.select("topic", "rank", F.col("term").alias("word"), F.col("weight").alias("score"))


def topic_vectors(df: DataFrame, topic: str = "topics", vector: str = "embedding") -> DataFrame:
    """(topic, vector): mean vector of each topic."""
    return vectors.mean_vector(df.select(F.col(topic).alias("topic"), vector), ["topic"], vector, "vector")


def _unit_matrix(centres: DataFrame) -> tuple[list[int], np.ndarray]:
    """Topic ids and unit centre vectors, a topics x dimensions matrix held by every task."""
    rows = collect_bounded(centres.select("topic", "vector").orderBy("topic"), MAX_TOPICS, "topic vectors")
    matrix = np.array([r["vector"] for r in rows], dtype=np.float64)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return [r["topic"] for r in rows], matrix / np.where(lengths > 0, lengths, 1.0)


def _unit_rows(column: pd.Series) -> np.ndarray:
    rows = np.array(column.tolist(), dtype=np.float64)
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths > 0, lengths, 1.0)


def topic_reassign(df: DataFrame, centres: DataFrame, id: str, vector: str = "embedding") -> DataFrame:
    """(id, topic, similarity): the most similar topic vector of each row, the smaller id on a tie."""
    ids, matrix = _unit_matrix(centres)
    names = np.array(ids)
    id_type = df.schema[id].dataType.simpleString()

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sims = _unit_rows(pdf[vector]) @ matrix.T
                best = np.argmax(np.round(sims, 12), axis=1)
                yield pd.DataFrame(
                    {id: pdf[id].to_numpy(), "topic": names[best], "similarity": sims[np.arange(len(pdf)), best]}
                )

    return df.select(id, vector).mapInPandas(nearest, f"{id} {id_type}, topic int, similarity double")


def topic_nearest_words(word_vecs: DataFrame, centres: DataFrame, n: int = 50) -> DataFrame:
    """(topic, rank, term, weight): the words whose vectors are closest to each topic vector.

    Every task keeps only its ``n`` best words per topic and batch, so topics x n rows per batch are ranked.
    """
    ids, matrix = _unit_matrix(centres)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            # Rounded before the cut: words that count as equal are all kept, whatever batch they are in.
            sims = np.round(matrix @ _unit_rows(pdf["vector"]).T, 6)
            terms = pdf["term"].to_numpy()
            for t, row in zip(ids, sims):
                floor = np.partition(row, -n)[-n] if len(row) > n else -np.inf
                keep = np.nonzero(row >= floor)[0]
                yield pd.DataFrame({"topic": t, "term": terms[keep], "weight": row[keep]})

    local = word_vecs.select("term", "vector").mapInPandas(best, "topic int, term string, weight double")
    return topic_top_words(local.withColumn("weight", F.round("weight", 6)), n)


def topic_info(
    docs: DataFrame, topic_words: DataFrame, id: str, topic: str = "topics", vector: str = "embedding", words: int = 10, examples: int = 3
) -> DataFrame:
    """topic, size, top words and the ids of the texts closest to the topic vector."""
    centres = broadcast_if_small(cut_lineage(topic_vectors(docs, topic, vector)), MAX_TOPICS)
    rows = docs.select(id, F.col(topic).alias("topic"), vector).join(centres, "topic")
    rows = rows.select("topic", id, F.round(vx.cosine(vector, "vector"), 9).alias("_s"))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("_s"), id))
    closest = rows.withColumn("_r", rank).filter(F.col("_r") <= examples)
    near = closest.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("_r", id)))[id].alias("representative"))
    named = (
        topic_words.filter(F.col("rank") <= words)
        .groupBy("topic")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "word")))["word"].alias("representation"))
    )
    sizes = topic_sizes(docs, topic).withColumnRenamed(topic, "topic")
    return sizes.join(named, "topic", "left").join(near, "topic", "left")


def topic_similarity(centres: DataFrame) -> DataFrame:
    """(topic_a, topic_b, cosine), a before b: each task compares its own topics with the shared matrix of all."""
    ids, matrix = _unit_matrix(centres)
    names = np.array(ids)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for topic, row in zip(pdf["topic"], _unit_rows(pdf["vector"]) if len(pdf) else []):
                later = names > topic
                yield pd.DataFrame({"topic_a": topic, "topic_b": names[later], "cosine": np.round(matrix[later] @ row, 6)})

    return centres.select("topic", "vector").mapInPandas(compare, "topic_a int, topic_b int, cosine double")


def topic_word_barchart_data(weights: DataFrame, docs: DataFrame, topic: str = "topics", topics: int = 10, words: int = 5) -> DataFrame:
    """(topic, rank, term, weight) of the ``topics`` biggest topics, noise left out."""
    sizes = topic_sizes(docs.filter(F.col(topic) != -1), topic).withColumnRenamed(topic, "topic")
    biggest = relational.top_k(sizes, "n", "topic", topics).select("topic")
    return topic_top_words(weights.join(biggest, "topic", "left_semi"), words)
