"""Thresholds and multi-label metrics over (id, label, y_true, score|prediction): counts first, ratios last."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _constant_map(values: Mapping[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])


def apply_thresholds(scores: DataFrame, thresholds: Mapping[str, float], strict: bool = True) -> DataFrame:
    """Adds ``threshold`` and ``prediction``; a score on the threshold counts only when not ``strict``."""
    cut = scores.withColumn("threshold", F.try_element_at(_constant_map(thresholds), "label"))
    hit = F.col("score") > F.col("threshold") if strict else F.col("score") >= F.col("threshold")
    return cut.withColumn("prediction", hit.cast("int"))


def best_threshold(scores: DataFrame, low: int = 10, high: int = 90, step: int = 1, default: float = 0.5) -> DataFrame:
    """(label, threshold, f1): the smallest threshold, in percent steps, of greatest F1; ``default`` if F1 is never above 0.

    One pass counts scores per percent bucket; all cuts follow from cumulative sums over at most 100
    buckets per label, so the sweep never rescans the scores.
    """
    percent = F.ceil(F.round(F.col("score") * 100, 9)).cast("int") - 1
    bucket = F.greatest(F.lit(low - 1), F.least(F.lit(high), percent))
    counts = scores.groupBy("label", bucket.alias("t")).agg(
        F.sum("y_true").cast("bigint").alias("pos"), F.count("*").alias("n")
    )
    grid = counts.select("label").distinct().select(
        "label", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("t"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("n")
    )
    merged = counts.unionByName(grid).groupBy("label", "t").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    above = Window.partitionBy("label").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("label")
    cuts = merged.select(
        "label", "t", F.sum("pos").over(above).alias("tp"), F.sum("n").over(above).alias("pred"), F.sum("pos").over(whole).alias("p")
    ).filter((F.col("t") >= low) & ((F.col("t") - low) % step == 0))
    f1 = F.coalesce(2.0 * F.col("tp") / F.nullif(F.col("pred") + F.col("p"), F.lit(0)), F.lit(0.0))
    best = cuts.withColumn("f1", f1).groupBy("label").agg(F.max(F.struct("f1", (-F.col("t")).alias("nt"))).alias("b"))
    return best.select(
        "label",
        F.when(F.col("b.f1") > 0, -F.col("b.nt") / 100.0).otherwise(F.lit(float(default))).alias("threshold"),
        F.round("b.f1", 6).alias("f1"),
    )


def _tally(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    y, p = F.col("y_true") == 1, F.col("prediction") == 1
    return preds.groupBy(*by).agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp")
    )


def confusion_per_label(preds: DataFrame) -> DataFrame:
    return _tally(preds, ["label"])


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when there is nothing to divide by."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2.0 * tp, 2 * tp + fp + fn)


def _rated(counts: DataFrame) -> DataFrame:
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r, "f1": f, "support": F.col("tp") + F.col("fn")})


def _micro(by: Sequence[str], counts: DataFrame) -> DataFrame:
    sums = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return _rated(sums)


def per_label_report(preds: DataFrame, id: str = "id") -> DataFrame:
    """name, precision, recall, f1, support per label and for the micro, macro, weighted and samples averages."""
    labels = _rated(_tally(preds, ["label"]))
    columns = ["name", "precision", "recall", "f1", "support"]
    per_label = labels.withColumnRenamed("label", "name").select(*columns)
    micro = _micro([], labels).withColumn("name", F.lit("micro avg")).select(*columns)
    macro = labels.agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support")
    ).withColumn("name", F.lit("macro avg"))
    weighted = labels.agg(
        *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    ).withColumn("name", F.lit("weighted avg"))
    samples = _rated(_tally(preds, [id])).agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support")
    ).withColumn("name", F.lit("samples avg"))
    rows = per_label
    for part in (micro, macro, weighted, samples):
        rows = rows.unionByName(part.select(*columns))
    return rows.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def f1_scores(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """micro, macro and weighted F1, one row per group of ``by``."""
    labels = _rated(_tally(preds, [*by, "label"]))
    sums = labels.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
        F.avg("f1").alias("_macro"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("_weighted"),
    )
    micro = _prf(F.col("tp"), F.col("fp"), F.col("fn"))[2]
    return sums.select(
        *by, F.round(micro, 6).alias("micro"), F.round("_macro", 6).alias("macro"), F.round("_weighted", 6).alias("weighted")
    )


def label_accuracy(preds: DataFrame) -> DataFrame:
    same = (F.col("y_true") == F.col("prediction")).cast("double")
    return preds.groupBy("label").agg(F.round(F.avg(same), 6).alias("accuracy"))


def hamming_loss(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of wrong (row, label) cells."""
    wrong = (F.col("y_true") != F.col("prediction")).cast("double")
    return preds.groupBy(*by).agg(F.round(F.avg(wrong), 6).alias("hamming_loss"))


def macro_precision_recall(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    labels = _rated(_tally(preds, [*by, "label"]))
    return labels.groupBy(*by).agg(
        F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("f1"), 6).alias("f1")
    )


def cross_val_scores(preds: DataFrame, fold: str = "fold") -> DataFrame:
    """metric, mean and sample std over folds of micro F1, macro F1 and Hamming loss."""
    per_fold = fold_scores(preds, fold)
    entries = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("f1_micro", "f1_macro", "hamming_loss")]
    )
    rows = per_fold.select(F.explode(entries).alias("e")).select("e.*")
    return rows.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"))


def fold_scores(preds: DataFrame, fold: str = "fold") -> DataFrame:
    f1 = f1_scores(preds, [fold]).select(fold, F.col("micro").alias("f1_micro"), F.col("macro").alias("f1_macro"))
    return f1.join(hamming_loss(preds, [fold]), fold)


def error_rows(preds: DataFrame, id: str = "id", n: int = 10) -> DataFrame:
    """(label, kind, id, scores): the first ``n`` false negatives and false positives of each label by id, each with
    the scores of all labels as a map."""
    wrong = preds.filter(F.col("y_true") != F.col("prediction")).select(
        "label", F.when(F.col("y_true") == 1, "false negative").otherwise("false positive").alias("kind"), id
    )
    rank = F.row_number().over(Window.partitionBy("label", "kind").orderBy(id))
    first = wrong.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")
    wanted = preds.join(first.select(id).distinct(), id, "left_semi")
    maps = wanted.groupBy(id).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "score")))).alias("scores"))
    return first.join(maps, id)


def model_comparison(preds: DataFrame, model: str = "model") -> DataFrame:
    """model, f1, precision, recall (macro), best F1 first, over stacked predictions."""
    return macro_precision_recall(preds, [model]).orderBy(F.desc("f1"), model)


def arena(scores: DataFrame, labels: Sequence[str], id: str = "id", model: str = "model", truth: bool = False) -> DataFrame:
    """(id, model, one column per label): OUI or NON per model, marked right or wrong when the truth is given."""

    def cell(label: str) -> Column:
        own = F.col("label") == label
        said = F.when(F.col("prediction") == 1, "OUI").otherwise("NON")
        if truth:
            said = F.concat(F.when(F.col("prediction") == F.col("y_true"), "✅ ").otherwise("❌ "), said)
        return F.max(F.when(own, said)).alias(label)

    return scores.groupBy(id, model).agg(*[cell(c) for c in labels])
