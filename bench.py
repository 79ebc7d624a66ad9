"""Benchmark of the headline queries: one JSON line. ``python bench.py [name ...]`` times chosen queries."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "clean_general", "dedup_keep_first", "explode_sentences", "detect_language", "tokenize_filter", "cleaning_funnel",
    "value_counts", "length_by_star", "daily_outliers", "box_stats_by_month",
    "word_freq", "ngram_counts", "ngram_star_distribution", "tfidf", "tfidf_bigrams", "doc_vector_mean",
    "regex_label", "label_totals", "labels_by_review", "label_coverage",
    "ctfidf", "topic_tfidf_words", "coherence_umass", "coherence_cv", "topic_reassign", "density_clusters",
    "knn_classify", "knn_cv_predict", "best_threshold", "per_label_report", "error_rows", "score_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from opinio.plans import catalog
    from opinio.session import get_session

    spark = get_session(
        "opinio-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or [n for n in HEADLINE if n in catalog.QUERIES]
    catalog.QUERIES["value_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        if sys.argv[1:]:
            print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
