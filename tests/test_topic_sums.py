"""Topic words by summed TF-IDF against plain Python: few n-grams are summed, the result is that of all."""

import math
import random
from collections import Counter, defaultdict

import pytest

from opinio.operators import topics


def plain(rows, high, n):
    """rows: (id, topic, tokens); rows of one id and topic are one text of more words, as their counts are added."""
    size, tf = Counter(t for _, t, _ in rows if t not in (-1, None)), Counter()
    for i, t, words in rows:
        if t not in (-1, None):
            tf.update((i, t, " ".join(words[j : j + k])) for k in range(1, high + 1) for j in range(len(words) - k + 1))
    df = Counter((t, g) for _, t, g in tf)
    w = {k: c * (math.log((1 + size[k[1]]) / (1 + df[k[1:]])) + 1) for k, c in tf.items()}
    length = defaultdict(float)
    for (i, _, _), x in w.items():
        length[i] += x * x
    sums = defaultdict(lambda: defaultdict(float))
    for (i, t, g), x in w.items():
        sums[t][g] += x / math.sqrt(length[i])
    return {(t, r, g): round(s, 6) for t, found in sums.items() for r, (g, s) in enumerate(sorted(found.items(), key=lambda x: (-round(x[1], 6), x[0]))[:n], 1)}


@pytest.mark.parametrize("first", [4, 30, 200])
@pytest.mark.parametrize("small", [False, True])
def test_summing_few_terms_gives_the_words_of_all(spark, monkeypatch, first, small):
    draw = random.Random(11)
    word = lambda: f"w{int(draw.paretovariate(0.9)) % 90}"
    rows = [(i, i % 4 - 1, [word() for _ in range(draw.randrange(1, 9))]) for i in range(400)]
    rows += [(7, 2, ["w1", "w2"]), (7, 1, ["w1"]), (None, 1, ["w1", "w3"]), (None, 1, ["w1"]), (999, None, ["w1"]), (1000, 2, [])]
    rows += [(2000, 9, ["only", "once"])] if small else []  # too small a topic for the bound: everything is summed
    monkeypatch.setattr(topics, "FIRST_TERMS", first)
    stored = {}
    keep = topics.store
    monkeypatch.setattr(topics, "store", lambda df, name: stored.setdefault(name, keep(df, name)))
    df = spark.createDataFrame(rows, "id long, topics int, t array<string>")
    got = {(r["topic"], r["rank"], r["word"]): r["score"] for r in topics.topic_tfidf_words(df, "id", "t", high=2, n=3).collect()}
    want = plain(rows, 2, 3)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    # N-grams of one text do not go on from there.
    assert stored["shared-terms"].filter("df < 2").isEmpty() and not stored["shared-terms"].isEmpty()
