"""The hidden Markov model against sums over all paths and a plain Python scorer."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinio.llm import hmm
from conftest_llm import EDGES, frame, prose


def toy(states=3, size=5, seed=1):
    rng = np.random.default_rng(seed)
    part = lambda *n: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.uniform(0.1, 1, n))
    return hmm.Model(part(states), part(states, states), part(states, size).T.copy())


def paths(model, text):
    for path in itertools.product(range(len(model.start)), repeat=len(text)):
        p = model.start[path[0]] * model.emits[text[0], path[0]]
        for a, b, x in zip(path, path[1:], text[1:]):
            p *= model.steps[a, b] * model.emits[x, b]
        yield path, p


TEXTS = [np.array(t, dtype="<u2") for t in ([0, 3, 1, 1, 4, 2], [2, 2, 0, 4], [1, 0, 3, 4], [4], [4])]


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_likelihoods_and_counts_equal_sums_over_paths(limit):
    model = toy()
    counts, got = hmm.Counts(3, 5), hmm.Counts(3, 5)
    logs = []
    for text in TEXTS:
        all_paths = list(paths(model, text))
        total = sum(p for _, p in all_paths)
        logs.append(math.log(total))
        for path, p in all_paths:
            counts.start[path[0]] += p / total
            for x, s in zip(text, path):
                counts.emits[x, s] += p / total
            for a, b in zip(path, path[1:]):
                counts.steps[a, b] += p / total
    assert np.allclose(hmm.log_likelihoods(model, TEXTS, limit), logs, rtol=1e-12)
    hmm.expect(model, TEXTS, got, limit)
    for name in ("start", "steps", "emits"):
        assert np.allclose(getattr(got, name), getattr(counts, name), rtol=1e-10), name


def test_a_long_text_does_not_underflow():
    model, text = toy(), np.tile(np.array([0, 1, 2, 3], dtype="<u2"), 30_000)
    whole = hmm.log_likelihoods(model, [text])
    assert np.isfinite(whole).all() and np.allclose(whole, hmm.log_likelihoods(model, [text], 777))


def tokens(text):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode("utf-8").lower()) if w] + ["end"]


def plain_scores(rows, learned):
    train = Counter(t for (_, text), take in zip(rows, learned) if take for t in tokens(text))
    n, v = sum(train.values()), len(train)
    return n, [(len(tokens(x)), sum(train[t] > 0 for t in tokens(x)), sum(math.log10((train[t] + 1) / (n + v + 1)) for t in tokens(x))) for _, x in rows]


def learn(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 != 2


def takes(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


def test_base_scores_and_edges(spark, edges):
    rows = [(r[0], r[1]) for r in EDGES]
    n, expected = plain_scores(rows, [takes(i) for i, _ in rows])
    found = hmm.score_texts(edges, learn(), passes=1).collect()
    assert {r["train_tokens"] for r in found} == {n}
    key = lambda r: (repr(r[0]), *r[1:3], round(r[3], 6))
    assert sorted(key((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"])) for r in found) == sorted(key((i, *e)) for (i, _), e in zip(rows, expected))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert all(r["held_out"] == (not takes(r["doc_id"])) for r in found)


def test_score_is_that_of_the_symbols_and_words_inside(spark):
    rows = [(i, prose(i, 40, 90) + f" once{i}") for i in range(60)] + [(100 + i, f"never{i} seen {prose(i, 9)}") for i in range(9)]
    df = frame(spark, rows)
    training = F.col("doc_id") < 60
    words = df.filter(training)
    symbols, rest = hmm.alphabet(hmm.vocabulary(words), words.count(), heavy_share=0.01)
    train = Counter(t for i, text in rows if i < 60 for t in tokens(text))
    assert symbols.heavy == {w: k for k, w in enumerate(sorted(w for w, c in train.items() if w != "end" and c > 0.01 * symbols.tokens))}
    assert symbols.heavy and symbols.tokens == sum(train.values()) and symbols.distinct == len(train)
    ends = {w: int(hmm.endings([w])[0]) for w in set(train) | {t for _, x in rows for t in tokens(x)} if w != "end"}
    size, kinds = Counter(), Counter()
    for w, c in train.items():
        if w != "end" and w not in symbols.heavy:
            size[ends[w]] += c
            kinds[ends[w]] += 1
    at = symbols.end + 1
    assert all(symbols.counts[at + e] == size[e] and symbols.kinds[at + e] == kinds[e] for e in size)
    got = {r["doc_id"]: r["score"] for r in hmm.score_texts(df, training, passes=1).collect()}
    # The production share makes every word of this small corpus heavy.
    symbols, _ = hmm.alphabet(hmm.vocabulary(words), words.count())
    texts = hmm.encoded(hmm.keyed(df, "doc_id", training.alias("training"), "text"), symbols)
    model = hmm.fit(texts.filter("training"), symbols, passes=1)
    for i, text in rows:
        ids, inside = [], 0.0
        for t in tokens(text):
            if t == "end":
                ids.append(symbols.end)
            elif t in symbols.heavy:
                ids.append(symbols.heavy[t])
            else:
                s = symbols.end + 1 + ends[t]
                ids.append(s)
                inside += math.log10((train[t] + 1) / (symbols.counts[s] + symbols.kinds[s] + 1))
        a = model.start * model.emits[ids[0]]
        log = 0.0
        for x in ids[1:]:
            log, a = log + math.log10(a.sum()), (a / a.sum()) @ model.steps * model.emits[x]
        assert got[i] == pytest.approx(log + math.log10(a.sum()) + inside, rel=1e-9)


def test_words_inside_a_symbol_are_joined_from_all_counts(spark, monkeypatch):
    # Without heavy words every word goes by its ending, and the probabilities inside come from the joined table.
    rows = [(i, " ".join(f"w{j}ing" for j in range(i % 5 + 1)) + " xyz") for i in range(30)] + [(50, "unseening w0ing"), (51, None)]
    monkeypatch.setattr(hmm, "HEAVY_BYTES", 0)
    found = {r["doc_id"]: r for r in hmm.score_texts(frame(spark, rows), F.col("doc_id") < 30, states=1, passes=1).collect()}
    train = Counter(t for i, x in rows if i < 30 for t in tokens(x))
    ing = {w: c for w, c in train.items() if w != "end" and w.endswith(b"ing")}
    inside = math.log10(1 / (sum(ing.values()) + len(ing) + 1)) + math.log10((ing[b"w0ing"] + 1) / (sum(ing.values()) + len(ing) + 1))
    assert (found[50]["n_tokens"], found[50]["n_known"]) == (3, 2)
    # With one state the chain is a product of the symbols' shares, close to their counts.
    n = sum(train.values())
    chain = 2 * math.log10(sum(ing.values()) / n) + math.log10(train["end"] / n)
    assert found[50]["score"] == pytest.approx(chain + inside, abs=0.5)


def test_training_raises_the_likelihood_and_beats_single_words(spark):
    rows = [(i, " ".join((("a b c", "x y z")[i % 2]).split() * 12) + f" {prose(i, 4)}") for i in range(140)]
    df = frame(spark, rows)
    symbols, _ = hmm.alphabet(hmm.vocabulary(df), df.count())
    texts = hmm.encoded(hmm.keyed(df, "doc_id", F.lit(True).alias("training"), "text"), symbols)
    model, seen = hmm.first_model(symbols, 4), []
    for _ in range(6):
        seen.append(hmm.likelihoods(texts, model).agg(F.sum("chain")).first()[0])
        model = hmm.baum_welch(texts, symbols, model)
    assert all(b > a for a, b in zip(seen, seen[1:]))
    assert np.allclose(model.emits.sum(axis=0), 1) and np.allclose(model.steps.sum(axis=1), 1) and (model.emits > 0).all()
    held = hmm.score_texts(df, learn()).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held["s"] > held["b"] * 0.8


def test_nothing_to_learn_from(spark, nothing):
    assert hmm.score_texts(nothing, learn()).collect() == []
    found = hmm.score_texts(frame(spark, [(1, "a b"), (2, None)]), F.lit(False), passes=1).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(math.isfinite(r["score"]) for r in found)
