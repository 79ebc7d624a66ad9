"""Hard negatives against plain sorting of all scores, and the pruning against plain products."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinio.llm import hard_negatives as h


def plain(rows, positives=5, negatives=3):
    """rows: (id, label, vector or None, anchor)."""
    use = []
    for i, label, v, anchor in rows:
        if i is None or label is None or not v or any(e is None or not math.isfinite(e) for e in v):
            continue
        use.append((i, label, [math.floor(256 * e) for e in v], anchor))
    out = []
    for k, (i, label, x, anchor) in enumerate(use):
        if not anchor:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, lab == label) for n, (j, lab, y, _) in enumerate(use) if n != k and len(y) == len(x))
        for s, j, _ in [r for r in scored if r[2]][:positives]:
            p = -s
            fit = [(-t, o) for t, o, same in scored if not same and Fraction(p) / 2 <= -t <= Fraction(95 * p, 100)][:negatives]
            out += [(i, j, r, o, p, t) for r, (t, o) in enumerate(fit, 1)]
    return sorted(out)


def frame(spark, rows):
    full = [(i, v, label, anchor, "a", "b", "c", None) for i, label, v, anchor in rows]
    return spark.createDataFrame(full, "vec_id bigint, embedding array<double>, label int, marked boolean, rid string, x string, asks string, score string")


def mined(spark, rows):
    return sorted(tuple(r) for r in h.hard_negatives(frame(spark, rows), F.col("label"), F.col("marked")).collect())


def cloud(seed, n, d=20, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    x = centres[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, d)) * (0.8 ** np.arange(d))
    return [(i, int(rng.integers(0, labels)), v.tolist(), i % 9 == 0) for i, v in enumerate(x)]


@pytest.mark.parametrize("seed", [0, 1])
def test_join_finds_all_pairs_and_no_more(seed):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(700, 37)) * (40 * 0.9 ** np.arange(37))).astype(np.int64)
    q = x[:50] + rng.integers(-3, 3, (50, 37))
    block, full = h.Block(x), q @ x.T
    for least in (full.max(axis=1) * 0.9, full.max(axis=1) * 0.4, np.zeros(50), full.min(axis=1), np.full(50, 10.0**9)):
        i, j, s = block.join(q, least.astype(float))
        ok = full >= least[:, None]
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(ok))))
        assert (s == full[i, j]).all()


def test_join_is_exact_beyond_doubles():
    x = np.array([[1 << 29, 3, 1], [1 << 29, 3, 2], [5, 5, 5]], dtype=np.int64)
    i, j, s = h.Block(x).join(x, np.full(3, 1 << 57, dtype=float))
    assert sorted(zip(i.tolist(), j.tolist(), s.tolist())) == [(a, b, int(x[a] @ x[b])) for a in (0, 1) for b in (0, 1)]


def test_most_of_a_block_is_never_multiplied(monkeypatch):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(2000, 64)) * (200 * 0.8 ** np.arange(64))).astype(np.int64)
    block, seen = h.Block(x), []
    spy = type("Spy", (np.ndarray,), {"__getitem__": lambda self, at: (seen.append(np.size(at[0]) if isinstance(at, tuple) else 0), np.ndarray.__getitem__(self, at))[1]})
    block.x = block.x.view(spy)
    block.join(x[:4], 0.9 * np.square(x[:4]).sum(axis=1).astype(float))
    assert sum(seen) * h.GROUP < 0.5 * x.size


@pytest.mark.parametrize("blocks", [10_000, 16])
def test_equals_sorting_all_scores(spark, monkeypatch, blocks):
    # Blocks of 16 rows make several blocks and turns, and levels of thresholds.
    monkeypatch.setattr(h, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(h, "TURN_ANCHORS", 7 if blocks == 16 else 2048)
    monkeypatch.setattr(h, "PART", 3 if blocks == 16 else 32)
    rows = cloud(2, 400)
    assert mined(spark, rows) == plain(rows)


def test_nulls_ties_repeats_and_odd_vectors(spark):
    v = [1.0, 0.5, -0.25, 2.0]
    rows = [(i, 0, v, True) for i in range(7)] + [(i, 0, v, True) for i in range(3)] + [(20 + i, 1, [0.7 * e for e in v], i == 0) for i in range(5)]
    rows += [(40, 1, None, True), (41, None, v, True), (None, 1, v, True), (42, 1, [], True), (43, 1, [1.0, None, 1.0, 1.0], True)]
    rows += [(44, 1, [float("nan")] * 4, True), (45, 1, [float("inf")] * 4, False), (46, 1, [0.0] * 4, True), (47, 0, [0.0] * 4, True), (48, 1, [0.0] * 4, False)]
    rows += [(50, 0, [1.0, 2.0], True), (51, 0, [1.0, 2.5], False), (52, 1, [0.8, 1.5], True), (53, 0, [-e for e in v], True), (54, 9, v, True)]
    expected = plain(rows)
    assert mined(spark, rows) == expected and expected
    assert mined(spark, [(1, 1, [1e300, 1.0], True), *[(2 + i, i % 2, [1.0, 1.0 + i], True) for i in range(4)]]) == plain([(2 + i, i % 2, [1.0, 1.0 + i], True) for i in range(4)])


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0], True)]) == [] and mined(spark, [(1, 1, [1.0], None), (2, 1, [1.0], False)]) == []


def test_a_very_common_vector(spark, monkeypatch):
    monkeypatch.setattr(h, "BLOCK_ROWS", 50)
    rows = cloud(3, 200) + [(1000 + i, 1, cloud(3, 200)[0][2], False) for i in range(150)]
    assert mined(spark, rows) == plain(rows)
