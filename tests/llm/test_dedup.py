import hashlib
from collections import Counter, defaultdict

import numpy as np
from conftest_llm import EDGES, LONG, frame, prose

from opinio.llm import exact_dedup, line_dedup, near_dedup


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# Exact copies


def test_exact_groups_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate([prose(k % 23, 5 + k % 23 * 9) + ("" if k % 3 else "!") for k in range(150)])]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(frame(spark, rows), block_bytes=8).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), i == max(ids))
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_edges(spark, edges, nothing):
    got = exact_dedup.exact_dedup(edges).collect()
    assert len(got) == len(EDGES)
    of = {r["doc_id"]: r for r in got}
    assert (of[2]["keep_id"], of[3]["keep_id"], of[2]["group_size"]) == (3, 3, 2)
    assert (of[5]["kept"], of[6]["kept"]) == (False, True)
    assert sum(r["kept"] for r in got) == len({t or "" for _, t in EDGES})
    kept = exact_dedup.drop_copies(edges)
    assert kept.columns == edges.columns and kept.count() == len({t or "" for _, t in EDGES})
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_blocks_with_equal_halves_get_different_names(spark):
    rows = [(1, "ab" * 8), (2, "ab" * 9), (3, "ab" * 7 + "ba"), (4, "ab" * 16), (5, "ab" * 8)]
    names = {r["doc_id"]: (r["level"], r["name"]) for r in exact_dedup.text_names(frame(spark, rows), block_bytes=2).collect()}
    assert names[1] == names[5] and len(set(names.values())) == 4


# Near copies


def jaccard(a, b, counted=False):
    def bag(text):
        w = text.split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    x, y = bag(a), bag(b)
    if not counted:
        x, y = Counter(set(x)), Counter(set(y))
    return sum((x & y).values()) / sum((x | y).values())


def edited(text, seed, edits):
    words, rng = text.split(), np.random.default_rng(seed)
    for at in rng.integers(0, len(words), edits):
        words[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def near_rows():
    base = [prose(100 + k, 120) for k in range(12)]
    rows = [(10 * k, t) for k, t in enumerate(base)]
    rows += [(10 * k + j, edited(base[k], 50 * k + j, 1 + j % 4)) for k in range(12) for j in range(1, 9)]
    hot = prose(999, 150)  # a centre and many copies that are like it, but hardly like each other
    rows += [(1000, hot)] + [(1001 + j, edited(hot, 7000 + j, 3)) for j in range(60)] + [(2000 + j, hot) for j in range(30)]
    return rows


def test_near_classes_equal_brute_force(spark):
    rows = near_rows()
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    pairs = [(a, b) for i, (a, s) in enumerate(rows) for b, t in rows[:i] if jaccard(s, t) >= 0.8]
    want = components([i for i, _ in rows], pairs)
    assert {i: r["class_id"] for i, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[want[i]] and r["kept"] == (want[i] == i) for i, r in got.items())


def test_near_with_counts(spark):
    line = prose(3, 12)
    rows = [(1, " ".join([line] * 10)), (2, " ".join([line] * 2)), (3, " ".join([line] * 9))]
    plain = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    counted = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(spark, rows), weights="counts").collect()}
    assert plain == {1: 1, 2: 1, 3: 1}
    assert jaccard(rows[0][1], rows[2][1], True) >= 0.8 > jaccard(rows[0][1], rows[1][1], True)
    assert counted == {1: 1, 2: 2, 3: 1}


def test_near_edges(spark, edges, nothing):
    got = near_dedup.near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    of = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert (of[2]["class_id"], of[3]["class_id"], of[4]["class_id"]) == (2, 3, 4)
    assert (of[5]["class_id"], of[6]["class_id"]) == (5, 5)
    assert sum(r["kept"] for r in got if r["doc_id"] == 1) == 1 and sum(r["kept"] for r in got if r["doc_id"] is None) == 1
    assert near_dedup.drop_near_copies(edges).columns == edges.columns
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_dart_agreement_is_the_weighted_similarity():
    rng = np.random.default_rng(0)
    elements = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    x, y = rng.integers(0, 9, 300) * rng.random(300), rng.integers(0, 9, 300) * rng.random(300)
    k = 4096
    flat = np.concatenate([elements[x > 0], elements[y > 0]])
    weights = np.concatenate([x[x > 0], y[y > 0]])
    owner = np.repeat([0, 1], [(x > 0).sum(), (y > 0).sum()])
    signatures = near_dedup.dart_signatures(flat, weights, owner, 2, k)
    assert (signatures != 0).all()
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    assert abs((signatures[0] == signatures[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / k)


# Repeated lines


def lines_left(rows, min_words=5):
    """Deletes by trying every run of every length."""
    seen, out, places = {}, {}, []
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        out[i] = (lines, set())
        places += [(i, p) for p in range(len(lines))]
    for i, p in places:
        lines = out[i][0]
        for n in range(1, len(lines) - p + 1):
            run = tuple(lines[p : p + n])
            if run in seen:
                if n > 1 or len(lines[p].split()) >= min_words:
                    out[i][1].update(range(p, p + n))
            else:
                seen[run] = (i, p)
    return {i: (len(lines), len(gone), "\n".join(x for q, x in enumerate(lines) if q not in gone)) for i, (lines, gone) in out.items()}


def test_line_runs_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = [prose(k, 2 + k % 9) for k in range(14)]
    rows = [(i, "\n".join(pool[j] if j < 14 else f"only {i} {j}" for j in rng.integers(0, 22, rng.integers(1, 25)))) for i in range(40)]
    rows += [(100, rows[3][1]), (101, "a\na\na\na\na"), (102, None), (103, "")]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.remove_repeated_runs(frame(spark, rows)).collect()}
    assert got == lines_left(rows)


def test_ranks_follow_the_order_of_suffixes(spark):
    rows = [(1, "b\na\nc\nb\na\nd"), (2, "b\na\nc"), (3, "a\nd\nb")]
    lines = spark.createDataFrame([(i, i, p, x) for i, t in rows for p, x in enumerate(t.split("\n"))], "doc_id bigint, rid bigint, pos int, line string")
    rounds = line_dedup.repeated_prefixes(lines)
    text = {i: t.split("\n") for i, t in rows}
    for k, found in enumerate(rounds):
        ranked = sorted((r["rank"], tuple(text[r["rid"]][r["pos"] : r["pos"] + 2**k])) for r in found.collect())
        assert [p for _, p in ranked] == sorted(p for _, p in ranked)
        assert all((a[0] == b[0]) == (a[1] == b[1]) for a, b in zip(ranked, ranked[1:]))
    assert len(rounds) == 2


def test_line_edges(spark, edges, nothing):
    got = line_dedup.remove_repeated_runs(edges).collect()
    assert len(got) == len(EDGES) and sorted(r["n_removed"] for r in got if r["doc_id"] in (5, 6)) == [0, 1]
    assert {r["text"] for r in got if r["doc_id"] == 5} == {LONG}
    assert line_dedup.remove_repeated_runs(nothing).count() == 0


def test_crowded_buckets_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CROWD", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    test_near_classes_equal_brute_force(spark)
    test_near_with_counts(spark)
