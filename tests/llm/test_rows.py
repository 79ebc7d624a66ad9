"""Sharding, mixing, packing, token output, personal data, quality, embeddings."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from conftest_llm import EDGES, frame, prose
from tokenizers import Tokenizer

from opinio.llm import embedding_dedup, mixing, packing, pii, quality, sharding, token_output, tokens
from opinio.llm.tokens import Encoder
from test_dedup import components

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")

# Sharding


def sized(t):
    return len((t or "").encode()) + 1


def check_shards(rows, got, shards):
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    where = defaultdict(set)
    texts = dict(rows)
    for r in got:
        t = texts[r["doc_id"]]
        where[t or ""].add(r["shard"])
        assert r["size"] == sized(t) and r["text_crc32"] == zlib.crc32((t or "").encode()) and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(s) == 1 for s in where.values())
    for s in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("per_bucket", [7, 20_000])
def test_shards_are_even_in_bytes(spark, per_bucket):
    rows = [(i, prose(i % 160, 3 + i % 160 * 2)) for i in range(200)]
    got = sharding.shard_documents(frame(spark, rows), 8, per_bucket).collect()
    check_shards(rows, got, 8)
    totals = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert max(totals) - min(totals) <= 0.02 * sum(totals) / 8


def test_shard_edges(spark, edges, nothing):
    check_shards(EDGES, sharding.shard_documents(edges).collect(), 8)
    assert sharding.shard_documents(nothing).count() == 0


def test_differencing_beats_the_largest_first_rule():
    rng = np.random.default_rng(1)
    items = [int(x) for x in rng.integers(1, 10_000, 300)]
    totals = [0] * 8
    for item, ends in zip(items, sharding.difference([[x] + [0] * 7 for x in items], 8)):
        assert sorted(ends) == list(range(8))
        totals[ends[0]] += item
    greedy = [0] * 8
    for x in sorted(items, reverse=True):
        greedy[greedy.index(min(greedy))] += x
    assert max(totals) - min(totals) <= max(greedy) - min(greedy)
    assert sharding.difference([], 8) == []


# Mixing


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes):
    """Shares by weight, the excess given on until no source is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix_meets_targets(spark):
    rows = [(i, prose(i, 1 + i * 7 % 60), ["a", "b", "c", None, "hot", "hot", "hot"][i % 7]) for i in range(700)]
    got = mixing.mix_documents(frame(spark, rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want, of = targets(sizes), {i: (t, s) for i, t, s in rows}
    taken = Counter()
    for r in got:
        t, s = of[r["doc_id"]]
        assert r["size"] == words(t) and r["source_size"] == sizes[s] and math.isclose(r["target"], want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    again = mixing.mix_documents(frame(spark, rows).repartition(5)).collect()
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in again}
    mixed = Counter(r["doc_id"] for r in mixing.mixed_rows(frame(spark, rows)).collect())
    assert mixed == Counter({r["doc_id"]: r["times"] for r in got if r["times"]})


def test_mix_edges(spark, edges, nothing):
    got = mixing.mix_documents(edges).collect()
    assert len(got) == len(EDGES) and all(r["taken"] <= 2 * r["size"] for r in got)
    blank = mixing.mix_documents(frame(spark, [(1, None), (2, " ")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 2
    assert mixing.mix_documents(nothing).count() == 0
    assert mixing.mixed_rows(edges).columns == edges.columns


# Tokens


TEXTS = ["", " ", "a", "Hello, world", "two  blanks", "a\nb", "a\n\nb", " a", "a ", "\n", "tab\tand no-break", "don't we'll", "x \ny", "x\n y", "é😀 ñandú z", "a\x1cb c", "\x00a \x00", "12 3.4 <|endoftext|> z", "日本 語", prose(5, 300), "Σας ΣΑΣ é ́x"]


@pytest.mark.parametrize("path, spaces", [(BYTE, "leading"), (WORD, "dropped")])
def test_pieces_give_the_tokenizers_ids(path, spaces):
    plain, pieces = Tokenizer.from_file(path), Encoder(path, spaces)
    plain.encode_special_tokens = True
    for t in TEXTS:
        assert np.frombuffer(pieces.encode(t), dtype="<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
    assert pieces.encode(None) == b""


@pytest.mark.parametrize("as_text", [True, False])
@pytest.mark.parametrize("path, spaces", [(BYTE, "leading"), (WORD, "dropped")])
def test_batches_give_the_tokenizers_ids(monkeypatch, path, spaces, as_text):
    monkeypatch.setattr(tokens, "SLICE_CHARS", 2_000)
    plain, pieces = Tokenizer.from_file(path), Encoder(path, spaces, special_as_text=as_text)
    plain.encode_special_tokens = as_text
    rng = np.random.default_rng(11)
    bits = [" ", " ", " ", "\n", "  ", "\t", ",", ".", "<|endoftext|>", "it's", "Word", "é́", "\u095c,", "42", "日本", "a" * 40]
    texts = [None, *TEXTS, *("".join(rng.choice(bits, rng.integers(1, 40))) for _ in range(3_000)), prose(7, 2_500)]
    texts += [" ".join(rng.choice(["river", "Stone.", "and", "don't", "\nnew"], 30)) for _ in range(300)]
    got = list(pieces.encode_all(texts))
    assert len(got) == len(texts)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, dtype="<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert list(pieces.encode_all([])) == []


def ids_of(path, text, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_planes_round_trip(plane):
    ids = np.random.default_rng(2).integers(0, 50_257, 1001).astype("<u4")
    for width in (2, 4):
        planes = token_output.to_planes(ids, width, plane)
        assert (token_output.from_planes(b"".join(planes), [len(p) for p in planes], len(ids), width, plane) == ids).all()


@pytest.mark.parametrize("plane, block", [("byte", 2000), ("bit", 1 << 18)])
def test_token_files_round_trip(spark, edges, tmp_path, plane, block):
    token_output.write_token_planes(edges, str(tmp_path / "t"), BYTE, block_ids=block, plane=plane)
    got = token_output.read_token_planes(spark, str(tmp_path / "t")).orderBy("start").collect()
    order = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    assert len(got) == len(order)
    for r, (i, t) in zip(got, order):
        ids = ids_of(BYTE, t, 0)
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (i, at, len(ids), ids.tobytes())
        at += len(ids)


def test_token_files_of_nothing(spark, nothing, tmp_path):
    token_output.write_token_planes(nothing, str(tmp_path / "t"), BYTE)
    assert token_output.read_token_planes(spark, str(tmp_path / "t")).count() == 0


# Packing


def check_packing(rows, got):
    pieces, texts = defaultdict(list), defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for r in got:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, found in pieces.items():
        ids, copies = ids_of(WORD, texts[i][0], 2), len(texts[i])
        cover = np.zeros(len(ids) + 1, dtype=int)
        for r in found:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["doc_tokens"] == len(ids) and len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(part.tobytes())
            cover[r["start"]] += 1
            cover[r["start"] + r["length"]] -= 1
        assert (np.cumsum(cover)[:-1] == copies).all()
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["context"]))
    for parts in sequences.values():
        at = 0
        for offset, length, context in sorted(parts):
            assert offset == at
            at += length
        assert at == context <= 4096 and at & (at - 1) == 0


def test_packing_covers_each_id_once(spark):
    rows = [(i, prose(i, 1 + i * i % 3000)) for i in range(60)]
    got = packing.pack_documents(frame(spark, rows), WORD, chunk_tokens=20_000).collect()
    check_packing(rows, got)
    groups = Counter()
    for r in got:
        groups[r["step_group"]] += r["length"]
    partial = [n for n in groups.values() if n != packing.STEP_TOKENS]
    assert max(groups.values()) <= packing.STEP_TOKENS and len(partial) <= frame(spark, rows).rdd.getNumPartitions()


def test_packing_edges(spark, edges, nothing):
    check_packing(EDGES, packing.pack_documents(edges, WORD).collect())
    assert packing.pack_documents(nothing, WORD).count() == 0


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        luhn = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
        return 16 <= len(digits) <= 19 and luhn % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def personal_rows():
    rng = np.random.default_rng(6)

    def card():
        d = [int(x) for x in rng.integers(0, 10, 15)]
        total = sum(2 * x - 9 * (x > 4) if k % 2 == 0 else x for k, x in enumerate(d))
        n = "".join(map(str, d + [-total % 10]))
        return n if rng.random() < 0.5 else "-".join(n[k : k + 4] for k in range(0, 16, 4))

    made = {
        0: lambda: f"user{rng.integers(99)}.x@mail.example.com",
        1: lambda: ".".join(map(str, rng.integers(0, 256, 4))),
        2: card,
        3: lambda: f"+1 ({rng.integers(100, 999)}) 555-{rng.integers(1000, 9999)}",
        4: lambda: ".".join(map(str, rng.integers(256, 999, 4))),
        5: lambda: "".join(map(str, rng.integers(0, 10, 40))),
        6: lambda: f"+{rng.integers(9)} {rng.integers(99)}",
    }
    return [(i, " ".join([prose(i, 6), "call", made[i % 7](), prose(i + 500, 4), made[i * 3 % 7](), "é😀."])) for i in range(280)]


TRICKY = [
    "a@b.c..d@e.f", "a@b.c_d@e.f x@@y.z", "a@b@c.d", "a..b@c.de.", "x@y", "a@b.c@d.e", ".@-.-", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "300.1.1.1 1.2.3.0004",
    "4111 1111 1111 1111", "4111-1111-1111-1111 ", "4111  1111 1111 1111", "4111 -1111 1111 1111", "4111111111111111-", "+1 (017) 555-7713", "+1((((((2", "+12 +34",
    "++1 234 567 89", "é😀 +44 20 7946 0958 😀 4111111111111111 😀 é@b.co z@é.co q@b.co", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9",
    "9" * 5000, "1-" * 9000, "1." * 9000, "a" * 20_000 + "@", "a@" + "b." * 9000 + "c", "+1" * 5000, "((((" * 3000 + "+1 " + "2-" * 3000, "",
]


def test_base_spans_equal_brute_force(spark):
    rows = personal_rows() + list(enumerate(TRICKY, 1000)) + [(5000, None)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(spark, rows)).collect()}
    for i, t in rows:
        found = [(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in got[i] if not s["added"]]
        assert found == base_spans(t), (i, (t or "")[:80])


def test_loose_spans_are_added_and_plain_text_is_left_alone(spark):
    loose = [(2000, "please call 212 555-0147 now"), (2001, "write to jane.doe (at) example [dot] org today"), (2002, "version 12.10 of 2024-01-02 costs 1,299.00")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(spark, personal_rows() + loose)).collect()}
    assert [(s["start"], s["end"]) for s in got[2001]] == [(9, 40)]
    assert got[2002] == []
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, personal_rows() + loose)).collect()}
    assert redacted[2001] == "write to " + "*" * 31 + " today" and redacted[2002] == loose[2][1]


def test_personal_edges(spark, edges, nothing):
    got = pii.personal_data(edges).collect()
    assert len(got) == len(EDGES) and pii.redact(edges).columns == edges.columns
    assert pii.personal_data(nothing).count() == 0


def test_personal_query_digest(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables not present")
    texts = dict(pd.read_parquet(f"{sf}/documents.parquet")[["doc_id", "text"]].itertuples(index=False))
    for r in pii.op5_candidate_boosting(spark, sf).collect():
        want = base_spans(texts[r["doc_id"]])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and r["spans"].startswith(said)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]


# Quality


def test_quality_learns_and_only_from_allowed_rows(spark):
    rows = [(i, prose(i, 60) if i % 3 else " | ".join(prose(i, 60).split())) for i in range(900)]
    flipped = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    labels = spark.createDataFrame([(i, int((i % 3 > 0) != flipped(i))) for i, _ in rows], "doc_id long, quality int")
    got = quality.score_quality(frame(spark, rows), labels).collect()
    assert all(r["held_out"] == flipped(r["doc_id"]) for r in got)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got]) > 0.98


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 4))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    network = quality.Network(4)
    network.fit(x[:2000], y[:2000])
    network.w[2], network.w[3] = network.w[2] * 5, network.w[3] * 5
    sharp = network.score(x)
    network.calibrate(x[2000:], y[2000:])
    loss = lambda p: -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
    assert network.temperature > 2 and loss(network.score(x)) < loss(sharp)


def test_quality_edges(spark, edges, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(None, 1), (1, None), (1, 1), (3, 7)], "doc_id long, quality int")
    got = quality.score_quality(edges, none).collect()
    assert len(got) == len(EDGES) and {(r["score"], r["predicted"]) for r in got} == {(0.5, 0)}
    assert {r["score"] for r in quality.score_quality(edges, odd).collect()} <= {0.5, 1.0}
    assert quality.score_quality(nothing, odd).count() == 0
    assert quality.keep_good(edges, none).columns == edges.columns


# Embeddings


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], c, "x") for i, v, c in rows], "vec_id long, embedding array<float>, label int, rid string")


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 16))
    near = np.concatenate([base[:120] + rng.normal(size=(120, 16)) * s for s in (0.1, 0.17, 0.2, 0.25)])
    hot = np.tile(base[0], (50, 1))
    x = np.concatenate([base, near, hot]).astype(np.float32)
    rows = [(i, v, int(i % 2) if i < 700 else 0) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_embeddings(vectors(spark, rows), lists=16).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = np.array([c for _, _, c in rows])
    link = (u @ u.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    assert link.sum() > 2000
    want = components(range(len(x)), zip(*np.nonzero(link)))
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum(), want[i], want[i] == i), i


def test_small_blocks_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(embedding_dedup, "BLOCK_QUERIES", 11)
    test_embedding_links_equal_brute_force(spark)


def test_embedding_edges(spark):
    rows = [
        (1, [1, 0], 1), (2, [2, 0], 1), (3, [0, 0], 1), (4, None, 1), (5, [1, None], 1), (6, [float("nan"), 1], 1), (7, [float("inf"), 1], 1),
        (8, [1, 0], None), (9, [1, 0], 2), (10, [], 1), (11, [1, 0, 0], 1), (1, [1, 0], 1), (None, [1, 0], 2), (12, [-1, 0], 1),
    ]
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_embeddings(vectors(spark, rows)).collect()))
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 10, 11, 12)]
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (9, 1, 9, True), (0, 1, 9, False), *alone])
    assert embedding_dedup.near_embeddings(vectors(spark, [])).count() == 0
