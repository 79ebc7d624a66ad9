"""Near-duplicate texts by DartMinHash signatures and banded joining.

A document is a weighted set of word shingles. Each (shingle, stretch of weight) is a region at which hashed darts
are thrown: a Poisson process of ranks, each dart with a place in the stretch and a coordinate. A dart counts if
its place lies below the shingle's weight, and each coordinate keeps its earliest dart. Two documents keep the same
dart at a coordinate with the probability of their weighted Jaccard similarity, and only darts up to a bound on the
rank, about k ln k per document, are ever made.

Documents that agree on all rows of a band meet in a bucket. They are compared exactly, but never all with all:
each with the bucket's most central document first. What that leaves open is limited by the triangle inequality of
the Jaccard distance; such pairs of still separate classes are compared once, in the first bucket that they share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.density import connected_components
from ..session import store
from .registry import query
from .tables import Rows, documents, numbered_rows

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4  # a pair at the threshold is missed with a probability of (1 - 0.8**4)**32, below 1e-7
CROWD = 64  # documents in a bucket beyond which its pairs are compared inside tasks
BLOCK = 1024  # documents of such a bucket that meet as many others in one task
CACHED_WORDS = 300_000


class _Words(dict):
    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_digest(word.encode("utf-8", "surrogatepass"))
        return found


_words = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers from 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``size`` words between blanks, ascending, and how often each occurs. A text of fewer words is one
    shingle; one without words has none."""
    words = np.frombuffer(b"".join(map(_words.__getitem__, (text or "").split())), dtype=np.uint64)
    if not len(words):
        return words, np.zeros(0, dtype=np.int64)
    n, rolled = max(1, len(words) - size + 1), None
    for i in range(min(size, len(words))):
        part = words[i : i + n]
        rolled = mix(part + np.uint64(i + 1)) if rolled is None else mix(rolled * np.uint64(31) + part + np.uint64(i + 1))
    return np.unique(rolled, return_counts=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _times(factor: int, n: int) -> np.uint64:
    return np.uint64(factor * n % (1 << 64))


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int, k: int) -> np.ndarray:
    """Signatures of ``k`` dart numbers, one row for each of ``owners`` weighted sets given as flat arrays.

    A set without elements gets a row of zeros. Sets that leave a coordinate empty throw again with twice the bound.
    """
    signatures = np.zeros((owners, k), dtype=np.uint64)
    totals = np.bincount(owner, weights=weights, minlength=owners)
    bound = np.zeros(owners)
    filled = totals > 0
    bound[filled] = (k * np.log(k) + 2 * k) / totals[filled]
    open_sets = filled.copy()
    while open_sets.any():
        mine = np.flatnonzero(open_sets[owner])
        darts = [_throw(elements[mine], weights[mine], owner[mine], bound, k)]
        cell, rank, name = (np.concatenate([d[i] for d in darts]) for i in range(3))
        order = np.lexsort((name, rank, cell))
        cell, name = cell[order], name[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, dtype=np.int64)
        hit = np.bincount(cell[first] // k, minlength=owners)
        done = open_sets & (hit == k)
        keep = first[done[cell[first] // k]]
        signatures[cell[keep] // k, cell[keep] % k] = name[keep]
        open_sets &= ~done
        bound[open_sets] *= 2
    return signatures


def _throw(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, bound: np.ndarray, k: int):
    """Darts (set * k + coordinate, rank, number) up to each set's rank bound.

    Stretches of weight are [0, 1), [1, 2), [2, 4), ...: a weight of 2**20 takes 21 of them.
    """
    cells, ranks, names = [], [], []
    stretch, low, width = 0, 0.0, 1.0
    while True:
        live = np.flatnonzero(weights > low)
        if not len(live):
            break
        seed = mix(elements[live] + _times(0x9E3779B97F4A7C15, stretch + 1))
        rank, throw = np.zeros(len(live)), 0
        while len(live):
            dart = mix(seed + _times(0xD1342543DE82EF95, throw + 1))
            rank = rank - np.log(_unit(dart)) / width
            near = rank <= bound[owner[live]]
            live, seed, rank, dart = live[near], seed[near], rank[near], dart[near]
            place = mix(dart ^ np.uint64(0xA0761D6478BD642F))
            inside = low + width * _unit(place) < weights[live]
            number = mix(place + np.uint64(0xE7037ED1A0B428DB))[inside]
            cells.append(owner[live[inside]] * k + (number % np.uint64(k)).astype(np.int64))
            ranks.append(rank[inside])
            names.append(number)
            throw += 1
        low, width, stretch = (1.0, 1.0, 1) if stretch == 0 else (low * 2, width * 2, stretch + 1)
    return (np.concatenate(cells), np.concatenate(ranks), np.concatenate(names)) if cells else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))


def _signatures(size: int, bands: int, rows: int, counted: bool):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

        def flush(keys, sets) -> pd.DataFrame:
            elements = np.concatenate([s for s, _ in sets])
            counts = np.concatenate([c for _, c in sets]) if counted else np.ones(len(elements))
            owner = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
            signatures = dart_signatures(elements, counts.astype(np.float64), owner, len(sets), bands * rows)
            band = np.zeros((len(sets), bands), dtype=np.uint64) + salt
            for r in range(rows):
                band = mix(band * np.uint64(31) + signatures[:, r::rows])
            digests = [
                hashlib.blake2b(s.tobytes() + (c.tobytes() if counted else b""), digest_size=16).digest() if len(s) else None for s, c in sets
            ]
            lists = [b if d is not None else [] for b, d in zip(band.view(np.int64), digests)]
            ids = pd.array([k[1] for k in keys], dtype="Int64")
            return pd.DataFrame({"rid": [k[0] for k in keys], "doc_id": ids, "digest": digests, "bands": lists})

        for batch in batches:
            keys, sets, held = [], [], 0
            for rid, doc_id, text in zip(batch["rid"], batch["doc_id"], batch["text"]):
                keys.append((rid, None if pd.isna(doc_id) else int(doc_id)))
                sets.append(shingles(text, size))
                held += len(sets[-1][0]) + 500
                if held >= 200_000:
                    yield flush(keys, sets)
                    keys, sets, held = [], [], 0
            if keys:
                yield flush(keys, sets)

    return sign


def _sets(size: int, counted: bool):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                found = [shingles(t, size) for t in part["text"]]
                counts = [c.astype("<i4").tobytes() if counted else b"" for _, c in found]
                yield pd.DataFrame({"node": part["node"], "elements": [s.tobytes() for s, _ in found], "counts": counts})

    return cut


def similarity(a: bytes, a_counts: bytes, b: bytes, b_counts: bytes) -> float:
    """Weighted Jaccard similarity; plain when there are no counts."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if not a_counts:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / (len(x) + len(y) - both)
    cx, cy = np.frombuffer(a_counts, dtype="<i4"), np.frombuffer(b_counts, dtype="<i4")
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = int(np.minimum(cx[i], cy[j]).sum())
    return low / (int(cx.sum()) + int(cy.sum()) - low)


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [similarity(*r) for r in zip(b["elements"], b["counts"], b["other_elements"], b["other_counts"])]
        yield pd.DataFrame({"a": b["a"], "b": b["b"], "similarity": np.array(found, dtype=float)})


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity) for distinct pairs (a, b) of nodes."""
    one = sets.select(F.col("node").alias("a"), "elements", "counts")
    other = sets.select(F.col("node").alias("b"), F.col("elements").alias("other_elements"), F.col("counts").alias("other_counts"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "elements", "counts", "other_elements", "other_counts")
    return both.mapInPandas(_compared, "a bigint, b bigint, similarity double")


def _overlaps(threshold: float, reach: float):
    """Links between the open documents and the others of a block pair: for each, one per class that it meets."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        others, asks = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        sets = [np.frombuffer(e, dtype=np.uint64) for e in others["elements"]]
        counts = [np.frombuffer(c, dtype="<i4") if c else np.ones(len(e), dtype="<i4") for c, e in zip(others["counts"], sets)]
        out = []
        if len(others) and len(asks):
            owner = np.repeat(np.arange(len(sets)), [len(e) for e in sets])
            element, weight = np.concatenate(sets), np.concatenate(counts)
            order = np.argsort(element, kind="stable")
            element, weight, owner = element[order], weight[order], owner[order]
            total = np.bincount(owner, weights=weight, minlength=len(sets))
            away, node, component = others["away"].to_numpy(), others["node"].to_numpy(), others["component"].to_numpy()
            for x in asks.itertuples(index=False):
                may = (component != x.component) & (np.abs(away - x.away) <= reach)
                if not may.any():
                    continue
                mine = np.frombuffer(x.elements, dtype=np.uint64)
                own = np.frombuffer(x.counts, dtype="<i4") if x.counts else np.ones(len(mine), dtype="<i4")
                lo, hi = np.searchsorted(element, mine, "left"), np.searchsorted(element, mine, "right")
                width = hi - lo
                at = np.repeat(lo - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
                both = np.bincount(owner[at], weights=np.minimum(weight[at], np.repeat(own, width)), minlength=len(sets))
                near = may & (both / (total + own.sum() - both) >= threshold)
                for c in np.unique(component[near]):
                    out.append((x.node, node[near & (component == c)].min()))
        return pd.DataFrame(out, columns=["a", "b"])

    return find


def _crowded(seen: DataFrame, crowd: DataFrame, sets: DataFrame, threshold: float, reach: float) -> DataFrame:
    """(a, b): links that the documents left open by their leader have in crowded buckets.

    Such a bucket may hold very many pairs just below the threshold. They are compared inside tasks, block by
    block, and only links leave them.
    """
    parts = crowd.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n_x") / BLOCK).cast("int").alias("turns"))
    rows = seen.join(parts, "key").join(sets, "node")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "block", "turn", "asks", "node", "away", "component", "elements", "counts"]
    others = rows.withColumn("block", deal("blocks")).withColumn("turn", every("turns")).withColumn("asks", F.lit(False))
    asks = rows.filter(F.col("away") > reach).withColumn("turn", deal("turns")).withColumn("block", every("blocks")).withColumn("asks", F.lit(True))
    meeting = others.select(columns).unionByName(asks.select(columns))
    return meeting.groupBy("key", "block", "turn").applyInPandas(_overlaps(threshold, reach), "a bigint, b bigint")


_SIGNED = "rid bigint, doc_id bigint, digest binary, bands array<bigint>"


def near_duplicates(
    docs: DataFrame,
    threshold: float = SIMILARITY,
    size: int = SHINGLE_WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    weights: str = "ones",
) -> DataFrame:
    """(rid, doc_id, class_id, class_size, kept): every row of ``docs`` with its class of near-duplicates.

    Two texts are linked when their shingle sets have a Jaccard similarity of at least ``threshold``; with
    ``weights="counts"`` shingles weigh as often as they occur. A class is what links connect; ``class_id`` is
    its smallest doc_id, whose row is the one kept (of repeated rows, one; a null doc_id comes last). Texts with
    equal shingle sets are one node, so copies never meet each other. Null and blank texts have no shingles and
    stand alone. An empty table gives no rows; other columns are ignored.
    """
    return _classes(numbered_rows(docs, "doc_id", "text"), threshold, size, bands, rows, weights)


def _classes(base: DataFrame, threshold: float, size: int, bands: int, rows: int, weights: str) -> DataFrame:
    """``near_duplicates`` of a stored table (rid, doc_id, text)."""
    counted = weights == "counts"
    signed = store(base.mapInPandas(_signatures(size, bands, rows, counted), _SIGNED), "bands")
    nodes = store(signed.filter("digest is not null").groupBy("digest").agg(F.min("rid").alias("node")), "nodes")
    placed = (
        signed.filter("digest is not null").join(nodes.select(F.col("node").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("node"), F.explode("bands").alias("key"))
    )
    sizes = placed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = store(placed.join(sizes, "key"), "buckets")
    # The document that meets most others is the most likely centre of its buckets.
    central = met.groupBy("node").agg(F.sum("n").alias("central"))
    leaders = met.join(central, "node").groupBy("key").agg(F.max(F.struct("central", (-F.col("node")).alias("minus"))).alias("best"))
    led = store(met.join(leaders.select("key", (-F.col("best.minus")).alias("leader")), "key").select("key", "node", "leader"), "leaders")
    involved = led.select(F.col("node").alias("rid")).distinct()
    texts = base.join(involved, "rid", "left_semi").select(F.col("rid").alias("node"), "text")
    sets = store(texts.mapInPandas(_sets(size, counted), "node bigint, elements binary, counts binary"), "sets")
    first = led.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    known = store(_compare(first, sets), "compared")
    links = known.filter(F.col("similarity") >= threshold).select("a", "b")
    graph = involved.select(F.col("rid").alias("id"))
    classes = connected_components(graph, links)

    # A pair that no leader decided: d(x, y) >= |d(x, leader) - d(y, leader)|, so both lie in like distance of it.
    away = F.when(F.col("node") == F.col("leader"), 0.0).otherwise(1 - F.col("similarity"))
    seen = led.join(known.select(F.col("a").alias("node"), F.col("b").alias("leader"), "similarity"), ["node", "leader"], "left")
    seen = seen.withColumn("away", away).join(classes.select(F.col("id").alias("node"), "component"), "node")
    split = seen.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo < _hi").select("key")
    seen = seen.join(split, "key", "left_semi").select("key", "node", "away", "component")
    seen = store(seen.join(signed.select(F.col("rid").alias("node"), "bands"), "node"), "undecided")
    reach = 1 - threshold + 1e-9
    crowd = seen.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("away") > reach).alias("n_x")).filter("n_x > 0")
    crowd = store(crowd, "crowds")
    small = seen.join(crowd.filter(F.col("n") <= CROWD).select("key"), "key", "left_semi")
    x = small.filter(F.col("away") > reach).select("key", F.col("node").alias("a"), F.col("away").alias("away_a"), F.col("component").alias("ca"), F.col("bands").alias("bands_a"))
    y = small.filter(F.col("away") > 0).select("key", F.col("node").alias("b"), F.col("away").alias("away_b"), F.col("component").alias("cb"), F.col("bands").alias("bands_b"))
    close = (F.col("ca") != F.col("cb")) & (F.abs(F.col("away_a") - F.col("away_b")) <= reach) & ((F.col("away_b") <= reach) | (F.col("a") < F.col("b")))
    first_shared = F.element_at(F.array_intersect("bands_a", "bands_b"), 1) == x["key"]
    rest = x.join(y, (x["key"] == y["key"]) & close & first_shared).select("a", "b").distinct()
    more = _compare(rest, sets).filter(F.col("similarity") >= threshold).select("a", "b")
    more = more.unionByName(_crowded(seen.drop("bands"), crowd.filter(F.col("n") > CROWD), sets, threshold, reach))
    more = store(more, "more-links")
    if more.limit(1).count():
        classes = connected_components(graph, links.unionByName(more))

    grouped = classes.select(F.col("id").alias("node"), "component")
    of_node = nodes.join(grouped, "node", "left").select("digest", F.coalesce("component", "node").alias("class"))
    members = store(
        signed.select("rid", "doc_id", "digest").join(of_node, "digest", "left").select("rid", "doc_id", F.coalesce("class", "rid").alias("class")), "members"
    )
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    heads = store(members.groupBy("class").agg(first_row.alias("head"), F.count("*").alias("class_size")), "heads")
    return members.join(heads, "class").select(
        "rid", "doc_id", F.col("head.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("head.rid")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates; all columns stay."""
    rows = Rows(docs)
    classes = _classes(rows.keyed("doc_id", "text"), threshold, SHINGLE_WORDS, BANDS, ROWS, "ones")
    return rows.join(classes.filter("kept").select("rid"), "left_semi")


@query("op3_dart_minhash")
def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("rid")
