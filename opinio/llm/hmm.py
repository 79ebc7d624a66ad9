"""Hidden Markov language model.

Words that make up a share of the corpus above a limit are symbols of their own; by that limit they cannot be many.
Every other word shares the symbol of its ending, and inside that symbol it has its own probability from its own
count. A state emits a symbol, the symbol its word, so the probability of a text is that of its symbols, summed over
all paths of states, times the words' probabilities inside their symbols. Nothing is left out: a word that was never
counted has the probability that one more word of its symbol would have.

Baum-Welch runs over the whole training corpus: tasks walk their documents side by side, forwards and backwards, and
send expected counts, one row per symbol; the model that comes back has one size for any corpus. The counts of words
stay a table and are joined.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import store
from .registry import query
from .tables import documents, keyed, least_by_hash

STATES = 8
HEAVY_SHARE = 1 / 60_000  # words of a larger share are symbols of their own: fewer than 60,000 of them
HEAVY_BYTES = 64  # longer words never are, so these words have a bound in bytes
ENDINGS = 4096  # symbols of all other words; all symbols fit in two bytes
PASSES = 3  # over the whole training corpus
START_ROUNDS = 20  # on the documents that the starting values come from
START_DOCUMENTS, START_TOKENS = 1500, 400  # at most so many documents of at most so many tokens
PRIOR = 0.5  # added to expected counts, dealt by the symbols' shares
POOL_TOKENS = 1 << 22  # tokens whose documents are sorted by length together
GROUP_TOKENS = 1 << 19  # tokens that are walked side by side
SCALED = 8  # positions from one scaling to the next; so few factors cannot underflow
COUNTED_WORDS = 500_000  # distinct words that a task counts before it sends them
CACHED_ENDINGS = 300_000


def words(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lowered, cut at space, tab, line feed, vertical tab, form feed, carriage return."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class _Endings(dict):
    """Number below ``ENDINGS`` of a word's last three bytes."""

    def __missing__(self, last: bytes) -> int:
        if len(self) >= CACHED_ENDINGS:
            self.clear()
        self[last] = found = zlib.crc32(last) % ENDINGS
        return found


_endings = _Endings()


def endings(rare: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_endings.__getitem__, [w[-3:] for w in rare]), dtype=np.int64, count=len(rare))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter[bytes] = Counter()

    def flush() -> pd.DataFrame:
        out = pd.DataFrame({"word": list(seen), "c": np.fromiter(seen.values(), dtype=np.int64, count=len(seen))})
        seen.clear()
        return out

    for batch in batches:
        for text in batch["text"]:
            seen.update(words(text))
            if len(seen) >= COUNTED_WORDS:
                yield flush()
    yield flush()


def vocabulary(training: DataFrame) -> DataFrame:
    """(word, c): how often each word occurs in ``training``, stored."""
    partial = training.select("text").mapInPandas(_counted, "word binary, c bigint")
    return store(partial.groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")


@dataclass(frozen=True)
class Alphabet:
    """The symbols: heavy words in order, then the end of a text, then the endings."""

    heavy: dict[bytes, int]
    counts: np.ndarray  # of each symbol in the training corpus
    kinds: np.ndarray  # distinct words of each ending
    tokens: int
    distinct: int

    @property
    def end(self) -> int:
        return len(self.heavy)

    @property
    def size(self) -> int:
        return len(self.heavy) + 1 + ENDINGS

    def base(self, count: np.ndarray) -> np.ndarray:
        """log10 of (c + 1) / (N + V + 1)."""
        return np.log10((count + 1) / (self.tokens + self.distinct + 1))


def _ending_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, kinds = np.zeros(ENDINGS, dtype=np.int64), np.zeros(ENDINGS, dtype=np.int64)
    for batch in batches:
        if len(batch):
            at = endings(batch["word"].to_list())
            np.add.at(total, at, batch["c"].to_numpy())
            kinds += np.bincount(at, minlength=ENDINGS)
    met = np.flatnonzero(kinds)
    yield pd.DataFrame({"ending": met, "c": total[met], "kinds": kinds[met]})


def alphabet(vocab: DataFrame, training_documents: int, heavy_share: float = HEAVY_SHARE) -> tuple[Alphabet, DataFrame]:
    """The symbols of a vocabulary, and the rest of it: the words that are not heavy."""
    n, v = vocab.agg(F.sum("c"), F.count("*")).first()
    tokens = (n or 0) + training_documents
    # Fewer than 1 / heavy_share words can each be above that share.
    heavy = (F.col("c") > tokens * heavy_share) & (F.octet_length("word") <= HEAVY_BYTES)
    own = vocab.filter(heavy).orderBy("word").collect()
    rest = vocab.filter(~heavy)
    sums = rest.mapInPandas(_ending_sums, "ending int, c bigint, kinds bigint").groupBy("ending").agg(F.sum("c").alias("c"), F.sum("kinds").alias("kinds")).collect()
    size = len(own) + 1 + ENDINGS
    counts, kinds = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for i, r in enumerate(own):
        counts[i] = r["c"]
    counts[len(own)] = training_documents
    for r in sums:
        counts[len(own) + 1 + r["ending"]], kinds[len(own) + 1 + r["ending"]] = r["c"], r["kinds"]
    return Alphabet({bytes(r["word"]): i for i, r in enumerate(own)}, counts, kinds, tokens, v + (training_documents > 0)), rest


_ENCODED = "rid bigint, doc_id bigint, training boolean, n_tokens bigint, n_known bigint, base double, symbols binary, rare string, times array<int>"


def encoded(rows: DataFrame, symbols: Alphabet) -> DataFrame:
    """``rows`` (rid, doc_id, training, text) as symbols of two bytes each, with what the heavy words and the end add
    to the base score, and the other words, between spaces, with how often each occurs. Stored."""
    shared = rows.sparkSession.sparkContext.broadcast(symbols)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alpha = shared.value
        look, nothing, end = alpha.heavy.get, itertools.repeat(-1), np.array([alpha.end])
        base, known_end = alpha.base(alpha.counts[: alpha.end + 1]), int(alpha.counts[alpha.end] > 0)
        for batch in batches:
            out = {k: [] for k in ("n_tokens", "n_known", "base", "symbols", "rare", "times")}
            for text in batch["text"]:
                found = words(text)
                ids = np.append(np.fromiter(map(look, found, nothing), dtype=np.int64, count=len(found)), end)
                others = np.flatnonzero(ids < 0)
                rare = [found[i] for i in others.tolist()]
                heavy = ids[ids >= 0]
                ids[others] = alpha.end + 1 + endings(rare)
                counted = Counter(rare)
                out["n_tokens"].append(len(ids))
                out["n_known"].append(len(heavy) - 1 + known_end)
                out["base"].append(math.fsum(base[heavy]))
                out["symbols"].append(ids.astype("<u2").tobytes())
                out["rare"].append(b" ".join(counted).decode("utf-8", "surrogatepass") if counted else None)
                out["times"].append(np.fromiter(counted.values(), dtype=np.int32, count=len(counted)))
            yield pd.DataFrame({"rid": batch["rid"], "doc_id": batch["doc_id"].astype("Int64"), "training": batch["training"], **out})

    return store(rows.mapInPandas(encode, _ENCODED), "symbols")


@dataclass
class Model:
    """Start of the chain (states), its steps (states x states), and what states emit (symbols x states)."""

    start: np.ndarray
    steps: np.ndarray
    emits: np.ndarray


def first_model(symbols: Alphabet, states: int = STATES, seed: int = 17) -> Model:
    """Nearly alike states; small differences let Baum-Welch tell them apart."""
    rng = np.random.default_rng(seed)
    share = (symbols.counts + 1.0) / (symbols.counts + 1.0).sum()
    emits = share[:, None] * rng.uniform(0.5, 1.5, (symbols.size, states))
    steps = rng.uniform(0.8, 1.2, (states, states)) + 2 * np.eye(states)
    return Model(np.full(states, 1 / states), steps / steps.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


class Counts:
    """Expected counts of one or more groups of documents."""

    def __init__(self, states: int, size: int):
        self.start, self.steps, self.emits = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))

    def model(self, symbols: Alphabet, prior: float = PRIOR) -> Model:
        share = (symbols.counts + 1.0) / (symbols.counts + 1.0).sum()
        # At least the prior for each state, and one for each thousand of its tokens: symbols that it did not meet stay possible.
        weight = prior * len(self.start) + 1e-3 * self.emits.sum(axis=0)
        emits, steps, start = self.emits + share[:, None] * weight, self.steps + prior, self.start + prior
        return Model(start / start.sum(), steps / steps.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def _side_by_side(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts (longest first) by position, and where each position begins: at position t the first texts
    that are longer than t have one symbol each."""
    lengths = np.array([len(t) for t in texts])
    at = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # how many texts are longer than t
    begins = np.concatenate([[0], np.cumsum(at)])
    out = np.empty(begins[-1], dtype=np.int64)
    for i, t in enumerate(texts):
        out[begins[: len(t)] + i] = t
    return out, begins


def _forward(model: Model, seen: np.ndarray, begins: np.ndarray, first: int, last: int, entry: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward values of positions ``first`` to ``last``, their scales, and what the symbols are emitted with.

    Values are scaled to a sum of 1 at every ``SCALED``-th position and at the end of each text; elsewhere the scale
    is 1. ``entry`` has the values of the position before. A state is a row, so numpy's inner loops run over texts.
    """
    low, high = begins[first], begins[last]
    emitted = np.take(np.ascontiguousarray(model.emits.T), seen[low:high], axis=1)
    alpha, scale, turned, before = np.empty_like(emitted), np.ones(high - low), np.ascontiguousarray(model.steps.T), entry
    edges = (begins[first : last + 1] - low).tolist()
    for t, (a, b) in enumerate(zip(edges, edges[1:]), first):
        now = alpha[:, a:b]
        if before is None:
            np.multiply(emitted[:, a:b], model.start[:, None], out=now)
        else:
            np.matmul(turned, before[:, : b - a], out=now)
            now *= emitted[:, a:b]
        if t % SCALED == SCALED - 1:
            np.add.reduce(now, axis=0, out=scale[a:b])
            now /= scale[a:b]
        before = now
    # The texts that end at a position are the last of it: those beyond the width of the next one.
    width = np.diff(begins)[first : last + 1]
    following = np.append(width[1:], 0) if len(width) == last - first else width[1:]
    place = np.arange(high - low) - np.repeat(begins[first:last] - low, width[: last - first])
    ends = np.flatnonzero(place >= np.repeat(following, width[: last - first]))
    totals = alpha[:, ends].sum(axis=0)
    alpha[:, ends] /= totals
    scale[ends] *= totals
    return alpha, scale, emitted


def _spans(begins: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Runs of positions with about ``limit`` symbols each."""
    spans, first = [], 0
    while first < len(begins) - 1:
        last = max(first + 1, int(np.searchsorted(begins, begins[first] + limit, side="right")) - 1)
        spans.append((first, last))
        first = last
    return spans


def log_likelihoods(model: Model, texts: list[np.ndarray], limit: int = GROUP_TOKENS) -> np.ndarray:
    """Natural logarithm of the probability of each text (longest first) by the scaled forward recursion."""
    seen, begins = _side_by_side(texts)
    out, entry = np.zeros(len(texts)), None
    for first, last in _spans(begins, limit):
        alpha, scale, _ = _forward(model, seen, begins, first, last, entry)
        logs, low = np.log(scale), begins[first]
        width = begins[first + 1 : last + 1] - begins[first:last]
        out += np.bincount(np.arange(len(logs)) - np.repeat(begins[first:last] - low, width), weights=logs, minlength=len(texts))
        entry = alpha[:, begins[last - 1] - low :].copy()
    return out


def expect(model: Model, texts: list[np.ndarray], into: Counts, limit: int = GROUP_TOKENS) -> None:
    """Adds the expected counts of texts (longest first). Only one span of positions is in memory: for more than one,
    the forward values at their borders are kept and those inside are computed again on the way back."""
    seen, begins = _side_by_side(texts)
    spans = _spans(begins, limit)
    entries, kept = [None], None
    for first, last in spans:
        kept = _forward(model, seen, begins, first, last, entries[-1])
        entries.append(kept[0][:, begins[last - 1] - begins[first] :].copy())
    after = None
    for k in range(len(spans) - 1, -1, -1):
        (first, last), low = spans[k], begins[spans[k][0]]
        alpha, scale, emitted = kept if k == len(spans) - 1 else _forward(model, seen, begins, first, last, entries[k])
        beta, coming = np.ones_like(alpha), emitted  # coming: emitted * beta / scale, what a position gives the one before
        coming /= scale
        edges = (begins[first : last + 1] - low).tolist()
        for t in range(len(edges) - 2, -1, -1):
            a, b = edges[t], edges[t + 1]
            if after is not None and after.shape[1]:
                beta[:, a : a + after.shape[1]] = model.steps @ after
            after = coming[:, a:b]
            after *= beta[:, a:b]
        after = after.copy()
        beta *= alpha
        for s, row in enumerate(beta):
            into.emits[:, s] += np.bincount(seen[low : begins[last]], weights=row, minlength=len(into.emits))
        if first == 0:
            into.start += beta[:, : begins[1]].sum(axis=1)
        # Each symbol but those of position 0 has one before it, as many places back as that position is wide.
        width = np.diff(begins[first : last + 1])
        back = np.repeat(np.concatenate([[0], width[:-1]]), width)
        inner = np.arange(width[0], coming.shape[1])
        into.steps += model.steps * (np.take(alpha, inner - back[inner], axis=1) @ coming[:, width[0] :].T)
        if first > 0:
            into.steps += model.steps * (entries[k][:, : width[0]] @ coming[:, : width[0]].T)


def _groups(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Rows of like length, longest first, with their symbols."""

    def cut(rows: list[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
        pool = pd.concat(rows, ignore_index=True)
        pool = pool.iloc[np.argsort(-pool["symbols"].str.len().to_numpy(), kind="stable")]
        group = np.cumsum(pool["symbols"].str.len().to_numpy() // 2) // GROUP_TOKENS
        for _, part in pool.groupby(group):
            yield part[columns], [np.frombuffer(s, dtype="<u2") for s in part["symbols"]]

    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += int(batch["symbols"].str.len().sum()) // 2
        if size >= POOL_TOKENS:
            yield from cut(waiting)
            waiting, size = [], 0
    if size:
        yield from cut(waiting)


def baum_welch(texts: DataFrame, symbols: Alphabet, model: Model) -> Model:
    """One pass over all ``texts``: tasks send a row per symbol they met, the driver gets one per symbol."""
    spark, states = texts.sparkSession, len(model.start)
    shared = spark.sparkContext.broadcast((model, symbols.size))
    columns = [f"s{i}" for i in range(states)]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, size = shared.value
        counts = Counts(states, size)
        for _, group in _groups(batches, []):
            expect(now, group, counts)
        met = np.flatnonzero(counts.emits.any(axis=1))
        keys = np.concatenate([met, [-1], -2 - np.arange(states)])
        table = pd.DataFrame(np.vstack([counts.emits[met], counts.start, counts.steps]), columns=columns)
        table.insert(0, "row", keys)
        yield table

    schema = ", ".join(["row int", *[f"{c} double" for c in columns]])
    sums = texts.select("symbols").mapInPandas(walk, schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
    total, values, at = Counts(states, symbols.size), sums[columns].to_numpy(dtype=float), sums["row"].to_numpy()
    total.emits[at[at >= 0]] = values[at >= 0]
    total.start = values[at == -1].sum(axis=0)
    total.steps[-2 - at[at < -1]] = values[at < -1]
    return total.model(symbols)


def fit(texts: DataFrame, symbols: Alphabet, states: int = STATES, passes: int = PASSES, rounds: int = START_ROUNDS) -> Model:
    """A model trained on all ``texts`` (rid, symbols). Starting values come from a bounded number of short ones,
    chosen by hash; then every text counts in each of ``passes`` passes."""
    model = first_model(symbols, states)
    short = texts.filter(F.octet_length("symbols") <= 2 * START_TOKENS).select("rid", "symbols")
    chosen = [np.frombuffer(r["symbols"], dtype="<u2") for r in least_by_hash(short, START_DOCUMENTS, "symbols", "rid").collect()]
    chosen.sort(key=len, reverse=True)
    if chosen:
        for _ in range(rounds):
            counts = Counts(states, symbols.size)
            expect(model, chosen, counts)
            model = counts.model(symbols)
    for _ in range(passes):
        model = baum_welch(texts, symbols, model)
    return model


def likelihoods(texts: DataFrame, model: Model) -> DataFrame:
    """(rid, doc_id, training, n_tokens, n_known, base, chain): ``chain`` is log10 of the probability of a text's symbols."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    columns = ["rid", "doc_id", "training", "n_tokens", "n_known", "base"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, group in _groups(batches, columns):
            yield rows.assign(chain=log_likelihoods(shared.value, group) / math.log(10))

    schema = "rid bigint, doc_id bigint, training boolean, n_tokens bigint, n_known bigint, base double, chain double"
    return texts.select(*columns, "symbols").mapInPandas(score, schema)


def _ending_of(word: Column) -> Column:
    last = F.substring(word, F.greatest(F.octet_length(word) - 2, F.lit(1)), F.lit(3))
    return F.crc32(last) % ENDINGS


def score_texts(docs: DataFrame, learn: Column, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs`` (doc_id, text).

    ``learn`` marks the rows that counts and model are learned from; null marks none. Scores are log10 probabilities
    of the whole text, its end included: ``base_score`` of an add-one unigram model, ``score`` of the hidden Markov
    model. A null, empty or blank text is its end alone. Repeated rows and null ids are rows of their own, an empty
    table gives no rows, other columns are ignored. With nothing to learn from, every word is unknown.
    """
    training = F.coalesce(learn, F.lit(False))
    # The row number is stored with the symbols; the text is not read after that.
    counted = docs.filter(training)
    symbols, rest = alphabet(vocabulary(counted), counted.count())
    texts = encoded(keyed(docs, "doc_id", training.alias("training"), "text"), symbols)
    model = fit(texts.filter("training"), symbols, states, passes)
    chains = store(likelihoods(texts, model), "chains")
    spark = docs.sparkSession
    first = symbols.end + 1
    inside = spark.createDataFrame(
        [(i, int(symbols.counts[first + i] + symbols.kinds[first + i] + 1)) for i in range(ENDINGS)], "_e int, _size bigint"
    )
    listed = F.explode(F.arrays_zip(F.split("rare", " ").alias("word"), F.col("times").alias("n")))
    pairs = texts.filter("rare is not null").select("rid", listed.alias("_w")).select("rid", F.col("_w.word").cast("binary").alias("word"), F.col("_w.n").alias("_n"))
    # The table of endings has a fixed number of rows.
    met = pairs.join(rest, "word", "left").withColumn("_e", _ending_of(F.col("word"))).join(F.broadcast(inside), "_e")
    c = F.coalesce("c", F.lit(0))
    places = symbols.tokens + symbols.distinct + 1
    added = store(
        met.groupBy("rid").agg(
            F.sum(F.when(c > 0, F.col("_n")).otherwise(0)).alias("_known"),
            F.sum(F.col("_n") * F.log10((c + 1) / F.lit(float(places)))).alias("_base"),
            F.sum(F.col("_n") * F.log10((c + 1) / F.col("_size"))).alias("_inside"),
        ),
        "rare",
    )
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    return chains.join(added, "rid", "left").select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(symbols.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("_base")).alias("base_score"), (F.col("chain") + zero("_inside")).alias("score"),
    )


@query("op12_hidden_markov")
def op12_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return score_texts(documents(spark, sf_dir), learn)
