import math
import re
from collections import Counter

from pyspark.sql import functions as F

from opinio.functions import text as tx
from opinio.operators import clean

LANGS = ["en", "fr"]


def _grams(text):
    s = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    return Counter(s[i : i + 3] for i in range(len(s) - 2))


def test_grams_of_whole_texts(spark):
    texts = ["", "?! 12", "a", "Été à Nice", "x" * 50_000 + " y", "don't\nstop", "日本 語"]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string").select("i", tx.char_grams("t").alias("g")).collect()
    assert [None if r["g"] is None else Counter(r["g"]) for r in sorted(rows)] == [*(_grams(t) for t in texts), None]


def test_like_smoothed_log_probabilities(spark):
    labelled = [("the cat sat on the mat", "en"), ("the dog and the cat", "en"), ("le chat est sur le tapis", "fr"), ("le chien", "fr"), ("das", "de")]
    frame = spark.createDataFrame([*labelled, (None, "fr")], "t string, l string")
    counts = {c: sum((_grams(t) for t, l in labelled if l == c), Counter()) for c in LANGS}
    both = counts["en"] + counts["fr"]
    kept = [g for g in both if both[g] >= 2]
    total = {c: sum(counts[c][g] for g in kept) + len(kept) + 1 for c in LANGS}
    want = {g: tuple(math.floor(1000 * math.log((counts[c][g] + 1) / total[c])) for c in LANGS) for g in kept}
    want[""] = tuple(math.floor(1000 * math.log(1 / total[c])) for c in LANGS)
    model = clean.detect_profile(frame, "t", "l", LANGS)
    assert {r["term"]: (r["w_en"], r["w_fr"]) for r in model.collect()} == want
    texts = ["the mat is there", "le chat et le chien", "zzzzzzzzzz", "short", "1234567890", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "comment_id int, clean_comment string")
    got = {r["comment_id"]: (r["lang_detected"], r["lang_score"]) for r in clean.detect_language(rows, model, LANGS).collect()}
    unseen = max(LANGS, key=lambda c: want[""][LANGS.index(c)])
    assert got == {0: ("en", 1.0), 1: ("fr", 1.0), 2: (unseen, 1.0), 3: (None, 0.0), 4: (None, 0.0), 5: (None, 0.0)}
    assert clean.detect_language(rows.limit(0), model, LANGS).count() == 0


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("lang").isin("de", "en", "es", "fr"))
    aside = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    names = ["de", "en", "es", "fr"]
    model = clean.detect_profile(docs.filter(~aside), "text", "lang", names)
    found = clean.detect_language(docs.filter(aside), model, names, "text", "doc_id")
    share = found.agg(F.avg((F.col("lang_detected") == F.col("lang")).cast("double"))).first()[0]
    most = docs.filter(aside).groupBy("lang").count().agg(F.max("count") / F.sum("count")).first()[0]
    assert share >= max(0.97, most)


def test_sums_in_tasks_equal_a_row_per_trigram(spark, monkeypatch):
    monkeypatch.setattr(clean, "SLICE_CHARS", 40)
    texts = ["the mat is there", "le chat et le chien", "𝔘𝔫𝔦 ß İ 日本 語", "a", "", "x" * 500 + " y", None, "?! 12 34567890", "été"] * 3
    ids = [None, 2**60 + 1, *range(18)]
    rows = spark.createDataFrame([(ids[i % 20], t, LANGS[i % 2]) for i, t in enumerate(texts)], "comment_id long, t string, l string")
    model = clean.detect_profile(rows, "t", "l", LANGS)
    plain = rows.select("comment_id", F.coalesce(tx.plain_letters("t"), F.lit("")).alias("text"))
    summed = [
        sorted(map(str, of(plain, model, ["w_en", "w_fr"], "comment_id").groupBy("comment_id").agg(F.sum("w_en"), F.sum("w_fr")).collect()))
        for of in (clean._gram_sums, clean._gram_rows)
    ]
    assert summed[0] == summed[1] and len(summed[0]) > 10
    found = [{r["comment_id"]: r["lang_detected"] for r in clean.detect_language(rows, model, LANGS, "t").collect()}]
    monkeypatch.setattr(clean, "PROFILE_ROWS", 3)
    found.append({r["comment_id"]: r["lang_detected"] for r in clean.detect_language(rows, model, LANGS, "t").collect()})
    assert found[0] == found[1]


def test_no_row_per_trigram_in_the_plan(spark):
    rows = spark.createDataFrame([(1, "the cat", "en")], "comment_id int, t string, l string")
    found = clean.detect_language(rows, clean.detect_profile(rows, "t", "l", LANGS), LANGS, "t")
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
