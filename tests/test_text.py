import re

import pytest
from pyspark.sql import functions as F

from opinio.functions import dates, fixed_values as fv, text as tx
from opinio.operators import clean, labels

NBSP = "\u00a0"
SAMPLES = [
    "",
    "   ",
    "?!... ;",
    "j'ai reçu mon colis",
    "un deux trois",
    "un deux trois quatre",
    f"Très bien{NBSP}! {NBSP}Merci !",
    "La BOÎTE est CASSÉE, été!",
    "voir https://ex.org/a?b=1 ou www.x.fr vite",
    "écrire à Jean.Dupont@mail.fr @moi #super_top fin",
    "a\tb\nc\r\n d\x0be",
    "abat-jour 2 pièces l'été 100%",
    "İstanbul œuvre ÿ æ",
]


def _one(spark, column, samples=SAMPLES):
    rows = spark.createDataFrame(list(enumerate(samples)), "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_word_count_like_python(spark):
    want = [len(re.sub(r"[^\w\s]", "", s).split()) for s in SAMPLES]
    assert _one(spark, tx.word_count("c")) == want


def test_clean_general_like_python(spark):
    def want(s):
        s = s.lower().strip()
        for pattern in (r"(http|www)\S+", r"\S+@\S+", r"(@|#)\w+"):
            s = re.sub(pattern, "", s)
        return re.sub(r"\s+", " ", s).strip()

    plain = [s for s in SAMPLES if "İ" not in s]
    assert _one(spark, tx.clean_general("c"), plain) == [want(s) for s in plain]
    assert _one(spark, tx.clean_steps("c")["clean"], plain) == [want(s) for s in plain]


def test_clean_simple_like_python(spark):
    def want(s):
        s = re.sub(r"http\S+|www\S+", "", s.lower())
        s = re.sub(r"\S+@\S+", "", s)
        return re.sub(r"\s+", " ", re.sub(rf"[^{tx.LETTERS}0-9\s'-]", " ", s)).strip()

    plain = [s for s in SAMPLES if "İ" not in s]
    assert _one(spark, tx.clean_simple("c"), plain) == [want(s) for s in plain]


def test_stop_word_cleanings(spark):
    texts = ["La montre est TOP, vraiment top!", None, "ab cd"]
    assert _one(spark, tx.clean_letters_stop("c", ["est"]), texts) == ["montre top vraiment top", "", ""]
    got = _one(spark, tx.clean_stripped_stop("c", fv.TOPIC_CLEAN_WORDS), ["L'abat-jour, la montre cassée 3x"])
    assert got == ["labatjour la cassée x"]


def test_short_texts_and_nulls(spark):
    rows = spark.createDataFrame([(1, "un deux trois"), (2, "un deux trois quatre"), (3, None)], "comment_id int, commentaire string")
    assert [r[0] for r in clean.min_words_filter(rows).collect()] == [2]
    assert clean.drop_missing_text(rows).count() == 2
    assert _one(spark, tx.blank_to_null("c"), [" nan ", "", "NaT", " ok", None]) == [None, None, None, "ok", None]
    assert _one(spark, tx.char_length("c"), ["abc", None]) == [3, 0]
    assert _one(spark, tx.lang_group("c"), ["fr", "en", None]) == ["fr", "Autres", "Autres"]
    assert _one(spark, tx.contains_term("c", "x"), ["axb", "b", None]) == [1, 0, 0]


def test_dedup_keeps_first_and_equates_nulls(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "a", "x"), (4, "b", "x"), (5, "a", "x")]
    df = spark.createDataFrame(rows, "comment_id long, commentaire string, client string").repartition(4)
    assert sorted(r["comment_id"] for r in clean.dedup_keep_first(df).collect()) == [1, 3, 4]


def test_sentences(spark):
    got = _one(spark, tx.split_sentences("c"), ["Bon produit. Livré vite !  ... 12. Merci… à vous"])
    assert got == [["Bon produit.", "Livré vite !", "Merci…", "à vous"]]


def test_tokens_lemmas_and_domain_words(spark):
    df = spark.createDataFrame([(1, "Les montres arrivent l'été x2 abc123 montres"), (2, None), (3, "le")], "comment_id long, c string")
    lemmas = spark.createDataFrame([("montres", "montre")], "form string, lemma string")
    got = {r["comment_id"]: r["clean_tokens"] for r in clean.tokenize_filter(df, "c", ["les"], lemmas).collect()}
    assert got == {1: ["montre", "arrivent", "été", "montre"], 2: None, 3: []}
    one = clean.tokenize_filter(df, "c", ["les"]).filter("comment_id = 1")
    cut = clean.remove_product_words(one, fv.PRODUCT_WORDS).first()
    assert cut["comment_sans_contexte"] == "arrivent été"


def test_ngrams(spark):
    got = _one(spark, tx.ngrams(F.split("c", " "), 2, 3), ["a b c d", "a b", "a"])
    assert got == [["a b", "b c", "c d", "a b c", "b c d"], ["a b"], []]


@pytest.mark.parametrize(
    "text, want",
    [
        ("tout est conforme", (1, 0, 0)),
        ("la qualité de service est nulle", (0, 0, 1)),
        ("QUALITÉ moyenne, LIVRAISON lente", (1, 1, 0)),
        ("le SAV est impossible à joindre", (0, 0, 1)),
        ("livresque solidement retardement", (0, 0, 0)),
        ("trop petit", (1, 0, 0)),
        ("déposée au point relais", (0, 1, 0)),
        (None, (0, 0, 0)),
    ],
)
def test_keyword_rules(spark, text, want):
    row = labels.regex_label(spark.createDataFrame([(text,)], "clean_comment string")).first()
    assert tuple(row[c] for c in fv.LABELS) == want


def test_rules_like_python(spark):
    texts = ["le colis est arrivé déchiré", "aucune réponse du sav", "bracelet solide, bas de gamme", "qualités de livraison", "rayures", "email reçu"]
    df = spark.createDataFrame([(t,) for t in texts], "clean_comment string")
    got = [tuple(r[c] for c in fv.LABELS) for r in labels.regex_label(df).collect()]
    rules = [re.compile(r"\b(" + "|".join(fv.LABEL_PATTERNS[c]) + r")\b", re.IGNORECASE) for c in fv.LABELS]
    assert got == [tuple(int(bool(r.search(t))) for r in rules) for t in texts]


def test_matched_keyword(spark):
    got = _one(spark, tx.matched_keyword("c", tx.whole_words(fv.DELIVERY_PATTERNS)), ["le Colis est en retard", "rien"])
    assert got == ["Colis", None]


def test_dates(spark):
    texts = ["2021-03-05 10:00:00+00:00", "28/06/2020", "", None, "31/02/2020", "n'importe", "2020-1-9", " 2020-12-24 "]
    got = [str(d) if d else None for d in _one(spark, dates.normalize_date("c"), texts)]
    assert got == ["2021-03-05", "2020-06-28", None, None, None, None, "2020-01-09", "2020-12-24"]
    parts = _one(spark, dates.date_parts_text("c"), ["2021-03-05 10:00", "28/06/2020", None, "2020-xx-01"])
    assert [tuple(p) for p in parts] == [(5, 3, 2021), (None,) * 3, (None,) * 3, (None,) * 3]
    assert _one(spark, dates.season(F.col("c").cast("int")), ["12", "1", "3", "8", "11", None]) == ["Hiver", "Hiver", "Printemps", "Été", "Automne", None]
    assert _one(spark, dates.quarter_label(F.to_date("c")), ["2020-02-01", "2020-12-31", None]) == ["2020Q1", "2020Q4", None]


def test_cheaper_patterns_find_the_same(spark):
    import random

    draw = random.Random(11)
    bits = ["a", "É", "1", "_", "-", "'", ".", "@", "#", "http", "www", " ", " ", "  ", "\t", "\n", "\xa0", "\u2003", "\x85", "\x1c", "ab", "x2y"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(0, 25))) for _ in range(3000)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    B, W = tx.BLANK, tx.WORD
    out = tx.strip(F.lower("t"))
    for pattern in (rf"(http|www)[^{B}]+", rf"[^{B}]+@[^{B}]+", rf"(@|#)[{W}]+"):
        out = F.regexp_replace(out, pattern, "")
    plain = {
        "clean": (tx.clean_general("t"), tx.strip(F.regexp_replace(out, rf"[{B}]+", " "))),
        "squeeze": (tx.squeeze("t"), tx.strip(F.regexp_replace("t", rf"[{B}]+", " "))),
        "letters": (tx.letter_tokens("t"), F.regexp_extract_all(F.lower("t"), F.lit(rf"(?<![{W}])\p{{L}}+(?![{W}])"), 0)),
        **{f"more{n}": (tx.more_words("t", n), tx.word_count("t") > n) for n in (-1, 0, 1, 3, 30)},
    }
    for name, (got, want) in plain.items():
        assert df.filter(~got.eqNullSafe(want)).collect() == [], name
    # No second start: a text of one long word is read once, not once from each of its characters.
    long = spark.range(1).select(F.repeat(F.lit("a"), 300_000).alias("t"))
    assert long.filter(tx.more_words("t", 3)).count() == 0 and long.filter(tx.more_words("t", 0)).count() == 1
    # The count of all words is not asked for to know that there are more than three.
    assert "regexp_extract_all" not in df.filter(tx.more_words("t", 3))._jdf.queryExecution().optimizedPlan().toString()
