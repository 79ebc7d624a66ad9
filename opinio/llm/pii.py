"""Personal data: generators with high recall propose spans, boosted trees choose among them; DataFrame operations only.

Four strict patterns give the base spans. Looser generators propose more: addresses written with (at) and (dot),
numbers with unusual separators. Gradient-boosted trees learn from the strict patterns' matches, those that pass
their check and those that fail it, by features of the format (brought to a common form) and of the context; the
least score at which the matches set aside for it are right often enough is the kind's threshold. Loose spans above
it are added; base spans always stay.

Regular expressions here never repeat a group without a bound and never start twice in one run of characters, so
they take linear time and a constant stack on any text.
"""

from __future__ import annotations


from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import store
from .registry import query
from .tables import Rows, documents, least_by_hash, numbered_rows

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000  # most matches that the trees are fitted on, those of least hash
PRECISION = 0.95
TREES, DEPTH = 10, 4
BINS = 100

_LOCAL = "[A-Za-z0-9._%+-]"
_PART = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_AT, _DOT = r"\x20?[(\[{<]\x20?at\x20?[)\]}>]\x20?", r"\x20?[(\[{<]\x20?dot\x20?[)\]}>]\x20?"

# kind, strict, a cheap test that holds for every text with a match, how the text is prepared (one character for
# one, so places stay), and the pattern on the prepared text.
GENERATORS = (
    # A dot that no domain character follows ends a domain; as an underscore it does so without a repeated group.
    ("email", True, r"@", (r"\.(?![A-Za-z0-9-])", "_"), rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"),
    ("ip", True, r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", None, r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    # Separators that do not stand between two digits end a number.
    ("card", True, r"[0-9](?:[\x20-]?[0-9]){9}", (r"[\x20-](?![0-9])|(?<![0-9])[\x20-]", "_"), r"[0-9][0-9\x20-]++"),
    ("phone", True, r"\+[0-9]", None, r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, rf"(?i){_AT}|@", None, rf"(?i)(?<!{_LOCAL}){_LOCAL}{{1,64}}(?:@|{_AT})[A-Za-z0-9-]{{1,63}}(?:(?:\.|{_DOT})[A-Za-z0-9-]{{1,63}}){{1,8}}"),
    ("ip", False, r"[0-9](?:\[\.\]|\(\.\)|\x20\.\x20)[0-9]", None, r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20\.\x20|\.)[0-9]{1,3}){3}(?![0-9])"),
    ("card", False, r"[0-9]{4}[._/\x20-]{1,2}[0-9]{4}", None, r"(?<![0-9])[0-9]{4}(?:[._/\x20-]{0,2}[0-9]{4}){3}(?![0-9])"),
    ("phone", False, r"[0-9)][\x20./-][0-9]{3,4}[\x20./-]?[0-9]", None, r"(?<![0-9+.(])(?:00[1-9][0-9]{0,2}[\x20./-]?)?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9])"),
)
FEATURES = (
    "is_email", "is_ip", "is_card", "is_phone", "length", "digits", "letters", "groups", "longest_group", "distinct_digits",
    "luhn", "parts_in_range", "word_before", "word_after", "hint_before", "quote_before",
)
_HINTS = r"(?i)(mail|contact|write|phone|call|tel|fax|mobile|card|visa|credit|pay|ip|host|server|address|client)[^A-Za-z]{0,6}$"


def _proposals(text: Column) -> Column:
    """Array of (generator, pos, gap, before, after, match): the pieces of the text between matches and the matches."""
    found = []
    for g, (_, _, test, prepare, pattern) in enumerate(GENERATORS):
        ready = F.regexp_replace(text, *prepare) if prepare else text
        pieces, matches = F.split(ready, pattern, -1), F.regexp_extract_all(ready, F.lit(pattern), F.lit(0))
        found.append(F.when(text.rlike(test), F.transform(F.arrays_zip(pieces.alias("p"), matches.alias("m")), _proposal(g))))
    empty = F.array().cast("array<struct<generator:int,pos:int,gap:int,before:string,head:string,match:string>>")
    return F.flatten(F.array(*[F.coalesce(f, empty) for f in found]))


def _proposal(generator: int):
    def row(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(generator).alias("generator"),
            i.alias("pos"),
            F.length(x["p"]).alias("gap"),
            F.right(x["p"], F.lit(24)).alias("before"),
            F.left(x["p"], F.lit(4)).alias("head"),
            x["m"].alias("match"),
        )

    return row


def _spans(rows: DataFrame) -> DataFrame:
    """(rid, kind, strict, start, end, match, before, after) of all generators; code points, end exclusive."""
    each = rows.select("rid", F.explode(_proposals(F.coalesce("text", F.lit("")))).alias("x")).select("rid", "x.*")
    order = Window.partitionBy("rid", "generator").orderBy("pos")
    size = F.coalesce(F.length("match"), F.lit(0))
    placed = each.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("after", F.lead("head").over(order)).filter("match is not null")
    at = F.col("generator") + 1
    return placed.select(
        "rid",
        F.element_at(F.array(*[F.lit(KINDS.index(g[0])) for g in GENERATORS]), at).alias("kind"),
        F.element_at(F.array(*[F.lit(g[1]) for g in GENERATORS]), at).alias("strict"),
        (F.col("end") - F.length("match")).alias("start"), "end", "match", "before", F.coalesce("after", F.lit("")).alias("after"),
    )


def _measured(spans: DataFrame) -> DataFrame:
    """Features of the spans, and for strict ones whether they pass their check."""
    plain = F.regexp_replace(F.regexp_replace(F.col("match"), f"(?i){_AT}", "@"), f"(?i){_DOT}|\\[\\.\\]|\\(\\.\\)|\\x20\\.\\x20", ".")
    digits = F.regexp_replace(F.col("match"), "[^0-9]", "")
    groups = F.filter(F.split("plain", "[^0-9]+"), lambda x: x != "")
    n = F.length("digits")
    as_float = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    luhn = F.when(n.between(12, 19), F.call_function("luhn_check", F.col("digits"))).otherwise(False)
    in_range = F.col("plain").rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    measured = spans.withColumns({"plain": plain, "digits": digits}).withColumns(
        {
            **{f"is_{k}": as_float(F.col("kind") == i) for i, k in enumerate(KINDS)},
            "n_groups": groups,
            "luhn": as_float(luhn),
            "parts_in_range": as_float(in_range),
            "distinct_digits": as_float(F.size(F.array_distinct(F.split("digits", "")))),
            "letters": as_float(F.length(F.regexp_replace("plain", "[^A-Za-z]", ""))),
            "word_before": as_float(F.col("before").rlike("[A-Za-z0-9_]$")),
            "word_after": as_float(F.col("after").rlike("^[A-Za-z0-9_]")),
            "hint_before": as_float(F.col("before").rlike(_HINTS)),
            "quote_before": as_float(F.col("before").rlike("[\"'=:/]$")),
            "length": as_float(F.length("plain")),
        }
    )
    valid = (
        F.when(F.col("kind") == 0, True)
        .when(F.col("kind") == 1, in_range)
        .when(F.col("kind") == 2, n.between(16, 19) & luhn)
        .otherwise(n.between(8, 15))
    )
    return measured.withColumn("valid", F.col("strict") & valid).select(
        "rid", "kind", "strict", "valid", "start", "end",
        *[F.col(c) for c in FEATURES if c not in ("digits", "groups", "longest_group")],
        as_float(n).alias("digits"),
        as_float(F.size("n_groups")).alias("groups"),
        as_float(F.array_max(F.transform("n_groups", lambda x: F.length(x)))).alias("longest_group"),
    )


def _part(column: str = "rid") -> Column:
    return F.pmod(F.xxhash64(column, "kind", "start"), F.lit(4))


def choose(measured: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> DataFrame:
    """(rid, kind, start, end, added): the loose spans that the trees accept. None when strict matches of one sort only exist.

    Three quarters of the strict matches may be fitted, at most ``sample`` of them; the last quarter, all of it,
    sets the thresholds by a histogram of scores for each kind.
    """
    labelled = measured.filter("strict").withColumn("y", F.col("valid").cast("double"))
    fitted = store(least_by_hash(labelled.filter(_part() != 0), sample, "rid", "kind", "start").select("y", *FEATURES), "fitted")
    nothing = measured.filter("false").select("rid", "kind", "start", "end")
    if fitted.select("y").distinct().count() < 2:
        return nothing
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(featuresCol="features", labelCol="y", maxIter=TREES, maxDepth=DEPTH, seed=3)
    model = trees.fit(assemble.transform(fitted))

    def scored(df: DataFrame) -> DataFrame:
        return model.transform(assemble.transform(df)).withColumn("score", vector_to_array("probability")[1])

    bins = scored(labelled.filter(_part() == 0)).groupBy("kind", F.floor(F.col("score") * BINS).alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("good"))
    above = Window.partitionBy("kind").orderBy(F.desc("bin"))
    right = F.sum("good").over(above) / F.sum("n").over(above)
    limits = store(bins.withColumn("right", right).filter(F.col("right") >= precision).groupBy("kind").agg((F.min("bin") / BINS).alias("limit")), "limits")
    loose = scored(measured.filter(~F.col("strict")))
    return loose.join(limits, "kind").filter((F.col("score") >= F.col("limit")) & (F.col("score") >= 0.5)).select("rid", "kind", "start", "end")


def personal_data(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> DataFrame:
    """(rid, doc_id, spans): for each row the array of (kind, start, end, added), base spans first by kind and place.

    A null text counts as empty and has no spans; repeated rows have the same spans each; an empty table gives
    no rows; other columns are ignored. Added spans do not overlap base spans of their kind, nor each other.
    """
    return _found(numbered_rows(docs, "doc_id", "text"), sample, precision)


def _found(rows: DataFrame, sample: int, precision: float) -> DataFrame:
    """``personal_data`` of a stored table (rid, doc_id, text)."""
    measured = store(_measured(_spans(rows.select("rid", "text"))), "spans")
    base = measured.filter("valid").select("rid", "kind", "start", "end", F.lit(False).alias("added"))
    both = base.unionByName(choose(measured, sample, precision).withColumn("added", F.lit(True)))
    # Within a kind, spans of one sort do not overlap: a base span before and one after are all that can.
    near = Window.partitionBy("rid", "kind").orderBy("start", "added")
    base_end, base_start = F.when(~F.col("added"), F.col("end")), F.when(~F.col("added"), F.col("start"))
    before = F.max(base_end).over(near.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(base_start).over(near.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    kept = both.withColumn("_clear", clear).filter(~F.col("added") | F.col("_clear"))
    by_row = kept.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("added", "kind", "start", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<added:boolean,kind:int,start:bigint,end:bigint>>")
    return rows.select("rid", "doc_id").join(by_row, "rid", "left").select("rid", "doc_id", F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> DataFrame:
    """``docs`` with every character of a found span replaced by ``*``; all columns stay."""
    name = "_spans" + "_" * max((len(c) for c in docs.columns), default=0)
    rows = Rows(docs)
    found = _found(rows.keyed("doc_id", "text"), sample, precision).select("rid", F.col("spans").alias(name))
    masked = F.aggregate(
        name,
        F.col("text"),
        lambda t, s: F.concat(
            F.substring(t, F.lit(1), s["start"].cast("int")),
            F.repeat(F.lit("*"), (s["end"] - s["start"]).cast("int")),
            F.substring(t, (s["end"] + 1).cast("int"), F.length(t)),
        ),
    )
    return rows.join(found).withColumn("text", masked).drop(name)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS], *[F.lit(f"{k}_like") for k in KINDS])
    at = lambda s: F.element_at(names, s["kind"] + F.when(s["added"], len(KINDS)).otherwise(0) + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", at(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op5_candidate_boosting")
def op5_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added spans are named email_like, ip_like, card_like and phone_like, after the four base kinds."""
    found = personal_data(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: ~s["added"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
