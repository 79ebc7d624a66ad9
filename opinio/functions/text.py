"""Text column expressions with Unicode-wide words and blanks, all evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

BLANK = r"\s\p{Z}\x0B\x1C-\x1F\x85"
# The same blanks as single characters.
BLANK_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"\p{L}\p{N}_"
LETTERS = "a-zàâçéèêëîïôûùüÿñæœ"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim every kind of blank, the no-break space before French punctuation included."""
    return F.btrim(_col(c), F.lit(BLANK_CHARS))


def squeeze(c: str | Column) -> Column:
    # A single blank that is a space already, the common case, is no match.
    return strip(F.regexp_replace(_col(c), rf"[{BLANK}&&[^ ]][{BLANK}]*+| [{BLANK}]++", " "))


def _drop_if(c: Column, marker: Column, pattern: str) -> Column:
    """Run a costly pattern only on texts holding its marker; the result is the same."""
    return F.when(marker, F.regexp_replace(c, pattern, "")).otherwise(c)


def word_count(c: str | Column) -> Column:
    """Words after deleting punctuation: blank-separated runs holding at least one word character."""
    return F.regexp_count(_col(c), F.lit(rf"[{WORD}][^{BLANK}]*"))


def more_words(c: str | Column, n: int) -> Column:
    """Whether ``word_count`` is above ``n``; for small ``n`` a text is read up to its next word only."""
    if not 0 <= n < 20:
        return word_count(c) > n
    return _col(c).rlike(rf"\A[^{WORD}]*+(?:[{WORD}][^{BLANK}]*+[^{WORD}]*+){{{n + 1}}}")


def word_count_simple(c: str | Column) -> Column:
    """Blank-separated runs."""
    return F.regexp_count(_col(c), F.lit(rf"[^{BLANK}]+"))


def clean_steps(c: str | Column) -> dict[str, Column]:
    """Every stage of the general cleaning, in order; each builds on the one before."""
    lowered = strip(F.lower(_col(c)))
    no_url = _drop_if(lowered, lowered.contains("http") | lowered.contains("www"), rf"(http|www)[^{BLANK}]+")
    no_mail = _drop_if(no_url, no_url.contains("@"), rf"[^{BLANK}]+@[^{BLANK}]+")
    no_tag = _drop_if(no_mail, no_mail.contains("@") | no_mail.contains("#"), rf"(@|#)[{WORD}]+")
    return {"lowered": lowered, "no_url": no_url, "no_mail": no_mail, "no_tag": no_tag, "clean": squeeze(no_tag)}


def clean_general(c: str | Column) -> Column:
    """Lower case, then without URLs, e-mails, mentions and hashtags, blanks collapsed."""
    lowered = strip(F.lower(_col(c)))
    text = F.regexp_replace(lowered, rf"(?=[hw])(?:http|www)[^{BLANK}]+", "")
    text = _drop_if(text, text.contains("@"), rf"[^{BLANK}]+@[^{BLANK}]+")
    text = F.regexp_replace(text, rf"[@#][{WORD}]+", "")
    return squeeze(text)


def clean_simple(c: str | Column) -> Column:
    """Lower case, without URLs and e-mails; other characters than letters, digits, ' and - become blanks."""
    text = F.regexp_replace(F.lower(_col(c)), rf"http[^{BLANK}]+|www[^{BLANK}]+", "")
    text = F.regexp_replace(text, rf"[^{BLANK}]+@[^{BLANK}]+", "")
    return squeeze(F.regexp_replace(text, rf"[^{LETTERS}0-9{BLANK}'-]", " "))


def words(c: str | Column) -> Column:
    """Blank-separated words of a text."""
    return F.regexp_extract_all(_col(c), F.lit(rf"[^{BLANK}]+"), 0)


def drop_words(tokens: Column, stops: Iterable[str]) -> Column:
    """Tokens outside a word list, repeats and order kept."""
    stops = sorted(set(stops))
    return F.filter(tokens, lambda t: ~t.isin(stops)) if stops else tokens


def clean_letters_stop(c: str | Column, stops: Iterable[str]) -> Column:
    """Letters only, stop words and words of one or two characters dropped."""
    letters = F.regexp_replace(lower_or_empty(c), rf"[^{LETTERS} ]", " ")
    kept = drop_words(F.filter(F.split(letters, " +"), lambda t: F.length(t) > 2), stops)
    return F.array_join(kept, " ")


def clean_stripped_stop(c: str | Column, stops: Iterable[str]) -> Column:
    """Everything but letters and blanks deleted (words may fuse), listed words dropped."""
    letters = F.regexp_replace(F.lower(_col(c)), rf"[^a-zà-ÿ{BLANK}]", "")
    return F.array_join(drop_words(words(letters), stops), " ")


def lower_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.lower(_col(c)), F.lit(""))


def char_length(c: str | Column) -> Column:
    """Length in characters, 0 for a missing text."""
    return F.length(F.coalesce(_col(c), F.lit("")))


def blank_to_null(c: str | Column) -> Column:
    """Blank texts and the spellings of a missing value become null."""
    text = strip(c)
    return F.when(~text.isin("", "nan", "NaT"), text)


def contains_term(c: str | Column, pattern: str) -> Column:
    """1 when the pattern occurs, 0 otherwise or when the text is missing."""
    return F.coalesce(_col(c).rlike(pattern), F.lit(False)).cast("int")


def whole_words(patterns: Iterable[str]) -> str:
    """Case-blind alternation of patterns that starts and ends at Unicode word borders."""
    return rf"(?iu)(?<![{WORD}])(?:{'|'.join(patterns)})(?![{WORD}])"


def matched_keyword(c: str | Column, pattern: str) -> Column:
    """First matching part of the text, null when there is none."""
    found = F.regexp_extract(_col(c), pattern, 0)
    return F.when(found != "", found)


def split_sentences(c: str | Column) -> Column:
    """Trimmed sentences holding at least one letter; a sentence ends at . ! ? … before a blank."""
    parts = F.split(_col(c), rf"(?<=[.!?…])[{BLANK}]+")
    return F.filter(F.transform(parts, strip), lambda s: s.rlike(r"\p{L}"))


def analyzer_tokens(c: str | Column) -> Column:
    """Lower-case runs of at least two word characters: the default tokens of a count vectoriser."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(rf"[{WORD}]{{2,}}"), 0)


def plain_letters(c: str | Column) -> Column:
    """The lower-case text with one blank for any run of other characters than letters, and a blank at either end."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}]+", " ")), F.lit(" "))


def letter_grams(c: str | Column) -> Column:
    """All runs of three characters of a text of letters and blanks, in three passes whatever its length."""
    cuts = [_col(c), *(F.substr(_col(c), F.lit(k)) for k in (2, 3))]
    return F.concat(*[F.regexp_extract_all(x, F.lit(".{3}"), 0) for x in cuts])


def char_grams(c: str | Column) -> Column:
    """All runs of three characters of ``plain_letters``; a text without letters has none, null stays null."""
    return letter_grams(plain_letters(c))


def letter_tokens(c: str | Column) -> Column:
    """Lower-case runs of letters not touching a digit or underscore."""
    pattern = rf"(?<![{WORD}])\p{{L}}++(?![{WORD}])"
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(pattern), 0)


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams of ``low`` to ``high`` tokens, joined by one blank."""

    def of_size(n: int) -> Column:
        if n == 1:
            return tokens
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1)))
        made = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
        return F.coalesce(made, F.array().cast("array<string>"))

    sizes = [of_size(n) for n in range(low, high + 1)]
    return sizes[0] if len(sizes) == 1 else F.concat(*sizes)


def lang_group(c: str | Column, target: str = "fr") -> Column:
    """The target language, or ``Autres`` for every other and for none."""
    return F.when(_col(c) == target, F.lit(target)).otherwise(F.lit("Autres"))
