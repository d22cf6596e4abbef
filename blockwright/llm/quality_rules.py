"""Document quality rules in native expressions: repetition, size and distribution divergence.

A document's character classes and its share of common words are compared with references of its
language by Jensen-Shannon distance (base 2, 0 to 1); a distance is judged only from a minimum length
on. The limit of the word distance is each language's own, computed from its reference: the distance of a
text in which the common words have a tenth of their usual shares. Everything is a Spark SQL expression over the row: no shuffle, no Python.

Defined cases: a null text has no words and fails the base rule; a null or unknown language is judged
by the nearest character reference and not by words; repeated rows are judged each; extra columns are
kept aside in one struct, so their names can't clash; an empty table gives an empty result.
Windows of five words compare by 64-bit hashes within one document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shares in running text of lower-case and other letters, upper case, digits, white space, punctuation, symbols.
CLASS_SHARES = {
    "en": (0.782, 0.022, 0.010, 0.160, 0.023, 0.003),
    "fr": (0.778, 0.022, 0.010, 0.160, 0.027, 0.003),
    "de": (0.775, 0.045, 0.010, 0.142, 0.025, 0.003),
    "es": (0.782, 0.022, 0.010, 0.160, 0.023, 0.003),
}
# The most common words of running text and their shares in thousandths.
COMMON_WORDS = {
    "en": {"the": 60, "of": 30, "and": 28, "to": 26, "in": 20, "a": 21, "is": 11, "that": 10, "it": 9, "for": 9, "was": 9, "on": 7, "with": 7, "as": 7, "be": 6, "by": 5},
    "fr": {"de": 50, "la": 30, "le": 25, "et": 24, "les": 20, "des": 18, "en": 15, "un": 13, "du": 12, "une": 11, "que": 10, "est": 10, "pour": 9, "qui": 9, "dans": 8, "par": 7},
    "de": {"der": 30, "die": 30, "und": 25, "in": 18, "den": 12, "von": 10, "zu": 10, "das": 10, "mit": 9, "sich": 8, "des": 8, "auf": 7, "für": 7, "ist": 7, "im": 7, "dem": 6},
    "es": {"de": 60, "la": 36, "que": 30, "el": 28, "en": 26, "y": 25, "a": 20, "los": 16, "se": 12, "del": 11, "las": 10, "un": 10, "por": 9, "con": 9, "no": 8, "una": 8},
}
CODES = "abcdefghijklmnop"


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: Characters and words from which on a distance is judged.
    min_chars: int = 200
    min_common_words: int = 100
    max_class_distance: float = 0.30
    #: A text is odd from where common words have this part of their usual shares; a fixed distance for all languages takes its place.
    min_common_part: float = 0.1
    max_word_distance: float | None = None
    class_shares: dict = field(default_factory=lambda: CLASS_SHARES)
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns computed once per row: a generator between them keeps the optimizer from copying them into lambdas."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _distance(shares: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms, as arrays of one length."""

    def part(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(shares, reference, part), F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def word_limit(table: dict[str, int], part: float) -> float:
    """The distance from its reference of a text whose common words have `part` of their usual shares."""
    usual = [v / 1000 for v in table.values()]
    pairs = [(part * q, q) for q in usual] + [(1 - part * sum(usual), 1 - sum(usual))]
    return math.sqrt(sum(x * math.log2(2 * x / (p + q)) for p, q in pairs for x in (p, q) if x > 0) / 2)


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: Rules | None = None) -> DataFrame:
    """doc_id, the base counts, both distances, base_failed and kept; `row` holds the input row."""
    r = rules or Rules()
    text, words = F.col("text"), F.col("words")
    df = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.lower(F.col(lang_col).cast("string")).alias("lang"))
    known = F.lit(None).cast("array<string>")
    for lang, table in r.common_words.items():
        known = F.when(F.col("lang") == lang, F.array(*map(F.lit, table))).otherwise(known)
    df = _once(
        df,
        words=F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), ""),
        lines=F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")),
        known=known,
    )
    n = F.size(words)
    df = _once(
        df,
        hashes=F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))).otherwise(F.array().cast("array<bigint>")),
        code=F.when(F.col("known").isNull(), "").otherwise(F.array_join(F.transform(words, lambda w: F.substring(F.lit("." + CODES), F.array_position(F.col("known"), F.lower(w)).cast("int") + 1, F.lit(1))), "")),
        n_words=n.cast("long"),
        word_chars=F.char_length(F.array_join(words, "")).cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_chars=F.char_length(text),
        n_upper=F.regexp_count(text, F.lit("[A-Z]")),
        n_digit=F.regexp_count(text, F.lit("[0-9]")),
        n_point=F.regexp_count(text, F.lit("[.,;:!?'\"()-]")),
        n_symbols=F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        n_other=F.regexp_count(text, F.lit(r"[@\[\]\\^_`{}~+=/]")),
    )
    hashes = F.col("hashes")
    df = _once(df, ordered=F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    o, last = F.col("ordered"), F.size("ordered") - 1

    def twice(j: Column) -> Column:
        h = o[j]["h"]
        return ((j > 0) & (o[F.greatest(j - 1, F.lit(0))]["h"] == h)) | ((j < last) & (o[F.least(j + 1, last)]["h"] == h))

    df = _once(df, repeated=F.when(last >= 0, F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), twice), lambda j: o[j]["i"]))).otherwise(F.array().cast("array<int>")))
    p, end = F.col("repeated"), F.size("repeated") - 1
    covered = F.aggregate(F.sequence(F.lit(0), F.greatest(end, F.lit(0))), F.lit(0), lambda a, j: a + F.when(j >= end, 5).otherwise(F.least(F.lit(5), p[F.least(j + 1, end)] - p[j])))
    size, letters = F.greatest(F.col("n_chars"), F.lit(1)), F.col("word_chars") - F.col("n_upper") - F.col("n_digit") - F.col("n_point") - F.col("n_symbols") - F.col("n_other")
    shares = F.array(*[(c / size).cast("double") for c in (letters, F.col("n_upper"), F.col("n_digit"), F.col("n_chars") - F.col("word_chars"), F.col("n_point"), F.col("n_symbols") + F.col("n_other"))])
    near, common = F.array(*map(_doubles, r.class_shares.values())), F.lit(None).cast("array<double>")
    for lang, shared in r.class_shares.items():
        near = F.when(F.col("lang") == lang, F.array(_doubles(shared))).otherwise(near)
    for lang, table in r.common_words.items():
        common = F.when(F.col("lang") == lang, _doubles([*(v / 1000 for v in table.values()), 1 - sum(table.values()) / 1000])).otherwise(common)
    places = F.sequence(F.lit(1), F.lit(len(CODES)))
    counts = F.transform(places, lambda k: (F.length("code") - F.length(F.replace("code", F.substring(F.lit(CODES), k, F.lit(1)), F.lit("")))) / F.greatest(F.col("n_words"), F.lit(1)))
    limit = F.lit(r.max_word_distance).cast("double")
    if r.max_word_distance is None:
        for lang, table in r.common_words.items():
            limit = F.when(F.col("lang") == lang, F.lit(word_limit(table, r.min_common_part))).otherwise(limit)
    df = _once(df, n_repeat_words=F.when(end >= 0, covered).otherwise(0).cast("long"), shares=shares, near=near, common=common, used=counts)
    df = _once(
        df,
        class_distance=F.array_min(F.transform("near", lambda q: _distance(F.col("shares"), q))),
        word_distance=F.when(F.col("common").isNotNull(), _distance(F.concat("used", F.array(F.aggregate("used", F.lit(1.0), lambda a, x: a - x))), F.col("common"))),
        base_failed=(F.col("n_words") < r.min_words) | (100 * F.col("n_repeat_words") > r.max_repeat_percent * F.col("n_words")),
    )
    odd = ((F.col("word_chars") >= r.min_chars) & (F.col("class_distance") > r.max_class_distance)) | ((F.col("n_words") >= r.min_common_words) & F.coalesce(F.col("word_distance") > limit, F.lit(False)))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"), "class_distance", "word_distance", "row")
