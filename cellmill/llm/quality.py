"""Quality rules with adaptive thresholds, in built-in expressions only.

Counts come from whole texts, inside each row, without exploding words.  The
cutoffs come from the documents: per language, source and measure a KLL sketch
is built by map-side partial aggregation, and sketches of a language's sources
are merged.  A measure may lie beyond its 0.9 quantile by some times what lies
between that and the median; a group's quantiles are drawn towards those of its
language by its number of documents.  What one symbol, line or window makes in
the document itself counts as spread too, so that a group without any does not
lose documents for one of them.  The table of bounds has one row per language
and source; it is joined with the documents, and Spark broadcasts it only when
its written size is under the broadcast threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmill.llm.common import text_of, written

#: Fixed: words are runs of other characters than these; symbols are those.
WORD = "[^\\x20\\x09-\\x0D]+"
BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio")
#: One step of a measure in a document: so many of the count it is a share of.
STEPS = {"word_length": (0, "n_words"), "symbol_ratio": (1, "n_words"), "dup_line_ratio": (1, "n_lines"), "repeat_ratio": (3, "n_words")}


@dataclass(frozen=True)
class QualityRules:
    """Parameters.  A document fails its base rules with fewer than min_words words, or more than max_repeat_percent percent
    of its words in repeated 3-word windows.  A measure is out of bounds above q + reach * (q - median + unit / size), with q
    the quantile ``tail`` of its group, and, for word length, under the like for the quantile 1 - tail.  unit / size is one
    step of the measure in the document: a symbol or a 3-word window of its words, a line of its lines; none for word length.
    A group of n documents has n / (n + own_rows) of its own quantiles and the rest of its language's.  Bounds are rounded
    outwards to multiples of ``step``."""

    min_words: int = 50
    max_repeat_percent: int = 50
    reach: float = 5.0
    tail: float = 0.9
    own_rows: int = 100
    step: float = 0.01
    sketch_k: int = 2048


def with_counts(df: DataFrame, text_col: str) -> DataFrame:
    """df and the columns of COUNTS plus n_lines (lines with a word), all long, prefixed with _q_.  Null text has none.

    Windows are compared by hashes first; only those whose hash comes again are made, sorted and compared as words.  The
    words, lines and hashes of one text are held at once, some 100 bytes per word.
    """
    text, blanks = F.col("_q_text"), F.lit(" \t\n\x0b\x0c\r")
    keep = [F.col(f"`{c}`") for c in df.columns]
    trimmed = F.btrim(text, blanks)
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))
    rows = df.select(*keep, text_of(df, text_col).alias("_q_text")).withColumn("_q_words", words)
    at = lambda i: F.get("_q_words", i)
    hashes = F.transform(F.sequence(F.lit(0), F.size("_q_words") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
    wide = rows.select(
        *keep,
        "_q_words",
        F.length(F.array_join("_q_words", "")).cast("long").alias("_q_word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("_q_n_symbols"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("_q_lines"),
        F.when(F.size("_q_words") >= 3, hashes).otherwise(F.array().cast("array<bigint>")).alias("_q_hashes"),
    )

    def again(name: str):
        """Whether the first field of an element of this sorted array of pairs is that of a neighbour."""
        own = lambda j: F.get(F.col(name), j)["k"]
        return lambda j: F.coalesce(own(j) == own(j - 1), F.lit(False)) | F.coalesce(own(j) == own(j + 1), F.lit(False))

    def places(name: str) -> Column:
        every = F.filter(F.sequence(F.lit(0), F.size(name) - 1), again(name))
        return F.when(F.size(name) > 0, F.transform(every, lambda j: F.get(F.col(name), j)["i"]))

    pairs = F.sort_array(F.transform("_q_hashes", lambda h, i: F.struct(h.alias("k"), i.alias("i"))))
    wide = wide.withColumn("_q_sorted", F.when(F.size(F.array_distinct("_q_hashes")) < F.size("_q_hashes"), pairs))
    wide = wide.withColumn("_q_likely", places("_q_sorted"))
    window = lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("k"), i.alias("i"))
    wide = wide.withColumn("_q_windows", F.sort_array(F.transform("_q_likely", window)))
    covered = F.flatten(F.transform(places("_q_windows"), lambda i: F.array(i, i + 1, i + 2)))
    return wide.select(
        *keep,
        F.size("_q_words").cast("long").alias("_q_n_words"),
        "_q_word_chars",
        "_q_n_symbols",
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("_q_n_dup_lines"),
        F.coalesce(F.size(F.array_distinct(covered)).cast("long"), F.lit(0).cast("long")).alias("_q_n_repeat_words"),
        F.size("_q_lines").cast("long").alias("_q_n_lines"),
    )


def _measure(name: str) -> Column:
    per = {
        "word_length": ("_q_word_chars", "_q_n_words"),
        "symbol_ratio": ("_q_n_symbols", "_q_n_words"),
        "dup_line_ratio": ("_q_n_dup_lines", "_q_n_lines"),
        "repeat_ratio": ("_q_n_repeat_words", "_q_n_words"),
    }[name]
    return F.coalesce(F.try_divide(F.col(per[0]).cast("double"), F.col(per[1]).cast("double")), F.lit(0.0))


def _base_failed(rules: QualityRules) -> Column:
    return (F.col("_q_n_words") < rules.min_words) | (100 * F.col("_q_n_repeat_words") > rules.max_repeat_percent * F.col("_q_n_words"))


def thresholds(counted: DataFrame, lang_col: str, source_col: str, rules: QualityRules) -> DataFrame:
    """counted: a written table, since a filter over with_counts would be moved into it and repeat its arrays.  Per (language, source): columns _q_lang, _q_source, _q_low and _q_high_<measure>, the bounds but for the document's own
    step; written.  Sketches cover every document that passes the base rules.
    """
    passed = counted.where(~_base_failed(rules)).select(
        F.col(lang_col).alias("_q_lang"), F.col(source_col).alias("_q_source"), *[_measure(m).alias(m) for m in MEASURES]
    )
    sketches = passed.groupBy("_q_lang", "_q_source").agg(
        F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(m, rules.sketch_k).alias(m) for m in MEASURES]
    )
    sketches = written(sketches, "quality-sketches")
    at = lambda m, q: F.kll_sketch_get_quantile_double(F.col(m), F.lit(q))
    fence = lambda m, q: at(m, q) + rules.reach * (at(m, q) - at(m, 0.5))
    fences = F.struct(fence("word_length", 1 - rules.tail).alias("low"), *[fence(m, rules.tail).alias(m) for m in MEASURES])
    merged = sketches.groupBy("_q_lang").agg(*[F.kll_merge_agg_double(m).alias(m) for m in MEASURES])
    whole = merged.select(F.col("_q_lang").alias("_l"), fences.alias("whole"))
    own = sketches.select("_q_lang", "_q_source", (F.col("n") / (F.col("n") + rules.own_rows)).alias("w"), fences.alias("own"))
    both = own.join(whole, F.col("_q_lang").eqNullSafe(F.col("_l")))
    drawn = lambda m: (F.col("w") * F.col(f"own.{m}") + (1 - F.col("w")) * F.col(f"whole.{m}")) / rules.step
    high = [(F.ceil(drawn(m)) * rules.step).alias(f"_q_high_{m}") for m in MEASURES]
    return written(both.select("_q_lang", "_q_source", (F.floor(drawn("low")) * rules.step).alias("_q_low"), *high), "quality-bounds")


def _verdicts(counted: DataFrame, bounds: DataFrame, lang_col: str, source_col: str, rules: QualityRules) -> DataFrame:
    where = F.col(lang_col).eqNullSafe(F.col("_q_lang")) & F.col(source_col).eqNullSafe(F.col("_q_source"))
    inside = _measure("word_length") >= F.col("_q_low")
    for m, (unit, size) in STEPS.items():
        own = rules.reach * F.coalesce(F.try_divide(F.lit(float(unit)), F.col(f"_q_{size}").cast("double")), F.lit(0.0))
        inside &= _measure(m) <= F.col(f"_q_high_{m}") + own
    kept = ~_base_failed(rules) & F.coalesce(inside, F.lit(True))
    return counted.join(bounds, where, "left").withColumn("_q_base_failed", _base_failed(rules)).withColumn("_q_kept", kept)


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rules: QualityRules = QualityRules()
) -> DataFrame:
    """One row per input row: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept.

    Null or empty text has no words and fails the base rules.  Null language or source is a group like any other.
    Repeated rows are judged alike; ties with a bound are kept; an empty table gives an empty result; other columns are
    not read.  The counts are written once, since thresholds and verdicts both need them.  See with_counts for very long
    texts.  Sketches of more than sketch_k documents are drawn by chance, so that a bound may move by a step between runs.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).alias("_body"))
    counted = with_counts(rows, "_body").drop("_body")
    counted = written(counted, "quality-counts")
    bounds = thresholds(counted, "_lang", "_source", rules)
    judged = _verdicts(counted, bounds, "_lang", "_source", rules)
    return judged.select(
        F.col("_id").alias(id_col), *[F.col(f"_q_{c}").alias(c) for c in COUNTS], F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept")
    )


def keep_good(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", rules: QualityRules = QualityRules()
) -> DataFrame:
    """The rows of df that pass, with the columns of df.  Rows are written with their counts, which costs less than counting
    a second time, and are not shuffled.  Nulls, repeated rows, ties and empty tables are as in quality_rules.
    """
    counted = written(with_counts(df, text_col), "quality-rows")
    judged = _verdicts(counted, thresholds(counted, lang_col, source_col, rules), lang_col, source_col, rules)
    return judged.where("_q_kept").select(*[F.col(f"`{c}`") for c in df.columns])
