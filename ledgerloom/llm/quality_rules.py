"""Line-first cleaning: rules per line, then a verdict on what a document has left.

Every line of a document is held against punctuation, navigation and boilerplate rules. Lines that
fail are removed, and a document that loses too large a share of its words is rejected, as is
one that fails the base rules (too few words, or mostly repeated three-word windows). All of it
is Spark SQL on one row at a time: no shuffle, no Python.

A word is a maximal run of characters other than space and U+0009 to U+000D. Lines end at U+000A.

Defined results: a null or empty text has no words, counts 0 and fails the base rules; repeated
rows are judged each for themselves; an empty table gives an empty table; further columns are
kept in :func:`clean_lines`, except that columns named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of page furniture, matched in lower-cased lines of few words.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "uses cookies",
    "use cookies",
    "enable javascript",
    "sign in",
    "sign up",
    "log in",
    "subscribe to our newsletter",
    "skip to content",
    "back to top",
    "click here",
    "read more",
    "share this",
    "lorem ipsum",
)

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

RESULTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_bad_lines",
    "n_kept_words",
    "base_failed",
    "kept",
    "clean_text",
)


@dataclass(frozen=True)
class Rules:
    """Production parameters.

    ``symbols``: symbols per word above which a line is navigation or noise. ``shouted``: share of
    upper-case letters among all characters above which a line of ``shout_words`` words or more is
    shouted. ``boilerplate_words``: longest line in which a boilerplate phrase counts.
    ``punctuation``: share of ASCII punctuation among all characters above which a line fails.
    ``max_lost``: share of words lost above which a document is rejected.
    ``min_words`` and ``max_repeat_percent`` are the base rules.
    """

    symbols: float = 0.3
    shouted: float = 0.4
    shout_words: int = 3
    boilerplate_words: int = 12
    punctuation: float = 0.3
    max_lost: float = 0.5
    min_words: int = 50
    max_repeat_percent: int = 50


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def count_matches(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that match a one-character ``pattern``."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))


def windows_of(words: Column, window) -> Column:
    """``window(first word, position)`` for each three-word window."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), window)


def repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in ``words``.

    Equal windows have equal 64-bit hashes, so a text whose hashes all differ repeats nothing. For the
    others hashes are sorted with their positions, so equal windows are neighbours, and the words
    themselves are compared; a covered stretch adds at most three words per window and less where
    windows overlap.
    """

    def covered(places: Column) -> Column:
        return F.aggregate(
            places,
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("total")),
            lambda acc, p: F.struct(
                p.alias("last"), (acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total")
            ),
            lambda acc: acc["total"],
        )

    def counted(w: Column) -> Column:
        def equal(a: Column, b: Column) -> Column:
            same = a["hash"] == b["hash"]
            for k in range(3):
                same = same & (F.get(w, a["at"] + k) == F.get(w, b["at"] + k))
            return same

        def repeated(s: Column) -> Column:
            same = F.filter(s, lambda x, i: equal(x, F.get(s, i - 1)) | equal(x, F.get(s, i + 1)))
            return F.sort_array(F.transform(same, lambda x: x["at"]))

        def exact(h: Column) -> Column:
            placed = F.transform(h, lambda x, i: F.struct(x.alias("hash"), i.alias("at")))
            return covered(let(F.sort_array(placed), repeated))

        hashes = windows_of(w, lambda first, i: F.xxhash64(first, F.get(w, i + 1), F.get(w, i + 2)))
        return let(
            hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(h))
        )

    return let(words, counted)


def line_fails(line: Column, n: Column, symbols: Column, rules: Rules) -> Column:
    """Whether a line of ``n`` words with ``symbols`` symbols breaks a rule; the dearest come last."""
    upper = count_matches(line, r"\p{Lu}")
    phrases = "|".join(p.replace(" ", f"{BLANK}+") for p in BOILERPLATE)
    return (
        (symbols > F.lit(rules.symbols) * n)
        | ((n <= rules.boilerplate_words) & line.rlike(rf"(?i)(^|[^a-zA-Z])({phrases})($|[^a-zA-Z])"))
        | ((n >= rules.shout_words) & (upper > F.lit(rules.shouted) * F.length(line)))
        | (count_matches(line, r"\p{Punct}") > F.lit(rules.punctuation) * F.length(line))
    )


def counted_lines(docs: DataFrame, rules: Rules) -> DataFrame:
    """``docs`` with the counts of each text, and its lines with whether they fail."""
    judged = docs.drop(*RESULTS)
    text = F.coalesce(F.col("text"), F.lit(""))
    judged = judged.withColumn(
        "__lines",
        F.transform(
            F.split(text, "\n"),
            lambda line: let(
                F.struct(words_of(line).alias("words"), count_matches(line, SYMBOL).alias("symbols")),
                lambda x: F.struct(
                    line.alias("line"),
                    x["words"].alias("words"),
                    x["symbols"].alias("symbols"),
                    ((F.size(x["words"]) > 0) & line_fails(line, F.size(x["words"]), x["symbols"], rules)).alias("fails"),
                ),
            ),
        ),
    )

    def total(value) -> Column:
        return F.aggregate("__lines", F.lit(0), lambda n, x: n + value(x)).cast("long")

    worded = F.transform(F.filter("__lines", lambda x: F.size(x["words"]) > 0), lambda x: x["line"])
    return judged.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in RESULTS],
        "__lines",
        total(lambda x: F.size(x["words"])).alias("n_words"),
        F.length(F.regexp_replace(text, f"{BLANK}+", "")).cast("long").alias("word_chars"),
        total(lambda x: x["symbols"]).alias("n_symbols"),
        let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("n_dup_lines"),
        repeat_words(F.flatten(F.transform("__lines", lambda x: x["words"]))).cast("long").alias("n_repeat_words"),
        total(lambda x: F.when(F.size(x["words"]) > 0, 1).otherwise(0)).alias("n_lines"),
        total(lambda x: F.when(x["fails"], 1).otherwise(0)).alias("n_bad_lines"),
        total(lambda x: F.when(x["fails"], 0).otherwise(F.size(x["words"]))).alias("n_kept_words"),
    )


def with_verdict(counted: DataFrame, rules: Rules) -> DataFrame:
    base_failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    enough = F.col("n_words") - F.col("n_kept_words") <= F.lit(rules.max_lost) * F.col("n_words")
    return (
        counted.withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & enough)
        .withColumn(
            "clean_text",
            F.array_join(F.transform(F.filter("__lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n"),
        )
        .drop("__lines")
    )


def clean_lines(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the counts of each text, the verdict and the text without failed lines."""
    return with_verdict(counted_lines(docs, rules), rules)


def kept_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of `clean_lines` that are kept.

    The optimizer writes the expressions of columns into a filter on them, once for each use. It moves none over
    a generator, so the counts go through one of a single row each and are computed once.
    """
    counted = counted_lines(docs, rules)
    row = F.struct(*[F.col(f"`{c}`") for c in counted.columns])
    return with_verdict(counted.select(F.inline(F.array(row))), rules).filter("kept")
