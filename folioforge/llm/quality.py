"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Everything is DataFrame expressions. Each text is measured once; what the rules say of it is
a short array of votes (1 good, -1 bad, 0 abstains). The corpus is then only a table of vote
patterns with counts, at most ``3 ** rules`` rows whatever the corpus, over which a two-class
model is fitted inside one expression. Its posterior decides on each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, fresh, let, materialise, words_of

#: Fixed values of the base measures.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

#: Frequent function words of the four languages; a rule asks for how many of them occur.
FUNCTION_WORDS = (
    "the and of to in is it for that with on this are be as was at by from or an not "
    "de la le les des et un une du que qui en dans pour sur pas par au est ce "
    "der die das und zu den von mit ist im nicht ein eine auf für dem sich des "
    "el los las del y por con no una su para es al lo como"
).split()

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_window_words(words: Column) -> Column:
    """Words that lie in a window of eight words which the text holds twice or more."""

    def fold(hashes: Column, step: int) -> Column:
        """Hash of 2 * step words from each hash of step words; the last ones have no partner."""
        return F.zip_with(
            F.slice(hashes, 1, F.size(hashes) - step),
            F.slice(hashes, 1 + step, F.size(hashes) - step),
            lambda x, y: F.xxhash64(x, y),
        )

    def spread(windows: Column) -> Column:
        by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(
            by_hash,
            lambda s: F.filter(
                s,
                lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]),
            ),
        )
        places = F.array_sort(F.transform(again, lambda x: x["i"]))
        return let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            spread(windows)
        )

    one = F.transform(words, lambda w: F.xxhash64(w))
    eight = let(one, lambda a: let(fold(a, 1), lambda b: let(fold(b, 2), lambda c: let(fold(c, 4), count))))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(eight)


def measure(docs: DataFrame, text_col: str = "text", name: str = "_m") -> DataFrame:
    """``docs`` with a struct ``name`` of what the rules need. Null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{SPACE_CLASS[1:]}"))
    functions = F.array(*[F.lit(w) for w in FUNCTION_WORDS])

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_window_words(words).alias("n_repeat_words"),
            let(lines, F.size).cast("long").alias("n_lines"),
            F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
            F.regexp_count(text, F.lit("!")).cast("long").alias("n_exclaims"),
            F.regexp_count(text, F.lit(r"[.?](?=[\s]|\z)")).cast("long").alias("n_sentences"),
            F.size(F.array_intersect(words, functions)).cast("long").alias("n_function_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
        )

    return docs.withColumn(name, let(words_of(F.col(text_col)), of))


def votes(m: Column) -> list[Column]:
    """One vote for each rule: 1 good, -1 bad, 0 abstains. A text without words gets none."""
    n = F.when(m["n_words"] > 0, m["n_words"])
    chars = F.when(m["word_chars"] > 0, m["word_chars"])

    def rule(bad: Column, good: Column = F.lit(False)) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    per_word, per_char, length = m["n_symbols"] / n, m["n_symbols"] / chars, m["word_chars"] / n
    sentences, long = m["n_sentences"] / n, m["n_words"] >= LEAST_WORDS
    return [
        rule(per_word > 0.1, per_word < 0.03),
        rule(per_char > 0.03, per_char < 0.005),
        rule(m["n_capitals"] / chars > 0.3),
        rule(m["n_exclaims"] / n > 0.1),
        rule((length > 7) | (length < 3), length.between(4.5, 6)),
        rule(m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)) > 0.3),
        rule(m["n_repeat_words"] / n > 0.2),
        rule((sentences < 0.02) & long | (sentences > 0.5), sentences.between(0.05, 0.3)),
        rule((m["n_function_words"] < 2) & long, m["n_function_words"] >= 5),
        rule((m["n_distinct_words"] / F.sqrt(n) < 2) & long, m["n_distinct_words"] / F.sqrt(n) > 3.5),
    ]


def fit(patterns: DataFrame, rules: int, rounds: int = 30) -> tuple[float, list[float], list[float]]:
    """(prior of good, P(vote good | good), P(vote good | bad)) for each rule, from a table
    (votes, n) of vote patterns, by expectation-maximisation inside one expression.

    Starts from the mean vote. Abstentions carry no weight. Each rate is smoothed by one
    agreeing and one contrary vote. An empty table gives even odds, which keep everything.
    """

    def start(p: Column) -> Column:
        cast = F.aggregate(p["votes"], F.lit(0.0), lambda s, v: s + v)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-cast))

    def posterior(p: Column, model: Column) -> Column:
        odds = F.log(model["prior"] / (1 - model["prior"]))
        for j in range(rules):
            a, b, v = F.get(model["good"], F.lit(j)), F.get(model["bad"], F.lit(j)), F.get(p["votes"], F.lit(j))
            odds += F.when(v == 1, F.log(a / b)).when(v == -1, F.log((1 - a) / (1 - b))).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    def maximise(table: Column, weigh) -> Column:
        def of(rows: Column) -> Column:
            def total(what) -> Column:
                return F.aggregate(rows, F.lit(0.0), lambda s, x: s + x["n"] * what(x))

            def rate(j: int, side) -> Column:
                v = lambda x: F.get(x["votes"], F.lit(j))
                yes = total(lambda x: F.when(v(x) == 1, side(x)).otherwise(0.0))
                said = total(lambda x: F.when(v(x) != 0, side(x)).otherwise(0.0))
                return (yes + 1.0) / (said + 2.0)

            return F.struct(
                ((total(lambda x: x["q"]) + 1.0) / (total(lambda x: F.lit(1.0)) + 2.0)).alias("prior"),
                F.array(*[rate(j, lambda x: x["q"]) for j in range(rules)]).alias("good"),
                F.array(*[rate(j, lambda x: 1.0 - x["q"]) for j in range(rules)]).alias("bad"),
            )

        weighed = F.transform(
            table, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), weigh(p).alias("q"))
        )
        return let(weighed, of)

    table = F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))))
    row = (
        patterns.agg(table.alias("t"))
        .select(
            F.aggregate(
                F.sequence(F.lit(1), F.lit(rounds)),
                maximise(F.col("t"), start),
                lambda model, _: maximise(F.col("t"), lambda p: posterior(p, model)),
            ).alias("model")
        )
        .first()["model"]
    )
    return row["prior"], list(row["good"]), list(row["bad"])


def posterior_of(cast: Column, prior: float, good: list[float], bad: list[float]) -> Column:
    """The probability of good quality for an array of votes under a fitted model."""
    odds = F.log(F.lit(prior / (1 - prior)))
    for j, (a, b) in enumerate(zip(good, bad, strict=True)):
        v = F.get(cast, F.lit(j))
        odds += F.when(v == 1, F.log(F.lit(a / b))).when(v == -1, F.log(F.lit((1 - a) / (1 - b)))).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def score_quality(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all, where none are named) of every row of ``docs``, with the
    base measures, votes array<int>, quality double, base_failed and kept booleans.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows of eight.
    kept: not base_failed and quality of 0.5 or more. Null, empty and blank texts have no
    words, fail the base rules and cast no vote but take part in the fit like any row;
    repeated rows count each time. Columns of the result replace columns of ``docs`` of the
    same name. An empty table gives an empty result.
    """
    carry = docs.columns if carry is None else carry
    own = [*BASE, "votes", "quality", "base_failed", "kept"]
    name = fresh(docs.columns, "_m")
    measured, m = measure(docs, text_col, name), F.col(name)
    flat = measured.select(
        *[F.col(f"`{c}`") for c in carry if c not in own],
        *[m[c].alias(c) for c in BASE],
        F.array(*votes(m)).alias("votes"),
    )
    flat = materialise(flat, "measures")
    model = fit(flat.groupBy("votes").agg(F.count("*").alias("n")), len(votes(m)))
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    return (
        flat.withColumn("quality", posterior_of(F.col("votes"), *model))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    )
