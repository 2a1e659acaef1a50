"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document.  How often a
rule is right on good and on bad documents is not set by hand: expectation
maximisation finds it, together with the share of good documents, from how the
votes of all documents agree.  The votes of a document then give the posterior
probability that it is good.

The model's input is the number of documents of each vote pattern, at most
three to the power of the number of rules, so its size does not grow with the
corpus; the counts cover every document.  All text work is expressions on
single rows: nothing but (pattern, count) rows is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import GAP, LOWER, NOT_GAP, UPPER, split_words
from rankloom.operators.chunks import written_once

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# fixed values: frequent short words
FREQUENT = (
    "the of and to in is that for with was it as be by on this from are an at or not have which a "
    "de la le les et des en un une du que dans qui est pour pas au sur il "
    "der die und den von das mit sich des dem nicht ein eine im ist auf zu als auch "
    "el los las del se por con para una su lo es al y"
).split()


MEASURES = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_upper", "n_lower", "n_frequent", "n_ends", "n_lines", "n_dup_lines")


def carried(keep: Sequence[str], outputs: Sequence[str]) -> tuple[Column, list[Column]]:
    """The kept columns as one struct, under names that nothing else has, and how to take them out again.

    A column that is called like an output is left out: the output takes its place.
    """
    kept = [c for c in dict.fromkeys(keep) if c.lower() not in outputs]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.lit(0).alias("_"))
    return row.alias("_row"), [F.col("_row").getField(f"c{i}").alias(c) for i, c in enumerate(kept)]


def measures(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns of every row with counts over its whole text; a null text counts as empty.

    Rows are kept apart even if they are equal, and an empty table gives none.
    A kept column that is called like a measure is left out.


    n_words, word_chars (code points in words), n_symbols, n_lines and
    n_dup_lines (lines with a word; those equal to an earlier one),
    n_repeat_words (words in 3-word windows found twice or more, compared by
    64-bit hashes), n_upper, n_lower (A-Z, a-z), n_frequent, n_ends (words that
    end a sentence).
    """
    row, kept = carried(keep, MEASURES)
    return measured(docs, text, row).select(*kept, *MEASURES)


def measured(docs: DataFrame, text: str, row: Column) -> DataFrame:
    """``row`` as ``_row`` with the measures of every row."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    less = lambda chars: F.char_length("_t") - F.char_length(F.translate("_t", chars, ""))
    base = docs.select(row, t.alias("_t"), split_words(t, GAP).alias("_words"))
    windows = F.expr(
        "transform(sequence(0, size(_words) - 3), i -> struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) as h, i as at))"
    )
    base = base.withColumn("_hashes", F.when(F.size("_words") > 3, windows))
    base = base.withColumn("_sorted", F.sort_array("_hashes"))
    twice = F.expr("filter(_sorted, (x, i) -> x.h = get(_sorted, i - 1).h or x.h = get(_sorted, i + 1).h)")
    base = base.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["at"])))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    cover = F.aggregate(
        F.coalesce("_twice", F.array().cast("array<int>")),
        zero,
        lambda acc, at: F.struct((at + 3).alias("end"), (acc.n + F.least(F.lit(3), at + 3 - acc.end)).alias("n")),
        lambda acc: acc.n,
    )
    lines = F.filter(F.split("_t", "\n"), lambda line: line.rlike(NOT_GAP))
    found = base.select(
        "_row",
        F.size("_words").cast("bigint").alias("n_words"),
        (F.char_length("_t") - less(SPACES)).cast("bigint").alias("word_chars"),
        less(SYMBOLS).cast("bigint").alias("n_symbols"),
        cover.alias("n_repeat_words"),
        less(UPPER).cast("bigint").alias("n_upper"),
        less(LOWER).cast("bigint").alias("n_lower"),
        F.size(F.filter("_words", lambda w: w.isin(FREQUENT))).cast("bigint").alias("n_frequent"),
        F.size(F.filter("_words", lambda w: w.endswith(".") | w.endswith("?") | w.endswith("!"))).cast("bigint").alias("n_ends"),
        lines.alias("_lines"),
    )
    n_lines = F.size("_lines").cast("bigint")
    return found.select("*", n_lines.alias("n_lines"), (n_lines - F.size(F.array_distinct("_lines"))).alias("n_dup_lines")).drop("_lines")


def votes() -> dict[str, Column]:
    """The rules.  Most of them know one kind of bad text and abstain on everything else; two also vote for good.

    A text without words gets a bad vote from ``length`` and no other.
    """
    n, letters = F.col("n_words"), F.col("n_upper") + F.col("n_lower")
    bad = {
        "length": n < 50,
        "symbols": F.col("n_symbols") * 10 > n,
        "repetition": F.col("n_repeat_words") * 10 > n * 3,
        "lines": F.col("n_dup_lines") * 10 > F.col("n_lines") * 4,
        "capitals": F.col("n_upper") * 10 > letters * 4,
        "word_length": (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 12),
        "frequent": (F.col("n_frequent") * 100 < n * 3) & (n >= 30),
        "sentences": (F.col("n_ends") * 100 > n * 60) & (n >= 30),
        "plain": F.lit(False),
    }
    good = {
        "frequent": F.col("n_frequent") * 100 >= n * 8,
        "plain": (F.col("n_symbols") * 50 <= n) & (F.col("n_upper") * 20 <= letters * 3) & (F.col("n_repeat_words") * 20 <= n * 3),
    }
    some = n > 0
    return {
        name: F.when(no & (some | F.lit(name == "length")), -1).when(good.get(name, F.lit(False)) & some, 1).otherwise(0)
        for name, no in bad.items()
    }


class VoteModel:
    """Share of good documents, and for each rule how often its votes are right."""

    def __init__(self, prior: float, accuracy: Sequence[float]):
        self.prior, self.accuracy = prior, list(accuracy)

    def weight(self, rule: int) -> float:
        """What a vote of the rule moves the log-odds."""
        return math.log(self.accuracy[rule] / (1 - self.accuracy[rule]))

    def posterior(self, pattern: Sequence[int]) -> float:
        total = math.log(self.prior / (1 - self.prior)) + sum(v * self.weight(r) for r, v in enumerate(pattern))
        return 1 / (1 + math.exp(-total))

    def column(self, rules: Sequence[str]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for r, name in enumerate(rules):
            total = total + F.col(name) * F.lit(self.weight(r))
        return 1 / (1 + F.exp(-total))


#: a rule is taken for better than chance and for fallible; the two classes cannot change places
LEAST, MOST = 0.6, 0.99
PRIOR_LEAST, PRIOR_MOST = 0.1, 0.9


def fit_votes(patterns: Sequence[tuple[Sequence[int], int]], rules: int, steps: int = 100) -> VoteModel:
    """Expectation maximisation over (votes, number of documents).

    Without documents, or for a rule that never votes, the starting values
    remain.
    """
    model = VoteModel(0.7, [0.8] * rules)
    patterns = sorted((tuple(p), n) for p, n in patterns)
    for _ in range(steps if patterns else 0):
        good = [model.posterior(p) for p, _ in patterns]
        prior = sum(q * n for q, (_, n) in zip(good, patterns)) / sum(n for _, n in patterns)
        accuracy = []
        for r in range(rules):
            cast = sum(n for p, n in patterns if p[r])
            right = sum((q if p[r] > 0 else 1 - q) * n for q, (p, n) in zip(good, patterns) if p[r])
            accuracy.append(max(LEAST, min(MOST, (right + 1.6) / (cast + 2))))
        model = VoteModel(max(PRIOR_LEAST, min(PRIOR_MOST, prior)), accuracy)
    return model


def judge(docs: DataFrame, text: str, keep: Sequence[str], threshold: float = 0.5) -> tuple[DataFrame, VoteModel]:
    """The measures of every row, each rule's vote (``vote_*``), ``quality`` and ``good``; and the fitted model.

    See ``measures`` for nulls, repeated rows and empty tables; a kept column
    that is called like any output is left out.  Measured rows are stored once in the shared folder, as both the model and
    the result need them.
    """
    rules = votes()
    names = [f"vote_{r}" for r in rules]
    row, kept = carried(keep, [*MEASURES, *names, "quality", "good"])
    rows = measured(docs, text, row).select("*", *[v.cast("tinyint").alias(f"vote_{r}") for r, v in rules.items()])
    rows = written_once(rows, "quality")
    counted = rows.groupBy(*names).count().collect()  # at most 3 ** rules rows
    model = fit_votes([(tuple(r[:-1]), r[-1]) for r in counted], len(names))
    rows = rows.withColumn("quality", model.column(names)).withColumn("good", F.col("quality") >= threshold)
    return rows.select(*kept, *MEASURES, *names, "quality", "good"), model
