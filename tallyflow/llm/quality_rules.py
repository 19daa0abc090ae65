"""Quality of texts by weak supervision, in DataFrame functions only.

Every rule votes good (1) or bad (-1), or abstains (0). How far each vote can be
trusted is estimated without labels: documents are counted by their pattern of
votes, a table of at most 3 ** rules rows, and expectation-maximisation over that
table finds how often the vote of each rule is right. The posterior probability
of being good replaces the demand that all rules pass.

Defined results: a null or blank text has no words and fails the base rule. Each
row is judged alone, so null, repeated keys and other columns do not matter. With
no rows at all the starting accuracies stand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.session import staged

SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SENTENCE_END = r"[.!?\x{2026}\"'\x{BB})][\x20\x09-\x0D]*$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and lets ``body`` use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the same text."""

    def of_hashes(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(
            bound(F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), of_sorted)
        )

    def of_sorted(ranked: Column) -> Column:
        twice = F.filter(
            ranked,
            lambda x, i: F.coalesce(F.get(ranked, i - 1)["g"] == x["g"], F.lit(False))
            | F.coalesce(F.get(ranked, i + 1)["g"] == x["g"], F.lit(False)),
        )
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    grams = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) < 3, 0).otherwise(bound(grams, of_hashes))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules need, one row per row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_CHAR))
        joined = F.array_join(words, "")
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.regexp_count(text, F.lit(SYMBOLS + "+")).cast("long").alias("n_symbol_words"),
            F.regexp_count(text, F.lit("!!+")).cast("long").alias("n_shouts"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            F.length(F.regexp_replace(joined, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
            bound(
                lines,
                lambda ls: F.struct(
                    F.size(ls).cast("long").alias("n_lines"),
                    (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                    F.size(F.filter(ls, lambda line: line.rlike(SENTENCE_END))).cast("long").alias("n_ended"),
                ),
            ).alias("by_line"),
        )

    return docs.select(
        "doc_id", bound(F.array_remove(F.split(text, SPACE_RUN), ""), counts).alias("c")
    ).select("doc_id", *(f"c.{n}" for n in COUNTS), "c.by_line.n_lines", "c.by_line.n_dup_lines", "c.by_line.n_ended")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_symbol_words", "n_shouts", "n_repeat_words", "n_distinct", "n_upper")


@dataclass(frozen=True)
class Rule:
    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.when(self.bad, -1).when(self.good, 1).otherwise(0)


def per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def default_rules() -> list[Rule]:
    """Rules on the counts of ``statistics``.

    A sign of junk votes bad and its absence abstains, since most documents lack
    most defects; only what looks like running prose votes good. Every kind of
    junk is seen by two rules, so that none stands alone against the prior.
    """
    never = F.lit(False)
    symbols, capitals = per("n_symbols", "n_words"), per("n_upper", "word_chars")
    shouts, repeats = per("n_shouts", "n_words"), per("n_repeat_words", "n_words")
    ended, variety = per("n_ended", "n_lines"), per("n_distinct", "n_words")
    some = F.col("n_words") >= 20
    plain = (symbols <= 0.02) & (capitals <= 0.15) & (shouts <= 0.02)
    return [
        Rule("length", never, F.col("n_words") < 50),
        Rule("word_length", never, (F.col("n_words") > 0) & ~per("word_chars", "n_words").between(2, 14)),
        Rule("symbols", never, symbols > 0.1),
        Rule("symbol_words", never, per("n_symbol_words", "n_words") > 0.08),
        Rule("capitals", never, capitals > 0.4),
        Rule("shouts", never, shouts > 0.2),
        Rule("repeated_words", never, repeats > 0.4),
        Rule("repeated_lines", never, per("n_dup_lines", "n_lines") > 0.5),
        Rule("variety", never, some & (variety < 0.15)),
        Rule("prose", some & plain & (ended >= 0.5), (F.col("n_lines") >= 3) & (F.col("n_ended") == 0)),
        Rule("fresh", some & plain & (repeats <= 0.3) & (variety >= 0.2), never),
    ]


@dataclass
class VoteModel:
    """Assumed share of good documents, and for each rule how often its vote is right."""

    balance: float
    accuracy: list[float]

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(log(self.balance / (1 - self.balance)))
        for vote, right in zip(votes, self.accuracy):
            odds = odds + vote * F.lit(log(right / (1 - right)))
        return 1 / (1 + F.exp(-odds))


def fit(
    patterns: DataFrame, rules: list[Rule], balance: float = 0.7, rounds: int = 25, tolerance: float = 1e-4
) -> VoteModel:
    """Expectation-maximisation over the counts of vote patterns (votes, n).

    A round is one aggregate of ``patterns``: for each rule, the expected number
    of its votes that name the true class. Accuracies start at 0.8, the sums are
    smoothed by one vote, and no rule is trusted beyond 0.98 or below 0.5. The
    balance is given, not estimated: as most documents get no bad vote at all,
    an estimate would outweigh the few rules that see a rare kind of junk.
    """
    model = VoteModel(balance, [0.8] * len(rules))
    votes = [F.col(r.name) for r in rules]
    for _ in range(rounds):
        good = F.col("n") * model.posterior(votes)
        sums = []
        for r, v in zip(rules, votes):
            right = F.when(v == 1, good).when(v == -1, F.col("n") - good)
            sums += [F.sum(right).alias(f"{r.name}_right"), F.sum(F.when(v != 0, F.col("n"))).alias(f"{r.name}_all")]
        row = patterns.agg(*sums).first()
        found = [((row[f"{r.name}_right"] or 0) + 0.8) / ((row[f"{r.name}_all"] or 0) + 1) for r in rules]
        new = VoteModel(balance, [min(0.98, max(0.5, x)) for x in found])
        moved = max(abs(x - y) for x, y in zip(new.accuracy, model.accuracy))
        model = new
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, rules: list[Rule] | None = None, keep_from: float = 0.5) -> DataFrame:
    """Counts, base verdict, votes, ``posterior`` and ``kept`` of each row of ``docs``."""
    rules = rules or default_rules()
    voted = staged(statistics(docs).withColumns({f"vote_{r.name}": r.vote() for r in rules}), "quality-votes")
    patterns = voted.groupBy(*(F.col(f"vote_{r.name}").alias(r.name) for r in rules)).agg(F.count("*").alias("n"))
    model = fit(staged(patterns, "quality-patterns"), rules)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.withColumn("base_failed", failed)
        .withColumn("posterior", model.posterior([F.col(f"vote_{r.name}") for r in rules]))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))
    )
