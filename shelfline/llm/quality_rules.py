"""Quality rules under weak supervision.

Every rule votes good, votes bad or abstains. Rules that look for one kind of damage are correlated and cast one vote
together: bad if one of them says so, good if all do. A text is good or has one kind of damage; expectation-maximisation
over counted vote patterns estimates how many texts have which, and how often a vote is an alarm on texts that have its
kind of damage and on others. Both rates have a prior whose weight grows with the number of texts, and an alarm is never
taken as a sign of quality. An abstention says nothing. A row is kept if the posterior probability that it is good is at
least one half. Only column expressions: no Python in tasks. The driver sees vote patterns, at most 3 to the power of the
number of rules, whatever the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .registry import query, table
from .wordcols import SPACE, doubled, hash_each, split_words, text_or_empty

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
#: Votes: a measure at or above ``bad`` is an alarm, below ``good`` a clean bill, between them no vote.
RULES: dict[str, tuple[str, float, float]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", 0.05, 0.3),
    "repeated_windows": ("n_repeat_words / greatest(n_words, 1)", 0.02, 0.2),
    "repeated_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.05, 0.3),
    "capitals": ("n_capitals / greatest(n_letters, 1)", 0.15, 0.4),
    "exclamations": ("n_exclamations / greatest(n_words, 1)", 0.05, 0.3),
    "same_words": ("1 - n_distinct_words / greatest(n_words, 1)", 0.72, 0.9),
    "few_letters": ("1 - n_letters / greatest(word_chars, 1)", 0.2, 0.4),
    "long_words": ("word_chars / greatest(n_words, 1)", 12.0, 20.0),
    "short_text": ("20 / greatest(n_words, 1)", 0.5, 1.0),
}
#: Rules that look for the same kind of damage.
KINDS: dict[str, tuple[str, ...]] = {
    "symbols": ("symbols", "few_letters"),
    "repetition": ("repeated_windows", "repeated_lines", "same_words"),
    "shouting": ("capitals", "exclamations"),
    "fragment": ("long_words", "short_text"),
}
#: Where expectation-maximisation starts: share of good texts, rates of alarms among votes on texts with and without the
#: damage; the rates are also the means of their priors, which weigh as much as this share of all texts.
START_GOOD, START_ON_BAD, START_ON_GOOD, PRIOR_SHARE = 0.85, 0.8, 0.01, 0.05
ROUNDS = 100


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The counts that rules look at, one row per input row; a null text counts as empty."""
    text = text_or_empty(text_column)
    rows = docs.select(F.col(id_column).alias(id_column), text.alias("text"))
    rows = rows.select(id_column, "text", split_words(F.col("text"), SPACE).alias("words"),
                       F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    length = F.length("text")
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    rows = rows.select(
        id_column, F.size("words").cast("long").alias("n_words"),
        F.length(_without(F.col("text"), "\x20\x09\x0a\x0b\x0c\x0d")).cast("long").alias("word_chars"),
        (length - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("words")).alias("n_distinct_words"),
        (length - F.length(_without(F.col("text"), "!"))).alias("n_exclamations"),
        letters.alias("n_letters"), F.length(F.regexp_replace("text", r"\P{Lu}+", "")).alias("n_capitals"),
        hash_each(F.col("words")).alias("window_hashes"))
    rows = doubled(rows, "window_hashes", REPEAT_WINDOW, lambda a, b: F.xxhash64(a, b))
    repeated = F.size(F.array_distinct("window_hashes")) < F.size("window_hashes")
    order = F.sort_array(F.transform("window_hashes", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.withColumn("window_order", F.when(repeated, order))
    twins = F.expr("""
        transform(filter(transform(window_order, (x, i) -> struct(x.i AS at,
                    x.g <=> get(window_order, i + 1).g OR (i > 0 AND x.g = get(window_order, greatest(i - 1, 0)).g) AS twin)),
                  y -> y.twin), y -> y.at)""")
    rows = rows.withColumn("starts", F.when(F.col("window_order").isNotNull(), F.sort_array(twins)))
    covered = F.expr(f"""
        aggregate(transform(starts, (s, i) -> least({REPEAT_WINDOW}, coalesce(get(starts, i + 1) - s, {REPEAT_WINDOW}))),
                  0L, (total, n) -> total + n)""")
    return rows.withColumn("n_repeat_words", F.when(F.col("starts").isNotNull(), covered).otherwise(F.lit(0)).cast("long")) \
        .drop("window_hashes", "window_order", "starts")


def votes(rows: DataFrame, rules: dict[str, tuple[str, float, float]]) -> DataFrame:
    """One digit for each rule: 0 bad, 1 no vote, 2 good. A text without words gets no votes but the alarms."""
    digits = []
    for expression, good, bad in rules.values():
        value = F.expr(expression)
        digits.append(F.when(value >= bad, "0").when(value < good, "2").otherwise("1"))
    return rows.withColumn("pattern", F.concat(*digits))


def together(pattern: str, groups: list[list[int]]) -> str:
    """The vote of each group of rules: bad if one says bad, good if all say good, else none."""
    out = ""
    for group in groups:
        digits = {pattern[i] for i in group}
        out += "0" if "0" in digits else "2" if digits == {"2"} else "1"
    return out


def fit_rules(patterns: list[tuple[str, int]], n_rules: int, rounds: int = ROUNDS,
              kinds: list[tuple[int, ...]] | None = None) -> tuple[float, list, dict[str, float]]:
    """Expectation-maximisation over counted vote patterns.

    ``kinds`` lists the rules that alarm on each kind of damage; by default there is one kind, which all rules look for.
    Returns the share of good texts, per rule the rates of alarms on texts (with, without) what it looks for, and the
    posterior probability of good per pattern. Patterns are taken in order, so equal counts give equal results.
    """
    patterns = sorted(patterns)
    kinds = kinds or [tuple(range(n_rules))]
    looks = [[k for k, rules in enumerate(kinds) if r in rules] for r in range(n_rules)]
    every = sum(n for _, n in patterns)
    prior = max(1.0, PRIOR_SHARE * every)
    shares = [START_GOOD] + [(1 - START_GOOD) / len(kinds)] * len(kinds)
    rates = [(START_ON_BAD, START_ON_GOOD)] * n_rules

    def posterior(pattern: str) -> list[float]:
        """Probability of good, and of each kind of damage."""
        plain = [0.0 if d == "1" else math.log(on_good if d == "0" else 1 - on_good)
                 for d, (_, on_good) in zip(pattern, rates, strict=True)]
        logs = [math.log(shares[0]) + sum(plain)]
        for share, rules in zip(shares[1:], kinds, strict=True):
            moved = sum(0.0 if pattern[r] == "1" else math.log(rates[r][0] if pattern[r] == "0" else 1 - rates[r][0]) - plain[r] for r in rules)
            logs.append(math.log(share) + sum(plain) + moved)
        most = max(logs)
        weights = [math.exp(x - most) for x in logs]
        return [w / sum(weights) for w in weights]

    for _ in range(rounds):
        totals = list(shares)  # one text in the proportions so far keeps every share above zero
        alarms = [[START_ON_BAD * prior, START_ON_GOOD * prior] for _ in range(n_rules)]
        voted = [[prior, prior] for _ in range(n_rules)]
        for pattern, n in patterns:
            found = posterior(pattern)
            totals = [t + n * p for t, p in zip(totals, found, strict=True)]
            for r, digit in enumerate(pattern):
                if digit != "1":
                    bad = sum(found[k + 1] for k in looks[r])
                    for side, weight in enumerate((n * bad, n * (1 - bad))):
                        voted[r][side] += weight
                        alarms[r][side] += weight if digit == "0" else 0.0
        shares = [t / sum(totals) for t in totals]
        # an alarm is at least as frequent on what the rule looks for as elsewhere
        rates = [(max(a[0] / v[0], a[1] / v[1]), a[1] / v[1]) for a, v in zip(alarms, voted, strict=True)]
    return shares[0], rates, {p: posterior(p)[0] for p, _ in patterns}


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            rules: dict[str, tuple[str, float, float]] | None = None, kinds: dict[str, tuple[str, ...]] | None = None,
            least_good: float = 0.5) -> DataFrame:
    """Per row: the measures, ``base_failed``, the votes, ``p_good`` and ``kept``.

    ``base_failed`` (fewer than 20 words, or over 30 % of the words in repeated windows) always rejects; else the
    posterior decides. ``kinds`` names the rules that look for the same damage; rules that none names are a kind each. A
    null or empty text has no words and fails. Repeated rows are judged alike, each on its own;
    an empty table gives no rows; other columns stay aside.
    """
    kinds = kinds if kinds is not None else KINDS if rules is None else {}
    rules = rules or RULES
    names = list(rules)
    groups = [[names.index(r) for r in kind] for kind in kinds.values()]
    groups += [[i] for i, r in enumerate(names) if not any(r in kind for kind in kinds.values())]
    rows = cut_lineage(votes(measures(docs, id_column, text_column), rules), "votes")
    counted = rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()
    grouped: dict[str, int] = {}
    for r in counted:
        vote = together(r["pattern"], groups)
        grouped[vote] = grouped.get(vote, 0) + r["n"]
    _, _, posterior = fit_rules(list(grouped.items()), len(groups), kinds=[(i,) for i in range(len(groups))])
    found = docs.sparkSession.createDataFrame(
        sorted((r["pattern"], posterior[together(r["pattern"], groups)]) for r in counted), "pattern string, p_good double")
    # one row for each vote pattern, at most 3 ** rules
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.join(F.broadcast(found), "pattern", "left").withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= least_good))


@query("op3_weak_quality_rules")
def op3_weak_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
