"""Quality rules by weak supervision, in DataFrame functions alone.

Each rule votes good (+1), bad (-1) or abstains (0). Expectation-maximisation over the counts of the vote patterns (at
most 3 to the number of rules, whatever the table's size) estimates how often a rule's vote says "good" among good and
among bad documents, and the share of good ones. The posterior probability of "good" then decides, so that one rule's
complaint does not remove a document the others vouch for.

Jobs: one map over the texts gives the features, which are stored; one pre-aggregated count of vote patterns; one map
that adds the posterior. Nothing is shuffled but the pattern counts.

Defined results: null or empty text has zero words, fails the base rules and is not kept; texts of white space too;
repeated rows get equal results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.shared import documents, stored

#: White space that separates words, as characters.
SPACE = " \t\n\x0b\x0c\r"
#: Words in a window that counts as repeated.
WINDOW = 8
#: A document is good if its posterior is at least this.
KEEP = 0.5
#: Expectation-maximisation stops after so many rounds, or once the log odds move less than the tolerance.
ROUNDS, TOLERANCE = 200, 1e-9
#: Where the estimate starts: a rule that votes says "good" of so many good and of so many bad documents. Most faults
#: of a bad document are seen by few rules, so a vote for it says little and a vote against it much.
SAYS_GOOD_OF_GOOD, SAYS_GOOD_OF_BAD = 0.99, 0.75
#: The same rates count as so many votes beside those of the data.
PRIOR_VOTES = 100.0


@dataclass(frozen=True)
class Rule:
    """``good`` and ``bad`` are SQL conditions over the features; where neither holds the rule abstains."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0).alias(self.name)


RULES = (
    Rule("symbols", "n_symbols * 50 <= n_words", "n_symbols * 5 > n_words"),
    Rule("letters", "n_letters * 100 >= word_chars * 93", "n_letters * 10 < word_chars * 9"),
    Rule("shouting", "n_upper * 6 <= n_letters", "n_upper * 2 > n_letters"),
    Rule("exclaiming", "n_marks * 50 <= n_words", "n_marks * 5 > n_words"),
    Rule("repeated_lines", "n_dup_lines * 20 <= n_lines", "n_dup_lines * 4 > n_lines"),
    Rule("repeated_words", "n_repeat_words * 20 <= n_words", "n_repeat_words * 5 > n_words"),
    Rule("length", "n_words >= 40", "n_words < 20"),
)


def _without(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that the pattern matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _joined_with(array: str, k: int):
    return lambda x, i: F.xxhash64(x, F.get(array, i + k))


def features(docs: DataFrame) -> DataFrame:
    """Counts of every whole text. The windows' hashes come by doubling: of 2, 4 and then 8 words."""
    text = F.coalesce("text", F.lit(""))
    df = documents(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    df = df.select(
        "doc_id",
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0).alias("lines"),
        _without(F.col("text"), r"[#*$%&|<>]+").alias("n_symbols"),
        _without(F.col("text"), r"\p{Lu}+").alias("n_upper"),
        _without(F.col("text"), r"[\p{L}\p{N}]+").alias("n_letters"),
        _without(F.col("text"), r"[!?]+").alias("n_marks"),
    )
    counts = ("doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_letters", "n_marks", "n_lines", "n_dup_lines")
    df = df.select(
        "doc_id",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        "n_symbols", "n_upper", "n_letters", "n_marks",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("words") > WINDOW, F.transform("words", lambda w: F.xxhash64(w))).alias("h"),
    )
    for k in (1, 2, 4):
        df = df.select(*counts, F.transform("h", _joined_with("h", k)).alias("h"))
    df = df.select(*counts, F.slice("h", 1, F.col("n_words") - (WINDOW - 1)).alias("h"))
    df = df.select(*counts, F.when(F.size(F.array_distinct("h")) < F.size("h"), F.col("h")).alias("h"))
    df = df.select(*counts, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))).alias("s"))
    same = lambda x, i, k: F.coalesce(F.get("s", i + k)["h"] == x["h"], F.lit(False))
    twice = F.filter("s", lambda x, i: same(x, i, -1) | same(x, i, 1))
    df = df.select(*counts, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at"))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("n")),
        lambda a: a["n"],
    )
    longs = [F.col(c).cast("long").alias(c) for c in counts[1:]]
    return df.select("doc_id", *longs, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[float, float]]]:
    """(log odds of the prior, for each rule the log odds that a good and a bad vote add) from counted vote patterns."""
    rules = len(patterns[0][0]) if patterns else 0
    tell, lie = SAYS_GOOD_OF_GOOD, SAYS_GOOD_OF_BAD
    base, odds = math.log(4.0), [(math.log(tell / lie), math.log((1 - tell) / (1 - lie)))] * rules
    start = [PRIOR_VOTES * x for x in (tell, 1 - tell, lie, 1 - lie)]  # good|good, bad|good, good|bad, bad|bad
    for _ in range(ROUNDS):
        good = bad = 1.0
        says = [list(start) for _ in range(rules)]
        for votes, n in patterns:
            logit = base + sum(odds[j][v < 0] for j, v in enumerate(votes) if v)
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, logit))))
            good, bad = good + n * p, bad + n * (1 - p)
            for j, v in enumerate(votes):
                if v:
                    says[j][v < 0] += n * p
                    says[j][2 + (v < 0)] += n * (1 - p)
        new_base = math.log(good / bad)
        new = []
        for gg, bg, gb, bb in says:
            tell, lie = gg / (gg + bg), gb / (gb + bb)
            new.append((math.log(tell / lie), math.log((1 - tell) / (1 - lie))))
        moved = max([abs(new_base - base), *(abs(a - b) for x, y in zip(new, odds, strict=True) for a, b in zip(x, y, strict=True))])
        base, odds = new_base, new
        if moved < TOLERANCE:
            break
    return base, odds


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Features, base_failed, kept, votes and posterior of every row of ``docs`` (``doc_id``, ``text``)."""
    rows = stored(features(docs), "quality-features").select("*", *(r.vote() for r in rules))
    counted = rows.groupBy(*(r.name for r in rules)).count().collect()  # at most 3 ** len(rules) rows
    base, odds = estimate([(tuple(x[: len(rules)]), x["count"]) for x in sorted(counted)])
    logit = F.lit(base)
    for rule, (good, bad) in zip(rules, odds, strict=False):
        logit = logit + F.when(F.col(rule.name) > 0, good).when(F.col(rule.name) < 0, bad).otherwise(0.0)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "posterior": 1 / (1 + F.exp(-logit))})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))
