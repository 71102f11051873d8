"""Weak supervision for text quality: rules vote or abstain, expectation-maximisation weighs them.

DataFrame functions only. Every rule says good (1), bad (-1) or nothing (0). What the corpus has to
say about the rules is the number of documents per pattern of votes: at most 3 ** len(RULES) rows,
whatever the size of the corpus; the iteration runs on those. A document is good with the posterior
probability that its votes give.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .arrays import let

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct",
            "n_upper", "n_marks", "n_runs"]


def _repeated(words: Column) -> Column:
    """Words inside any WINDOW-word window that occurs at least twice in ``words``."""
    def hashed(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def counted(h):
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s):
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(F.get(s, k)["h"] == F.get(s, k + 1)["h"], F.lit(False))
                          | F.coalesce(F.get(s, k)["h"] == F.get(s, F.when(k > 0, k - 1).otherwise(F.size(s)))["h"], F.lit(False)))
            return F.sort_array(F.transform(at, lambda k: F.get(s, k)["i"]))
        covered = let(let(placed, twins), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered)
    return F.when(F.size(words) >= WINDOW, let(let(words, hashed), counted)).otherwise(0)


def features(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` of every row and FEATURES of its text, counted over the whole text; null has none."""
    text = F.coalesce("text", F.lit(""))
    counted = docs.select(*carry, text.alias("in_text"), F.filter(F.split(text, BLANK + "+"), lambda w: w != "").alias("in_words"),
                          F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("in_lines"))
    words, lines, t = F.col("in_words"), F.col("in_lines"), F.col("in_text")

    def without(characters):
        return F.length(t) - F.length(F.translate(t, characters, ""))
    values = {
        "n_words": F.size(words), "word_chars": F.length(F.translate(t, " \t\n\x0b\f\r", "")), "n_symbols": without(SYMBOLS),
        "n_lines": F.size(lines), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeated(words), "n_distinct": F.size(F.array_distinct(words)),
        "n_upper": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", "")), "n_marks": without("!?|"),
        "n_runs": F.regexp_count(t, F.lit(r"([#*$%&|<>!?~=_])\1++"))}
    return counted.select(*carry, *[values[f].cast("long").alias(f) for f in FEATURES])


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes as expressions over FEATURES. A text without words gets no vote but that on its length."""
    n, some = F.col("n_words"), F.col("n_words") >= 10
    c = {f: F.col(f) for f in FEATURES}
    return {
        "length": _vote(n >= 25, n < 10),
        "symbols": _vote(some & (c["n_symbols"] * 50 <= n), some & (c["n_symbols"] * 10 > n)),
        "repeats": _vote(some & (c["n_repeat_words"] * 20 <= n), some & (c["n_repeat_words"] * 5 > n)),
        "lines": _vote((c["n_lines"] >= 3) & (c["n_dup_lines"] == 0), c["n_dup_lines"] * 2 > c["n_lines"]),
        "word_length": _vote(some & c["word_chars"].between(n * 3, n * 9), some & ~c["word_chars"].between(n * 2, n * 12)),
        "variety": _vote(some & (c["n_distinct"] * 4 >= n), some & (n >= 50) & (c["n_distinct"] * 20 < n)),
        "capitals": _vote(some & (c["n_upper"] * 8 <= c["word_chars"]), some & (c["n_upper"] * 2 > c["word_chars"])),
        "marks": _vote(some & (c["n_marks"] * 25 <= n), some & (c["n_marks"] * 5 > n)),
        "runs": _vote(some & (c["n_runs"] * 50 <= n), some & (c["n_runs"] * 10 > n)),
    }


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[float, list[tuple[float, float]]]:
    """Prior of good, and per rule its two accuracies: how often it says good of good documents and bad of
    bad ones, when it votes; by expectation-maximisation over counts of vote patterns.

    Rules that nearly always say good prove little by saying so, and much by saying bad; hence the two.
    Whether a rule abstains tells nothing, and rules are independent given the class. To begin with, a
    document is good with 0.9 if no rule calls it bad, with 0.1 if more rules do than don't, else with
    0.4. Accuracies of a rule always sum to more than 1, so that good keeps meaning good. Patterns
    are summed in order, so reruns agree. No patterns: no rules are known.
    """
    rows = sorted(patterns.items())
    if not rows:
        return 0.5, []
    size = len(rows[0][0])
    believed = [0.9 if min(p) >= 0 else (0.1 if sum(p) < 0 else 0.4) for p, _ in rows]
    prior, right = 0.5, [(0.0, 0.0)] * size
    for _ in range(rounds):
        total = sum(n for _, n in rows)
        prior = min(0.98, max(0.02, sum(n * p for (_, n), p in zip(rows, believed)) / total))
        new = []
        for j in range(size):
            tally = {(c, v): 1.0 if c == v else 0.25 for c in (1, -1) for v in (1, -1)}
            for (pattern, n), p in zip(rows, believed):
                if pattern[j]:
                    tally[1, pattern[j]] += n * p
                    tally[-1, pattern[j]] += n * (1 - p)
            good = min(0.999, max(0.5, tally[1, 1] / (tally[1, 1] + tally[1, -1])))
            bad = min(0.999, max(1.01 - good, tally[-1, -1] / (tally[-1, -1] + tally[-1, 1])))
            new.append((good, bad))
        moved = max(abs(x - y) for a, b in zip(new, right) for x, y in zip(a, b))
        right = new
        believed = [posterior(p, prior, right) for p, _ in rows]
        if moved < 1e-9:
            break
    return prior, right


def weights(accuracies: tuple[float, float]) -> tuple[float, float]:
    """Log-odds that a vote for good and a vote for bad add."""
    good, bad = accuracies
    return math.log(good / (1 - bad)), math.log((1 - good) / bad)


def posterior(pattern, prior: float, right: list[tuple[float, float]]) -> float:
    x = math.log(prior / (1 - prior))
    for v, a in zip(pattern, right):
        if v:
            x += weights(a)[0 if v > 0 else 1]
    return 1 / (1 + math.exp(-x))


def score_quality(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (text and any others): ``carry`` (default doc_id), FEATURES, ``votes``,
    ``quality`` (posterior probability of good), ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 10 words, or more than a fifth of the words in repeated windows; so a
    null, empty or blank text fails. ``kept``: not failed and quality of at least 0.5. Repeated rows
    are judged alike; an empty table gives no rows.
    """
    carry = ["doc_id"] if carry is None else carry
    made = features(docs, carry)
    made = made.withColumn("votes", F.array(*[v.cast("int") for v in rules().values()]))
    made = materialise(made, "quality-votes")
    patterns = {tuple(r.votes): r.n for r in made.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior, right = fit(patterns)
    logit = F.lit(math.log(prior / (1 - prior)))
    for j, accuracies in enumerate(right):
        for_good, for_bad = weights(accuracies)
        vote = F.get("votes", F.lit(j))
        logit = logit + F.when(vote == 1, for_good).when(vote == -1, for_bad).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return made.withColumn("quality", 1 / (1 + F.exp(-logit))).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
