"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them. DataFrame operations only.

Rules that measure the same thing are a family: their evidence is averaged, so that two of them don't count as two
witnesses. Accuracies are estimated on what the base rules let through, for that is what the verdict is about.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookloom.llm.shared import quoted, unused, without

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_symbol_runs", "n_short", "n_ends", "n_clean", "base_failed"]


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(x)`` with ``value`` evaluated once a row, also where the body reads it inside of lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more, in O(n log n) of the text's words."""

    def hashed(ws: Column) -> Column:
        return F.slice(F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2))), 1, F.greatest(F.size(ws) - 2, F.lit(0)))

    def twice(s: Column) -> Column:
        # s: (hash, place) in order; equal neighbours are repeated windows
        same = F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
        places = F.sort_array(F.transform(same, lambda e: e["i"]))
        return let(places, lambda p: F.aggregate(F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - v, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, twice))

    return let(let(words, hashed), count).cast("long")


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the base columns and those that rules read; a null or empty text has no words. No shuffle."""
    t = F.coalesce(quoted(text), F.lit(""))
    df = without(df, ADDED)
    (words,) = unused(df, "_words")
    out = df.withColumn(words, F.filter(F.split(t, SPACE), lambda w: w != ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeat_words(F.col(words)),
            "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
            "n_symbol_runs": F.regexp_count(t, F.lit(r"[#*$%&|<>]+")).cast("long"),
            "n_short": F.size(F.filter(words, lambda w: F.length(w) <= 3)).cast("long"),
            "n_clean": F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])\p{L}++[.,;:!?)]*+(?![^\x20\x09-\x0D])")).cast("long"),
            "n_ends": F.regexp_count(t, F.lit(r"[.!?](?=[\x20\x09-\x0D]|\z)")).cast("long"),
        }
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.drop(words)


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains."""
    c = F.col

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    def share(n: str) -> Column:
        return 100 * c(n) / F.greatest(c("n_words"), F.lit(1))

    return {
        "length": vote(c("n_words") < 20, c("n_words") >= 80),
        "symbols": vote(share("n_symbols") > 10, share("n_symbols") <= 2),
        "symbol_runs": vote(share("n_symbol_runs") > 5, share("n_symbol_runs") <= 1),
        "lines": vote(10 * c("n_dup_lines") > 3 * c("n_lines"), 10 * c("n_dup_lines") <= c("n_lines")),
        "repeats": vote(share("n_repeat_words") > 30, share("n_repeat_words") <= 10),
        "letters": vote((c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 10 * c("n_words")), c("word_chars").between(3.5 * c("n_words"), 8 * c("n_words"))),
        "capitals": vote(10 * c("n_upper") > 3 * c("word_chars"), 10 * c("n_upper") <= c("word_chars")),
        "short_words": vote(share("n_short") < 10, share("n_short") >= 20),
        "clean_words": vote(share("n_clean") < 60, share("n_clean") >= 80),
        "sentences": vote((share("n_ends") < 1) | (share("n_ends") > 30), share("n_ends").between(2, 20)),
    }


#: Rules that measure the same thing; each other rule is a family of its own.
FAMILIES = {"symbols": "symbols", "symbol_runs": "symbols", "lines": "repeats", "repeats": "repeats"}


@dataclass
class Accuracies:
    """bad: share of bad texts. false and hit: by rule, chances that its vote, if it votes, is bad for a good and a bad text."""

    bad: float = 0.1
    false: dict[str, float] = field(default_factory=dict)
    hit: dict[str, float] = field(default_factory=dict)

    def says(self, rule: str) -> tuple[float, float]:
        """Log odds of good that a bad and a good vote give."""
        f, h = self.false[rule], self.hit[rule]
        return math.log(f / h), math.log((1 - f) / (1 - h))


def families_of(names: Iterable[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name in names:
        out.setdefault(FAMILIES.get(name, name), []).append(name)
    return out


def posterior(votes: dict[str, Column], model: Accuracies) -> Column:
    """Probability of good, with families independent given the hidden label; a rule that abstains says nothing."""
    odds = F.lit(math.log((1 - model.bad) / model.bad))
    for family in families_of(votes).values():
        said = F.lit(0.0)
        for name in family:
            low, high = model.says(name)
            said = said + F.when(votes[name] == -1, low).when(votes[name] == 1, high).otherwise(0.0)
        heard = sum((F.abs(votes[n]) for n in family), F.lit(0))
        odds = odds + said / F.greatest(heard, F.lit(1))
    return 1 / (1 + F.exp(-odds))


def odds_of(pattern: tuple[int, ...], names: list[str], model: Accuracies) -> float:
    """Log odds of good of one pattern of votes, as in ``posterior``."""
    odds, at = math.log((1 - model.bad) / model.bad), {n: v for n, v in zip(names, pattern, strict=True)}
    for family in families_of(names).values():
        said = [model.says(n)[at[n] > 0] for n in family if at[n]]
        odds += sum(said) / max(1, len(said))
    return odds


def within(x: float, low: float, high: float) -> float:
    return min(high, max(low, x))


def estimate(voted: DataFrame, names: list[str], rounds: int = 100, weight: str = "n", most_false: float = 0.02) -> Accuracies:
    """Expectation-maximisation over vote patterns (columns ``names`` and their count): 3 ** rules rows at most.

    Each round computes expected votes of each rule on good and on bad texts. It starts at 0.1 bad, 0.01 false and 0.4
    hit. False votes stay within 0.001 and ``most_false``: a rule's bad vote is meant to be rare on good texts. Hits stay
    within 0.05 and 0.95, the share of bad within 0.001 and 0.5. Counts are smoothed by one vote.
    """
    patterns = [(tuple(r[n] for n in names), float(r[weight])) for r in voted.select(*names, weight).collect()]
    model = Accuracies(0.1, dict.fromkeys(names, min(0.01, most_false)), dict.fromkeys(names, 0.4))
    total = sum(n for _, n in patterns)
    if not total:
        return model
    for _ in range(rounds):
        good = [(v, n, 1 / (1 + math.exp(-within(odds_of(v, names, model), -500, 500)))) for v, n in patterns]
        false, hit = {}, {}
        for i, name in enumerate(names):
            on_good = sum(n * p for v, n, p in good if v[i])
            on_bad = sum(n * (1 - p) for v, n, p in good if v[i])
            false[name] = within((sum(n * p for v, n, p in good if v[i] < 0) + 0.01) / (on_good + 1), 0.001, most_false)
            hit[name] = within((sum(n * (1 - p) for v, n, p in good if v[i] < 0) + 0.4) / (on_bad + 1), 0.05, 0.95)
        after = Accuracies(within((sum(n * (1 - p) for _, n, p in good) + 0.1) / (total + 1), 0.001, 0.5), false, hit)
        moved = abs(after.bad - model.bad) + sum(abs(hit[n] - model.hit[n]) + abs(false[n] - model.false[n]) for n in names)
        model = after
        if moved < 1e-6:
            break
    return model


def judge(featured: DataFrame, least: float = 0.5) -> DataFrame:
    """Add probability and kept to a stored table with the columns of ``features``.

    kept: the posterior probability of good is ``least`` or more, and the base rules hold. Accuracies come from the votes
    of all rows that pass the base rules, counted by pattern before any shuffle. An empty table stays empty; repeated rows
    count as often as they occur. Columns named probability and kept are replaced.
    """
    votes = rules()
    names = list(votes)
    passed = featured.where(~F.col("base_failed"))
    model = estimate(passed.select(*[v.alias(n) for n, v in votes.items()]).groupBy(*names).agg(F.count(F.lit(1)).alias("n")), names)
    out = without(featured, ["probability", "kept"]).withColumn("probability", posterior(votes, model))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= least))
