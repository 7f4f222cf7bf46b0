"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates how often each is right,
and the posterior probability of good quality takes the place of all-must-pass filtering. DataFrame functions only.

Most bad texts break one rule only and look good to the others, so two classes would not do: the votes that go together
would make up the bad one. There is one class of good texts, and for each rule one of texts that are bad for its reason;
every class has a distribution of its own over every rule's votes, abstentions included.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words

SYMBOLS = "#*$%&|<>"
ROUNDS, KEEP_AT = 12, 0.5
#: A vote is one of: bad, rather bad, abstention, good.
BAD, RATHER_BAD, ABSTAIN, GOOD = range(4)
#: Prior knowledge: how a rule votes on texts that are not bad for its reason, and on those that are, and the share of bad
#: texts. It weighs as much as PRIOR_TEXTS texts for each class, so the corpus soon outweighs it.
ELSEWHERE, OWN = (0.001, 0.02, 0.079, 0.9), (0.7, 0.2, 0.05, 0.05)
BAD_SHARE, PRIOR_TEXTS = 0.15, 20.0


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the counts n_lines (lines with a word),
    n_upper, n_bangs, n_stops that the rules also use. Everything is computed inside the row: nothing is shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    with_lines = split.withColumns({
        "lines": lines,
        # windows of three words, as text (words hold no space), beside their place; equal windows end up side by side
        "grams": F.expr("""if(size(w) < 3, cast(array() as array<struct<g:string,i:int>>),
            sort_array(transform(sequence(0, size(w) - 3), i -> named_struct('g', concat_ws(' ', w[i], w[i + 1], w[i + 2]), 'i', i))))"""),
    })
    repeated = with_lines.withColumn("at", F.expr("""sort_array(transform(
        filter(transform(grams, (x, j) -> named_struct('i', x.i, 'again',
            (j > 0 and grams[greatest(j - 1, 0)].g = x.g) or (j < size(grams) - 1 and grams[least(j + 1, size(grams) - 1)].g = x.g))),
          x -> x.again), x -> x.i))"""))
    covered = "aggregate(at, named_struct('last', -3, 'n', 0L), (acc, i) -> named_struct('last', i, 'n', acc.n + least(3, i - acc.last)), acc -> acc.n)"
    less = lambda pattern: (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")
    dropped = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    return repeated.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        dropped(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        less("\\p{Lu}").alias("n_upper"),
        dropped("!").alias("n_bangs"),
        dropped(".").alias("n_stops"),
    )


#: Each rule's conditions for the votes bad, rather bad and good, the first that holds, in SQL that both Spark and an ANSI
#: engine read; integers only.
RULES = {
    "v_symbols": ("10 * n_symbols > 3 * n_words", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "v_repeats": ("100 * n_repeat_words > 40 * n_words", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 20 * n_words"),
    "v_lines": ("n_dup_lines > 1 and 10 * n_dup_lines > 3 * n_lines", "n_dup_lines > 1 and 10 * n_dup_lines > 2 * n_lines", "n_lines > 1 and 10 * n_dup_lines <= n_lines"),
    "v_shout": (
        "10 * n_upper > 4 * word_chars or 10 * n_bangs > 2 * n_words", "100 * n_upper > 20 * word_chars or 100 * n_bangs > 5 * n_words",
        "100 * n_upper <= 15 * word_chars and 100 * n_bangs <= n_words"),
    "v_length": ("word_chars < 3 * n_words or word_chars > 12 * n_words", "2 * word_chars < 7 * n_words or word_chars > 9 * n_words", "word_chars >= 4 * n_words and word_chars <= 8 * n_words"),
    "v_stops": ("200 * n_stops < n_words", "60 * n_stops < n_words", "40 * n_stops >= n_words and 4 * n_stops <= n_words"),
}


def votes(counts: DataFrame, rules: dict[str, tuple[str, str, str]] = RULES) -> DataFrame:
    """Add one column per rule: BAD, RATHER_BAD, ABSTAIN (always for a text without words) or GOOD."""
    def vote(bad: str, rather: str, good: str) -> Column:
        return F.when(F.col("n_words") == 0, ABSTAIN).when(F.expr(bad), BAD).when(F.expr(rather), RATHER_BAD).when(F.expr(good), GOOD).otherwise(ABSTAIN)

    return counts.withColumns({k: vote(*conditions) for k, conditions in rules.items()})


class Model(NamedTuple):
    """shares[c]: of class c (0: good; 1, 2, ...: bad for the reason of that rule). chances[c][j][v]: that rule j votes v on
    a text of class c. Accuracies follow: chances[0][j][BAD] is how often a bad vote of rule j falls on a good text."""

    shares: list[float]
    chances: list[list[list[float]]]


def prior_model(n_rules: int) -> Model:
    shares = [1 - BAD_SHARE, *[BAD_SHARE / n_rules] * n_rules]
    return Model(shares, [[list(OWN if c == j + 1 else ELSEWHERE) for j in range(n_rules)] for c in range(n_rules + 1)])


def _joint(names: Sequence[str], model: Model) -> Column:
    """For each class, the probability of the class and of the row's votes."""
    n = len(names)
    shares = F.array(*map(F.lit, model.shares))
    chances = F.array(*[F.lit(x) for by_rule in model.chances for by_vote in by_rule for x in by_vote])

    def one(c: Column) -> Column:
        product = F.get(shares, c)
        for j, k in enumerate(names):
            product = product * F.get(chances, c * (4 * n) + 4 * j + F.col(k))
        return product

    return F.transform(F.sequence(F.lit(0), F.lit(n)), one)


def _posteriors(names: Sequence[str], model: Model) -> Column:
    """The probability of each class given the row's votes."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    # within a list of one, so that the joint probabilities have a name
    return F.transform(F.array(_joint(names, model)), lambda x: F.transform(x, lambda v: v / total(x)))[0]


def fit(voted: DataFrame, names: Sequence[str], rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over the votes.

    The texts are counted by pattern of votes first (at most 4^rules rows, whatever the input), so a round is one sum
    over that table by class, rule and vote; only these sums come to the driver.
    """
    patterns = cut(voted.groupBy(*names).agg(F.count("*").cast("double").alias("n")), "patterns")
    prior = model = prior_model(len(names))
    for _ in range(rounds):
        weighed = patterns.select("n", F.array(*names).alias("v"), F.posexplode(_posteriors(names, model)).alias("c", "p"))
        sums = weighed.select("c", (F.col("n") * F.col("p")).alias("w"), F.posexplode("v").alias("j", "v")).groupBy("c", "j", "v").agg(F.sum("w").alias("w")).collect()
        if not sums:
            break
        got = {(r["c"], r["j"], r["v"]): r["w"] for r in sums}
        size = [sum(got.get((c, 0, v), 0.0) for v in range(4)) for c in range(len(names) + 1)]
        shares = [(size[c] + PRIOR_TEXTS * p) / (sum(size) + PRIOR_TEXTS) for c, p in enumerate(prior.shares)]
        chances = [[[(got.get((c, j, v), 0.0) + PRIOR_TEXTS * p) / (size[c] + PRIOR_TEXTS) for v, p in enumerate(by_vote)] for j, by_vote in enumerate(by_rule)] for c, by_rule in enumerate(prior.chances)]
        model = Model(shares, chances)
    return model


def judge(docs: DataFrame, rules: dict[str, tuple[str, str, str]] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, base_failed, posterior (of good quality), kept, and the votes.

    Null and empty texts have no words, all rules abstain, and base_failed holds (fewer than 50 words). Repeated rows
    are counted and returned as they are; an empty table gives an empty result; other columns are dropped.
    """
    names = list(rules)
    voted = cut(votes(base_counts(docs), rules), "votes")
    model = fit(voted, names, rounds)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("posterior", _posteriors(names, model)[0]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= KEEP_AT)).alias("kept"), "posterior", *names,
    )
