"""Quality rules that vote or abstain, weighed by expectation-maximisation, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipcurate.llm.common import free_name, materialize

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A word of letters, with quotes or hyphens inside and punctuation after it.
PLAIN_WORD = r"^[\p{L}\p{M}'’\-]+[.,;:!?]*$"
ENDED_LINE = "[.!?:;][\"'”’»)]*[ \\t\\r\\f\\x0B]*$"


@dataclass(frozen=True)
class Rule:
    """Votes: ``bad`` where that condition over the measures holds, else ``good`` where this one does; abstains elsewhere.
    Conditions are integer arithmetic in SQL over columns of ``text_measures``."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("word_length", "10 * word_chars < 25 * n_words OR word_chars > 10 * n_words", "word_chars >= 3 * n_words AND word_chars <= 7 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines", "20 * n_dup_lines <= n_lines"),
    Rule("repeated_words", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    Rule("capitals", "10 * n_upper > 3 * word_chars", "10 * n_upper <= word_chars"),
    Rule("words_with_letters", "10 * n_alpha_words < 8 * n_words", "10 * n_alpha_words >= 9 * n_words"),
    Rule("plain_words", "10 * n_plain_words < 6 * n_words", "10 * n_plain_words >= 8 * n_words"),
    Rule("ended_lines", "10 * n_ended_lines < n_lines", "10 * n_ended_lines >= 6 * n_lines"),
    Rule("digits", "10 * n_digits > 2 * word_chars", "20 * n_digits <= word_chars"),
)
BASE_FAILS = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Prior:
    """What is believed before counting, in pseudo-documents: how often a rule that votes on good text votes good, one that
    votes on bad text votes bad (each catches only its own kind), and the share of good texts."""

    right_on_good: tuple[float, float] = (0.97, 100.0)
    right_on_bad: tuple[float, float] = (0.4, 10.0)
    good: tuple[float, float] = (0.8, 10.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though lambdas in ``body`` use it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * 5), " "), "")


def repeated_words(words: Column) -> Column:
    """How many of the words lie in a window of three words that occurs twice or more, its first occurrence included.

    Windows are sorted, with a hash in front, so that equal ones are neighbours; the words themselves are compared."""

    def of(w: Column) -> Column:
        window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))
        same = lambda x, y: (x.h == y.h) & (x.a == y.a) & (x.b == y.b) & (x.c == y.c)
        twin = lambda s: lambda x, k: F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False))
        places = let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window)), lambda s: F.sort_array(F.transform(F.filter(s, twin(s)), lambda x: x.i)))
        step = lambda p: lambda s, k: s + F.when(k + 1 < F.size(p), F.least(F.lit(3), F.get(p, k + 1) - F.get(p, k))).otherwise(3)
        covered = lambda p: F.when(F.size(p) == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), step(p)))
        return F.when(F.size(w) < 4, 0).otherwise(let(places, covered))

    return let(words, of)


def text_measures(text: Column) -> dict[str, Column]:
    """Counts of a text, longs; null counts as empty. Lines are ``\\n``-split and hold a word."""
    t = F.coalesce(text, F.lit(""))
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    matching = lambda a, p: F.size(F.filter(a, lambda x: x.rlike(p)))
    counts = let(split_words(t), lambda w: F.struct(F.size(w).alias("n"), matching(w, r"\p{L}").alias("alpha"), matching(w, PLAIN_WORD).alias("plain"), repeated_words(w).alias("repeat")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"), matching(x, ENDED_LINE).alias("ended")))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {
        "__words": counts, "__lines": by_line, "word_chars": F.length(t) - without(SPACES), "n_symbols": without(SYMBOLS), "n_upper": without(letters), "n_digits": without("0123456789"),
    }


def measured(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_alpha_words,
    n_plain_words, n_ended_lines, n_digits)`` of every row."""
    raw = docs.select(*keep, *[c.alias(k) for k, c in text_measures(F.col(text)).items()])
    w, line = F.col("__words"), F.col("__lines")
    named = {
        "n_words": w["n"], "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"), "n_dup_lines": line["dup"], "n_repeat_words": w["repeat"], "n_lines": line["n"],
        "n_upper": F.col("n_upper"), "n_alpha_words": w["alpha"], "n_plain_words": w["plain"], "n_ended_lines": line["ended"], "n_digits": F.col("n_digits"),
    }
    return raw.select(*[c for c in raw.columns if c not in (*named, "__words", "__lines")], *[c.cast("long").alias(k) for k, c in named.items()])


def vote_column(rules: tuple[Rule, ...]) -> Column:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    return F.array(*[F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0) for r in rules])


def posterior(votes: Column, model: Column, rules: int) -> Column:
    """Probability that a text is good, by its votes: log-odds of the prior and of each vote add up."""

    def vote(s: Column, j: Column) -> Column:
        v, a, b = F.get(votes, j), F.get(model["right_on_good"], j), F.get(model["right_on_bad"], j)
        return s + F.when(v == 1, F.log(a / (1 - b))).when(v == -1, F.log((1 - a) / b)).otherwise(0.0)

    start = F.log(model["good"] / (1 - model["good"]))
    return 1 / (1 + F.exp(-F.aggregate(F.sequence(F.lit(0), F.lit(rules - 1)), start, vote)))


def fit(votes: DataFrame, rules: int, prior: Prior = Prior(), iterations: int = 30) -> DataFrame:
    """One row, ``model``: the share of good texts, and of each rule how often its vote is right on good and on bad texts.

    ``votes`` has a row a text and a column ``votes``. Texts are counted by pattern of votes, at most 3 ** rules, and the
    counts of all texts go through the rounds of expectation-maximisation as one array, in one expression. No texts: the
    prior."""
    if rules > 10:
        raise ValueError("at most ten rules: patterns of votes are gathered, 3 for each")
    j = F.sequence(F.lit(0), F.lit(rules - 1))
    counts = votes.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    table = counts.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    shape = lambda good, a, b: F.struct(good.alias("good"), a.alias("right_on_good"), b.alias("right_on_bad"))
    start = shape(F.lit(prior.good[0]), F.array_repeat(F.lit(prior.right_on_good[0]), rules), F.array_repeat(F.lit(prior.right_on_bad[0]), rules))

    def total(rated: Column, weight: Callable[[Column], Column]) -> Column:
        return F.aggregate(rated, F.lit(0.0), lambda s, x: s + weight(x))

    def share(rated: Column, weight: Callable[[Column], Column], vote: int, belief: tuple[float, float]) -> Callable[[Column], Column]:
        at, strength = belief
        voted = lambda k: total(rated, lambda x: F.when(F.get(x.votes, k) != 0, weight(x)).otherwise(0.0))
        right = lambda k: total(rated, lambda x: F.when(F.get(x.votes, k) == vote, weight(x)).otherwise(0.0))
        return lambda k: (right(k) + at * strength) / (voted(k) + strength)

    def again(model: Column, _: Column) -> Column:
        def maximise(rated: Column) -> Column:
            good, bad = (lambda x: x.n * x.p), (lambda x: x.n * (1 - x.p))
            at, strength = prior.good
            return shape(
                (total(rated, good) + at * strength) / (total(rated, lambda x: x.n) + strength),
                F.transform(j, share(rated, good, 1, prior.right_on_good)), F.transform(j, share(rated, bad, -1, prior.right_on_bad)),
            )

        rated = F.transform("patterns", lambda x: F.struct(x.votes.alias("votes"), x.n.alias("n"), posterior(x.votes, model, rules).alias("p")))
        return let(rated, maximise)

    return table.select(F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, again).alias("model"))


def judged(rows: DataFrame, model: DataFrame, rules: tuple[Rule, ...], least: float) -> DataFrame:
    """``rows`` with ``quality`` and ``kept``, by a model of one row."""
    both = rows.crossJoin(F.broadcast(model.select(F.col("model").alias("__model"))))
    quality = F.when(~F.col("base_failed"), posterior(F.col("votes"), F.col("__model"), len(rules)))
    return both.withColumn("quality", quality).withColumn("kept", F.coalesce(F.col("quality") >= least, F.lit(False))).drop("__model")


def judge_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, base_fails: str = BASE_FAILS, prior: Prior = Prior(), least: float = 0.5) -> DataFrame:
    """``(doc_id, measures, base_failed, votes, quality, kept)`` of every row.

    ``base_fails`` is a hard condition. Of the other texts each rule calls some good and some bad and abstains on the rest;
    how far each can be trusted on good and on bad texts is estimated from how the votes of all of them agree, without any
    labels, and ``quality`` is the probability of a good text that follows: no single rule has to be passed. ``kept``: not
    failed, and a quality of ``least`` or more. ``quality`` is null for failed texts.

    Null texts count as empty and fail; repeated rows and ids, null ones too, are judged row by row; other columns aren't read.
    Empty table: no rows. A text's windows of words are sorted in one row, about 200 bytes a word of that text.
    """
    rows = measured(docs, [F.col(doc_id).alias("doc_id")], text).withColumn("base_failed", F.expr(base_fails))
    rows = materialize(rows, "measures").withColumn("votes", vote_column(rules))
    return judged(rows, materialize(fit(rows.where("not base_failed"), len(rules), prior), "model"), rules, least)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base_fails: str = BASE_FAILS, prior: Prior = Prior(), least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns, with a struct column ``quality`` (or see ``free_name``): the probability and
    the votes by rule. Texts are measured once for the fit and once for the verdict, so nothing is joined or written."""
    rows = measured(docs, [F.struct(*docs.columns).alias("__record")], text).withColumn("base_failed", F.expr(base_fails)).withColumn("votes", vote_column(rules))
    model = materialize(fit(rows.where("not base_failed"), len(rules), prior), "model")
    votes = F.struct(*[F.get("votes", F.lit(k)).alias(r.name) for k, r in enumerate(rules)])
    kept = judged(rows, model, rules, least).where("kept")
    return kept.select("__record.*", F.struct(F.col("quality").alias("probability"), votes.alias("votes")).alias(free_name(docs, "quality")))
