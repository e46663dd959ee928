"""Quality rules as a short-circuit cascade (DataFrame functions only).

A rule is a declared expression that is true for a document to reject. A
document is kept if no rule rejects it, so the order of the rules never
changes the verdict, only the work: they are nested (``CASE``), and a rule is
evaluated only for the documents that every rule before it let pass. The order
is chosen from a bounded sample (``SAMPLE_ROWS`` documents): each rule is timed
on it (cost) and its rejected share is counted (selectivity), and the rules run
by rejection per cost, best first.

The measures are computed per document with array functions:

* windows of ``WINDOW`` words are hashed (XXH64 over the words); a window hash
  seen twice in the text marks its words, first occurrence included. Only texts
  in which ``array_distinct`` finds fewer hashes than windows go on to the sort
  that lists the repeated positions, so the usual text costs one linear pass,
  and the worst one n log n;
* duplicate lines are lines with a word minus distinct lines with a word;
* stuttering is judged by the distinct words inside windows of ``STRETCH``
  words: over a whole text their share falls with its length alone.

Defined cases: a null text has no words and is rejected by the base rule;
texts of any length are measured whole; repeated rows get equal verdicts;
an empty table gives an empty result (the order is then the declared one).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlens.llm.common import WORD, filled, saved

WINDOW = 8
STRETCH = 100
SAMPLE_ROWS = 400
REPEATED = 4
# The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Rule:
    """``rejects(text, words)`` is a boolean column expression."""
    name: str
    rejects: Callable[[Column, Column], Column]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``: inside a
    higher-order function an expression would be evaluated per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def repeated_words(words: Column) -> Column:
    """Number of words inside windows that occur at least twice in the text."""
    n = F.size(words)

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                           lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def positions(h: Column) -> Column:
        """Sorted positions of the windows whose hash occurs more than once."""
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(pairs, lambda s: F.filter(s, lambda x, i: (
            (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        """Words under the windows at p: each adds what the next one leaves."""
        return F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x)

    counted = let(hashes(words), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(positions(h), covered)))
    return F.when(n < WINDOW, F.lit(0)).otherwise(counted)


def word_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def duplicate_lines(text: Column) -> Column:
    return let(word_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def stutters(words: Column) -> Column:
    """True if under 5% of the words are distinct in windows of ``STRETCH``
    words, on average. The windows lie side by side (the last one ends with the
    text), so a text of any length is measured whole and alike."""
    n = F.size(words)
    windows = F.ceil(n / STRETCH).cast("int")
    distinct = F.aggregate(
        F.sequence(F.lit(0), windows - 1), F.lit(0),
        lambda a, i: a + F.size(F.array_distinct(F.slice(words, F.least(i * STRETCH, n - STRETCH) + 1, STRETCH))))
    return F.when(n < STRETCH, F.lit(False)).otherwise(20 * distinct < STRETCH * windows)


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """The keys, the text, its words, and the base measures. ``array`` columns
    are written out by the projection once and reused by what follows."""
    t, w = F.col("__text"), F.col("__words")
    return (docs.select(*[F.col(f"`{k}`") for k in keys], filled(text).alias("__text"))
            .withColumn("__words", words_of(t))
            .withColumns({
                "__n_words": F.size(w).cast("long"),
                "__word_chars": F.length(F.concat_ws("", w)).cast("long"),
                "__n_symbols": count_of(t, SYMBOLS).cast("long"),
                "__n_dup_lines": duplicate_lines(t).cast("long"),
                "__n_repeat_words": repeated_words(w).cast("long"),
            }))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def default_rules() -> list[Rule]:
    """Written for prose."""
    def chars(w: Column) -> Column:
        return F.length(F.concat_ws("", w))

    return [
        Rule("too_few_words", lambda t, w: F.size(w) < 20),
        Rule("repeats_itself", lambda t, w: 100 * repeated_words(w) > 30 * F.size(w)),
        Rule("symbols_for_words", lambda t, w: 10 * count_of(t, SYMBOLS) > F.size(w)),
        Rule("lines_repeat", lambda t, w: let(
            word_lines(t), lambda x: F.size(x) > 2 * F.size(F.array_distinct(x)))),
        Rule("word_length", lambda t, w: (chars(w) < 2 * F.size(w)) | (chars(w) > 14 * F.size(w))),
        Rule("shouting", lambda t, w: 10 * F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")) > 4 * chars(w)),
        Rule("stuttering", lambda t, w: stutters(w)),
        Rule("exclaiming", lambda t, w: 5 * count_of(t, "!") > F.size(w)),
    ]


def sample_of(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``sample_rows`` texts with their words, drawn from all partitions
    (at most twice as many)."""
    rows = docs.count()
    drawn = docs.select(filled(text).alias("t"))
    if rows > sample_rows:
        drawn = drawn.sample(sample_rows / rows, seed=1).limit(2 * sample_rows)
    return saved(drawn.select("t", words_of(F.col("t")).alias("w")), "rule-sample")


def profiled(docs: DataFrame, rules: Sequence[Rule], text: str = "text",
             sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Cost (seconds beyond those of a rule that does nothing) and rejected
    share of each rule on a sample, every text ``REPEATED`` times over."""
    sample = sample_of(docs, text, sample_rows)
    rows = sample.count()
    many = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATED))))

    def timed(rejects: Column) -> tuple[float, int]:
        # the number of the copy keeps the rule from being evaluated once per text
        found = many.agg(F.count_if(rejects & (F.col("again") > 0)))
        seconds, hits = [], 0
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            hits = found.first()[0]
            seconds.append(time.perf_counter() - began)
        return min(seconds), hits

    idle, _ = timed((F.size("w") < 0) | (F.length("t") < 0))
    out = []
    for rule in rules:
        seconds, hits = timed(rule.rejects(F.col("t"), F.col("w")))
        out.append({"rule": rule, "cost": max(seconds - idle, 1e-4),
                    "rejected": hits / (rows * REPEATED) if rows else 0.0})
    return out


def ordered(profile: Sequence[dict]) -> list[Rule]:
    """By rejection per cost, best first; ties in declared order."""
    return [p["rule"] for p in sorted(profile, key=lambda p: -(p["rejected"] / max(p["cost"], 1e-9)))]


def rejected_by(rules: Sequence[Rule], text: Column, words: Column) -> Column:
    """Name of the first rule that rejects, else null; a later rule is not
    evaluated where an earlier one rejects."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(text, words), F.lit(rule.name)).otherwise(verdict)
    return verdict


def quality_report(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per document: the base measures and the verdict of the
    cascade."""
    rest = [r for r in rules or default_rules() if r.name not in ("too_few_words", "repeats_itself")]
    rest = ordered(profiled(docs, rest))
    m = measured(docs, "text", "doc_id")
    failed = base_failed(F.col("__n_words"), F.col("__n_repeat_words"))
    return m.select(
        "doc_id", *[F.col(f"__{c}").alias(c)
                    for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(
            rejected_by(rest, F.col("__text"), F.col("__words")).isNull()).alias("kept"))


def keep_good(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with the columns of ``docs``."""
    rules = ordered(profiled(docs, rules or default_rules(), text))
    t = filled(text)
    return docs.filter(let(words_of(t), lambda w: rejected_by(rules, t, w)).isNull())
