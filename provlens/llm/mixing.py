"""Mixing sources to target weights.

Words are summed per source, a target is set for each source, and
``rate = target / size`` says how often its documents are repeated: every
document is emitted ``floor(rate)`` times, plus one more time if a hash-seeded
Bernoulli draw with probability ``rate - floor(rate)`` succeeds. The draw
depends only on the seed and the document, so a rerun, a retried task or a
different partitioning gives the same mix.

A source with few or very unequal documents could miss its target by chance.
Therefore each document's hash gives ``TURNS`` draws (the hash plus a fixed
step for each turn, modulo one, so each is uniform), the words each turn would
take are summed per source, and every source uses the turn that comes nearest
to its target. With ``turns=1`` there is one plain draw: the chance of a copy is
then exactly the fraction, and sources are as near to their targets as it falls.

Targets: a source asks for its weight's part of all words, but no more than
``max_rate`` times its own; what is cut off is shared out again by weight until
no source is above its limit. That is ``target = min(max_rate * size,
weight * level)`` with one common ``level``, found by recomputing the level
from the sources not yet at their limit until none is added (each round is one
aggregate over the table of sources; the driver holds two numbers).

Defined cases: a null text has size 0; null is a source of its own, ordered
last; a source without words has target 0 and its documents are emitted once
(rate 1), as there is nothing to weigh; equal ``doc_id`` values draw alike,
and a document without ``doc_id`` draws by its text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlens.llm.common import filled, n_words, saved, shuffle_width

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = 20240229
TURNS = 32
RANGE = 1 << 52
STEP = 2783386121099911  # about RANGE times the golden ratio's fraction: turns spread evenly


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, source_size): one row per source; partial sums before the
    shuffle, so a source with a third of all rows costs a row per task."""
    return (docs.select(F.col(source).alias("source"), n_words(filled(text)).alias("n"))
            .groupBy("source").agg(F.sum("n").alias("source_size")))


def ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank``, the 0-based position by source (code point order, null
    last). Sorted by range partitions; only one count per partition passes
    through a single task."""
    spark = sources.sparkSession
    order = F.col("source").asc_nulls_last()
    placed = saved(sources.repartitionByRange(shuffle_width(spark), order)
                   .withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("part").count()
              .select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return (placed.withColumn("i", inside).join(F.broadcast(starts), "part")  # a row per partition
            .select("source", "source_size", (F.col("start") + F.col("i") - 1).alias("rank")))


def above_limit(words: int, share: int, max_rate: int) -> Column:
    """weight * words / share > max_rate * source_size, in whole numbers that
    neither round nor overflow."""
    def whole(c: Column, digits: int) -> Column:
        return c.cast(f"decimal({digits},0)")
    return (whole(F.col("weight"), 6) * whole(F.lit(words), 30)
            > whole(F.col("source_size") * max_rate, 20) * whole(F.lit(share), 16))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size)."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = saved(ranked(sources).withColumn("weight", weight.cast("long")), "weights")
    limit = F.col("source_size") * max_rate
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    words, share, level = total, weighed.agg(F.sum("weight")).first()[0] or 0, (0, 1)
    while share:
        level = (words, share)
        # a source is at its limit when weight * words / share is above it (whole numbers: no rounding)
        at_limit = above_limit(words, share, max_rate)
        row = weighed.agg(F.sum(F.when(at_limit, limit)).alias("full"),
                          F.sum(F.when(~at_limit, F.col("weight"))).alias("rest")).first()
        now = (total - (row["full"] or 0), row["rest"] or 0)
        if now == level:
            break
        words, share = now
    words, share = level
    target = F.when(above_limit(words, share, max_rate), limit.cast("double")).otherwise(
        (F.col("weight") * F.lit(words)).cast("double") / F.lit(float(share)))
    return weighed.select("source", "source_size", "weight", target.alias("target"))


def drawn_hash(doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> Column:
    """The first 52 bits of an MD5 hash of seed and document."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.md5(filled(text))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("long")


def succeeds(hashed: Column, turn: Column, probability: Column) -> Column:
    """The Bernoulli draw of a turn."""
    return ((hashed + turn * F.lit(STEP)) % F.lit(RANGE)).cast("double") < probability * F.lit(float(RANGE))


def copies(docs: DataFrame, target_table: DataFrame, source: str = "source", doc_id: str = "doc_id",
           text: str = "text", seed: int = SEED, turns: int = TURNS) -> DataFrame:
    """``docs`` with ``__size``, ``__source_size``, ``__target`` and
    ``__copies``. The table of sources is joined by hash (with AQE splitting a
    hot source); Spark broadcasts it only below its own size threshold."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    rates = saved(target_table.withColumn("rate", rate)
                  .select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"),
                          F.col("target").alias("__target"), F.floor("rate").alias("__whole"),
                          (F.col("rate") - F.floor("rate")).alias("__part")), "rates")
    same = F.col(source).eqNullSafe(F.col("__source"))
    draws = (docs.select(source, n_words(filled(text)).alias("size"), drawn_hash(doc_id, text, seed).alias("hash"))
             .join(rates, same)
             .select("__source", "size", "hash", "__part",
                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("turn"))
             .groupBy("__source", "turn")
             .agg(F.sum(F.when(succeeds(F.col("hash"), F.col("turn"), F.col("__part")), F.col("size"))
                        .otherwise(0)).alias("more")))
    known = rates.select(F.col("__source").alias("s"), "__target", "__whole", "__source_size")
    miss = F.abs(F.col("__whole") * F.col("__source_size") + F.col("more") - F.col("__target"))
    best = (draws.join(known, F.col("__source").eqNullSafe(F.col("s")))
            .groupBy("__source").agg(F.min(F.struct(miss.alias("miss"), F.col("turn").alias("turn"))).alias("best"))
            .select(F.col("__source").alias("s"), F.col("best.turn").alias("__turn")))
    chosen = saved(rates.join(best, F.col("__source").eqNullSafe(F.col("s"))).drop("s"), "turns")
    more = succeeds(F.col("__hash"), F.col("__turn"), F.col("__part")).cast("int")
    return (docs.withColumn("__size", n_words(filled(text))).withColumn("__hash", drawn_hash(doc_id, text, seed))
            .join(chosen, same)
            .withColumn("__copies", (F.col("__whole") + more).cast("long")))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE, seed: int = SEED,
        source: str = "source", doc_id: str = "doc_id", text: str = "text", turns: int = TURNS) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the
    columns of ``docs`` only."""
    t = targets(source_sizes(docs, source, text), weights, max_rate)
    counted = copies(docs, t, source, doc_id, text, seed, turns).filter("__copies > 0")
    return (counted.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def mix_report(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_rate: int = MAX_RATE,
               seed: int = SEED, turns: int = TURNS) -> DataFrame:
    """One row per document: its size, its source's size and target, and the
    words the mix takes from it."""
    docs = docs.select("doc_id", "source", "text")
    t = targets(source_sizes(docs), weights, max_rate)
    return copies(docs, t, seed=seed, turns=turns).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"),
        F.col("__copies").alias("copies"))
