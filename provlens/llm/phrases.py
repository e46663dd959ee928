"""Document fingerprints by locally consistent parsing.

A text is parsed in levels. At each level runs of one symbol become a symbol;
then deterministic coin tossing gives every symbol a label: the place and value
of the lowest bit in which it differs from its left neighbour, applied again to
the labels until six values are left, neighbours always staying different. A
local minimum of the labels starts a block, and the block's content is hashed
to the name of a phrase, a symbol of the next level (about three times fewer).
Whether a block starts somewhere depends only on a few symbols around it, so
equal substrings have equal phrases in their interior, wherever they begin.

The fingerprint is a one-permutation MinHash of the phrase names of ``LEVELS``:
``BINS`` bins with the smallest ``VALUE_BITS``-bit value each, as hexadecimal
text (all ones: empty). Likeness is the share of equal bins among those that
are filled in either, an estimate of the Jaccard similarity of the phrase sets.

The parsing is vectorised over a batch of documents, whose ends are barriers:
the result for a document does not depend on the batch it is in.

``fingerprint_report`` needs each document's successor. The ids are dealt to
ranges once and the ranges' lower bounds kept (:func:`lower_bounds`), so the
range of a document is a function of its id, the same in every branch of the
plan and in a retried task. Documents are shuffled to their ranges (the one
shuffle of texts), sorted and streamed; the last document of a range meets the
first of the next filled one through a table with a row per range.

Defined cases: a null or empty text has no phrases; two empty fingerprints have
likeness 1, one empty and one filled 0; rows with equal ids are ordered by
text, null ids come last; in a table of one row the next document is itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provlens.llm.common import chunks, filled, saved, shuffle_width
from provlens.llm.runindex import mixed

LEVELS = (2, 3)
BINS = 128
VALUE_BITS = 24
EMPTY = (1 << VALUE_BITS) - 1
TOSSES = 4  # 64-bit names -> 128 -> 14 -> 8 -> 6 labels


def labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing: labels below six, different from the left neighbour's.
    ``first`` marks the first symbol of each document."""
    x = names
    for toss in range(TOSSES):
        left = np.empty_like(x)
        left[1:] = x[:-1]
        left[first] = ~x[first]  # a document's first symbol differs from nothing in bit 0
        differ = x ^ left
        place = np.bitwise_count((differ & (~differ + np.asarray(1, x.dtype))) - np.asarray(1, x.dtype))
        x = (place << 1 | (x >> place.astype(x.dtype) & np.asarray(1, x.dtype)).astype(np.uint8)).astype(np.uint8)
    return x


def next_level(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the next level, and the document of each."""
    if not len(names):
        return names, owner
    # runs of one symbol
    edge = np.concatenate(([True], (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])))
    start = np.flatnonzero(edge)
    length = np.diff(np.append(start, len(names)))
    names, owner = names[start], owner[start]
    names = np.where(length > 1, mixed(names ^ mixed(length.astype(np.uint64) << np.uint64(32))), names)
    # blocks begin at local minima of the labels
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    label = labels(names, first)
    low = np.zeros(len(names), bool)
    low[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:]) & ~first[2:]  # not a document's last
    begins = low | first
    begins[1:] &= ~first[:-1] | first[1:]  # a document's second symbol stays with its first
    start = np.flatnonzero(begins)
    place = np.arange(len(names)) - np.repeat(start, np.diff(np.append(start, len(names))))
    parts = mixed(names + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mixed(np.add.reduceat(parts, start)), owner[start]


def sketches(texts: Sequence[str], levels: Sequence[int] = LEVELS, bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` values per text."""
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    names, owner = mixed(points.astype(np.uint64) + np.uint64(1)), np.repeat(np.arange(len(texts)), size)
    out = np.full(len(texts) * bins, EMPTY, np.uint32)
    for level in range(1, max(levels) + 1):
        names, owner = next_level(names, owner)
        if level in levels:
            h = mixed(names + np.uint64(level))
            value = np.minimum(h >> np.uint64(64 - VALUE_BITS), np.uint64(EMPTY - 1)).astype(np.uint32)
            np.minimum.at(out, owner * bins + (h % np.uint64(bins)).astype(np.int64), value)
    return out.reshape(len(texts), bins)


def shown(sketch: np.ndarray) -> list[str]:
    """Sketches as hexadecimal text, ``VALUE_BITS / 4`` digits a bin."""
    digits = VALUE_BITS // 8
    raw = sketch.astype(">u4").view(np.uint8).reshape(*sketch.shape, 4)[:, :, 4 - digits:]
    return [row.tobytes().hex() for row in raw]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, between 0 and 1."""
    either = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    return np.where(either == 0, 1.0, same / np.maximum(either, 1))


def fingerprints(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Keys and ``fingerprint`` of every text; no shuffle."""
    src = docs.select(*[F.col(f"`{k}`") for k in keys], filled(text).alias("__t"))
    types = {f.name: f.dataType.simpleString() for f in src.schema.fields}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, "__t"):
            yield pdf.drop(columns="__t").assign(fingerprint=shown(sketches(pdf["__t"].tolist())))

    return src.mapInPandas(each, ", ".join([f"`{k}` {types[k]}" for k in keys] + ["fingerprint string"]))


def edited(text: str, following: str) -> str:
    """The last quarter replaced by the beginning of the next document."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def compared(ids: Sequence, texts: Sequence[str], following: Sequence[str]) -> pd.DataFrame:
    """Report rows for documents and the document after each."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    # a document is mostly the next one of the row before: parse each text once
    number: dict[str, int] = {}
    every = [number.setdefault(t, len(number)) for t in (*texts, *following)]
    own = sketches(list(number))
    mine, after = own[every[:len(texts)]], own[every[len(texts):]]
    new = sketches(changed)
    return pd.DataFrame({
        "doc_id": ids, "n_chars": np.array([len(t) for t in texts], np.int64),
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": shown(mine), "edited_fingerprint": shown(new),
        "near_edited": likeness(mine, new), "near_next": likeness(mine, after)})


def lower_bounds(docs: DataFrame) -> list:
    """The smallest id of each filled range partition of the ids, ascending: at
    most one for each shuffle partition."""
    ids = docs.select("doc_id").filter("doc_id is not null")
    dealt = saved(ids.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id")
                  .withColumn("part", F.spark_partition_id()), "ranges")
    lows = dealt.groupBy("part").agg(F.min("doc_id").alias("low"))
    return [r["low"] for r in lows.orderBy("low").collect()]


def range_of(bounds: Sequence, kind: str) -> Column:
    """Number of the bounds at or below the id; ids of null come last."""
    lows = F.array(*[F.lit(b) for b in bounds]).cast(f"array<{kind}>")
    below = F.size(F.filter(lows, lambda b: b <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(below)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprints of its text and of the edited text,
    and their likeness to each other and to the next document's."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double")
    order = F.col("doc_id").asc_nulls_last()
    bounds = lower_bounds(docs)
    ordered = (docs.select("doc_id", filled("text").alias("text"), range_of(bounds, kind).alias("part"))
               .repartitionById(len(bounds) + 2, F.col("part")).sortWithinPartitions(order, "text"))
    whole = kind in ("bigint", "int", "smallint", "tinyint")

    def ids(values) -> pd.Series:
        return pd.Series(values, dtype="object").astype("Int64") if whole else pd.Series(values)

    def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All documents of a range but its last."""
        last = None
        for pdf in chunks(batches, "text"):
            found = [None if pd.isna(x) else x for x in pdf["doc_id"].tolist()]
            texts = pdf["text"].tolist()
            if last is not None:
                found, texts = [last[0], *found], [last[1], *texts]
            last = (found[-1], texts[-1])
            if len(texts) > 1:
                yield compared(ids(found[:-1]), texts[:-1], texts[1:])

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield compared(ids([None if pd.isna(row.doc_id) else row.doc_id]), [row.text], [row.following])

    exact = ordered if not whole else ordered.withColumn("doc_id", F.col("doc_id").cast("decimal(20,0)"))
    main = exact.select("doc_id", "text").mapInPandas(inner, schema)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    ends = (ordered.groupBy("part")
            .agg(F.min(place).alias("low"), F.max(place).alias("high")))
    # a row per filled range: its number and the next one's, the first after the last
    parts = ends.select("part")
    follow = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")),
                                             F.min("part").over(Window.partitionBy())).alias("next_part"))
    heads = ends.select(F.col("part").alias("next_part"), F.col("low.text").alias("following"))
    pairs = (ends.select("part", F.col("high.doc_id").alias("doc_id"), F.col("high.text").alias("text"))
             .join(follow, "part").join(heads, "next_part").select("doc_id", "text", "following"))
    if whole:
        pairs = pairs.withColumn("doc_id", F.col("doc_id").cast("decimal(20,0)"))
    return main.unionByName(pairs.mapInPandas(edges, schema))
