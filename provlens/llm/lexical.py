"""Ranked lexical search over a length-stratified index.

A document's length enters its score only through the integer normaliser m, so
documents of equal m form a stratum, and a term's impact in a stratum depends on
its tf alone. The index is a table with a row per piece of a stratum (at most
``PIECE_CHARS`` characters of text): its documents in ascending id, and its
postings by term and tf. A search computes the impact of a (term, tf) once per
stratum and scatters it to the documents; the sum of the items' greatest impacts
bounds the scores of the stratum, strata are visited in descending order of that
bound, and an item stops at the first bound below its twentieth score (equal
bounds are visited, as ids decide ties).

Scores are exact integers: w * ((10^9 tf) div (1000 tf + 12 m)), summed over an
item's terms with repeats.

Scale: one pass counts documents and characters by length, one shuffle brings
equal normalisers together in parts of equal size (a stratum that holds a third
of all rows is spread over a third of the parts), index and search are narrow
passes. A task returns ``k`` rows per
item; they are reduced in two rounds. Items are processed in blocks of
``ITEMS`` (their terms and weights travel with the tasks), so any number of
items can be asked.

Defined cases: a null or term-less document is not counted and never found; a
null or term-less item has no rows; repeated items are ranked each, repeated
documents found each; equal scores are ordered by id, null ids last; no
documents or items give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provlens.llm.common import chunks, filled, saved, shuffle_width
from provlens.plans.position import with_position

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PIECE_CHARS = 1 << 20
SLICE = 1024  # documents that become Python objects at once
VISIT = 16  # pieces whose strata a task orders together
ITEMS = 256
TOP_K = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# byte -> byte: letters lower-cased, what separates terms a blank; other bytes belong to characters beyond ASCII
SEPARATED = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32
                  for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(SEPARATED).split()


@dataclass(frozen=True)
class Index:
    """Pieces (m, postings) and the statistics of the corpus: documents with a
    term, and their terms with repeats. The first posting of a piece has the
    empty term and holds its document ids, the others places among them."""

    pieces: DataFrame
    n_docs: int
    n_terms: int


def n_terms(texts: pd.Series) -> pd.Series:
    """Terms of each text, counted where a term begins, 1 MB at a time."""
    out = []
    for part in chunks([texts.to_frame("t")], "t"):
        raw = [t.encode() for t in part["t"]]
        is_term = np.frombuffer((b" " + b" ".join(raw) + b" ").translate(SEPARATED), np.uint8) != 32
        begins = is_term[1:] & ~is_term[:-1]
        size = np.array([len(r) + 1 for r in raw])
        out.append(np.add.reduceat(begins, np.cumsum(size) - size, dtype=np.int64))
    return pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    spark = docs.sparkSession
    counted = (docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), filled(text).alias("t"))
               .withColumn("n", F.pandas_udf(n_terms, "bigint")("t")).where("n > 0"))
    lengths = saved(counted.groupBy("n").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("t")).alias("chars")),
                    "lexical-lengths")
    stats = lengths.agg(F.sum("docs"), F.sum(F.col("docs") * F.col("n")), F.sum("chars")).first()
    n_docs, terms, chars = (x or 0 for x in stats)
    m = F.lit(75) + F.expr(f"(25L * n * {n_docs}L) div {max(terms, 1)}L")
    # strata lie one after the other on a line of all characters, which is cut into equal parts
    strata = lengths.groupBy(m.alias("m")).agg(F.sum("chars").alias("chars"))
    before = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    strata = strata.select("m", "chars", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("begin"))
    width = shuffle_width(spark)
    share = F.pmod(F.xxhash64("id", "t"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    part = F.floor((F.col("begin") + share * F.col("chars")) * F.lit(width) / F.lit(float(max(chars, 1)))).cast("int")
    by_length = (counted.select("id", "t", m.alias("m")).join(strata, "m")
                 .select("id", "t", "m", F.least(part, F.lit(width - 1)).alias("part"))
                 .repartitionById(width, F.col("part")).drop("part")
                 .sortWithinPartitions("m", F.col("id").asc_nulls_last()))
    schema = "m bigint, postings array<struct<term binary, tf int, docs array<bigint>>>"
    return Index(saved(by_length.mapInArrow(_pieces, schema), "lexical-index"), n_docs, terms)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents sorted by m, PIECE_CHARS of text at a time, a row per stratum."""
    frames = (b.slice(i, SLICE).to_pandas(integer_object_nulls=True) for b in batches for i in range(0, b.num_rows, SLICE))
    for pdf in chunks(frames, "t", PIECE_CHARS):
        cut = [terms_of(t) for t in pdf["t"]]
        code, names = pd.factorize(np.array([t for x in cut for t in x], dtype=object))
        m = pdf["m"].to_numpy().astype(np.int64)
        first = np.flatnonzero(np.diff(m, prepend=m[0] - 1))
        stratum = np.cumsum(np.diff(m, prepend=m[0] - 1) != 0) - 1
        doc = np.repeat(np.arange(len(cut)), [len(x) for x in cut])
        pair, tf = np.unique(code * np.int64(len(cut)) + doc, return_counts=True)
        term, doc = pair // len(cut), pair % len(cut)
        order = np.lexsort((doc, tf, term, stratum[doc]))
        term, doc, tf = term[order], doc[order], tf[order]
        group = np.flatnonzero(np.diff(stratum[doc], prepend=-1) | np.diff(term, prepend=-1) | np.diff(tf, prepend=0))
        # a head per stratum, then its groups: entries in order, their values gathered from ids and places
        width = np.diff(first, append=len(m))
        size = np.concatenate([width, np.diff(group, append=len(doc))])
        start = np.concatenate([first, len(m) + group])
        entry = np.argsort(np.concatenate([np.arange(len(first)), stratum[doc[group]]]), kind="stable")
        size, start = size[entry], start[entry]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
        none = pdf["id"].isna().to_numpy()
        ids = np.where(none, 0, pdf["id"].to_numpy()).astype(np.int64)
        values = np.concatenate([ids, doc - first[stratum[doc]]])[flat]
        blank = np.concatenate([none, np.zeros(len(doc), bool)])[flat]
        words = pa.array([b"", *names], pa.binary()).take(
            pa.array(np.concatenate([np.zeros(len(first), np.int64), term[group] + 1])[entry]))
        postings = pa.StructArray.from_arrays(
            [words, pa.array(np.concatenate([np.zeros(len(first), np.int32), tf[group].astype(np.int32)])[entry]),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, mask=blank))], ["term", "tf", "docs"])
        rows = np.concatenate([[0], np.cumsum(1 + np.bincount(stratum[doc[group]], minlength=len(first)))])
        yield pa.RecordBatch.from_arrays([pa.array(m[first]), pa.ListArray.from_arrays(pa.array(rows, pa.int32()), postings)],
                                         ["m", "postings"])


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(position, item_id, term, repeats) of all items; a position is a row."""
    rows = with_position(items.select(F.col(f"`{key}`").alias("item_id"), filled(text).alias("t")),
                         [F.col("item_id"), F.col("t")])
    words = F.explode(F.regexp_extract_all("t", F.lit(TERM), F.lit(0)))
    return (rows.select("position", "item_id", words.alias("term"))
            .withColumn("term", F.translate("term", UPPER, LOWER).cast("binary"))
            .groupBy("position", "item_id", "term").agg(F.count(F.lit(1)).alias("repeats")))


def search(index: Index, items: DataFrame, k: int = TOP_K, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of each item."""
    asked = saved(item_terms(items, key, text), "lexical-items")
    last = asked.agg(F.max("position")).first()[0] or 0
    found = None
    for low in range(0, max(last, 1), ITEMS):
        block = asked.where(F.col("position").between(low + 1, low + ITEMS))
        rows = _search_block(index, block, k)
        found = rows if found is None else found.unionByName(rows)
    names = asked.select("position", "item_id").distinct()
    best = found.join(names, "position")
    return best.select("item_id", "rank", "doc_id", "score")


def _search_block(index: Index, block: DataFrame, k: int) -> DataFrame:
    words = [(int(r["position"]), bytes(r["term"]), int(r["repeats"])) for r in block.collect()]  # of ITEMS items at most
    vocabulary = sorted({t for _, t, _ in words})
    spark = block.sparkSession
    entries = index.pieces.select("m", F.inline("postings"))
    asked = spark.createDataFrame([(bytearray(t),) for t in vocabulary], "term binary")
    df = {bytes(r["term"]): r["df"] for r in entries.select("term", F.size("docs").alias("n"))
          .join(F.broadcast(asked), "term")
          .groupBy("term").agg(F.sum("n").alias("df")).collect()}  # at most a row per term of the block
    number = {t: i for i, t in enumerate(t for t in vocabulary if t in df)}
    weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * df[t] + 1))) for t in number], np.int64)
    queries: dict[int, tuple[list[int], list[int]]] = {}
    for position, term, repeats in words:
        if term in number:
            q = queries.setdefault(position, ([], []))
            q[0].append(number[term])
            q[1].append(repeats)
    asks = [(p, np.array(t), np.array(r, np.int64)) for p, (t, r) in sorted(queries.items())]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {p: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for p, _, _ in asks}
        held: list[Stratum] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            m, no, tf = (batch.column(c).to_numpy().astype(np.int64) for c in ("m", "no", "tf"))
            heads = {0, *np.flatnonzero(no < 0).tolist()}
            for low, high in pairwise([*sorted(heads), len(no)]):
                docs = batch.column("docs").slice(low, high - low)
                if no[low] < 0:  # the head of a piece
                    if len(held) == VISIT:
                        _visit(held, asks, best, k)
                        held = []
                    held.append(Stratum(int(m[low]), docs.slice(0, 1).flatten(), len(weight)))
                    low, docs = low + 1, docs.slice(1)
                held[-1].add(no[low:high], tf[low:high], docs, weight)
        _visit(held, asks, best, k)
        for p, (score, doc, none) in best.items():
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), p)), pa.array(doc, mask=none), pa.array(score)],
                    ["position", "doc_id", "score"])

    numbered = F.broadcast(spark.createDataFrame(
        [(bytearray(b""), -1), *((bytearray(t), i) for t, i in number.items())], "term binary, no int"))
    # a piece is one row of the index, so its entries stay side by side in one task
    near = (entries.join(numbered, "term").select("m", "no", "tf", "docs")
            .mapInArrow(visit, "position bigint, doc_id bigint, score bigint"))
    # two rounds, so that no task sees all tasks' rows of an item
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = near.withColumn("salt", F.spark_partition_id() % 64)
    some = (some.withColumn("rank", F.row_number().over(Window.partitionBy("position", "salt").orderBy(*order)))
            .where(F.col("rank") <= k))
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("position").orderBy(*order)))
            .where(F.col("rank") <= k).select("position", "rank", "doc_id", "score"))


class Stratum:
    """The asked terms of one piece: the impact of every (term, tf), once."""

    def __init__(self, m: int, ids: pa.Array, terms: int):
        self.m = m
        self.none = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.impact: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.most = np.zeros(terms, np.int64)

    def add(self, no: np.ndarray, tf: np.ndarray, docs: pa.ListArray, weight: np.ndarray) -> None:
        """Postings in the order of term and tf."""
        impact = weight[no] * (1_000_000_000 * tf // (1000 * tf + 12 * self.m))
        np.maximum.at(self.most, no, impact)
        size = docs.value_lengths().to_numpy(zero_copy_only=False)
        value, place = np.repeat(impact, size), docs.flatten().to_numpy(zero_copy_only=False)
        end = np.concatenate([[0], np.cumsum(size)])
        edges = np.flatnonzero(np.diff(no, prepend=-1, append=-1))  # a term's groups lie side by side
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            self.impact.setdefault(int(no[a]), []).append((value[end[a]:end[b]], place[end[a]:end[b]]))

    def scores(self, terms: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.ids), np.int64)
        for t, r in zip(terms.tolist(), repeats.tolist()):
            for value, place in self.impact.get(t, ()):
                total[place] += r * value
        return total


def _visit(held: list[Stratum], asks: list, best: dict, k: int) -> None:
    """Bring the strata's documents into the best ``k`` of each item."""
    if not held:
        return
    most = np.stack([s.most for s in held])
    for p, terms, repeats in asks:
        bound = most[:, terms] @ repeats
        for i in np.argsort(-bound, kind="stable"):
            score, doc, none = best[p]
            if bound[i] <= 0 or (len(score) == k and bound[i] < score[-1]):
                break
            got = held[i].scores(terms, repeats)
            new = np.flatnonzero(got >= max(1, score[-1] if len(score) == k else 1))
            if len(new):
                score = np.concatenate([score, got[new]])
                doc = np.concatenate([doc, held[i].ids[new]])
                none = np.concatenate([none, held[i].none[new]])
                top = np.lexsort((doc, none, -score))[:k]
                best[p] = (score[top], doc[top], none[top])


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP_K) -> DataFrame:
    """(item_id, rank, doc_id, score): build the index, search all items."""
    return search(build_index(docs), items, k)
