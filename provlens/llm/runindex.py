"""Exact removal of long repeats with a run-length suffix index.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier
in the corpus (in a smaller document, or earlier in the same one). Strings
never cross documents, and all are judged on the input.

One index over 100 TB is out of reach, and so is streaming every document
through the index of every block. Therefore equal strings are first brought
together, by content:

1. anchors: in every ``LENGTH``-byte window the ``GRAM``-byte gram with the
   smallest hash (the leftmost of equals) is the window's anchor; equal windows
   have equal anchors at equal offsets. Neighbouring windows mostly share their
   anchor, so one *segment* (anchor hash ``h``, hash ``g`` of its bytes,
   document, position, number of windows) stands for about forty windows;
2. segments meet by ``h``. With equal ``(h, g)`` all but the first are repeats
   as a whole. An ``h`` with one segment is unique. What is left is an ``h``
   whose first segments differ: they share a gram and perhaps windows;
3. those segments are read from the documents and indexed: a suffix array of
   the concatenation gives the Burrows-Wheeler transform, of which the index
   keeps the runs and the suffix positions at both ends of every run with their
   common prefix lengths (:class:`RunIndex`). Matching statistics are streamed
   over it: from a text position the samples give its neighbours in suffix
   order and the length they share with it, and a window is marked as soon as a
   neighbour chain of ``LENGTH`` or more reaches an earlier position;
4. the marked spans meet the documents, which are cut.

Skew: equal segments are reduced to the first before any shuffle, within a
batch of documents and, by a table of bounded size (:class:`Seen`), over the
batches of a task, so a text copied a million times costs about a row per task
and segment. Where segments meet they come sorted and are streamed: the first
row of a segment is carried from batch to batch and repeats are marked batch by
batch, so memory does not grow with the number of copies. A gram that is common in many contexts (found on a bounded sample of
``PLAN_ROWS`` documents, at most ``MAX_HOT`` grams) is split into its single
windows, keyed by their own content, as are groups of more than ``MAX_GROUP``
segments: the exact way for what would not fit an index. Both only change the
plan, never a row.

Defined cases: null is empty; shorter texts than ``LENGTH`` stay as they are;
rows repeated whole are one document (each gets its result); documents with the
same id and different texts are ordered by the text's hash; a document without
an id comes after all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provlens.llm.common import filled, saved, shuffle_width

LENGTH = 100
GRAM = 32
MAX_GROUP = 2048
MAX_HOT = 4096
PLAN_ROWS = 4000
BATCH_BYTES = 1 << 20
INDEX_BYTES = 1 << 20
SEEN_SLOTS = 1 << 17
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SEGMENT = "h bigint, g bigint, d bigint, p int, n int, off int"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Two polynomial hashes of any substring of ``data`` in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n + 1, BASE, np.uint64)
        self.inverse = np.full(n + 1, INVERSE, np.uint64)
        powers[0] = self.inverse[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = []
        for seed in (1, 2):
            values = mixed(np.arange(256, dtype=np.uint64) + np.uint64(seed << 32))[data]
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(values * powers[:n], out=total[1:])
            self.sums.append(total)

    def of(self, which: int, start: np.ndarray, size) -> np.ndarray:
        total = self.sums[which]
        return mixed((total[start + size] - total[start]) * self.inverse[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, in linear time."""
    blocks = -(-len(x) // width)
    grid = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    grid[:len(x)] = x
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    last = len(x) - width + 1
    return np.minimum(behind[:last], ahead[width - 1:width - 1 + last])


def segments(texts: list[bytes], docs: np.ndarray, offsets: np.ndarray, hot: np.ndarray,
             length: int = LENGTH, gram: int = GRAM) -> pd.DataFrame:
    """The segments (columns of ``SEGMENT``) of a batch of texts, each from an
    offset of its document on."""
    sizes = np.array([len(t) for t in texts], np.int64)
    long = sizes >= length
    texts = [t for t, keep in zip(texts, long) if keep]
    docs, offsets, sizes = docs[long], offsets[long], sizes[long]
    if not len(texts):
        return _rows([], [], [], [], [], [])
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    hashes = Hashes(data)
    grams = hashes.of(0, np.arange(len(data) - gram + 1), gram)
    place = np.arange(len(grams), dtype=np.uint64)
    low = sliding_min((grams & np.uint64(0xFFFFFFFF00000000)) | place, length - gram + 1)
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(len(low), bool)
    for end in ends.tolist():
        inside[max(0, end - length + 1):end] = False
    start = np.flatnonzero(inside)
    anchor = anchor[start]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(start) != 1))))
    n = np.diff(np.concatenate((first, [len(start)])))
    start, anchor = start[first], anchor[first]
    off = anchor - start
    h = grams[anchor]
    if len(hot):
        split = np.isin(h.view(np.int64), hot)
        if split.any():
            each = np.repeat(start[split], n[split]) + _counting(n[split])
            start = np.concatenate((start[~split], each))
            h = np.concatenate((h[~split], hashes.of(0, each, length)))
            off = np.concatenate((off[~split], np.zeros(len(each), np.int64)))
            n = np.concatenate((n[~split], np.ones(len(each), np.int64)))
    g = mixed(hashes.of(1, start, n + (length - 1)) + (off * 4096 + n).astype(np.uint64))
    owner = np.searchsorted(ends, start, side="right")
    return _rows(h.view(np.int64), g.view(np.int64), docs[owner], start - begins[owner] + offsets[owner], n, off)


def windows(texts: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> pd.DataFrame:
    """Segments of one window each, keyed by the window's own content."""
    size = np.array([len(t) for t in texts], np.int64)
    n = size - (length - 1)
    hashes = Hashes(np.frombuffer(b"".join(texts), np.uint8))
    inner = _counting(n)
    at = np.repeat(np.cumsum(size) - size, n) + inner
    return _rows(hashes.of(0, at, length).view(np.int64), hashes.of(1, at, length).view(np.int64),
                 np.repeat(docs, n), np.repeat(starts, n) + inner, np.ones(len(at), np.int64),
                 np.zeros(len(at), np.int64))


def _counting(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _rows(h, g, d, p, n, off) -> pd.DataFrame:
    return pd.DataFrame({"h": np.asarray(h, np.int64), "g": np.asarray(g, np.int64), "d": np.asarray(d, np.int64),
                         "p": np.asarray(p, np.int32), "n": np.asarray(n, np.int32),
                         "off": np.asarray(off, np.int32)})


def marks(d: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Marked spans as rows with ``off`` -1 and ``n`` bytes; spans of a document
    that touch are joined. ``h`` only deals them out."""
    if not len(d):
        return _rows([], [], [], [], [], [])
    order = np.lexsort((start, d))
    d, start, end = d[order], start[order].astype(np.int64), end[order].astype(np.int64)
    new = np.concatenate(([True], d[1:] != d[:-1]))
    # running maximum of the ends within a document; ends are below 2^32, so 2^31 documents fit
    base = (np.cumsum(new) - 1) * (end.max() + 1)
    reach = np.maximum.accumulate(end + base) - base
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    stop = np.maximum.reduceat(end, at)
    spread = mixed(d[at].astype(np.uint64) * BASE + start[at].astype(np.uint64)).view(np.int64)
    return _rows(spread, np.zeros(len(at)), d[at], start[at], stop - start[at], np.full(len(at), -1))


def firsts(rows: pd.DataFrame, length: int = LENGTH) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The first row of each (h, g), and marks for what repeats it."""
    rows = rows.sort_values(["h", "g", "d", "p"], kind="stable", ignore_index=True)
    h, g, d, p = (rows[c].to_numpy() for c in "hgdp")
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))) if len(h) else np.zeros(0, bool)
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = ~new & ((d != d[lead]) | (p != p[lead]))  # the same place, in a row repeated whole, is no repeat
    n = rows["n"].to_numpy()
    return rows[new], marks(d[again], p[again], p[again] + n[again] + (length - 1))


class Leads:
    """:func:`firsts` over rows sorted by (h, g, d, p) that come in batches:
    the first row of the last (h, g) is carried on, whatever its copies."""

    def __init__(self, length: int = LENGTH):
        self.length, self.last = length, None

    def of(self, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        if not len(rows):
            return rows, marks(*np.zeros((3, 0), np.int64))
        carried = self.last is not None
        first, repeated = firsts(pd.concat([self.last, rows], ignore_index=True) if carried else rows, self.length)
        self.last = first.iloc[-1:]
        return first.iloc[int(carried):], repeated


class Seen:
    """Segments of the earlier batches of a task, one to a slot of a table of
    ``slots`` rows. A segment that was met again keeps its slot, so what is
    copied all over the task stays; others make room. What is forgotten meets
    its copies after the shuffle."""

    def __init__(self, slots: int = SEEN_SLOTS):
        self.rows = np.zeros((4, slots), np.int64)
        self.filled, self.again = np.zeros(slots, bool), np.zeros(slots, bool)

    def of(self, rows: pd.DataFrame, length: int = LENGTH) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The rows (one of each segment) that no earlier batch holds at a
        smaller place, and marks for the others."""
        new = rows[["h", "g", "d", "p"]].to_numpy(np.int64).T
        slot = (mixed(new[0].astype(np.uint64) ^ mixed(new[1].astype(np.uint64)))
                % np.uint64(len(self.filled))).astype(np.int64)
        old = self.rows[:, slot]
        known = self.filled[slot] & (old[0] == new[0]) & (old[1] == new[1])
        less = (old[2] < new[2]) | ((old[2] == new[2]) & (old[3] < new[3]))
        same = known & (old[2] == new[2]) & (old[3] == new[3])  # the same place, in a row repeated whole
        self.again[slot[known]] = True
        put = np.flatnonzero(np.where(known, ~less & ~same, ~self.again[slot]))
        to, one = np.unique(slot[put], return_index=True)
        self.rows[:, to] = new[:, put[one]]
        self.filled[to] = True
        if 2 * self.again.sum() > len(self.again):
            self.again[:] = False
        drop = known & less
        d, p, n = (rows[c].to_numpy()[drop].astype(np.int64) for c in "dpn")
        return rows[~(drop | same)], marks(d, p, p + n + (length - 1))


def contested(leads: Iterable[pd.DataFrame], max_group: int = MAX_GROUP) -> Iterator[pd.DataFrame]:
    """Of first rows sorted by h, in batches, those whose h has several; ``g``
    becomes 1 where they are more than ``max_group``, else 0. No more than that
    many rows are held back; every batch gives one, if an empty one."""
    held, split = None, None  # the rows of the last h; the last h that has too many
    for first in leads:
        rows = first if held is None else pd.concat([held, first], ignore_index=True)
        if not len(rows):
            yield rows
            continue
        h = rows["h"].to_numpy()
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        count = count[inverse]
        many = count > max_group
        if split is not None:
            many |= h == split
        if many[-1]:
            split = h[-1]
        going = (h == h[-1]) & ~many
        yield rows.assign(g=many.astype(np.int64))[((count > 1) | many) & ~going]
        held = rows[going]
    if held is not None and len(held) > 1:
        yield held.assign(g=np.int64(0))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text`` (non-negative integers, the last one unique) by
    prefix doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    step, packed = 1, rank.max() + 2
    while True:
        shifted = np.zeros(n, np.int64)
        if step < n:
            shifted[:n - step] = rank[step:] + 1
        key = rank * packed + shifted
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        grown = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = grown
        if grown[-1] == n - 1:
            return order
        step, packed = step * 2, n + 1


class RunIndex:
    """Run-length index of a text: runs of the Burrows-Wheeler transform with
    the suffix positions sampled at run ends.

    For a sampled position the neighbour in suffix order and the common prefix
    length are kept; any other position has the neighbour of the nearest sample
    before it, moved by the distance, with the prefix shortened by it. Size and
    lookups depend on the number of runs, not on the length of the text.
    """

    def __init__(self, text: np.ndarray):
        sa = suffix_array(text)
        bwt = text[sa - 1]  # the character before each suffix; -1 wraps to the last
        edge = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1  # rows that begin a run, without the first
        self.heads = bwt[np.concatenate(([0], edge))]
        self.starts = np.concatenate(([0], edge))
        above, below = sa[edge - 1], sa[edge]  # the last of a run, the first of the next
        shared = common_prefixes(text, above, below)
        order = np.argsort(below)
        self.up = (below[order], above[order], shared[order])
        order = np.argsort(above)
        self.down = (above[order], below[order], shared[order])

    def neighbour(self, side, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the next suffix on that side, length shared with it)."""
        known, other, shared = side
        i = np.searchsorted(known, at, side="right") - 1
        valid = i >= 0
        i = np.maximum(i, 0)
        move = at - known[i]
        return other[i] + move, np.where(valid, shared[i] - move, -1)

    def repeats_earlier(self, at: np.ndarray, length: int) -> np.ndarray:
        """True where the ``length`` characters from ``at`` also start at a
        smaller position: matching statistics followed in both directions of
        the suffix order while they stay at ``length`` or more."""
        found = np.zeros(len(at), bool)
        for side in (self.up, self.down):
            if not len(side[0]):
                continue
            who = np.flatnonzero(~found)
            here = at[who]
            while len(who):
                there, shared = self.neighbour(side, here)
                long = shared >= length
                hit = long & (there < at[who])
                found[who[hit]] = True
                go = long & ~hit
                who, here = who[go], there[go]
        return found


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b. Separators are
    unique, so it ends inside a segment."""
    size = np.zeros(len(a), np.int64)
    who, n = np.arange(len(a)), len(text)
    while len(who):
        x, y = a[who] + size[who], b[who] + size[who]
        ok = (x < n) & (y < n)
        who, x, y = who[ok], x[ok], y[ok]
        who = who[text[x] == text[y]]
        size[who] += 1
    return size


def indexed(parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For segments in order of occurrence: (segment, window) of every window
    that an earlier segment, or an earlier place of its own, holds as well."""
    size = np.array([len(x) for x in parts], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    text = np.zeros(int(size.sum()) + len(parts), np.int64)
    text[begin + size] = 256 + np.arange(len(parts))  # separators, all different
    inside = np.ones(len(text), bool)
    inside[begin + size] = False
    text[inside] = np.frombuffer(b"".join(parts), np.uint8)
    n = size - (length - 1)
    which, inner = np.repeat(np.arange(len(parts)), n), _counting(n)
    hit = RunIndex(text).repeats_earlier(begin[which] + inner, length)
    return which[hit], inner[hit]


# --- Spark steps


def numbered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``__d``, a number that orders documents and tells them
    apart: the id itself where ids are unique, else the position of (id, text
    hash), from a range-partitioned sort."""
    ids = docs.groupBy(F.col(doc_id).alias("id")).count().filter("count > 1 or id is null")
    if ids.isEmpty():
        return docs.withColumn("__d", F.col(doc_id).cast("long"))
    spark = docs.sparkSession
    order = [F.col("id").asc_nulls_last(), F.col("hash")]
    keys = docs.select(F.col(doc_id).alias("id"), F.sha2(filled(text), 256).alias("hash")).distinct()
    placed = saved(keys.repartitionByRange(shuffle_width(spark), *order)
                   .withColumn("part", F.spark_partition_id()), "order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begin = (placed.groupBy("part").count()
             .select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begin")))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    placed = (placed.withColumn("i", place).join(F.broadcast(begin), "part")  # a row per partition
              .select(F.col("id").alias("__id"), F.col("hash").alias("__hash"),
                      (F.col("begin") + F.col("i") - 1).alias("__d")))
    return (docs.join(placed, F.col(doc_id).eqNullSafe(F.col("__id"))
                      & (F.sha2(filled(text), 256) == F.col("__hash"))).drop("__id", "__hash"))


def _pieces(batches: Iterable[pd.DataFrame], length: int,
            limit: int = BATCH_BYTES) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(texts, documents, offsets) of about ``limit`` bytes. A longer text is
    cut into parts that share ``length - 1`` bytes, so every window is in
    exactly one part and memory does not grow with the longest text."""
    texts, ids, offsets, held = [], [], [], 0
    for pdf in batches:
        for t, d in zip(pdf["t"], pdf["d"]):
            t = bytes(t)
            for at in range(0, max(1, len(t) - length + 1), limit):
                part = t[at:at + limit + length - 1]
                if texts and held + len(part) > limit:
                    yield texts, np.array(ids, np.int64), np.array(offsets, np.int64)
                    texts, ids, offsets, held = [], [], [], 0
                texts.append(part)
                ids.append(d)
                offsets.append(at)
                held += len(part)
    if texts:
        yield texts, np.array(ids, np.int64), np.array(offsets, np.int64)


def scan(docs: DataFrame, hot: np.ndarray, length: int = LENGTH, gram: int = GRAM,
         batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """First segments of every batch of documents, without those that an
    earlier batch of the task is known to hold, and marks for the rest."""
    def each(batches):
        seen = Seen()
        for texts, ids, offsets in _pieces(batches, length, batch_bytes):
            first, repeated = firsts(segments(texts, ids, offsets, hot, length, gram), length)
            yield repeated
            first, repeated = seen.of(first, length)
            yield first
            yield repeated

    return docs.mapInPandas(each, SEGMENT)


def common_grams(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, plan_rows: int = PLAN_ROWS) -> np.ndarray:
    """Anchor hashes that occur in many contexts, on a bounded sample: at most
    ``MAX_HOT`` numbers, which only steer how rows are dealt out."""
    total = docs.count()
    sample = docs if total <= plan_rows else docs.sample(plan_rows / total, seed=1)
    rows = (scan(sample, np.zeros(0, np.int64), length, gram).filter("off >= 0")
            .groupBy("h").agg(F.count_distinct("g").alias("n")).filter(f"n >= {max(8, plan_rows // 200)}")
            .orderBy(F.desc("n"), "h").limit(MAX_HOT).select("h").collect())
    return np.array(sorted(r["h"] for r in rows), np.int64)


def _groups(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by h, regrouped so that no h is cut. An empty batch is
    passed on."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            yield pdf
            continue
        h = pdf["h"].to_numpy()
        cut = int(np.searchsorted(h, h[-1], side="left"))
        if cut and (not held or held[0]["h"].iat[0] != h[0]):
            yield from held and [pd.concat(held, ignore_index=True)]
            yield pdf.iloc[:cut]
            held = [pdf.iloc[cut:]]
        elif cut:
            edge = int(np.searchsorted(h, h[0], side="right"))
            yield pd.concat([*held, pdf.iloc[:edge]], ignore_index=True)
            if edge < cut:
                yield pdf.iloc[edge:cut]
            held = [pdf.iloc[cut:]]
        elif held and held[0]["h"].iat[0] != h[0]:
            yield pd.concat(held, ignore_index=True)
            held = [pdf]
        else:
            held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def met(rows: DataFrame, length: int = LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """Segments of the corpus met by anchor: marks for whole repeats, and the
    first segments of anchors whose segments differ (``g`` is then 1 if the
    group is to be split into windows, else 0)."""
    def each(batches):
        found, leads = [], Leads(length)

        def first_rows():
            for pdf in batches:
                off = pdf["off"].to_numpy()
                first, repeated = leads.of(pdf[off >= 0])
                found.extend([pdf[off < 0], repeated])
                yield first

        for rows in contested(first_rows(), max_group):
            yield from found
            found.clear()
            yield rows
        yield from found

    n = shuffle_width(rows.sparkSession)
    return rows.repartition(n, "h").sortWithinPartitions("h", "g", "d", "p").mapInPandas(each, SEGMENT)


PART = SEGMENT + ", part binary"


def cut_out(docs: DataFrame, contested: DataFrame, length: int = LENGTH) -> DataFrame:
    """The bytes of contested segments, or the windows of those to be split."""
    def each(batches):
        unpack = zstandard.ZstdDecompressor()
        for pdf in batches:
            out, parts, big = [], [], []
            for z, d, items in zip(pdf["z"], pdf["d"], pdf["items"]):
                text = unpack.decompress(z)
                for x in items:
                    piece = text[x["p"]:x["p"] + x["n"] + length - 1]
                    if x["g"]:
                        big.append((piece, d, x["p"]))
                    else:
                        out.append((x["h"], d, x["p"], x["n"], x["off"]))
                        parts.append(piece)
            if out:
                h, d, p, n, off = (np.array(x) for x in zip(*out))
                yield _rows(h, np.zeros(len(h)), d, p, n, off).assign(part=parts)
            for i in range(0, len(big), 20_000):
                texts, d, p = zip(*big[i:i + 20_000])
                first, repeated = firsts(windows(list(texts), np.array(d), np.array(p), length), length)
                yield first.assign(part=None)
                yield repeated.assign(part=None)

    items = contested.groupBy("d").agg(F.collect_list(F.struct("h", "p", "n", "off", "g")).alias("items"))
    # a row repeated whole gives its segments once, or they would be found earlier in themselves
    return docs.dropDuplicates(["d"]).join(items, "d").select("d", "z", "items").mapInPandas(each, PART)


def settled(parts: DataFrame, length: int = LENGTH, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Marks found by indexing the contested segments, whole groups at a time
    and at most about ``index_bytes`` to an index."""
    def index(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        which, inner = indexed(rows["part"].tolist(), length)
        start = rows["p"].to_numpy()[which] + inner
        return marks(rows["d"].to_numpy()[which], start, start + length)

    def each(batches):
        held, size = [], 0
        found, leads = [], Leads(length)

        def with_part():
            for pdf in batches:
                off, part = pdf["off"].to_numpy(), pdf["part"].notna().to_numpy()
                found.append(pdf.loc[off < 0].drop(columns="part"))
                found.append(leads.of(pdf[(off >= 0) & ~part].drop(columns="part"))[1])
                yield pdf[part]

        for pdf in _groups(with_part()):
            yield from found
            found.clear()
            rows = pdf.sort_values(["h", "d", "p"], kind="stable", ignore_index=True)
            if not len(rows):
                continue
            # cut between groups where the text of an index is full
            total = np.cumsum(rows["part"].str.len().to_numpy())
            edge = np.flatnonzero(np.concatenate(([True], np.diff(rows["h"].to_numpy()) != 0)))
            low = 0
            for begin, end in zip(edge.tolist(), [*edge[1:].tolist(), len(rows)]):
                if size + total[end - 1] - (total[low - 1] if low else 0) > index_bytes:
                    if begin > low:
                        held.append(rows.iloc[low:begin])
                    if held:
                        yield index(held)
                    held, size, low = [], 0, begin
            held.append(rows.iloc[low:])
            size += int(total[-1] - (total[low - 1] if low else 0))
        yield from found
        if held:
            yield index(held)

    n = shuffle_width(parts.sparkSession)
    return parts.repartition(n, "h").sortWithinPartitions("h", "g", "d", "p").mapInPandas(each, SEGMENT)


def packed(docs: DataFrame) -> DataFrame:
    """(d, z): texts compressed for the shuffle that brings them to their marks."""
    def each(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            yield pd.DataFrame({"d": pdf["d"], "z": [pack.compress(bytes(t)) for t in pdf["t"]]})

    return docs.select("d", "t").mapInPandas(each, "d bigint, z binary")


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM,
                   max_group: int = MAX_GROUP, plan_rows: int = PLAN_ROWS) -> DataFrame:
    """(d, spans array<struct<start,end>>) for the table (d, t binary): the
    bytes to remove, for documents that have any."""
    hot = common_grams(texts, length, gram, plan_rows)
    found = saved(met(scan(texts, hot, length, gram), length, max_group), "segments")
    parts = cut_out(packed(texts), found.filter("off >= 0"), length)
    more = saved(settled(parts, length), "settled")
    spans = found.filter("off < 0").select("d", "p", "n").union(more.filter("off < 0").select("d", "p", "n"))
    return spans.groupBy("d").agg(F.collect_list(F.struct(F.col("p").alias("start"),
                                                          (F.col("p") + F.col("n")).alias("end"))).alias("spans"))


def _clean(text: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    """(kept bytes, maximal removed runs)."""
    runs: list[list[int]] = []
    for s in sorted((x["start"], x["end"]) for x in (spans if spans is not None else ())):
        if runs and s[0] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], s[1])
        else:
            runs.append([s[0], s[1]])
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), [tuple(r) for r in runs]


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("__d").alias("d"), F.encode(filled(text), "UTF-8").alias("t"))


def repeat_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_group: int = MAX_GROUP,
                  plan_rows: int = PLAN_ROWS) -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs, hash of the rest."""
    keyed = numbered(docs.select("doc_id", "text"))
    texts = _texts(keyed, "text")
    spans = repeated_spans(texts, length, gram, max_group, plan_rows)
    ids = keyed.select(F.col("doc_id"), F.col("__d").alias("d"), F.encode(filled("text"), "UTF-8").alias("t"))

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "d": pdf["d"],
                                "z": [squeeze.compress(bytes(t)) for t in pdf["t"]]})

    def each(batches):
        unpack = zstandard.ZstdDecompressor()
        for pdf in batches:
            out = []
            for z, items in zip(pdf["z"], pdf["spans"]):
                text = unpack.decompress(z)
                kept, runs = _clean(text, items)
                out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            n_bytes, n_removed, n_spans, digest = zip(*out) if out else ((), (), (), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": np.array(n_bytes, np.int64),
                                "n_removed": np.array(n_removed, np.int64), "n_spans": np.array(n_spans, np.int64),
                                "kept_sha256": list(digest)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    small = ids.mapInPandas(pack, f"doc_id {kind}, d bigint, z binary")
    return (small.join(spans, "d", "left").select("doc_id", "z", "spans")
            .mapInPandas(each, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", n_chars: str = "n_chars",
                   doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the repeats cut from the text (a character that loses some
    of its bytes goes) and, if there is one, ``n_chars`` counted anew."""
    keyed = numbered(docs, doc_id, text)
    spans = repeated_spans(_texts(keyed, text), length)

    @F.pandas_udf("string")
    def rest(t: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_clean(a.encode(), b)[0].decode("utf-8", "ignore") for a, b in zip(t, spans)])

    out = keyed.join(spans.withColumnRenamed("d", "__d").withColumnRenamed("spans", "__spans"), "__d", "left")
    cut = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(rest(filled(text), F.col("__spans")))
    out = out.withColumn(text, cut)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.coalesce(F.length(text), F.lit(0)).cast(docs.schema[n_chars].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
