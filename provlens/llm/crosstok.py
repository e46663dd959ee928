"""Cross-tokenizer alignment with external spill counting.

Every text is encoded by a byte-level BPE (A, a blank before the text) and by a
sentencepiece model (B, which adds the blank itself). Offsets in the bytes where
tokens of both end cut the text into groups; an A and a B token of one group are
linked. The documents that hold a linked pair of ids are counted over the whole
corpus.

1. *Runs.* A task turns about ``RUN_CHARS`` characters of text at a time into a
   run of pair-document records (A id, B id, document, links), sorted with the A
   id as the major key and radix-partitioned by A id. Each part of a run is one
   row: its pairs with their document counts, and its records, both compressed
   with Zstandard and spilled to the shared folder.
2. *Counting.* Per radix part a heap merges the runs' sorted pairs and adds their
   counts, at most ``FAN_IN`` runs at a time, in as many levels as there are runs
   for. As all pairs of an A id follow each other, the last merge also knows the
   highest count of the A id when its pairs end.
3. *Contributions.* The counted pairs of a part meet the records of every run
   (spread over further tasks where there are many runs); each part of a run
   gives its documents' sums back to the run, which adds them up.

Texts are cut into units at blanks between two other characters, where both
tokenizers always end a token; a unit is encoded and aligned once per task (at
most ``REMEMBERED`` characters of distinct units are kept).

Scale: a hot pair or A id costs one record per run in the counting, never one
per document; records move twice (spill and shuffle). A counted part is bounded
by the two vocabularies, a run by its text. Nothing is collected but the number
of runs.

Defined cases: a null or empty text, and a text whose tokens do not spell it
(such as one with U+2581), has zeros and an empty digest; repeated rows are
documents of their own; strings of special tokens are plain text; an empty table
gives no rows; columns other than the key and the text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlens.llm.bpe import byte_characters
from provlens.llm.common import chunks, filled, saved

RUN_CHARS = 1 << 22
REMEMBERED = 1 << 24
RADIX = 64
FAN_IN = 128
RETURN_RUNS = 1024  # runs that meet one copy of a part's counts
UNIT_END = re.compile(r"(?<=\S) (?=\S)")
JOINED = 512  # units encoded by A in one string
DOC_BITS = 22
FIGURES = ("n_a", "n_b", "n_groups", "n_links")


class Sides:
    """The two tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        of = {c: i for i, c in enumerate(byte_characters())}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(self.a.get_vocab().values()))
        for token, i in vocabulary.items():
            if all(c in of for c in token):
                self.a_bytes[i] = bytes(of[c] for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i)
                                else piece.replace("▁", " ").encode())
        if any(re.search("[^ ] ", x.decode("utf-8", "replace")) for x in self.b_bytes):
            raise ValueError("a piece of B reaches over a word's end")
        if len(self.a_bytes) > 1 << 20 or len(self.b_bytes) > 1 << 20:
            raise ValueError("the vocabularies are too large for packed keys")
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # decimal ids with what follows them: inside a group, and at its side's end
        self.shown = np.array([f"{i}{end}".encode() for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;"))
                               for end in ends for i in range(n)], dtype=object)

    def encode_a(self, units: Sequence[str]) -> list[list[int]]:
        """Ids of each unit after a blank; units that begin and end with a
        character that is no white space are encoded many at a time."""
        out: list[list[int]] = [[]] * len(units)
        clean = [i for i, u in enumerate(units) if u and not u[0].isspace() and not u[-1].isspace()]
        loose = sorted(set(range(len(units))).difference(clean))
        for i, e in zip(loose, self.a.encode_batch([" " + units[i] for i in loose], add_special_tokens=False)):
            out[i] = e.ids
        parts = [clean[i:i + JOINED] for i in range(0, len(clean), JOINED)]
        joined = self.a.encode_batch(["".join(" " + units[i] for i in p) for p in parts], add_special_tokens=False)
        for part, e in zip(parts, joined):
            every = e.ids
            end = np.cumsum(self.a_size[np.array(every, np.int64)])
            stop = np.cumsum([1 + len(units[i].encode()) for i in part])
            at = np.searchsorted(end, stop)
            if at[-1] >= len(end) or (end[at] != stop).any():  # not where a unit ends: one by one
                for i, one in zip(part, self.a.encode_batch([" " + units[i] for i in part], add_special_tokens=False)):
                    out[i] = one.ids
                continue
            for i, low, high in zip(part, [0, *(at[:-1] + 1).tolist()], (at + 1).tolist()):
                out[i] = every[low:high]
        return out


def aligned(sides: Sides, units: Sequence[str]) -> dict[str, np.ndarray | list]:
    """Alignment of units, all at once: the figures, the shown groups, and the
    linked id pairs (``pairs`` with ``links``, unit i from ``start[i]`` on)."""
    n = len(units)
    raw = [(" " + u).encode() for u in units]
    a_ids, b_ids = sides.encode_a(units), sides.b.encode(list(units), num_threads=1)
    good = np.array([b"".join(map(sides.b_bytes.__getitem__, y)) == r and b"".join(map(sides.a_bytes.__getitem__, x)) == r
                     for x, y, r in zip(a_ids, b_ids, raw)], bool)
    a_ids, b_ids = ([x if g else [] for x, g in zip(ids, good)] for ids in (a_ids, b_ids))
    na, nb = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
    a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a_ids, b_ids))
    end_a, end_b = np.cumsum(sides.a_size[a]), np.cumsum(sides.b_size[b])
    common = np.intersect1d(end_a, end_b, assume_unique=True)  # the ends of units are among them
    ga, gb = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    in_a, in_b = np.bincount(ga, minlength=len(common)), np.bincount(gb, minlength=len(common))
    unit = np.repeat(np.arange(n), na)[np.cumsum(in_a) - 1] if len(common) else np.zeros(0, np.int64)
    # tokens in shown order: a group's A tokens, then its B tokens
    before_b, upto_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
    shown = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.diff(ga, append=-1) != 0, np.diff(gb, append=-1) != 0
    width_a, width_b = len(sides.a_bytes), len(sides.b_bytes)
    shown[np.arange(len(a)) + before_b[ga]] = a + last_a * width_a
    shown[np.arange(len(b)) + upto_a[gb]] = 2 * width_a + b + last_b * width_b
    pieces = sides.shown[shown].tolist()
    stop = np.cumsum(na + nb)
    text = [b"".join(pieces[low:high])[:-1] for low, high in zip((stop - na - nb).tolist(), stop.tolist())]
    # distinct ids of a group and side with their repeats, then every pair of the two sides
    key_a, times_a = np.unique(ga << 20 | a, return_counts=True)
    key_b, times_b = np.unique(gb << 20 | b, return_counts=True)
    own_b = np.bincount(key_b >> 20, minlength=len(common))
    first_b = np.cumsum(own_b) - own_b
    many = own_b[key_a >> 20]
    left = np.repeat(np.arange(len(key_a)), many)
    right = first_b[key_a[left] >> 20] + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
    mask = (1 << 20) - 1
    pairs = (key_a[left] & mask) << 20 | key_b[right] & mask
    return {"n_a": na, "n_b": nb, "n_groups": np.bincount(unit, minlength=n),
            "n_links": np.bincount(unit, weights=in_a * in_b, minlength=n).astype(np.int64), "good": good, "text": text,
            "pairs": pairs, "links": times_a[left] * times_b[right],
            "start": np.searchsorted(unit[key_a[left] >> 20], np.arange(n + 1))}


class Units:
    """Alignments of the units a task has met."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.text: list[bytes] = []
        self.tables = {c: np.zeros(0, np.int64) for c in (*FIGURES, "good", "pairs", "links")}
        self.start = np.zeros(1, np.int64)

    def learn(self, words: set[str]) -> None:
        if self.chars > REMEMBERED:
            self.clear()
        new = [w for w in words if w not in self.number]
        if not new:
            return
        got = aligned(self.sides, new)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.chars += sum(map(len, new))
        self.text.extend(got["text"])
        self.start = np.concatenate([self.start, self.start[-1] + got["start"][1:]])
        for c in self.tables:
            self.tables[c] = np.concatenate([self.tables[c], got[c]])


def units_of(text: str) -> list[str]:
    """The text cut at blanks between two characters that are no white space."""
    parts = text.split(" ")
    if any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
        return UNIT_END.split(text)
    return parts


def run_of(units: Units, texts: Sequence[str]) -> tuple[dict[str, np.ndarray | list], np.ndarray, np.ndarray, np.ndarray]:
    """Figures of each text, and the sorted records: pair, text and links."""
    cut = [units_of(t) if t else [] for t in texts]
    every = set(chain.from_iterable(cut))
    units.learn(every)
    if any(w not in units.number for w in every):  # forgotten just now
        units.learn(every)
    flat = np.fromiter(map(units.number.__getitem__, chain.from_iterable(cut)), np.int64)
    size = np.array([len(x) for x in cut], np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    t = units.tables
    good = np.bincount(doc, weights=1 - t["good"][flat], minlength=len(texts)) == 0
    rows: dict[str, np.ndarray | list] = {
        c: (np.bincount(doc, weights=t[c][flat], minlength=len(texts)).astype(np.int64) * good) for c in FIGURES}
    stop = np.cumsum(size)
    names = flat.tolist()
    rows["groups_sha256"] = [
        hashlib.sha256(b";".join(map(units.text.__getitem__, names[high - n:high]))).hexdigest() if n and ok else ""
        for n, high, ok in zip(size.tolist(), stop.tolist(), good.tolist())]
    kept = good[doc]
    key, times = np.unique(doc[kept] << 40 | flat[kept], return_counts=True)
    which, unit = key >> 40, key & ((1 << 40) - 1)
    own = units.start[unit + 1] - units.start[unit]
    at = np.repeat(units.start[unit] - (np.cumsum(own) - own), own) + np.arange(own.sum())
    pair, which, links = t["pairs"][at], np.repeat(which, own), t["links"][at] * np.repeat(times, own)
    order = np.lexsort((which, pair))
    pair, which, links = pair[order], which[order], links[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1) | np.diff(which, prepend=-1))
    return rows, pair[first], which[first], np.add.reduceat(links, first) if len(first) else links


def packed(values: np.ndarray, kind: str) -> bytes:
    """Zstandard frame of fixed-width numbers, equal bytes side by side."""
    raw = values.astype(kind)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(kind).ravel()


def merged(blobs: Sequence[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Heap merge of sorted runs of (pair, count), adding up the counts."""
    streams = [zip(unpacked(p, "<u8").tolist(), unpacked(c, "<u8").tolist()) for p, c in blobs]
    pairs: list[int] = []
    counts: list[int] = []
    last = -1
    for pair, n in heapq.merge(*streams):
        if pair == last:
            counts[-1] += n
        else:
            pairs.append(pair)
            counts.append(n)
            last = pair
    return np.array(pairs, np.uint64), np.array(counts, np.uint64)


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spilled(docs: DataFrame, vocabularies: tuple[str, str] | None = None, key: str = "doc_id",
            text: str = "text", radix: int = RADIX) -> DataFrame:
    """The table of runs: a row per run (``part`` null) with its documents and
    their figures, and a row per radix part with its pairs, the documents that
    hold each (``counts``), and the records (``which``, ``links``)."""
    paths = vocabularies or default_vocabularies()
    src = docs.select(F.col(f"`{key}`").alias("id"), filled(text).alias("t"))
    id_type = src.schema["id"].dataType.simpleString()
    arrays = {"ids": id_type, **{c: "bigint" for c in FIGURES}, "groups_sha256": "string"}
    schema = ("run bigint, part int, " + ", ".join(f"{c} array<{t}>" for c, t in arrays.items())
              + ", pairs binary, counts binary, which binary, links binary")
    blobs = ("pairs", "counts", "which", "links")
    RUN = RUN_CHARS

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        units = Units(Sides(*paths))
        run = TaskContext.get().partitionId() << 32
        for pdf in chunks(batches, "t", RUN):
            figures, pair, which, links = run_of(units, pdf["t"].tolist())
            base = {"run": run, "part": None, **figures, "ids": [None if pd.isna(x) else x for x in pdf["id"]]}
            rows = [base]
            place = (pair >> 20) % radix
            order = np.argsort(place, kind="stable")
            edge = np.searchsorted(place[order], np.arange(radix + 1))
            for part in range(radix):
                at = order[edge[part]:edge[part + 1]]
                if not len(at):
                    continue
                first = np.flatnonzero(np.diff(pair[at], prepend=-1))
                n = np.diff(first, append=len(at))
                rows.append({"run": run, "part": part, "pairs": packed(pair[at][first], "<u8"),
                             "counts": packed(n, "<u8"),
                             "which": packed(which[at], "<u4"), "links": packed(links[at], "<u4")})
            run += 1
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype="Int32" if c == "part" else object)
                                for c in ("run", "part", *arrays, *blobs)})

    return saved(src.mapInPandas(each, schema), "crosstok-runs")


def counted(runs: DataFrame) -> DataFrame:
    """Per radix part all its pairs with their document counts, and whether a
    pair's count is the highest of its A id."""
    level = runs.where("part is not null").select("part", "run", "pairs", "counts")
    numbers = runs.where("part is null").select("run")
    left = numbers.count()
    # runs of a task follow each other; a hash spreads them evenly over the merges of a level
    while left > FAN_IN:
        left = -(-left // (FAN_IN // 2))

        def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pairs, counts = merged(list(zip(pdf["pairs"], pdf["counts"])))
            return pd.DataFrame({"part": [key[0]], "run": [key[1]], "pairs": [packed(pairs, "<u8")],
                                 "counts": [packed(counts, "<u8")]})

        level = saved(level.groupBy("part", F.pmod(F.xxhash64("run"), F.lit(left)).alias("run"))
                      .applyInPandas(merge, "part int, run bigint, pairs binary, counts binary"), "crosstok-merge")

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pairs, counts = merged(list(zip(pdf["pairs"], pdf["counts"])))
        first = np.flatnonzero(np.diff((pairs >> np.uint64(20)).astype(np.int64), prepend=-1))
        most = np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(pairs)))
        return pd.DataFrame({"part": [key[0]], "pairs": [packed(pairs, "<u8")], "counts": [packed(counts, "<u8")],
                             "best": [packed(counts == most, "u1")]})

    return saved(level.groupBy("part").applyInPandas(finish, "part int, pairs binary, counts binary, best binary"),
                 "crosstok-counts")


def _contributions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (part, salt, run), the counts (run null) first: the sums
    of each run's documents over the part."""
    table: tuple | None = None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if pd.isna(row.run):
                table = (unpacked(row.pairs, "<u8"), unpacked(row.counts, "<u8").astype(np.int64),
                         unpacked(row.best, "u1").astype(np.int64))
                continue
            pairs, n = unpacked(row.pairs, "<u8"), unpacked(row.counts, "<u8").astype(np.int64)
            at = np.repeat(np.searchsorted(table[0], pairs), n)
            which, links = unpacked(row.which, "<u4").astype(np.int64), unpacked(row.links, "<u4").astype(np.int64)
            order = np.argsort(which, kind="stable")
            some, first = np.unique(which[order], return_index=True)
            yield pd.DataFrame({"run": [row.run], "which": [packed(some, "<u4")],
                                "best": [packed(np.add.reduceat((links * table[2][at])[order], first), "<u8")],
                                "sum": [packed(np.add.reduceat((links * table[1][at])[order], first), "<u8")]})


def alignment(docs: DataFrame, vocabularies: tuple[str, str] | None = None, key: str = "doc_id",
              text: str = "text", radix: int = RADIX) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    runs = spilled(docs, vocabularies, key, text, radix)
    counts = counted(runs)
    base = runs.where("part is null")
    salts = -(-base.count() // RETURN_RUNS) or 1
    records = runs.where("part is not null").select(
        "part", F.pmod(F.xxhash64("run"), F.lit(salts)).cast("int").alias("salt"), "run", "pairs", "counts", "which",
        "links", F.lit(None).cast("binary").alias("best"))
    copies = counts.select("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
                           F.lit(None).cast("bigint").alias("run"), "pairs", "counts",
                           F.lit(None).cast("binary").alias("which"), F.lit(None).cast("binary").alias("links"), "best")
    met = (copies.unionByName(records).repartitionById(radix * salts, F.col("salt") * radix + F.col("part"))
           .sortWithinPartitions("salt", "part", F.col("run").asc_nulls_first()))
    sums = met.mapInPandas(_contributions, "run bigint, which binary, best binary, sum binary")
    arrays = ["ids", *FIGURES, "groups_sha256"]
    blobs = ["which", "best", "sum"]
    kinds = dict(base.dtypes)
    rows = base.select("run", *arrays, *[F.lit(None).cast("binary").alias(c) for c in blobs]).unionByName(
        sums.select("run", *[F.lit(None).cast(kinds[c]).alias(c) for c in arrays], *blobs))
    schema = (f"`{key}` {kinds['ids'][6:-1]}, " + ", ".join(f"{c} bigint" for c in (*FIGURES, "n_best", "count_sum"))
              + ", groups_sha256 string")

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = best = total = None

        def out() -> pd.DataFrame:
            cols = {key: pd.Series(list(held.ids), dtype=object), **{c: getattr(held, c) for c in FIGURES},
                    "n_best": best, "count_sum": total, "groups_sha256": held.groups_sha256}
            return pd.DataFrame(cols)

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.ids is not None:
                    if held is not None:
                        yield out()
                    held, best, total = row, np.zeros(len(row.n_a), np.int64), np.zeros(len(row.n_a), np.int64)
                    continue
                which = unpacked(row.which, "<u4")
                best[which] += unpacked(row.best, "<u8").astype(np.int64)
                total[which] += unpacked(row.sum, "<u8").astype(np.int64)
        if held is not None:
            yield out()

    return (rows.repartition("run").sortWithinPartitions("run", F.col("ids").isNull())
            .mapInPandas(added, schema))
