"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprint: 64 bits; a bit is 1 if it is set in over half of the XXH64
hashes of the document's word shingles.

Linking fingerprints that differ in at most two bits:

1. classes: equal fingerprints are grouped first (partial aggregation), so
   thousands of copies are one row from here on;
2. embedding: the fingerprint is cut into ``SEGMENTS`` segments and mapped to
   the vector of bit counts per segment. Flipping a bit changes one count by
   one, so the Manhattan distance of two vectors is a lower bound of the bit
   distance, and two fingerprints within two bits have vectors within two;
3. grid range join: every vector is put into its own unit cell and the cells
   one step away (``2 * SEGMENTS + 1`` cells). Vectors within Manhattan
   distance two always share a cell: the one half-way. Cells with one
   fingerprint are dropped - for most fingerprints that is all of them;
4. exact check inside the shared cells: a fingerprint is in a cell with each
   of its variants (itself, or one bit flipped) whose bit counts are the
   cell's. Two fingerprints are within two bits exactly if they share a
   variant, so members are grouped by (cell, variant) and linked to the
   smallest one. That needs a row per member, not per pair, however many
   members a cell has, and it links no pair that is further apart;
5. connected components of the links by alternating star contraction, with
   every round written to the shared folder.

Defined cases: a text without words has fingerprint zero and is linked like
any other; fewer words than a shingle needs make one shingle of them all;
``component_id`` is null only where no member has a ``doc_id``; repeated rows
are members of one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlens.llm.common import filled, saved

SHINGLE = 3
MAX_BITS = 2  # the method links through one-bit variants: two bits
SEGMENTS = 16
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    last = len(words) - k + 1
    for low in range(0, last, 1 << 16):  # bounds memory for very long texts
        high = min(last, low + (1 << 16))
        spans = zip(starts[low:high].tolist(), ends[low + k - 1:high + k - 1].tolist())
        h = np.array([digest(flat[a:b], seed) for a, b in spans], dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id",
                 text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, __fp): the fingerprint as a signed long."""
    src = docs.select(F.col(doc_id).alias(doc_id), *keep, filled(text).alias("__t"))
    fields = [f for f in src.schema.fields if f.name != "__t"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["__fp bigint"])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, shingle) for t in pdf["__t"]], dtype=np.uint64).view(np.int64)
            out = pdf.drop(columns="__t")
            out["__fp"] = fps
            yield out

    return src.mapInPandas(each, schema)


def links(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """(a, b): links between distinct fingerprints of the one-column table
    ``fp``. Same components as all pairs within two bits, a row per member."""
    width = 64 // segments
    if width * segments != 64 or width < 2:
        raise ValueError("segments must divide 64 into parts of two bits or more")
    # the vector as one number: a digit of base width + 1 for each segment
    weights = [(width + 1) ** i for i in range(segments)]
    mask = (1 << width) - 1
    fp = F.col("fp")
    part = [F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit(mask).cast("long")))
            for i in range(segments)]
    home = F.lit(0).cast("long")
    for i in range(segments):
        home = home + part[i].cast("long") * F.lit(weights[i]).cast("long")
    # cells one step away, named by segment and direction: (segment + 1) * direction; 0 is the home cell
    steps = [F.struct(F.lit(0).alias("step"), F.col("home").alias("cell"))]
    for i in range(segments):
        one = F.lit(weights[i]).cast("long")
        steps += [F.when(part[i] < width, F.struct(F.lit(i + 1).alias("step"), (F.col("home") + one).alias("cell"))),
                  F.when(part[i] > 0, F.struct(F.lit(-i - 1).alias("step"), (F.col("home") - one).alias("cell")))]
    placed = fps.select("fp", home.alias("home")).select("fp", F.inline(F.filter(F.array(*steps), lambda s: s.isNotNull())))
    shared = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell")
    candidates = placed.join(shared, "cell")
    # the variants of a member that lie in the cell: flip a 0 bit (step up) or a 1 bit (step down) of the segment
    segment = F.abs("step") - 1
    bits = F.sequence(segment * width, segment * width + (width - 1))
    variants = F.when(F.col("step") == 0, F.array(fp)).otherwise(F.transform(
        F.filter(bits, lambda b: F.call_function("getbit", fp, b) == (F.col("step") < 0).cast("int")),
        lambda b: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    members = candidates.select("fp", F.explode(variants).alias("variant"))
    first = members.groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a <> z")
    return (members.join(first.select("variant", "a"), "variant").filter("fp <> a")
            .select(F.col("fp").alias("b"), "a").distinct())


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected links (a, b): alternating
    large-star and small-star rounds until every node points to the smallest
    node of its component. Rounds grow with the logarithm of the longest chain;
    each is a grouping by node with a partial minimum, written to the shared
    folder, and only a row count reaches the driver."""
    pairs = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .filter("u <> v").distinct(), label)
    def state(p: DataFrame):
        return p.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(pairs)
    while before[0]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: each greater neighbour of u points to the least of u's neighbourhood
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = saved(large, label)
        # small star: u and its smaller neighbours point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        pairs = saved(small, label)
        now = state(pairs)
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classed(fps: DataFrame, doc_id: str = "doc_id", segments: int = SEGMENTS) -> DataFrame:
    """(fp, root, component_id, n): one row per distinct fingerprint of
    (doc_id, __fp), with its component."""
    classes = saved(fps.groupBy(F.col("__fp").alias("fp"))
                    .agg(F.min(doc_id).alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    found = components(links(classes.select("fp"), segments))
    rooted = (classes.join(found, classes["fp"] == found["node"], "left")
              .select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "root", "component_id", "n")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document."""
    fps = saved(fingerprints(docs, shingle), "fingerprints")
    classes = classed(fps, segments=segments)
    return (fps.join(classes, fps["__fp"] == classes["fp"])
            .select("doc_id", F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE, segments: int = SEGMENTS,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest ``doc_id``
    (a document without one only if no member has one; then, and for rows with
    equal ids, one of them by text), with the columns of ``docs``. A row is
    named by its id and text, as an id may occur with texts of different
    components."""
    key = F.concat(F.coalesce(F.concat(F.lit("id:"), F.col(doc_id).cast("string")), F.lit("none")), F.lit(" "),
                   F.sha2(filled(text), 256))
    fps = saved(fingerprints(docs.withColumn("__key", key), shingle, doc_id, text, keep=("__key",)), "fingerprints")
    classes = classed(fps.withColumnRenamed(doc_id, "__id"), "__id", segments).select("fp", "root")
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("__key").alias("__key"))
    keepers = (fps.join(classes, fps["__fp"] == classes["fp"]).groupBy("root")
               .agg(F.min(order).alias("k")).select(F.col("k.__key").alias("__key")))
    kept = docs.withColumn("__key", key).join(keepers, "__key", "left_semi")
    if not fps.groupBy("__key").count().filter("count > 1").isEmpty():  # rows with equal id and text
        kept = kept.dropDuplicates(["__key"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
