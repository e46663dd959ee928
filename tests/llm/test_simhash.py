from __future__ import annotations

import numpy as np
import pytest
import xxhash

from provlens.llm import simhash
from tests.llm import edge


def fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, most=2):
    """Smallest index reachable over values within ``most`` bits."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def check(spark, rows, segments=16):
    got = simhash.near_duplicates(edge.documents(spark, rows), segments=segments).collect()
    values = [fingerprint(t) for _, t, _ in rows]
    root = groups(values)
    least = {}
    for (i, _, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = [(i, f"{v:016x}", least.get(r)) for (i, _, _), v, r in zip(rows, values, root)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("segments", [8, 16, 32])
def test_edge_rows(spark, segments):
    check(spark, edge.texts(), segments)


def test_near_copies(spark):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 900, 800)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(i % 5):
            words[int(rng.integers(len(words)))] = f"n{rng.integers(99)}"
        rows.append((500 - i, " ".join(words), "a"))
    rows += [(i, None if i % 2 else "", "a") for i in range(900, 905)]
    check(spark, rows)


@pytest.mark.parametrize("segments", [8, 16, 32])
def test_links_have_the_components_of_all_pairs(spark, segments):
    rng = np.random.default_rng(7)
    values = [0, (1 << 64) - 1]
    for _ in range(40):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        values.append(x)
        for _ in range(int(rng.integers(0, 6))):  # chains of one to three flips
            for b in rng.integers(0, 64, int(rng.integers(1, 4))):
                x ^= 1 << int(b)
            values.append(x)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(fps, segments)).collect()}
    by_root, want = {}, {}
    for v, s, r in zip(values, signed, groups(values)):
        by_root.setdefault(found.get(s, s), set()).add(s)
        want.setdefault(r, set()).add(s)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, want.values()))
    for a, b in simhash.links(fps, segments).select("a", "b").collect():
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2


def test_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in simhash.components(df).collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and all(found[100 + i] == 100 for i in range(1, 50))


def test_keep_first(spark):
    rows = [(3, "alpha beta gamma delta", "a"), (1, "Alpha beta GAMMA delta", "b"), (None, "alpha beta gamma delta", "c"),
            (9, "another text of words", "a"), (9, "another text of words", "a"), (None, "lonely null text here", "d"),
            (None, "lonely null text here", "d"), (5, None, "e"), (4, "", "e")]
    docs = edge.documents(spark, rows)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["source"]) for r in kept.collect() if r["doc_id"] is not None) == [
        (1, "b"), (4, "e"), (9, "a")]
    assert [r["source"] for r in kept.collect() if r["doc_id"] is None] == ["d"]


def test_keep_first_of_equal_ids_with_different_texts(spark):
    rng = np.random.default_rng(4)
    a, b, c, d = (" ".join(f"w{x}" for x in rng.integers(0, 900, 60)) for _ in range(4))
    rows = [(8, a, "x"), (8, b, "y"), (3, b.upper(), "y"), (8, a, "x"), (20, c, "z"), (20, d, "t"), (21, d, "t"),
            (None, a, "x"), (None, "one lonely text", "u"), (None, "and another one", "v")]
    assert groups([fingerprint(t) for _, t, _ in rows]) == [0, 1, 1, 0, 4, 5, 5, 0, 8, 9]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_first(edge.documents(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted(
        [(8, a), (3, b.upper()), (20, c), (20, d), (None, "one lonely text"), (None, "and another one")], key=str)


def test_empty_table(spark):
    docs = edge.documents(spark, [])
    assert simhash.near_duplicates(docs).collect() == [] and simhash.keep_first(docs).collect() == []
