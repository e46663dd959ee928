from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from provlens.llm import mixing
from tests.llm import edge


def expected_targets(size):
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, done, free = sum(size.values()), {}, set(order)
    while free:
        rest, share = total - sum(done.values()), sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * rest > 3 * size[s] * share}
        if not over:
            return done | {s: weight[s] * rest / share for s in free}
        done |= {s: 3 * size[s] for s in over}
        free -= over
    return done


def words(text):
    return len((text or "").encode().split())


def check(spark, rows):
    docs = edge.documents(spark, rows)
    out = mixing.mix_report(docs).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += words(t)
    targets = expected_targets(size)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in out) == sorted(
        (i is None, i or 0, words(t)) for i, t, _ in rows)
    by_source = {(r["source_size"], round(r["target"], 6)) for r in out}
    assert by_source == {(size[s], round(float(targets[s]), 6)) for s in size}
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in out)
    return docs, out


def test_edge_rows(spark):
    docs, out = check(spark, edge.texts())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in out)
    assert sorted(map(str, mixing.mix_report(docs).collect())) == sorted(map(str, out))


def test_taken_words_come_near_the_target(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{i % 7}" if i % 3 else "hot") for i in range(3000)]
    _, out = check(spark, rows)
    taken, target = Counter(), {}
    for (_, _, s), r in zip(sorted(rows), sorted(out, key=lambda r: r["doc_id"])):
        taken[s] += r["taken"]
        target[s] = r["target"]
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.05)


def test_one_plain_draw(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), f"s{i % 7}" if i % 3 else "hot") for i in range(600)]
    for r in mixing.mix_report(edge.documents(spark, rows), turns=1).collect():
        drawn = int(hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16)
        rate = r["target"] / r["source_size"]
        assert r["copies"] == int(rate) + (drawn < (rate - int(rate)) * mixing.RANGE)


def test_empty_table(spark):
    docs = edge.documents(spark, [])
    assert mixing.mix_report(docs).collect() == [] and mixing.mix(docs).collect() == []


def test_sources_without_words(spark):
    out = mixing.mix_report(edge.documents(spark, [(1, None, "a"), (2, " ", "a"), (3, "two words", "b")])).collect()
    assert {r["doc_id"]: r["taken"] for r in out}[1] == 0
    assert {r["doc_id"]: r["target"] for r in out} == {1: 0.0, 2: 0.0, 3: 2.0}


def test_large_counts_do_not_overflow(spark):
    sizes = spark.createDataFrame([("a", 4 * 10**15), ("b", 10**14), (None, 10**12)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    want = expected_targets({"a": 4 * 10**15, "b": 10**14, None: 10**12})
    assert {s: pytest.approx(float(t)) for s, t in want.items()} == got
