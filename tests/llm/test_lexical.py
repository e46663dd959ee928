"""Ranked lexical search against scoring every document."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from provlens.llm import lexical as L
from tests.llm.edge import documents, texts

ITEMS_SCHEMA = "item_id bigint, text string, doc_id string, rank string"


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10 ** 9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, i is None, i, score))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, score) for r, (_, _, i, score) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("setting", ["whole", "small"])
def test_edge_rows(spark, monkeypatch, setting):
    if setting == "small":
        monkeypatch.setattr(L, "PIECE_CHARS", 40)
        monkeypatch.setattr(L, "VISIT", 2)
        monkeypatch.setattr(L, "ITEMS", 3)
    docs = texts() + [(30 + i, f"Same words HERE {'pad ' * (i % 3)}", "a") for i in range(40)]
    items = [(1, "same words here same"), (2, None), (3, ""), (4, "...,;"), (5, "PASSAGE of words; hundred bytes"),
             (None, "two texts"), (7, "ÜNÏCODE ünïcode 日本 repeated row"), (7, "here"), (7, "here"), (9, "no such-thing zzz"),
             (10, "word7919 word1 the same text")]
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS_SCHEMA)
    for k in (20, 3):
        got = L.search(L.build_index(documents(spark, docs).repartition(3)), table, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        rows = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()), key=repr)
        assert rows == plain([(i, t) for i, t, _ in docs], items, k)


def test_empty_tables(spark):
    none = documents(spark, [])
    items = spark.createDataFrame([(1, "a", "x", "y")], ITEMS_SCHEMA)
    assert L.ranked(none, items).collect() == []
    assert L.ranked(documents(spark), items.limit(0)).collect() == []
    assert L.ranked(documents(spark, [(1, None, "a"), (2, "!?", "a")]), items).collect() == []


def test_every_document_with_a_term_is_indexed(spark):
    docs = documents(spark)
    index = L.build_index(docs)
    heads = index.pieces.selectExpr("m", "inline(postings)").where("tf = 0")
    ids = [i for r in heads.collect() for i in r["docs"]]
    assert len(ids) == index.n_docs == sum(bool(terms(t)) for _, t, _ in texts())
    assert index.n_terms == sum(len(terms(t)) for _, t, _ in texts())
