from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provlens.llm import runindex
from tests.llm import edge


def brute(docs, length):
    """docs: list of (key, bytes) in order; equal (key, bytes) are one document."""
    seen, out = set(), {}
    for key, data in dict.fromkeys(docs):
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[key, data] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def keyed(rows):
    def order(r):
        data = (r[1] or "").encode()
        return (r[0] is None, r[0] or 0, hashlib.sha256(data).hexdigest())
    return [(r[0], (r[1] or "").encode()) for r in sorted(rows, key=order)]


def check(spark, rows, length=100, **options):
    got = runindex.repeat_report(edge.documents(spark, rows), length=length, **options).collect()
    want = brute(keyed(rows), length)
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == sorted(
        (str(i), *want[i, (t or "").encode()]) for i, t, _ in rows)


@pytest.mark.parametrize("options", [{}, {"max_group": 1}, {"plan_rows": 3}])
def test_edge_rows(spark, options):
    check(spark, edge.texts(), **options)


def test_many_copies_passages_and_periodic_texts(spark):
    rng = np.random.default_rng(3)
    def text(n):
        return "".join(rng.choice(list("abcd "), n))
    passage, line = text(300), text(120)
    rows = [(i, text(int(rng.integers(20, 400))) + (passage[i % 50:] if i % 3 else line) + text(40), "a")
            for i in range(150)]
    rows += [(1000 + i, rows[7][1] + ("" if i % 2 else "!"), "a") for i in range(40)]
    rows += [(2000, "ab" * 400, "a"), (2001, "x" * 700, "a"), (2002, "ab" * 90 + "x" * 150, "a")]
    check(spark, rows)
    check(spark, rows, max_group=3, plan_rows=10)


@pytest.mark.parametrize("options", [{}, {"max_group": 1}])
def test_rows_repeated_whole_keep_their_first_occurrence(spark, options):
    rng = np.random.default_rng(5)
    def text(n):
        return "".join(rng.choice(list("abcdefgh "), n))
    passage = text(260)
    rows = [(7, text(150) + passage + text(90), "a")] * 2 + [(None, text(60) + passage[:130] + text(50), "b")] * 3
    rows += [(9, text(130) + passage[30:] + text(140), "a"), (3, text(20) + passage[90:150] + text(80), "a")]
    check(spark, rows, **options)


def test_groups_are_streamed_in_batches(spark):
    rng = np.random.default_rng(6)
    def text(n):
        return "".join(rng.choice(list("abcd "), n))
    passage = text(240)
    rows = [(i, text(30 + i % 7) + passage[i % 5:] + text(20), "a") for i in range(60)]
    rows += [(100 + i, text(10) + passage, "a") for i in range(40)] + [(200, "ab" * 300, "a"), (201, "ab" * 400, "a")]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        check(spark, rows, max_group=4)
    finally:
        spark.conf.set(key, before)


def test_sorted_batches_give_the_rows_of_one_frame():
    rng = np.random.default_rng(7)
    n = 4000
    rows = runindex._rows(rng.integers(0, 60, n) ** 2 // 40, rng.integers(0, 5, n), rng.integers(0, 90, n),
                          rng.integers(0, 50, n) * 300, np.ones(n), np.zeros(n))
    rows = rows.sort_values(["h", "g", "d", "p"], ignore_index=True)
    first, repeated = runindex.firsts(rows)
    leads, batches = runindex.Leads(), [rows.iloc[i:i + 13] for i in range(0, n, 13)]
    got = [leads.of(x) for x in batches]
    def places(frames):
        return sorted({(d, q) for f in frames for d, p, k in zip(f["d"], f["p"], f["n"]) for q in range(p, p + k)})
    assert pd.concat(x for x, _ in got).to_numpy().tolist() == first.to_numpy().tolist()
    assert places(x for _, x in got) == places([repeated])
    for limit in (1, 3, 1000):
        size = first.groupby("h")["g"].transform("size")
        want = first.assign(g=(size > limit).astype(int))[size > 1]
        seen = pd.concat(runindex.contested((x for x, _ in got), limit))
        assert seen.to_numpy().tolist() == want.to_numpy().tolist()


@pytest.mark.parametrize("slots", [1, 64, 1 << 12])
def test_copies_all_over_a_task_are_a_row(slots):
    rng = np.random.default_rng(9)
    seen, kept, marked, rows = runindex.Seen(slots), [], [], []
    for i in rng.permutation(50).tolist():  # a passage of 20 segments in every batch, and segments of their own
        h = np.concatenate((np.arange(20), 1000 + 30 * i + np.arange(30)))
        batch = runindex._rows(h, h + 1, np.full(50, i), h * 100, np.ones(50), np.zeros(50))
        first, repeated = seen.of(batch)
        rows.append(batch)
        kept.append(first)
        marked.append(repeated)
    def end(frames, more=()):
        first, repeated = runindex.firsts(pd.concat(frames))
        spans = pd.concat([repeated, *more])
        return first.to_numpy().tolist(), sorted({(d, q) for d, p, k in zip(spans["d"], spans["p"], spans["n"])
                                                  for q in range(p, p + k)})
    assert end(kept, marked) == end(rows)
    if slots > 64:  # one row of a segment, and one more for each smaller place than those before
        assert sum((x["h"] < 20).sum() for x in kept) < 20 * 15


def test_spans_of_many_documents():
    n = (1 << 23) + 3
    d = np.concatenate((np.arange(n), [n - 1, n - 1]))
    start = np.concatenate((np.zeros(n, np.int64), [50, 500]))
    got = runindex.marks(d, start, np.concatenate((np.full(n, 100), [120, 600])))
    assert len(got) == n + 1 and got["n"].tolist()[-2:] == [120, 100]


def test_long_texts_are_scanned_in_parts():
    rng = np.random.default_rng(8)
    data = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (5, 900, 12, 400, 3000)]
    def windows(limit):
        rows = []
        frame = pd.DataFrame({"t": data, "d": range(len(data))})
        for texts, ids, offsets in runindex._pieces([frame], 12, limit):
            got = runindex.segments(texts, ids, offsets, np.zeros(0, np.int64), 12, 5)
            rows += [(d, p + i) for d, p, n in zip(got["d"], got["p"], got["n"]) for i in range(n)]
        return sorted(rows)
    assert windows(64) == windows(1 << 20) == [(d, i) for d, t in enumerate(data) for i in range(len(t) - 11)]


def test_empty_table(spark):
    assert runindex.repeat_report(edge.documents(spark, [])).collect() == []
    assert runindex.remove_repeats(edge.documents(spark, [])).collect() == []


def test_removal_keeps_columns_and_valid_text(spark):
    shared = "".join(chr(0xE9 + 7 * i % 400) + chr(0x4E00 + i * 31) for i in range(60))  # without a period
    docs = edge.documents(spark, [(1, "first " + shared, "a"), (2, "secönd " + shared + " tail", "b"), (3, None, None)])
    rows = {r["doc_id"]: r for r in runindex.remove_repeats(docs).collect()}
    assert runindex.remove_repeats(docs).columns == docs.columns
    assert rows[1]["text"] == "first " + shared and rows[3]["text"] is None and rows[3]["n_chars"] == 0
    assert rows[2]["text"] == "secönd tail" and rows[2]["n_chars"] == 11


def test_a_text_with_a_period_keeps_its_first_turn(spark):
    text = "first " + "é" * 80 + "日本" * 30  # repeats in itself: all but the first 100 bytes of each period go
    raw, seen, gone = text.encode(), set(), set()
    for i in range(len(raw) - 99):
        if raw[i:i + 100] in seen:
            gone.update(range(i, i + 100))
        seen.add(raw[i:i + 100])
    want = bytes(b for i, b in enumerate(raw) if i not in gone).decode("utf-8", "ignore")
    got = runindex.remove_repeats(edge.documents(spark, [(1, text, "a")])).first()
    assert got["text"] == want == "first é日本"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=5, max_size=30), min_size=1, max_size=12))
def test_run_index_against_brute_force(parts):
    length = 5
    parts = [p.encode() for p in parts]
    which, inner = runindex.indexed(parts, length)
    got = set(zip(which.tolist(), inner.tolist()))
    seen, want = set(), set()
    for k, p in enumerate(parts):
        for i in range(len(p) - length + 1):
            if p[i:i + length] in seen:
                want.add((k, i))
            seen.add(p[i:i + length])
    assert got == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array_and_runs(symbols):
    text = np.array([*symbols, 9])
    sa = runindex.suffix_array(text)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = runindex.RunIndex(text)
    assert len(index.heads) == 1 + sum(1 for a, b in zip(sa, sa[1:]) if text[a - 1] != text[b - 1])
    order = {int(p): i for i, p in enumerate(sa)}
    for p in range(len(text)):  # neighbours and shared lengths from the samples alone
        for side, step in ((index.up, -1), (index.down, 1)):
            i = order[p] + step
            if 0 <= i < len(sa) and len(side[0]):
                there, shared = index.neighbour(side, np.array([p]))
                q = int(sa[i])
                common = next((k for k in range(len(text)) if max(p, q) + k >= len(text) or text[p + k] != text[q + k]))
                assert (int(there[0]), int(shared[0])) == (q, common)
