"""Cross-tokenizer alignment against whole-text encoding and plain loops."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from provlens.llm import crosstok as C
from tests.llm.edge import documents, texts

SIDES = C.Sides(*C.default_vocabularies())
AWKWARD = ["", "a", " a", "a ", "  ", "a  b", "a\n b \n c", "x▁y", "日本語のテキスト 漢字", "émile  l'été", "🙂🙂 👩‍👩‍👧", "=" * 300,
           "<|endoftext|> </s> <0x41>", "a\x00b", "\x1c x \x85y", "don't can't we'll", "\t\ttab\tand  space ", "ﬁ ① Å", "q" * 5000]


def plain(texts_):
    """Figures of every text, from whole encodings and loops over tokens."""
    figures, links = [], []
    count = Counter()
    for text in texts_:
        text = text or ""
        a = SIDES.a.encode(" " + text, add_special_tokens=False).ids
        b = SIDES.b.encode(text)
        raw = (" " + text).encode()
        spelt = all(b"".join(table[i] for i in ids) == raw for table, ids in ((SIDES.a_bytes, a), (SIDES.b_bytes, b)))
        if not text or not spelt:
            figures.append((0, 0, 0, 0, ""))
            links.append(Counter())
            continue
        ends_a, ends_b = (np.cumsum([len(table[i]) for i in ids]).tolist()
                          for table, ids in ((SIDES.a_bytes, a), (SIDES.b_bytes, b)))
        groups, own, i, j = [], Counter(), 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            i2, j2 = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            own.update((x, y) for x in a[i:i2] for y in b[j:j2])
            i, j = i2, j2
        figures.append((len(a), len(b), len(groups), sum(own.values()),
                        hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
        count.update(own.keys())
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(*f[:4], sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()), f[4])
            for f, own in zip(figures, links)]


def rows_of(df):
    return sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"],
                    r["groups_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("setting", ["one run", "many runs"])
def test_edge_rows(spark, monkeypatch, setting):
    if setting == "many runs":  # a run per text, merged in several levels, records spread over salts
        monkeypatch.setattr(C, "RUN_CHARS", 1)
        monkeypatch.setattr(C, "FAN_IN", 4)
        monkeypatch.setattr(C, "RETURN_RUNS", 8)
    rows = texts() + [(100 + i, t, "a") for i, t in enumerate(AWKWARD)]
    got = rows_of(C.alignment(documents(spark, rows).repartition(3), radix=8))
    assert got == sorted(((i, *f) for (i, _, _), f in zip(rows, plain([t for _, t, _ in rows]))), key=repr)


def test_empty_table(spark):
    assert C.alignment(documents(spark, [])).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 'é日\n\t  \x1c\x85▁🙂.,19")), max_size=40))
def test_units_give_the_whole_text(text):
    units = C.Units(SIDES)
    figures = C.run_of(units, [text])[0]
    want = plain([text])[0]
    assert tuple(figures[c][0] for c in C.FIGURES) + (figures["groups_sha256"][0],) == (*want[:4], want[6])


def test_forgetting_units_changes_nothing(monkeypatch):
    monkeypatch.setattr(C, "REMEMBERED", 3)
    units = C.Units(SIDES)
    for part in (["one two", "three one"], ["two two four"], ["one"]):
        figures = C.run_of(units, part)[0]
        assert figures["groups_sha256"] == [w[6] for w in plain(part)]


def test_merge_and_packing():
    rng = np.random.default_rng(3)
    runs, want = [], Counter()
    for _ in range(9):
        pairs = np.unique(rng.integers(0, 50, 30))
        counts = rng.integers(1, 1 << 40, len(pairs))
        want.update(dict(zip(pairs.tolist(), counts.tolist())))
        runs.append((C.packed(pairs, "<u8"), C.packed(counts, "<u8")))
    pairs, counts = C.merged(runs)
    assert dict(zip(pairs.tolist(), counts.tolist())) == want and pairs.tolist() == sorted(want)
    assert C.unpacked(C.packed(np.zeros(0, np.int64), "<u4"), "<u4").size == 0
