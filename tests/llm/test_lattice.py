from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from provlens.llm import lattice
from tests.llm import edge


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces(lattice.default_vocabulary())


def brute_word(pieces, log_p, word):
    known = {p: i for i, p in enumerate(pieces.names)}
    word = lattice.MARK + word
    alpha = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        ways = [alpha[j - 1] + sum(log_p[len(known) + b] for b in word[j - 1].encode())]
        ways += [alpha[i] + log_p[known[word[i:j]]] for i in range(max(0, j - pieces.longest), j) if word[i:j] in known]
        top = max(ways)
        alpha[j] = top + math.log(sum(math.exp(x - top) for x in ways))
    return alpha[-1]


def test_forward_recursion_sums_all_segmentations(pieces):
    words = ["the", "unbelievable", "éàü", "日本語", "a", "x" * 300, "\x01\x85"]
    log_p = np.log(pieces.start)
    want = [brute_word(pieces, log_p, w) for w in words]
    assert np.allclose(pieces.scores(words, log_p), want, rtol=1e-12)


def test_expected_counts_match_the_gradient(pieces):
    """The expected use of a piece is the derivative of the log likelihood."""
    words, counts = ["there", "here", "évé"], np.array([2.0, 3.0, 1.0])
    log_p = np.log(pieces.start)
    use = pieces.expected(words, counts, log_p)
    for i in np.argsort(-use)[:6]:
        moved = log_p.copy()
        moved[i] += 1e-6
        change = ((pieces.scores(words, moved) - pieces.scores(words, log_p)) * counts).sum() / 1e-6
        assert change == pytest.approx(use[i], rel=1e-3)


def is_held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def check(spark, rows, frequent):
    got = lattice.scored(edge.documents(spark, rows), frequent=frequent).collect()
    seen = Counter()
    for i, t, _ in rows:
        if not is_held_out(i):
            seen.update([*(t or "").encode().lower().split(), "end"])
    n, v = sum(seen.values()), len(seen)
    want = []
    for i, t, _ in rows:
        tokens = [*(t or "").encode().lower().split(), "end"]
        want.append((i, is_held_out(i), len(tokens), sum(seen[w] > 0 for w in tokens), n,
                     round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens), 6)))
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                  for r in got if r["doc_id"] is not None) == sorted(w for w in want if w[0] is not None)
    assert len(got) == len(want) and all(r["score"] < 0 for r in got)
    return got


@pytest.mark.parametrize("frequent", [100_000, 20])
def test_edge_rows(spark, frequent):
    check(spark, edge.texts(), frequent)


def test_scores_do_not_depend_on_what_is_broadcast(spark):
    rows = edge.texts()
    a, b = (sorted(round(r["score"], 6) for r in check(spark, rows, k)) for k in (100_000, 20))
    assert a == b


def test_no_training_documents_and_empty_table(spark):
    held = next(i for i in range(100) if is_held_out(i))
    (row,) = lattice.scored(edge.documents(spark, [(held, "only held out", "a")])).collect()
    assert row["n_known"] == 0 and row["train_tokens"] == 0 and -100 < row["score"] < 0
    assert lattice.scored(edge.documents(spark, [])).collect() == []


def test_training_beats_the_starting_weights(spark):
    rng = np.random.default_rng(2)
    parts = ["qua", "zor", "blix", "tho", "gre", "mmu"]
    rows = [(i, " ".join("".join(rng.choice(parts, 4)) for _ in range(40)), "a") for i in range(60)]

    def held(rounds):
        got = lattice.scored(edge.documents(spark, rows), rounds=rounds).collect()
        return sum(r["score"] for r in got if r["held_out"])
    assert held(3) > held(0)


def cuts(word, known):
    """Every segmentation of a spelled word, as lists of piece numbers."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in known:
            for rest in cuts(word[n:], known):
                yield [known[word[:n]], *rest]
    if word:  # one character by its bytes
        for rest in cuts(word[1:], known):
            yield [*(len(known) + b for b in word[0].encode()), *rest]


@pytest.mark.parametrize("rounds", [0, 2])
def test_whole_scores_against_enumerated_segmentations(spark, pieces, rounds):
    rows = [(i, " ".join(t), "a") for i, t in enumerate(
        [["the", "cat"], ["the", "é"], ["sat", "the"], [], ["cat", "on"], ["mat"], ["the", "cat", "zq"], ["on"],
         ["hat", "the"], ["oat"], ["zq", "sat"], ["é", "cats"], ["them"], ["cat", "cat"]])]
    assert 0 < sum(is_held_out(i) for i, _, _ in rows) < len(rows)
    known = {p: i for i, p in enumerate(pieces.names)}
    seen = Counter()
    for i, t, _ in rows:
        if not is_held_out(i):
            seen.update([*t.split(), "end"])
    paths = {w: list(cuts(lattice.MARK + w, known)) for _, t, _ in rows for w in t.split()}
    p = pieces.start
    for _ in range(rounds):
        total = pieces.start * lattice.PRIOR
        for w in seen:
            if w != "end":
                weights = np.array([np.prod(p[path]) for path in paths[w]])
                for path, share in zip(paths[w], weights / weights.sum()):
                    np.add.at(total, path, share)
        p = total / total.sum()
    n, v = sum(seen.values()), len(seen)
    once, twice = (sum(c == k for c in seen.values()) for k in (1, 2))
    discount = once / (once + 2 * twice)

    def word(w):
        spelled = p[pieces.end] if w == "end" else sum(np.prod(p[path]) for path in paths[w])
        return math.log10(max(seen[w] - discount, 0) / n + discount * v / n * spelled)

    want = {i: sum(word(w) for w in [*t.split(), "end"]) for i, t, _ in rows}
    for frequent in (100_000, 1):
        got = {r["doc_id"]: r["score"] for r in
               lattice.scored(edge.documents(spark, rows), rounds=rounds, frequent=frequent).collect()}
        assert got == pytest.approx(want, rel=1e-9)


def test_long_words_are_scanned_with_the_same_result(pieces, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["short", "a" * 700, "".join(rng.choice(list("thequickbrownfox日é"), 650)), "x" * 129]
    log_p, counts = np.log(pieces.start), np.array([1.0, 2.0, 3.0, 1.0])
    whole = np.array([-3.0, -5.0, -np.inf, -np.inf])
    scores, uses = pieces.scores(words, log_p, -0.5, whole), pieces.expected(words, counts, log_p)
    monkeypatch.setattr(lattice, "LONG_WORD", 128)
    monkeypatch.setattr(lattice, "SCAN", 100)
    assert [k for k, _ in lattice.long_words(words)] == [1, 2, 3]
    assert np.allclose(pieces.scores(words, log_p, -0.5, whole), scores, rtol=1e-12)
    assert np.allclose(pieces.expected(words, counts, log_p), uses, rtol=1e-9, atol=1e-12)


def test_very_long_words_in_documents(spark):
    rows = [(i, t, "a") for i, t in enumerate(["a" * 100_000, "b " + "ab" * 30_000, "a b " + "日本" * 9000, "a"])]
    assert all(math.isfinite(r["score"]) for r in check(spark, rows, 100_000))


def test_report_of_words_sums_to_the_scores(spark):
    docs = edge.documents(spark)
    report = lattice.word_report(docs).collect()
    scored = [r for r in lattice.scored(docs).collect() if r["held_out"]]
    assert sum(r["held_out_tokens"] for r in report) == sum(r["n_tokens"] for r in scored)
    for name in ("score", "base"):
        total = sum(r[f"{name}_held_out"] * r["held_out_tokens"] for r in report if r["held_out_tokens"])
        own = sum(r["score" if name == "score" else "base_score"] for r in scored)
        assert total == pytest.approx(own, rel=1e-9)
    by = {r["known"]: r for r in report}
    assert 0 < by[True]["arc_train"] < 1 and by[False]["train_tokens"] == 0 and by[False]["arc_held_out"] in (0.0, None)
