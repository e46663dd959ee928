from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np

from provlens.llm import phrases
from tests.llm import edge


def order(row):
    i, t, _ = row
    return (i is None, i or 0, t or "")


MASK = (1 << 64) - 1


def plain_mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_labels(names):
    """Coin tossing, one symbol after the other."""
    for _ in range(phrases.TOSSES):
        now = [names[0] & 1]
        for left, x in zip(names, names[1:]):
            place = 0
            while (left >> place & 1) == (x >> place & 1):
                place += 1
            now.append(2 * place + (x >> place & 1))
        names = now
    return names


def plain_phrases(names):
    """The next level of one document."""
    runs = [(x, len(list(g))) for x, g in groupby(names)]
    names = [plain_mixed(x ^ plain_mixed(n << 32)) if n > 1 else x for x, n in runs]
    label = plain_labels(names)
    assert max(label) < 6 and all(a != b for a, b in zip(label, label[1:]))
    blocks = [[names[0]]]
    for i in range(1, len(names)):
        if 1 < i < len(names) - 1 and label[i - 1] > label[i] < label[i + 1]:
            blocks.append([])
        blocks[-1].append(names[i])
    return [plain_mixed(sum(plain_mixed(x + j * 0x9E3779B97F4A7C15 & MASK) for j, x in enumerate(b)) & MASK)
            for b in blocks]


def plain_sketch(text):
    bins = [phrases.EMPTY] * phrases.BINS
    names = [plain_mixed(ord(c) + 1) for c in text]
    for level in (1, 2, 3):
        names = plain_phrases(names) if names else []
        for x in names if level in phrases.LEVELS else ():
            h = plain_mixed(x + level & MASK)
            bins[h % phrases.BINS] = min(bins[h % phrases.BINS], h >> 40, phrases.EMPTY - 1)
    return bins


def plain_likeness(a, b):
    filled = [(x, y) for x, y in zip(a, b) if (x, y) != (phrases.EMPTY, phrases.EMPTY)]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def brute(rows):
    """The report by a parser that goes through one text symbol by symbol."""
    rows = sorted(rows, key=order)
    out = []
    for k, (i, t, _) in enumerate(rows):
        t, after = list(t or ""), list(rows[(k + 1) % len(rows)][1] or "")
        quarter = len(t) // 4
        changed = "".join(t[:len(t) - quarter] + after[:quarter])
        a, b, c = plain_sketch(t), plain_sketch(changed), plain_sketch(after)
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), "".join("%06x" % v for v in a),
                    "".join("%06x" % v for v in b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    return out


def reported(docs):
    return sorted([tuple(r)[:5] + (round(r[5], 9), round(r[6], 9))
                   for r in phrases.fingerprint_report(docs).collect()], key=str)


def test_report_matches_brute_force(spark):
    rows = edge.texts()
    assert reported(edge.documents(spark, rows).repartition(5)) == sorted(brute(rows), key=str)


def test_branches_of_the_plan_agree_without_exchange_reuse(spark):
    rows = [(i * 7919 % 3001, f"text {i * i % 977} of document {i}", None) for i in range(400)] + [
        (None, "no id", None), (None, None, None)]
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert reported(edge.documents(spark, rows).repartition(7)) == sorted(brute(rows), key=str)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_ids_as_text(spark):
    rows = [(f"id-{i * 37 % 101:03d}", f"some text {i}", None) for i in range(60)] + [(None, "last", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string").repartition(5)
    by_id = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    got = {r["doc_id"]: r["edited_sha256"] for r in phrases.fingerprint_report(docs).collect()}
    want = {r[0]: hashlib.sha256(phrases.edited(r[1], by_id[(k + 1) % len(by_id)][1]).encode()).hexdigest()
            for k, r in enumerate(by_id)}
    assert got == want


def test_texts_go_through_one_shuffle(spark):
    report = phrases.fingerprint_report(edge.documents(spark).repartition(5))
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString()
    plan = plan[:plan.index("== Initial Plan ==")]
    assert "ReusedExchange" in plan


def test_one_row_and_no_rows(spark):
    assert phrases.fingerprint_report(edge.documents(spark, [])).collect() == []
    (row,) = phrases.fingerprint_report(edge.documents(spark, [(1, "alone and alone", "a")])).collect()
    assert row["near_next"] == 1.0


def test_equal_substrings_share_interior_phrases():
    rng = np.random.default_rng(5)
    def text(n):
        return "".join(rng.choice(list("abcdefgh "), n))
    middle = text(4000)
    def names(t, level):
        x = phrases.mixed(np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1))
        owner = np.zeros(len(x), int)
        for _ in range(level):
            x, owner = phrases.next_level(x, owner)
        return set(x.tolist())
    for level in (1, 2, 3):
        inner = names(middle, level)
        for shift in (1, 17, 333):
            assert len(inner - names(text(shift) + middle + text(shift), level)) <= 12
    a, b, c = (phrases.sketches([x]) for x in (middle, text(500) + middle, text(4500)))
    assert phrases.likeness(a, b)[0] > 0.7 and phrases.likeness(a, c)[0] < 0.1


def test_fingerprints_of_equal_texts_are_equal(spark):
    got = {r["doc_id"]: r["fingerprint"] for r in phrases.fingerprints(edge.documents(spark)).collect()}
    assert got[5] == got[6] and got[1] == got[2] and got[5] != got[7]
