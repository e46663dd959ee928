from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from provlens.llm import bpe
from tests.llm import edge


@pytest.fixture(scope="module")
def pair():
    path = bpe.default_vocabulary()
    return bpe.Bpe(path), Tokenizer.from_file(path)


def same(pair, texts):
    ours, theirs = pair
    want = theirs.encode_batch(texts, add_special_tokens=False)
    for text, got, ref in zip(texts, ours.encode(texts), want):
        assert got.tolist() == ref.ids, text[:80]
        assert ours.decode(got) == theirs.decode(ref.ids, skip_special_tokens=False)


def test_awkward_texts(pair):
    rng = random.Random(4)
    alphabet = "abcde  \n\t'’<|>éß日🙂0½٣ \x1c\x85"
    texts = ["", " ", "  ", "\n\n x", "<|endoftext|>", "a<|endoftext|> b  <|endoftext|>", "<|endoftext", "x" * 1000,
             "ab" * 700, "don't we'LL they're", "three   spaces \n \t mixed \n ", "\x00\x01"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(1500)]
    texts += ["".join(rng.choice("thean") for _ in range(rng.randrange(1, 300))) for _ in range(200)]
    same(pair, texts)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(pair, text):
    same(pair, [text])


def test_one_tree_and_many_trees_agree(pair):
    rng = random.Random(5)
    words = ["".join(rng.choice("ethainsor") for _ in range(rng.randrange(1, 100))).encode() for _ in range(300)]
    ids, ends = pair[0].merge_rows(words)
    for word, part in zip(words, np.split(ids, ends[:-1])):
        assert pair[0].merge_one(word).tolist() == part.tolist()


def test_memory_is_bounded(pair, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    for i in range(5):
        same(pair, [" ".join(f"w{i}x{k}" for k in range(60))])
    assert len(pair[0].known) + len(pair[0].blank) < 1000


def test_table(spark, pair):
    rows = edge.texts()
    want = []
    for i, t, _ in rows:
        ids = pair[1].encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(pair[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    docs = edge.documents(spark, rows)
    assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=str) == sorted(want, key=str)
    back = bpe.decoded(bpe.encoded(docs, keys=("doc_id", "source"))).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in back) == sorted(str((i, t or "")) for i, t, _ in rows)
    assert bpe.round_trip(edge.documents(spark, [])).collect() == []
