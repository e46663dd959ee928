"""Jump consistent hashing: the sequence, stability, slots and files."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from provlens.llm import shards as S
from tests.conftest import SF_SMALL
from tests.llm.edge import documents, texts


def plain_jump(key, n):
    at, nxt = -1, 0
    while nxt < n:
        at = nxt
        key = (key * S.MULTIPLIER + 1) % 2 ** 64
        nxt = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at


def key_of(i):
    return int(hashlib.md5(b"null" if i is None else f"k{i}".encode()).hexdigest()[:15], 16)


def test_jump_sequence():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 2000)
    for n in (1, 2, 8, 9, 1000):
        got = S.jump(keys, n)
        assert got.tolist() == [plain_jump(int(k), n) for k in keys]
        more = S.jump(keys, n + 1)
        assert ((got == more) | (more == n)).all()  # rows move into the new shard only
        assert abs((more == n).mean() - 1 / (n + 1)) < 0.05


def test_report_on_edge_rows(spark):
    got = S.shard_report(documents(spark).repartition(3)).collect()
    assert len(got) == len(texts())
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "key"
        assert (r["shard"], r["grown_shard"]) == (plain_jump(key_of(r["doc_id"]), 8), plain_jump(key_of(r["doc_id"]), 9))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in texts())
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == want


def test_slots_follow_the_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("row_no", F.lit("clash"))
    path = str(tmp_path / "out")
    S.write_shards(docs, path, 5)
    schema = ", ".join(f"{f.name}{'__in' if f.name == 'row_no' else ''} {f.dataType.simpleString()}" for f in docs.schema)
    back = S.read_shards(spark, path, schema)
    assert back.count() == docs.count()
    assert {r["row_no__in"] for r in back.collect()} == {"clash"}
    parts = S.manifest(spark, path).collect()
    assert sum(r["rows"] for r in parts) == docs.count()
    by_shard = defaultdict(list)
    for r in back.collect():
        by_shard[r["shard"]].append((r["slot"], r["doc_id"]))
    for rows in by_shard.values():
        rows.sort()
        assert [s for s, _ in rows] == list(range(len(rows)))
        assert [i for _, i in rows] == sorted(i for _, i in rows)


def test_copies_of_one_row_are_spread(spark):
    docs = spark.createDataFrame([(None, "same")] * 4000, "doc_id bigint, text string").repartition(8)
    got = S.shard_report(docs)
    assert sorted(r["slot"] for r in got.collect()) == list(range(4000))
    assert len({r["shard"] for r in got.collect()}) == 1


def test_empty_table_and_bad_number(spark):
    assert S.shard_report(documents(spark, [])).collect() == []
    with pytest.raises(ValueError):
        S.shard_of(F.col("doc_id"), 0)
