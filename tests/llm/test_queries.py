"""Every query with an oracle against DuckDB at sf0.001, the pipeline against
its operators' brute-force versions, and the shape of the registry."""

from __future__ import annotations

import hashlib

import duckdb
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from provlens.llm import bpe, mixing, queries
from tests.conftest import SF_SMALL
from tests.llm import test_rules, test_simhash
from tools.oracle_check import TYPES, digest

TABLES = ("documents", "pages", "conversations", "labels", "benchmark", "embeddings")


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = queries.QUERIES[key](spark, SF_SMALL)
    res = con.sql(queries.ORACLE_SQL[key])
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == dict(zip(res.columns, map(str, res.types)))
    rows = [tuple(r) for r in df.collect()]
    assert digest(df.columns, rows)[0] == digest(res.columns, res.fetchall())[0]


@pytest.mark.parametrize("key", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_return_a_row_per_input_row(spark, key):
    source = "pages" if "main_text" in key else "documents"
    df = queries.QUERIES[key](spark, SF_SMALL)
    assert df.count() == spark.read.parquet(f"{SF_SMALL}/{source}.parquet").count()


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    texts = {}
    verdict = {r["doc_id"]: r["kept"] for r in queries.QUERIES["op8_quality_rules"](spark, SF_SMALL).collect()}
    for i, r in rows.items():
        if test_rules.measures(r["text"])[5]:
            assert not verdict[i]
        if verdict[i]:
            texts[i] = r["text"]
    order = sorted(texts)
    root = test_simhash.groups([test_simhash.fingerprint(texts[i]) for i in order])
    texts = {i: texts[i] for i, r in zip(order, root) if order[r] == i}
    data = [(i, texts[i].encode()) for i in sorted(texts)]
    cut = {}
    seen = set()
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k:k + 100] in seen:
                gone[k:k + 100] = b"\1" * 100
            seen.add(b[k:k + 100])
        cut[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    kept = spark.createDataFrame([(i, t, rows[i]["source"]) for i, t in cut.items()],
                                 "doc_id bigint, text string, source string")
    times = {r["doc_id"]: r["copies"] for r in mixing.mix_report(kept).collect()}
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = sorted((i, tuple(library.encode(t, add_special_tokens=False).ids)) for i, t in cut.items()
                  for _ in range(times[i]))
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert sorted((r["doc_id"], tuple(r["ids"])) for r in out) == want
    assert all(r["decoded_sha256"] == hashlib.sha256(cut[r["doc_id"]].encode()).hexdigest() for r in out)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_SMALL).columns == docs.columns


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_SMALL).collect() == []

