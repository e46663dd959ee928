from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from provlens.llm import queries, rules
from tests.llm import edge


def measures(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    n = len(words)
    return (n, sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def rows():
    prose = "The quick brown fox jumps over the lazy dog while many other animals look on and wonder what it is about today"
    return edge.texts() + [
        (100, prose, "a"), (101, prose + "\n" + prose, "a"), (102, "a " * 500, "a"), (103, prose.upper(), "a"),
        (104, prose.replace(" ", " # "), "a"), (105, "\n".join(["same line here"] * 9 + [prose]), "a"),
        (106, prose.replace(" ", "!! "), "a"), (107, " ".join("abcdefghijklmnopqrstuvwxyz"), "a"),
        (108, " ".join(f"w{i % 9}" for i in range(30)) + " " + prose, "a"),
        (109, " ".join("supercalifragilistic" + str(i) for i in range(30)), "a")]


def test_measures_and_base(spark):
    got = rules.quality_report(edge.documents(spark, rows())).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, *tuple(r)[1:7]) for r in got) == sorted(
        (i is None, i or 0, *measures(t)) for i, t, _ in rows())
    assert all(not r["kept"] for r in got if r["base_failed"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert 100 in kept and not kept & {1, 2, 101, 102, 103, 104, 105, 106, 107, 109}


def test_the_order_of_rules_changes_no_verdict(spark):
    docs = edge.documents(spark, rows())
    declared = rules.default_rules()
    names = {r.name for r in declared}
    profile = rules.profiled(docs, declared)
    assert {p["rule"].name for p in profile} == names and all(p["cost"] > 0 for p in profile)
    best = rules.ordered(profile)
    value = [next(p["rejected"] / p["cost"] for p in profile if p["rule"] is r) for r in best]
    assert value == sorted(value, reverse=True)
    verdicts = [sorted(map(str, _kept(docs, order).collect())) for order in (declared, declared[::-1], best)]
    assert verdicts[0] == verdicts[1] == verdicts[2]


def _kept(docs, order):
    t = F.coalesce("text", F.lit(""))

    def verdict(w):
        return rules.rejected_by(order, t, w)

    return docs.filter(rules.let(rules.words_of(t), verdict).isNull())


def rows_for_every_rule():
    rng = random.Random(5)
    prose = "The quick brown fox jumps over the lazy dog while many other animals look on and wonder what it is about today"
    few = " ".join(rng.choice(["ha", "ho", "hey"]) for _ in range(4000))
    many = " ".join(f"w{rng.randrange(150)}" for _ in range(4000))  # 150 of 4000 words, but no stutter
    return rows() + [(200, "short", "a"), (201, few, "a"), (202, many, "a"), (203, few[:400], "a"),
                     (204, many + " " + few[:300], "a"), (205, " ".join(few.split()[:99]), "a"),
                     (206, "\n".join(prose + f" {i % 3}" for i in range(9)), "a")]


def test_every_rule_rejects_and_the_sql_agrees(spark):
    docs = edge.documents(spark, rows_for_every_rule())
    t, w = F.coalesce("text", F.lit("")), F.col("w")
    hits = docs.select(t.alias("text")).withColumn("w", rules.words_of(F.col("text"))).agg(
        *[F.count_if(r.rejects(F.col("text"), w)).alias(r.name) for r in rules.default_rules()]).first().asDict()
    assert all(n > 0 for n in hits.values()), hits
    assert set(hits) == {r.name for r in rules.default_rules()}
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toArrow()
    con.register("documents", documents)
    res = con.sql(queries.OP8_SQL)
    got = rules.quality_report(docs).select(*res.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, res.fetchall()))
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert 202 in kept and not kept & {200, 201}


def test_the_sample_is_bounded_and_from_all_partitions(spark):
    docs = spark.createDataFrame([(f"text {i}",) for i in range(4000)], "text string").repartition(8)
    texts = {r["t"] for r in rules.sample_of(docs, sample_rows=200).collect()}
    assert 100 < len(texts) <= 400
    first = {r["text"] for r in docs.where(F.spark_partition_id() == 0).collect()}
    assert 0 < len(texts & first) < len(texts) / 2


def test_later_rules_are_not_evaluated_for_rejected_documents(spark):
    docs = edge.documents(spark, [(1, "reject me", "a"), (2, "reject me too", "a")])
    order = [rules.Rule("first", lambda t, w: F.size(w) < 20),
             rules.Rule("fails", lambda t, w: F.raise_error(F.lit("evaluated")).cast("boolean"))]
    assert _kept(docs, order).collect() == []


def test_stage_and_report_agree(spark):
    docs = edge.documents(spark, rows())
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        str(r["doc_id"]) for r in rules.quality_report(docs).collect() if r["kept"])


def test_stuttering_does_not_depend_on_length(spark):
    rng = random.Random(2)
    prose = [f"w{int(rng.paretovariate(0.5)) % 3000}" for _ in range(150_000)]  # 2% distinct, but never a stutter
    few = [rng.choice(["ha", "ho", "hey", "so"]) for _ in range(150_000)]
    five = [f"w{i % 5}" for i in range(1000)]
    sizes = (99, 100, 101, 250, 1000, 20_000, 150_000)
    rows = [(k, " ".join(prose[:k]), "a") for k in sizes] + [(-k, " ".join(few[:k]), "a") for k in sizes]
    rows += [(7, " ".join(five), "a"), (8, "", "a"), (9, None, "a")]
    rule = next(r for r in rules.default_rules() if r.name == "stuttering")
    docs = edge.documents(spark, rows)
    t = F.coalesce("text", F.lit(""))
    hit = {r["doc_id"] for r in docs.filter(rules.let(rules.words_of(t), lambda w: rule.rejects(t, w))).collect()}
    assert hit == {-k for k in sizes if k >= 100}
    assert 150_000 in {r["doc_id"] for r in rules.keep_good(docs).collect()}


def test_empty_table_and_native_plan(spark):
    docs = edge.documents(spark, [])
    assert rules.quality_report(docs).collect() == [] and rules.keep_good(docs).collect() == []
    plan = rules.quality_report(edge.documents(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
