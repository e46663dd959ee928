"""Byte ranges, one-file exports, catalogue documents and external wide files."""

from __future__ import annotations

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from provlens.operators.engagement import Measure, resolve_names
from provlens.sources import onefile, ranges
from provlens.sources.files import read_catalog_document, read_csv, write_csv
from provlens.sources.results import open_wide


@pytest.fixture
def small_ranges(spark):
    """Files are split every few hundred bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def awkward(n, seed=1):
    rng = random.Random(seed)
    alphabet = ['"', ",", "\n", "a", "b c", "é", "\n\n", '""', "'", "\\", "{", "}", "[", "]", ":", "x" * 40]
    return [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))), rng.choice([None, "plain", "", "two\nlines"]))
            for i in range(n)] + [(n, "long " + 'line "of" text,\n' * 200, None)]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


SCHEMA = "id bigint, text string, other string"


@pytest.mark.parametrize("parts", [1, 3])
def test_quoted_csv_is_split_and_equals_the_whole_file_reader(spark, tmp_path, small_ranges, parts):
    df = spark.createDataFrame(awkward(150), SCHEMA).repartition(parts)
    path = str(tmp_path / "t.csv")
    write_csv(df, path)
    whole = spark.read.schema(SCHEMA).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    got = ranges.read_quoted_csv(spark, path, SCHEMA)
    assert as_rows(got) == as_rows(whole) and got.schema == whole.schema
    assert read_csv(spark, path, SCHEMA, multiline=True).count() == 151
    assert ranges._lines(spark, path, "\n").rdd.getNumPartitions() > 20
    text = ranges.read_quoted_csv(spark, path)
    assert text.columns == ["id", "text", "other"] and {t for _, t in text.dtypes} == {"string"}
    assert sorted(r["id"] for r in text.collect()) == sorted(str(i) for i in range(151))


def test_quoted_csv_line_ends_and_empty_files(spark, tmp_path, small_ranges):
    (tmp_path / "w.csv").write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n')
    assert as_rows(ranges.read_quoted_csv(spark, str(tmp_path / "w.csv"), "a int, b string")) == [(1, "x\r\ny"), (2, "z")]
    (tmp_path / "h.csv").write_text("a,b\n")
    assert as_rows(ranges.read_quoted_csv(spark, str(tmp_path / "h.csv"))) == []
    (tmp_path / "o.csv").write_text('a\n"' + "l\n" * 2000 + '"\nlast')  # one record over many ranges, no line feed at the end
    assert as_rows(ranges.read_quoted_csv(spark, str(tmp_path / "o.csv"), "a string")) == [("l\n" * 2000,), ("last",)]


def test_one_file_has_the_bytes_of_one_task(spark, tmp_path):
    names = ["id", "a \"quoted\", name", "x.y"]
    df = spark.createDataFrame(awkward(60), SCHEMA).toDF(*names).repartition(5, "id").sortWithinPartitions("id")
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(str(tmp_path / "one"))
    with open(glob.glob(str(tmp_path / "one" / "part-*"))[0], "rb") as f:
        want = f.read()
    assert onefile.write_csv_file(df, str(tmp_path / "out" / "t.csv")) > 1
    assert (tmp_path / "out" / "t.csv").read_bytes() == want
    write_csv(df, str(tmp_path / "folder"), single_file=True)
    write_csv(df, str(tmp_path / "folder"), single_file=True)  # written over
    assert [open(p, "rb").read() for p in glob.glob(str(tmp_path / "folder" / "*"))] == [want]
    onefile.write_csv_file(df.limit(0), str(tmp_path / "none.csv"))
    assert (tmp_path / "none.csv").read_bytes() == want.split(b"\n")[0] + b"\n"


def test_parts_are_streamed_where_the_store_is_not_a_local_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(onefile.fs, "LocalFileSystem", type("Other", (), {}))
    monkeypatch.setattr(onefile, "COPY_BYTES", 7)
    df = spark.createDataFrame(awkward(20), SCHEMA).repartition(3)
    onefile.write_catalog_document(df, str(tmp_path / "d.json"), "drugs")
    assert len(json.loads((tmp_path / "d.json").read_text())["drugs"]) == 21


def test_catalogue_document_is_written_by_ranges_and_read_back(spark, tmp_path, small_ranges):
    df = spark.createDataFrame(awkward(200, 4), SCHEMA)
    path = str(tmp_path / "cat" / "c.json")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert onefile.write_catalog_document(df, path, 'the "drugs"') > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with open(path, encoding="utf-8") as f:
        (field, items), = json.load(f).items()
    assert field == 'the "drugs"' and [x["id"] for x in items] == list(range(201))
    back = read_catalog_document(spark, path, SCHEMA)
    assert as_rows(back) == as_rows(df)
    assert ranges._lines(spark, path, "}").rdd.getNumPartitions() > 20
    onefile.write_catalog_document(df.limit(0), path, "drugs")
    assert json.load(open(path)) == {"drugs": []} and read_catalog_document(spark, path, SCHEMA).collect() == []


@pytest.mark.parametrize("indent", [None, 0, 4])
def test_documents_of_other_writers(spark, tmp_path, small_ranges, indent):
    rows = [{"id": i, "text": t, "other": {"deep": [{"x": "}"}, {"y": o}]}} for i, t, o in awkward(120, 9)]
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"drugs": rows}, indent=indent, ensure_ascii=False), encoding="utf-8")
    got = read_catalog_document(spark, str(path), "id bigint, text string, other struct<deep: array<struct<x: string, y: string>>>")
    assert sorted((r["id"], r["text"], r["other"]["deep"][1]["y"]) for r in got.collect()) == [
        (r["id"], r["text"], r["other"]["deep"][1]["y"]) for r in rows]
    path.write_text(json.dumps({"drugs": []}, indent=indent))
    assert read_catalog_document(spark, str(path), "id bigint").collect() == []


KNOWN = ["Patients", "Claims", "OTHERS_GENERAL", "GENERAL", "FOOD&BEVERAGE"]


def test_names_of_wide_columns():
    got = resolve_names(["DRUG_A_OTHERS_GENERAL", "DRUG_A_Claims", "B_patients", "A.B (X)_FOOD&BEVERAGE"], KNOWN)
    assert got == [Measure("DRUG_A_OTHERS_GENERAL", "DRUG_A", "OTHERS_GENERAL"), Measure("DRUG_A_Claims", "DRUG_A", "Claims"),
                   Measure("B_patients", "B", "Patients"), Measure("A.B (X)_FOOD&BEVERAGE", "A.B (X)", "FOOD&BEVERAGE")]
    assert resolve_names(["A_OTHERS_GENERAL"], KNOWN)[0].drug == "A"
    # the shorter reading where only its drug is known
    assert resolve_names(["A_OTHERS_GENERAL", "A_OTHERS_Claims"], KNOWN)[0] == Measure("A_OTHERS_GENERAL", "A_OTHERS", "GENERAL")
    for names, said in ((["A_OTHERS_GENERAL", "A_Claims", "A_OTHERS_Claims"], "can be read as"), (["A_Other"], "no known measure"),
                        (["_Claims"], "no known measure"), (["A_Claims", "A_claims"], "one cell")):
        with pytest.raises(ValueError, match=said):
            resolve_names(names, KNOWN)


def test_external_wide_file(spark, tmp_path):
    (tmp_path / "w.csv").write_text(
        "npi,last_name,Facility_Name_1,Org_pac_id_1,DRUG_A_OTHERS_GENERAL,DRUG_A_Claims,B_C_NEW\n"
        '1,X,"two\nlines",7,5,0,2\n2,Y,,,0,3,0\n')
    opened = open_wide(spark, str(tmp_path / "w.csv"), ["NEW"])
    assert sorted(tuple(r) for r in opened.engagement.collect()) == [
        (1, "B_C", "NEW", 2), (1, "DRUG_A", "OTHERS_GENERAL", 5), (2, "DRUG_A", "Claims", 3)]
    assert opened.profile.where("npi = 1").first()["Facility_Name_1"] == "two\nlines"
    assert dict(opened.profile.dtypes)["Org_pac_id_1"] == "bigint"
    assert opened.viewed_facts().agg(F.sum("amount")).first()[0] == 10
    with pytest.raises(ValueError, match="no known measure"):
        open_wide(spark, str(tmp_path / "w.csv"))
