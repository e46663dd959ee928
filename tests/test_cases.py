"""Hand-made cases the test data cannot plant (FIXTURES.md section 3)."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from provlens.operators import affiliations as A
from provlens.operators import claims as C
from provlens.operators import engagement as E
from provlens.operators import payments as P
from provlens.operators import registry as R
from provlens.operators import viewer as V
from provlens.plans import profile as PR
from provlens.sources.results import SavedGroups, save_groups
from provlens.sources.selections import Selections

PAY = ("Covered_Recipient_NPI", "amount", "date", "nature", "drug")


def pay(npi, amount, nature, drug):
    return (npi, amount, "2024-01-01", nature, drug)


def provider(npi, code="1", postal="12345"):
    return (npi, f"Last{npi}", "First", None, postal, code, None, None)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_duplicate_interest_row_doubles_by_default(spark, make_src):
    src = make_src(part_d=[(1, "Humira", "adalimumab", 10, 2)])
    sel_rows = [("humira", "adalimumab", "HUMIRA"), ("humira", "other generic", "HUMIRA")]
    doubled = Selections.from_rows(spark, part_d=sel_rows)
    once = Selections.from_rows(spark, part_d=sel_rows, dedupe_interest=True)
    assert rows(C.by_drug(C.part_d_normalised(src.part_d, doubled)), "drug", "claims") == [("HUMIRA", 20)]
    assert rows(C.by_drug(C.part_d_normalised(src.part_d, once)), "drug", "claims") == [("HUMIRA", 10)]


def test_blank_first_mapping_row_and_duplicates(spark, make_src):
    src = make_src(payments=[pay(1, 5.9, "Gift", "X"), pay(1, 3.2, "Education", "X")])
    sel = Selections.from_rows(spark, drugs=["x"], category_map=[
        ("Gift", ""), ("Education", "EDUCATION"), ("Education", "NaN"), ("Gift", "null")])
    out = rows(P.payments_mapped(src.payments, sel), "npi", "drug", "category", "amount")
    assert out == [(1, "X", "EDUCATION", 3), (1, "X", "OTHERS_GENERAL", 5)]


def test_first_rename_of_a_nature_wins(spark, make_src, tmp_path):
    src = make_src(payments=[pay(1, 5.0, "Gift", "X"), pay(1, 3.0, "Education", "X")])
    pairs = [("Gift", "zebra"), ("Education", "null"), ("Gift", "ant"), ("Education", "school"), ("Education", "alpha")]
    want = [(1, "X", "SCHOOL", 3), (1, "X", "ZEBRA", 5)]
    lists = Selections.from_rows(spark, drugs=["x"], category_map=pairs)
    (tmp_path / "drugs.csv").write_text("Drug_Name\nx\n")
    (tmp_path / "taxonomy.csv").write_text("Code\n")
    (tmp_path / "category_map.csv").write_text("Original,Renamed\n" + "".join(f"{a},{b}\n" for a, b in pairs))
    sheets = Selections.from_folder(spark, tmp_path.as_uri())
    (tmp_path / "many").mkdir()  # one row a file, in the order of the names
    for i, (a, b) in enumerate(pairs):
        (tmp_path / "many" / f"part-{i}.csv").write_text(f"Original,Renamed\n{a},{b}\n")
    parts = Selections.from_files(spark, {"drugs": str(tmp_path / "drugs.csv"), "category_map": str(tmp_path / "many")})
    for sel in (lists, sheets, parts):
        assert rows(P.payments_mapped(src.payments, sel), "npi", "drug", "category", "amount") == want


def test_more_measures_than_a_table_has_columns(spark, make_src, tmp_path):
    drugs = [f"D{i}" for i in range(1800)]
    renames = [(f"N{i}", f"C{i}") for i in range(9)]
    src = make_src(payments=[pay(1, 5.0, "N0", "D0"), pay(1, 7.0, "N8", "D1799"), pay(2, 3.0, "other", "D900"), pay(3, -1.0, "N1", "D1")],
                   providers=[(i, "a", "b", "c", "1", None, None, None) for i in (1, 2, 3, 4)])
    sel = Selections.from_rows(spark, drugs=drugs, category_map=renames)
    opts = PR.ProfileOptions(part_b=False, part_d=False, with_affiliations=False)
    places = PR.measure_places(sel, opts)
    out = str(tmp_path / "wide")
    assert save_groups(out, PR.sparse_profile(src, sel, places, opts), places, 4000) == 5
    opened = SavedGroups(spark, out, 4000)
    assert opened.places.count() == 18_000
    assert rows(opened.profile, "npi", "total") == [(1, 12), (2, 3)]
    got = opened.of_drugs(["D0", "D1799", "D900"])
    assert len(got.columns) == 31
    assert rows(got, "npi", "D0_C0", "D1799_C8", "D900_OTHERS_GENERAL", "D900_C1") == [(1, 5, 7, 0, 0), (2, 0, 0, 3, 0)]


def test_category_absent_from_data_is_a_zero_column(spark, make_src):
    src = make_src(payments=[pay(7, 10.0, "Education", "X")])
    sel = Selections.from_rows(spark, drugs=["X"], category_map=[("Education", "EDUCATION"),
                                                                  ("Travel and Lodging", "TRAVEL")])
    wide = E.pivot_wide(P.payments_long(P.payments_mapped(src.payments, sel)), E.payment_measures(sel))
    assert set(wide.columns) == {"npi", "X_EDUCATION", "X_TRAVEL", "X_OTHERS_GENERAL"}
    assert wide.collect()[0].asDict() == {"npi": 7, "X_EDUCATION": 10, "X_TRAVEL": 0, "X_OTHERS_GENERAL": 0}


def test_drug_spelled_in_two_cases_is_one_drug(spark, make_src):
    src = make_src(payments=[pay(1, 10.0, "Education", "Humira"), pay(1, 5.0, "Education", "HUMIRA "),
                             pay(None, 99.0, "Education", "Humira")])
    sel = Selections.from_rows(spark, drugs=["humira"], category_map=[("Education", "EDUCATION")])
    wide = E.pivot_wide(P.payments_long(P.payments_mapped(src.payments, sel)), E.payment_measures(sel))
    assert rows(wide, "npi", "HUMIRA_EDUCATION") == [(1, 15)]


def test_drug_names_with_separators_round_trip(spark, make_src):
    names = ["A_B", "A.B", "A (X)"]
    src = make_src(payments=[pay(1, 2.0, "Education", n) for n in names])
    sel = Selections.from_rows(spark, drugs=names, category_map=[("Education", "EDUCATION")])
    ms = E.payment_measures(sel)
    wide = E.pivot_wide(P.payments_long(P.payments_mapped(src.payments, sel)), ms)
    back = rows(E.wide_to_long(wide, ms, spark), "drug", "measure", "amount")
    assert back == sorted((n, "EDUCATION", 2) for n in names)
    # OTHERS_GENERAL keeps its full name in the long form
    assert {m.measure for m in ms} == {"EDUCATION", "OTHERS_GENERAL"}


def _profile_src(make_src):
    return make_src(
        part_b=[(1, "P1", "desc", 3, 2.7), (2, "P1", "desc", 1, 1.0)],
        part_d=[(1, "Brand#2", "gen", 4, None), (3, "Brand#2", "gen", 0, None)],
        payments=[pay(1, 10.5, "Education", "brand#2"), pay(2, -1.0, "Education", "Brand#1")],
        providers=[provider(1), provider(2), provider(3, code="9")],
        taxonomy=[("1", "Class1", "Spec1"), ("9", "Class9", None)],
        affiliations=[(1, "Fac B", 12.7), (1, "Fac A", 3.2), (1, "Fac A", 3.2), (2, "Fac C", 1.0),
                      (3, "Fac D", 2.0), (1, None, 5.0)],
    )


def _sel(spark, part_b=True, part_d=True, taxonomy=("1", "9")):
    return Selections.from_rows(
        spark,
        part_b=[("P1", "brand#1")] if part_b else None,
        part_d=[("BRAND#2", "gen", "Brand#2")] if part_d else None,
        drugs=["Brand#1", "Brand#2"], taxonomy=taxonomy,
        category_map=[("Education", "EDUCATION")])


def test_profile_modes_have_the_same_block_shape(spark, make_src):
    src = _profile_src(make_src)
    full = PR.profile(src, _sel(spark))
    d_only = PR.profile(src, _sel(spark, part_b=False), PR.ProfileOptions(part_b=False))
    neither = PR.profile(src, _sel(spark, part_b=False, part_d=False),
                         PR.ProfileOptions(part_b=False, part_d=False))
    head = list(R.PROVIDER_BLOCK) + list(A.affiliation_block())
    for df in (full, d_only, neither):
        assert df.columns[:len(head)] == head
    assert "BRAND#1_Claims" in full.columns and "BRAND#1_Claims" not in d_only.columns
    assert "BRAND#2_Claims" in d_only.columns
    assert not any(c.endswith(("_Claims", "_Patients")) for c in neither.columns)


def test_activity_filter_drops_zero_and_negative(spark, make_src):
    src = _profile_src(make_src)
    out = PR.profile(src, _sel(spark), keep_total=True)
    totals = {r["npi"]: r["total"] for r in out.collect()}
    # npi 2: part B claims 1 + patients 1 - 1 dollar = 1 > 0; npi 3: all zero
    assert totals == {1: 3 + 2 + 0 + 4 + 10, 2: 1}


def test_first_facilities_are_sorted_and_cut(spark, make_src):
    src = _profile_src(make_src)
    top = A.affiliations_top(A.affiliations_clean(src.affiliations), 1)
    assert rows(top, "npi", "Facility_Name_1", "Org_pac_id_1") == [(1, "Fac A", 3), (2, "Fac C", 1),
                                                                   (3, "Fac D", 2)]


def test_empty_taxonomy_selection_means_no_filter(spark, make_src):
    src = _profile_src(make_src)
    everyone = R.registry_filtered(src.providers, src.taxonomy, _sel(spark, taxonomy=()))
    only_nine = R.registry_filtered(src.providers, src.taxonomy, _sel(spark, taxonomy=("9",)))
    assert everyone.count() == 3
    assert rows(only_nine, "npi", "Primary_Classification", "Primary_Specialization") == [(3, "Class9", None)]


def test_postal_codes(spark):
    df = spark.createDataFrame([("501",), ("12345",), ("1234567",), ("123456789",), (None,), ("1234567890",)],
                               "postal_code string")
    got = [r[0] for r in df.select(V.format_postal("postal_code")).collect()]
    assert got == ["00501", "12345", "00123-4567", "12345-6789", None, "1234567890"]


def test_selection_pairs_with_blank_brand_are_rejected(spark):
    sel = Selections.from_rows(spark, part_b=[("P1", " "), ("P2", "x"), (" ", "y")],
                               drugs=[" ", "nan", "a"], category_map=[])
    assert rows(sel.part_b, "code", "drug") == [("P2", "X")]
    assert rows(sel.drugs, "drug") == [("A",)]


def test_truncation_versus_floor(spark):
    df = spark.createDataFrame([(-1.9,), (1.9,), (3e30,)], "x double")
    from provlens.functions.normalise import floor_to_bigint, truncate_to_bigint
    got = [tuple(r) for r in df.select(truncate_to_bigint("x"), floor_to_bigint(F.col("x"))).collect()]
    assert got[0] == (-1, -2) and got[1] == (1, 1) and got[2][0] is None


def test_selections_save_and_load(spark, tmp_path):
    from provlens.sources.selections import save_selections, stack_selections
    sel = Selections.from_rows(spark, part_b=[("P1", "a")], part_d=None, drugs=["x", "y"],
                               taxonomy=["1"], category_map=[("click", "EDU"), ("error", "")])
    save_selections(sel, str(tmp_path / "sel"))
    back = Selections.load(spark, str(tmp_path / "sel"))
    assert back.part_d is None
    assert rows(stack_selections(back), "kind", "key", "value") == rows(stack_selections(sel), "kind", "key", "value")
    assert back.categories() == ["EDU", "OTHERS_GENERAL"]


def test_public_files_with_published_headers(spark, tmp_path):
    from provlens.sources.public_files import PublicFiles
    d = tmp_path
    (d / "b.csv").write_text("Rndrng_NPI,Extra,HCPCS_Cd,HCPCS_Desc,Tot_Benes,Tot_Srvcs\n1,x,P1,desc,3,2.5\n")
    (d / "d.csv").write_text("Prscrbr_NPI,Brnd_Name,Gnrc_Name,Tot_Clms,Tot_Benes\n1,Humira,ada,4,\n")
    (d / "p.csv").write_text(
        "Covered_Recipient_NPI,Total_Amount_of_Payment_USDollars,Date_of_Payment,"
        "Number_of_Payments_Included_in_Total_Amount,Form_of_Payment_or_Transfer_of_Value,"
        "Nature_of_Payment_or_Transfer_of_Value,Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1\n"
        "1,10.9,01/02/2023,1,Cash,Education,Humira\n")
    (d / "n.csv").write_text(
        '"NPI","Provider Last Name (Legal Name)","Provider First Name","Provider Middle Name",'
        '"Provider First Line Business Mailing Address","Provider Business Mailing Address City Name",'
        '"Provider Business Mailing Address State Name","Provider Business Mailing Address Postal Code",'
        '"Healthcare Provider Taxonomy Code_1","Healthcare Provider Taxonomy Code_2",'
        '"Healthcare Provider Taxonomy Code_3"\n'
        '"1","DOE","JANE","","1 MAIN ST","TOWN","ST","021381234","207R00000X","",""\n')
    (d / "t.csv").write_text("Code,Grouping,Classification,Specialization\n207R00000X,G,Internal Medicine,\n")
    (d / "a.csv").write_text("NPI,Facility Name,org_pac_id\n1,General Hospital,123.0\n")
    src = PublicFiles(spark, {"part_b": str(d / "b.csv"), "part_d": str(d / "d.csv"),
                              "payments": str(d / "p.csv"), "providers": str(d / "n.csv"),
                              "taxonomy": str(d / "t.csv"), "affiliations": str(d / "a.csv")})
    sel = Selections.from_rows(spark, part_b=[("P1", "humira")], part_d=[("humira", "ada", "humira")],
                               drugs=["Humira"], taxonomy=["207R00000X"],
                               category_map=[("Education", "EDUCATION")])
    shapes: dict = {}
    out = PR.profile(src, sel, shapes=shapes).collect()
    assert len(out) == 1
    r = out[0].asDict()
    assert (r["npi"], r["address"], r["postal_code"], r["Primary_Classification"]) == \
        (1, "1 MAIN ST", "021381234", "Internal Medicine")
    assert (r["HUMIRA_EDUCATION"], r["HUMIRA_Claims"], r["HUMIRA_Patients"]) == (10, 2 + 4, 3)
    assert (r["Facility_Name_1"], r["Org_pac_id_1"]) == ("General Hospital", 123)
    assert shapes["result"].get["n_rows"] == 1 and shapes["base"].get["n_rows"] == 1
    assert src.bad_value_counts(["part_b"])["part_b"] == {"Rndrng_NPI": 0, "Tot_Benes": 0, "Tot_Srvcs": 0}
    disp = V.view_display(V.ranked_view(V.view_filtered(PR.profile(src, sel), PR.measures_for(sel), ["All"]),
                                        PR.measures_for(sel), ["All"])).collect()[0]
    assert disp["postal_code"] == "02138-1234" and disp["middle_name"] == "" and disp["city"] == "TOWN"


def test_selections_from_csv_files(spark, tmp_path):
    (tmp_path / "drugs.csv").write_text("Drug_Name\n humira \n\nKEYTRUDA\n")
    (tmp_path / "map.csv").write_text("Original,Renamed\nEducation,EDUCATION\nGift,\n")
    sel = Selections.from_files(spark, {"drugs": str(tmp_path / "drugs.csv"),
                                        "category_map": str(tmp_path / "map.csv")})
    assert sel.part_b is None and sel.payment_drugs() == ["HUMIRA", "KEYTRUDA"]
    assert sel.categories() == ["EDUCATION", "OTHERS_GENERAL"]
    assert sel.taxonomy.count() == 0


def test_two_phase_pivot_with_separator_names(spark, make_src):
    names = ["A_B", "A.B", "A (X)"]
    src = make_src(payments=[pay(1, 2.0, "Education", n) for n in names] + [pay(2, 1.0, "Gift", "A.B")])
    sel = Selections.from_rows(spark, drugs=names, category_map=[("Education", "EDUCATION")])
    ms = E.payment_measures(sel)
    long = P.payments_long(P.payments_mapped(src.payments, sel))
    a = E.pivot_wide(long, ms, total="total", strategy="conditional")
    b = E.pivot_wide(long, ms, total="total", strategy="two_phase")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*[F.col(f"`{c}`") for c in a.columns]).collect()))


def test_empty_drug_choice_gives_empty_view(spark, make_src):
    src = _profile_src(make_src)
    sel = _sel(spark)
    prof = PR.profile(src, sel)
    ranked = V.ranked_view(V.view_filtered(prof, PR.measures_for(sel), []), PR.measures_for(sel), [])
    assert ranked.count() == 0


def test_wide_profile_builds_quickly_and_is_exact(spark, make_src):
    import time
    drugs = [f"D{i}" for i in range(40)]
    cats = [(f"n{j}", f"C{j}") for j in range(4)]
    pays = [pay(npi, float(npi + k), f"n{k % 5}", drugs[(npi * 7 + k) % 40])
            for npi in range(1, 30) for k in range(12)]
    src = make_src(payments=pays, providers=[provider(n) for n in range(1, 30)],
                   taxonomy=[("1", "Class1", "Spec1")],
                   affiliations=[(n, f"Fac{n}", float(n)) for n in range(1, 30)])
    sel = Selections.from_rows(spark, drugs=drugs, taxonomy=[], category_map=cats)
    t0 = time.time()
    prof = PR.profile(src, sel, PR.ProfileOptions(part_b=False, part_d=False), keep_total=True)
    assert time.time() - t0 < 60  # wide plans must not blow up planning
    ms = PR.measures_for(sel)
    assert len(ms) == 40 * 5 and len(prof.columns) == 11 + 8 + 200 + 1
    got = {r["npi"]: r["total"] for r in prof.select("npi", "total").collect()}
    want = {}
    for npi, amount, _, _, _ in pays:
        want[npi] = want.get(npi, 0) + int(amount)
    assert got == want
    cell = prof.where("npi = 3").select("`D21_C0`").first()[0]
    assert cell == sum(int(a) for n, a, _, na, d in pays if n == 3 and d == "D21" and na == "n0")


def test_csv_bad_records_and_schema_suggestion(spark, tmp_path):
    from provlens.sources.files import read_csv, suggest_schema
    (tmp_path / "t.csv").write_text("Code,Classification,Specialization\n1,A,B\n2,C\n3,D,E,F,G\n")
    df = read_csv(spark, str(tmp_path / "t.csv"),
                  "Code int, Classification string, Specialization string, _bad string", bad_records_column="_bad")
    got = sorted((r["Code"], r["_bad"] is not None) for r in df.collect())
    assert got == [(1, False), (2, True), (3, True)]
    sch = suggest_schema(spark, str(tmp_path / "t.csv"), sampling_ratio=1.0)
    assert [f.name for f in sch.fields] == ["Code", "Classification", "Specialization"]


def test_catalog_document_form(spark, tmp_path):
    from provlens.sources.files import read_catalog_document
    (tmp_path / "c.json").write_text('{"drugs": [{"Brnd_Name": "A", "Gnrc_Name": "a"},\n'
                                     ' {"Brnd_Name": "B", "Gnrc_Name": null}]}')
    df = read_catalog_document(spark, str(tmp_path / "c.json"), "Brnd_Name string, Gnrc_Name string")
    assert rows(df, "Brnd_Name", "Gnrc_Name") == [("A", "a"), ("B", None)]


def test_broadcast_needs_both_row_and_byte_bounds(spark, monkeypatch):
    import provlens.sources.selections as S
    sel = Selections.from_rows(spark, drugs=["a", "b"], category_map=[("x", "Y")])
    assert sel.measured("drugs") == (2, 2) and sel.measured("taxonomy") == (0, 0)
    from tests.test_plans import explain
    assert "strategy=broadcast" in explain(sel.small("drugs").join(sel.drugs, "drug"), "extended")
    monkeypatch.setattr(S, "BROADCAST_MAX_BYTES", 1)
    sel2 = Selections.from_rows(spark, drugs=["a", "b"], category_map=[("x", "Y")])
    assert "strategy=broadcast" not in explain(sel2.small("drugs").join(sel2.drugs, "drug"), "extended")


def test_taxonomy_filter_small_and_large_paths_agree(spark):
    from provlens.sources.tables import Inputs
    from tests.conftest import SF_SMALL
    i = Inputs(spark, SF_SMALL)
    sel = Selections.from_inputs(i)
    reg = R.registry_select(i.providers)
    reg = reg.unionByName(reg.limit(3).withColumn("npi", F.lit(None).cast("bigint")))  # malformed npis
    small = R.taxonomy_code_filter(reg, sel, large=False)
    large = R.taxonomy_code_filter(reg, sel, large=True)
    assert small.count() > 0
    assert small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0
    from tests.test_plans import explain
    plan = explain(large)
    assert "Generate" in plan and "explode" in plan and "LeftSemi" in plan


def test_run_names_from_a_folder(spark, tmp_path):
    from provlens.operators import runs as RN
    for name in ("alice_20241223065426_abc-1", "bob_20241223065427_def-2"):
        (tmp_path / name).write_text("")
    got = rows(RN.parse_run_names(RN.run_names_in_folder(spark, str(tmp_path))), "username", "ts_text", "run_id")
    assert got == [("alice", "20241223065426", "abc-1"), ("bob", "20241223065427", "def-2")]
    (tmp_path / "folder").mkdir()
    assert RN.run_names_in_folder(spark, tmp_path.as_uri()).count() == 2  # files only


def test_run_names_of_a_large_folder_are_listed_by_a_task(spark, tmp_path, monkeypatch):
    from provlens.operators import runs as RN
    wanted = {f"user{i % 7}_20241223065426_{i}" for i in range(2 * RN.LISTED + 5)}
    for name in wanted:
        (tmp_path / name).touch()
    monkeypatch.setattr(RN, "filesystem_of", None)  # here, not in the tasks: the driver does not list
    names = RN.run_names_in_folder(spark, str(tmp_path))
    assert {r["name"] for r in names.collect()} == wanted


def test_run_names_of_an_empty_and_a_missing_folder(spark, tmp_path):
    from provlens.operators import runs as RN
    assert RN.run_names_in_folder(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="none-such"):
        RN.run_names_in_folder(spark, str(tmp_path / "none-such")).collect()



def _write_public_files(d):
    (d / "b.csv").write_text("Rndrng_NPI,Extra,HCPCS_Cd,HCPCS_Desc,Tot_Benes,Tot_Srvcs\n1,x,P1,desc,3,2.5\n")
    (d / "d.csv").write_text("Prscrbr_NPI,Brnd_Name,Gnrc_Name,Tot_Clms,Tot_Benes\n1,Humira,ada,4,\n")
    (d / "p.csv").write_text(
        "Covered_Recipient_NPI,Total_Amount_of_Payment_USDollars,Date_of_Payment,"
        "Number_of_Payments_Included_in_Total_Amount,Form_of_Payment_or_Transfer_of_Value,"
        "Nature_of_Payment_or_Transfer_of_Value,Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1\n"
        "1,10.9,01/02/2023,1,Cash,Education,Humira\n2,5.0,01/02/2023,1,Cash,Gift,humira\n")
    (d / "n.csv").write_text(
        '"NPI","Provider Last Name (Legal Name)","Provider First Name","Provider Middle Name",'
        '"Provider First Line Business Mailing Address","Provider Business Mailing Address City Name",'
        '"Provider Business Mailing Address State Name","Provider Business Mailing Address Postal Code",'
        '"Healthcare Provider Taxonomy Code_1","Healthcare Provider Taxonomy Code_2",'
        '"Healthcare Provider Taxonomy Code_3"\n'
        '"1","DOE","JANE","","1 MAIN ST","TOWN","ST","021381234","207R00000X","",""\n'
        '"2","ROE","JOHN","Q","2 MAIN ST","CITY","ST","501","207R00000X","",""\n')
    (d / "t.csv").write_text("Code,Grouping,Classification,Specialization\n207R00000X,G,Internal Medicine,\n")
    (d / "a.csv").write_text("NPI,Facility Name,org_pac_id\n1,General Hospital,123.0\n2,Clinic,7.9\n")
    sel = d / "sel"
    sel.mkdir()
    (sel / "part_b.csv").write_text("HCPCS_Cd,BRAND\nP1,humira\n")
    (sel / "drugs.csv").write_text("Drug_Name\nHumira\n")
    (sel / "taxonomy.csv").write_text("Code\n")
    (sel / "category_map.csv").write_text("Original,Renamed\nEducation,EDUCATION\nGift,\n")
    return {"part_b": str(d / "b.csv"), "part_d": str(d / "d.csv"), "payments": str(d / "p.csv"),
            "providers": str(d / "n.csv"), "taxonomy": str(d / "t.csv"), "affiliations": str(d / "a.csv")}


def test_cli_run_writes_profile_and_ledger(spark, tmp_path):
    from provlens.cli import run
    from provlens.operators import runs as RN
    files = _write_public_files(tmp_path)
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    run_id = run(spark, files, str(tmp_path / "sel"), out, ledger=ledger, user="jane")
    res = spark.read.option("header", True).csv(out + "/profile.csv")
    got = {r["npi"]: r.asDict() for r in res.collect()}
    assert set(got) == {"1", "2"}
    assert got["1"]["HUMIRA_EDUCATION"] == "10" and got["2"]["HUMIRA_OTHERS_GENERAL"] == "5"
    assert "HUMIRA_Patients" in res.columns and got["1"]["HUMIRA_Claims"] == "2"
    hist = RN.read_ledger(spark, ledger).collect()
    assert len(hist) == 1 and hist[0]["run_id"] == run_id and hist[0]["out_time"] is not None


def test_nothing_selected_gives_an_empty_profile(spark, make_src):
    src = _profile_src(make_src)
    sel = _sel(spark, part_b=False, part_d=False)
    out = PR.profile(src, sel, PR.ProfileOptions(part_b=False, part_d=False, payments=False))
    assert out.count() == 0
    assert out.columns[:2] == ["npi", "last_name"]


def test_long_drug_lists_join_by_shuffle(spark):
    """No cap on a selection: beyond the broadcast limits the join shuffles."""
    n = 300_000
    drugs = spark.range(n).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("Drug_Name"))
    empty = Selections.from_rows(spark)
    sel = Selections.from_raw(None, None, drugs, empty.taxonomy.withColumnRenamed("code", "Code"),
                              spark.createDataFrame([], "Original string, Renamed string"))
    pays = spark.createDataFrame([pay(1, 5.0, "Gift", "D7"), pay(2, 6.0, "Gift", "d299999"), pay(3, 1.0, "Gift", "no")],
                                 "Covered_Recipient_NPI bigint, Total_Amount_of_Payment_USDollars double, d string, "
                                 "Nature_of_Payment_or_Transfer_of_Value string, "
                                 "Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1 string")
    out = P.payments_filtered(pays, sel)
    assert rows(out, "npi", "drug") == [(1, "D7"), (2, "D299999")]
    assert sel._names is None
    from tests.test_plans import explain
    assert "strategy=broadcast" not in explain(out, "extended")
    # the long form works at any width, every wide table has the same limit
    assert E.totals_by_measure(E.payment_facts(P.payments_mapped(pays, sel))).count() == 2
    assert E.measure_table(sel).count() == n
    for build in (E.payment_measures, E.all_measures):
        with pytest.raises(ValueError, match="long form"):
            build(sel)


def test_wide_names_that_collide_keep_their_own_cells(spark, make_src):
    src = make_src(payments=[pay(1, 10.0, "n1", "A"), pay(1, 5.0, "n2", "A_B"), pay(1, 100.0, "n3", "X"),
                             pay(1, 3.0, "n4", "X"), pay(1, 4.0, "n5", "X")],
                   part_b=[(1, "P1", "desc", 2, 7.0)])
    sel = Selections.from_rows(spark, part_b=[("P1", "X")], drugs=["A", "A_B", "X"], category_map=[
        ("n1", "B_C"), ("n2", "C"), ("n3", "Claims"), ("n4", "Travel"), ("n5", "TRAVEL")])
    ms = E.all_measures(sel)
    facts = E.facts(src.part_b, None, src.payments, sel)
    cells = {(m.drug, m.measure): m.name for m in ms}
    assert len({n.lower() for n in cells.values()}) == len(cells)
    wides = [E.pivot_wide(facts, ms, total="total", strategy=s).collect()[0].asDict()
             for s in ("conditional", "two_phase")]
    assert wides[0] == wides[1]
    got = {pair: wides[0][name] for pair, name in cells.items() if wides[0][name]}
    assert got == {("A", "B_C"): 10, ("A_B", "C"): 5, ("X", "CLAIMS"): 100, ("X", "TRAVEL"): 7,
                   ("X", "Claims"): 7, ("X", "Patients"): 2}
    assert wides[0]["total"] == sum(got.values())
    back = E.wide_to_long(E.pivot_wide(facts, ms), ms, spark)
    assert {(r["drug"], r["measure"]): r["amount"] for r in back.collect()} == got


def test_keys_are_trimmed_in_every_source(spark, make_src):
    src = make_src(part_b=[(1, "P1 ", "d", 1, 1.0)], part_d=[(1, " Humira ", "g", 1, 1)],
                   payments=[pay(1, 1.0, "Gift", "Humira ")])
    sel = Selections.from_rows(spark, part_b=[(" P1", "x")], part_d=[("humira ", "g", "x")], drugs=[" humira"])
    assert (C.part_b_filtered(src.part_b, sel).count(), C.part_d_filtered(src.part_d, sel).count(),
            P.payments_filtered(src.payments, sel).count()) == (1, 1, 1)


def test_history_keeps_runs_without_a_user(spark):
    from provlens.operators import runs as RN
    led = spark.createDataFrame([("r1", None, "2024-01-01", None), ("r2", "u", "2024-01-02", None),
                                 ("r3", None, "2024-01-03", "2024-01-04")],
                                "run_id string, username string, in_time string, out_time string")
    got = [tuple(r) for r in RN.run_history(led).select("run_id", "username", "position").collect()]
    assert got == [("r3", None, 1), ("r1", None, 2), ("r2", "u", 1)]
    assert [r["run_id"] for r in RN.user_history(led, "u").collect()] == ["r2"]


def test_quotes_commas_and_line_breaks_come_through(spark, tmp_path):
    import csv
    import glob

    from provlens.cli import run, view
    files = _write_public_files(tmp_path)
    name = 'Joe "Bud" Clinic,\nLLC'
    with open(files["affiliations"], "w", newline="") as f:
        csv.writer(f).writerows([("NPI", "Facility Name", "org_pac_id"), (1, name, 123), (2, "Clinic", "bad")])
    with open(files["part_b"], "a") as f:
        f.write("x1,x,P1,desc,many,2.5\n")
    out, report = str(tmp_path / "out"), {}
    run(spark, files, (tmp_path / "sel").as_uri(), out, report=report, single_file=True)
    assert report["bad_values"]["part_b"] == {"Rndrng_NPI": 1, "Tot_Benes": 1, "Tot_Srvcs": 0}
    assert report["bad_values"]["affiliations"]["org_pac_id"] == 1
    assert report["rows"]["result"] == 1
    with open(glob.glob(out + "/profile.csv/part-*.csv")[0], newline="") as f:
        (row,) = csv.DictReader(f)
    assert row["Facility_Name_1"] == name and row["HUMIRA_Claims"] == "2"
    view(spark, out, str(tmp_path / "seen"), ["All"], top=1)
    with open(glob.glob(str(tmp_path / "seen" / "view") + "/part-*.csv")[0], newline="") as f:
        (shown,) = csv.DictReader(f)
    assert shown["Facility_Name_1"] == name and shown["postal_code"] == "02138-1234" and shown["total"] == "15"
    totals = spark.read.option("header", True).csv(str(tmp_path / "seen" / "category_totals"))
    assert {(r["drug"], r["category"]): r["amount"] for r in totals.collect()} == {
        ("HUMIRA", "EDUCATION"): "10", ("HUMIRA", "OTHERS_GENERAL"): "0"}


def test_missing_selection_files(spark, tmp_path):
    (tmp_path / "drugs.csv").write_text("Drug_Name\nA\n")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        Selections.from_folder(spark, tmp_path.as_uri())
    (tmp_path / "taxonomy.csv").write_text("Code\n")
    (tmp_path / "category_map.csv").write_text("Original,Renamed\n")
    sel = Selections.from_folder(spark, tmp_path.as_uri())
    assert sel.part_b is None and sel.part_d is None and sel.payment_drugs() == ["A"]


def test_catalogue_run(spark, tmp_path):
    from provlens.cli import catalogues
    catalogues(spark, _write_public_files(tmp_path), str(tmp_path / "cat"))
    got = {n: [r.asDict() for r in spark.read.json(str(tmp_path / "cat" / n)).collect()]
           for n in ("procedures", "drugs", "categories")}
    with open(tmp_path / "cat" / "drugs.json") as f:
        assert json.load(f) == {"drugs": got["drugs"]}
    assert got["procedures"] == [{"HCPCS_Cd": "P1", "HCPCS_Desc": "desc"}]
    assert got["drugs"] == [{"Brnd_Name": "Humira", "Gnrc_Name": "ada"}]
    assert sorted((r["Original"], r["Renamed"]) for r in got["categories"]) == [("Education", "EDUCATION"), ("Gift", "")]


def test_scratch_on_a_cluster_needs_the_setting(spark, tmp_path):
    from types import SimpleNamespace

    from provlens.session import checkpoint_root, remove_scratch, scratch_dir
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: {"spark.master": "yarn"}.get(k, d)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(cluster)
    path = scratch_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    assert remove_scratch() >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
