"""DuckDB oracle text for every query key.

The base tables are registered by the driver; the input views of FIXTURES.md
section 2 and the derived steps are inlined as CTEs. Measure lists are the
fixture's known values, written out here, so the oracle does not share the
Spark side's run-time derivation of pivot columns.

Oracle typing rules (Spark vs DuckDB): truncation is ``CAST(trunc(x) AS
BIGINT)``; sums and floors are cast back to BIGINT.
"""

from __future__ import annotations

from provlens.operators.catalog import DEFAULT_CATEGORY_NAMES
from provlens.sources.tables import PUBLIC_NATURES

# Fixture selections seen from the oracle side.
PAY_DRUGS = ("BRAND#1", "BRAND#2", "BRAND#3", "BRAND#4")
CATEGORIES = ("EDUCATION", "FOOD&BEVERAGE", "SPEAKER", "OTHERS_GENERAL")
CLAIM_DRUGS = ("BRAND#1", "BRAND#2", "BRAND#3", "BRAND#4")
PART_D_DRUGS = ("BRAND#2", "BRAND#3", "BRAND#4")
CLAIM_MEASURES = ("Patients", "Claims")
VIEW_DRUGS = ("BRAND#2", "BRAND#3")

PROVIDER_BLOCK = ("npi", "last_name", "first_name", "middle_name", "postal_code",
                  "Primary_Classification", "Primary_Specialization",
                  "Secondary_Classification", "Secondary_Specialization",
                  "Tertiary_Classification", "Tertiary_Specialization")
AFFILIATION_BLOCK = tuple(c for i in range(1, 5) for c in (f"Facility_Name_{i}", f"Org_pac_id_{i}"))


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def blank_to_null(x: str) -> str:
    return f"CASE WHEN lower(trim({x})) IN ('', 'nan', 'null') THEN NULL ELSE trim({x}) END"


# ---------------------------------------------------------------------------
# fragments: name -> (sql, dependencies)

F: dict[str, tuple[str, tuple[str, ...]]] = {}


def frag(name: str, sql: str, *deps: str) -> None:
    F[name] = (sql, deps)


# -- input views (FIXTURES.md section 2) --
frag("part_b", """
SELECT o_custkey AS Rndrng_NPI, 'P' || CAST(l_partkey AS STRING) AS HCPCS_Cd,
       p_name AS HCPCS_Desc, CAST(l_linenumber AS BIGINT) AS Tot_Benes,
       l_quantity * 1.5 AS Tot_Srvcs
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE l_linestatus = 'O'""")
frag("part_d", """
SELECT o_custkey AS Prscrbr_NPI, p_brand AS Brnd_Name, p_type AS Gnrc_Name,
       CAST(l_quantity AS BIGINT) AS Tot_Clms,
       CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS Tot_Benes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE l_linestatus = 'F'""")
frag("payments", """
SELECT CASE WHEN user_id = 0 THEN NULL ELSE user_id END AS Covered_Recipient_NPI,
       value AS Total_Amount_of_Payment_USDollars, ts AS Date_of_Payment,
       event_type AS Nature_of_Payment_or_Transfer_of_Value,
       'Brand#' || CAST(CAST(replace(replace(props, '{"k": ', ''), '}', '') AS INT) % 25 + 1 AS STRING)
         AS Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1
FROM events""")
frag("payments_public", f"""
SELECT user_id AS Covered_Recipient_NPI, value AS Total_Amount_of_Payment_USDollars,
       [{', '.join(lit(n) for n in PUBLIC_NATURES)}][k % {len(PUBLIC_NATURES)} + 1] AS Nature_of_Payment_or_Transfer_of_Value,
       'Brand#' || CAST(k % 25 + 1 AS STRING) AS Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1
FROM (SELECT *, CAST(replace(replace(props, '{{"k": ', ''), '}}', '') AS INT) AS k FROM events)""")
frag("providers", """
SELECT c_custkey AS NPI, c_name AS last_name_legal, c_mktsegment AS first_name,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'M' END AS middle_name,
       CASE WHEN c_custkey % 3 = 0 THEN CAST((c_custkey * 37) % 100000 AS STRING)
            WHEN c_custkey % 3 = 1 THEN CAST(1000000 + c_custkey * 7919 AS STRING)
            ELSE CAST(100000000 + c_custkey * 7919 AS STRING) END AS postal_code,
       CAST(c_nationkey AS STRING) AS tax_code_1,
       CAST((c_nationkey * 7 + 3) % 30 AS STRING) AS tax_code_2,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST((c_custkey % 6) * 5 AS STRING) END AS tax_code_3
FROM customer""")
frag("taxonomy", """
SELECT CAST(n_nationkey AS STRING) AS Code, n_name AS Classification,
       CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE r_name END AS Specialization
FROM nation JOIN region ON n_regionkey = r_regionkey""")
frag("affiliations", """
SELECT o_custkey AS NPI,
       CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE s_name END AS facility_name,
       CAST(s_suppkey AS DOUBLE) + CAST(0.5 AS DOUBLE) AS org_pac_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""")
frag("sel_b", """
SELECT 'P' || CAST(p_partkey AS STRING) AS HCPCS_Cd, upper(p_brand) AS BRAND
FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')""")
frag("sel_d", """
SELECT DISTINCT lower(p_brand) AS Brnd_Name, upper(p_brand) AS BRAND
FROM part WHERE p_brand IN ('Brand#2', 'Brand#3', 'Brand#4')""")
frag("sel_drugs", """
SELECT DISTINCT upper(p_brand) AS Drug_Name
FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')""")
frag("sel_tax", """
SELECT Code FROM taxonomy WHERE Classification IN ('NATION_1', 'NATION_2', 'NATION_5', 'NATION_10')""",
     "taxonomy")
frag("sel_map", """
SELECT * FROM (VALUES ('click', 'EDUCATION'), ('view', 'FOOD&BEVERAGE'), ('purchase', 'SPEAKER'),
                      ('signup', 'SPEAKER'), ('error', '')) AS t(Original, Renamed)""")

# -- normalised selections --
frag("nsel_b", f"""
SELECT code, drug FROM (SELECT {blank_to_null('HCPCS_Cd')} AS code, upper({blank_to_null('BRAND')}) AS drug
FROM sel_b) WHERE code IS NOT NULL AND drug IS NOT NULL""", "sel_b")
frag("nsel_d", f"""
SELECT brand, drug FROM (SELECT lower({blank_to_null('Brnd_Name')}) AS brand, upper({blank_to_null('BRAND')}) AS drug
FROM sel_d) WHERE brand IS NOT NULL AND drug IS NOT NULL""", "sel_d")
frag("nsel_drugs", f"""
SELECT drug FROM (SELECT upper({blank_to_null('Drug_Name')}) AS drug FROM sel_drugs) WHERE drug IS NOT NULL""",
     "sel_drugs")
frag("nsel_tax", f"""
SELECT code FROM (SELECT {blank_to_null('Code')} AS code FROM sel_tax) WHERE code IS NOT NULL""", "sel_tax")
frag("nsel_map", f"""
SELECT Original AS original, min({blank_to_null('Renamed')}) AS renamed
FROM sel_map WHERE Original IS NOT NULL GROUP BY Original""", "sel_map")

# -- claims --
frag("b_filtered", """
SELECT p.HCPCS_Cd, p.Rndrng_NPI, p.HCPCS_Desc, p.Tot_Benes, p.Tot_Srvcs, s.drug AS BRAND
FROM part_b p JOIN nsel_b s ON p.HCPCS_Cd = s.code""", "part_b", "nsel_b")
frag("d_filtered", """
SELECT lower(p.Brnd_Name) AS Brnd_Name, p.Prscrbr_NPI, p.Gnrc_Name, p.Tot_Clms, p.Tot_Benes, s.drug AS BRAND
FROM part_d p JOIN nsel_d s ON lower(p.Brnd_Name) = s.brand""", "part_d", "nsel_d")
frag("b_norm", """
SELECT CAST(Rndrng_NPI AS BIGINT) AS npi, BRAND AS drug, CAST(Tot_Benes AS BIGINT) AS patients,
       CAST(trunc(Tot_Srvcs) AS BIGINT) AS claims FROM b_filtered""", "b_filtered")
frag("d_norm", """
SELECT CAST(Prscrbr_NPI AS BIGINT) AS npi, BRAND AS drug, CAST(coalesce(Tot_Benes, 0) AS BIGINT) AS patients,
       CAST(Tot_Clms AS BIGINT) AS claims FROM d_filtered""", "d_filtered")
frag("claims_u", "SELECT * FROM b_norm UNION ALL SELECT * FROM d_norm", "b_norm", "d_norm")
frag("claims_l", """
SELECT npi, drug, 'Patients' AS measure, patients AS amount FROM claims_u
UNION ALL SELECT npi, drug, 'Claims' AS measure, claims AS amount FROM claims_u""", "claims_u")
frag("claims_l_d", """
SELECT npi, drug, 'Patients' AS measure, patients AS amount FROM d_norm
UNION ALL SELECT npi, drug, 'Claims' AS measure, claims AS amount FROM d_norm""", "d_norm")

# -- payments --
frag("pay_f", """
SELECT CAST(p.Covered_Recipient_NPI AS BIGINT) AS npi,
       upper(trim(p.Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1)) AS drug,
       p.Nature_of_Payment_or_Transfer_of_Value AS nature,
       p.Total_Amount_of_Payment_USDollars AS amount_usd
FROM payments p JOIN nsel_drugs s
  ON upper(trim(p.Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1)) = s.drug
WHERE p.Covered_Recipient_NPI IS NOT NULL""", "payments", "nsel_drugs")
frag("pay_m", """
SELECT f.npi, f.drug, coalesce(m.renamed, 'OTHERS_GENERAL') AS category,
       CAST(trunc(f.amount_usd) AS BIGINT) AS amount
FROM pay_f f LEFT JOIN nsel_map m ON f.nature = m.original""", "pay_f", "nsel_map")
frag("pay_l", "SELECT npi, drug, category AS measure, amount FROM pay_m", "pay_m")
frag("eng_l", "SELECT * FROM pay_l UNION ALL SELECT * FROM claims_l", "pay_l", "claims_l")
frag("eng_l_d", "SELECT * FROM pay_l UNION ALL SELECT * FROM claims_l_d", "pay_l", "claims_l_d")

# -- registry --
frag("reg_sel", """
SELECT CAST(NPI AS BIGINT) AS npi, last_name_legal AS last_name, first_name, middle_name,
       CAST(postal_code AS VARCHAR) AS postal_code, tax_code_1, tax_code_2, tax_code_3
FROM providers""", "providers")
frag("reg_f", """
SELECT * FROM reg_sel
WHERE tax_code_1 IN (SELECT code FROM nsel_tax) OR tax_code_2 IN (SELECT code FROM nsel_tax)
   OR tax_code_3 IN (SELECT code FROM nsel_tax) OR NOT EXISTS (SELECT 1 FROM nsel_tax)""",
     "reg_sel", "nsel_tax")


def _enrich(src: str) -> str:
    return f"""
SELECT r.*, t1.Classification AS Primary_Classification, t1.Specialization AS Primary_Specialization,
       t2.Classification AS Secondary_Classification, t2.Specialization AS Secondary_Specialization,
       t3.Classification AS Tertiary_Classification, t3.Specialization AS Tertiary_Specialization
FROM {src} r LEFT JOIN taxonomy t1 ON r.tax_code_1 = t1.Code
LEFT JOIN taxonomy t2 ON r.tax_code_2 = t2.Code
LEFT JOIN taxonomy t3 ON r.tax_code_3 = t3.Code"""


frag("reg_tax", _enrich("reg_sel"), "reg_sel", "taxonomy")
frag("reg_ftax", _enrich("reg_f"), "reg_f", "taxonomy")
frag("reg_out", f"SELECT {', '.join(PROVIDER_BLOCK)} FROM reg_ftax", "reg_ftax")

# -- affiliations --
frag("aff_clean", """
SELECT npi, facility_name, CAST(floor(org_pac_id) AS BIGINT) AS org_pac_id FROM (
  SELECT DISTINCT CAST(NPI AS BIGINT) AS npi, facility_name, org_pac_id FROM affiliations
  WHERE NPI IS NOT NULL AND facility_name IS NOT NULL AND org_pac_id IS NOT NULL)""", "affiliations")
frag("aff_top", "SELECT npi, " + ", ".join(
    f"max(CASE WHEN rn = {i} THEN facility_name END) AS Facility_Name_{i}, "
    f"max(CASE WHEN rn = {i} THEN org_pac_id END) AS Org_pac_id_{i}" for i in range(1, 5)) + """
FROM (SELECT *, row_number() OVER (PARTITION BY npi ORDER BY facility_name, org_pac_id) AS rn FROM aff_clean)
WHERE rn <= 4 GROUP BY npi""", "aff_clean")
frag("freq", """
SELECT facility_count, CAST(count(*) AS BIGINT) AS physician_count FROM (
  SELECT npi, CAST(count(*) AS BIGINT) AS facility_count FROM aff_clean GROUP BY npi)
GROUP BY facility_count""", "aff_clean")


def measure_names(drugs_measures) -> list[tuple[str, str, str]]:
    return [(f"{d}_{m}", d, m) for d, ms in drugs_measures for m in ms]


PAY_MEASURES = measure_names([(d, CATEGORIES) for d in PAY_DRUGS])
CLAIM_MEASURE_NAMES = measure_names([(d, CLAIM_MEASURES) for d in CLAIM_DRUGS])
PART_D_MEASURE_NAMES = measure_names([(d, CLAIM_MEASURES) for d in PART_D_DRUGS])
ALL_MEASURES = PAY_MEASURES + CLAIM_MEASURE_NAMES
PART_D_ONLY_MEASURES = PAY_MEASURES + PART_D_MEASURE_NAMES


def pivot_sql(src: str, measures, total: bool = True) -> str:
    cols = []
    if total:
        cols.append("CAST(coalesce(sum(amount), 0) AS BIGINT) AS total")
    for name, d, m in measures:
        cols.append(f"CAST(coalesce(sum(CASE WHEN drug = {lit(d)} AND measure = {lit(m)} THEN amount END), 0)"
                    f" AS BIGINT) AS {q(name)}")
    names = ", ".join(lit(n) for n, _, _ in measures)
    return (f"SELECT npi, {', '.join(cols)} FROM {src} WHERE drug || '_' || measure IN ({names}) "
            f"GROUP BY npi")


frag("wide_all", pivot_sql("eng_l", ALL_MEASURES), "eng_l")
frag("wide_d", pivot_sql("eng_l_d", PART_D_ONLY_MEASURES), "eng_l_d")
frag("base_inner", "SELECT r.*, a.* EXCLUDE (npi) FROM reg_out r JOIN aff_top a ON r.npi = a.npi",
     "reg_out", "aff_top")
frag("base_left", "SELECT r.*, a.* EXCLUDE (npi) FROM reg_out r LEFT JOIN aff_top a ON r.npi = a.npi",
     "reg_out", "aff_top")


def profile_select(base: str, wide: str, measures, affiliations: bool = True,
                   activity: bool = True) -> str:
    cols = ["b." + c for c in PROVIDER_BLOCK]
    if affiliations:
        cols += ["b." + c for c in AFFILIATION_BLOCK]
    cols += ["w." + q(n) for n, _, _ in measures]
    where = " WHERE w.total > 0" if activity else ""
    return f"SELECT {', '.join(cols)} FROM {base} b JOIN {wide} w ON b.npi = w.npi{where}"


frag("profile_wide", profile_select("base_inner", "wide_all", ALL_MEASURES), "base_inner", "wide_all")


def resolve(names) -> list[str]:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in F[n][1]:
            visit(d)
        order.append(n)
    for n in names:
        visit(n)
    return order


def with_ctes(body: str, *needs: str) -> str:
    """``WITH`` + every fragment ``needs`` depends on + the body."""
    names = resolve(needs)
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({F[n][0].strip()})" for n in names)
    return f"WITH {ctes}\n{body}"


# ---------------------------------------------------------------------------
# one statement per query key

ORACLE: dict[str, str] = {}


def oracle(key: str, body: str, *needs: str) -> None:
    ORACLE[key] = with_ctes(body, *needs)


oracle("selection_tables", """
SELECT 'part_b' AS kind, code AS key, drug AS value FROM nsel_b
UNION ALL SELECT 'part_d', brand, drug FROM nsel_d
UNION ALL SELECT 'drugs', drug, NULL FROM nsel_drugs
UNION ALL SELECT 'taxonomy', code, NULL FROM nsel_tax
UNION ALL SELECT 'category_map', original, renamed FROM nsel_map""",
       "nsel_b", "nsel_d", "nsel_drugs", "nsel_tax", "nsel_map")

oracle("part_b_filtered", "SELECT * FROM b_filtered", "b_filtered")
oracle("part_d_filtered", "SELECT * FROM d_filtered", "d_filtered")
oracle("part_b_normalised", "SELECT * FROM b_norm", "b_norm")
oracle("part_d_normalised", "SELECT * FROM d_norm", "d_norm")
oracle("part_b_by_drug", """
SELECT drug, CAST(sum(patients) AS BIGINT) AS patients, CAST(sum(claims) AS BIGINT) AS claims
FROM b_norm GROUP BY drug""", "b_norm")
oracle("part_d_by_drug", """
SELECT drug, CAST(sum(patients) AS BIGINT) AS patients, CAST(sum(claims) AS BIGINT) AS claims
FROM d_norm GROUP BY drug""", "d_norm")
oracle("claims_union", "SELECT * FROM claims_u", "claims_u")
oracle("claims_by_provider_drug", """
SELECT npi, drug, CAST(sum(patients) AS BIGINT) AS patients, CAST(sum(claims) AS BIGINT) AS claims
FROM claims_u GROUP BY npi, drug""", "claims_u")
oracle("claims_wide", pivot_sql("claims_l", CLAIM_MEASURE_NAMES, total=False), "claims_l")

oracle("payments_filtered", "SELECT * FROM pay_f", "pay_f")
oracle("payments_semi", """
SELECT * FROM pay_f""", "pay_f")
oracle("payments_mapped", "SELECT * FROM pay_m", "pay_m")
oracle("payments_mapped_regex", """
SELECT npi, drug,
       CASE WHEN nature = 'click' THEN 'EDUCATION' WHEN nature = 'view' THEN 'FOOD&BEVERAGE'
            WHEN regexp_matches(nature, '^[ps]') THEN 'SPEAKER' ELSE 'OTHERS_GENERAL' END AS category,
       CAST(trunc(amount_usd) AS BIGINT) AS amount
FROM pay_f""", "pay_f")
oracle("payments_by_category", "SELECT npi, drug, " + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN category = {lit(c)} THEN amount END), 0) AS BIGINT) AS {q(c)}"
    for c in CATEGORIES) + " FROM pay_m GROUP BY npi, drug", "pay_m")
oracle("payments_wide", pivot_sql("pay_l", PAY_MEASURES, total=False), "pay_l")

frag("pw", pivot_sql("pay_l", PAY_MEASURES, total=False), "pay_l")
frag("cw", pivot_sql("claims_l", CLAIM_MEASURE_NAMES, total=False), "claims_l")
oracle("engagement_outer", "SELECT coalesce(p.npi, c.npi) AS npi, " + ", ".join(
    [f"coalesce(p.{q(n)}, 0) AS {q(n)}" for n, _, _ in PAY_MEASURES]
    + [f"coalesce(c.{q(n)}, 0) AS {q(n)}" for n, _, _ in CLAIM_MEASURE_NAMES])
    + " FROM pw p FULL OUTER JOIN cw c ON p.npi = c.npi", "pw", "cw")

oracle("registry_select", "SELECT * FROM reg_sel", "reg_sel")
oracle("registry_taxonomy", "SELECT * FROM reg_tax", "reg_tax")
oracle("registry_filtered", "SELECT * FROM reg_out", "reg_out")

oracle("affiliations_clean", "SELECT * FROM aff_clean", "aff_clean")
oracle("affiliations_top4", "SELECT * FROM aff_top", "aff_top")
oracle("facility_frequency", "SELECT * FROM freq", "freq")
oracle("facility_weighted_mean", """
SELECT CAST(sum(facility_count * physician_count) AS DOUBLE) / CAST(sum(physician_count) AS DOUBLE)
       AS weighted_mean FROM freq""", "freq")
oracle("facility_mode", """
SELECT facility_count, physician_count FROM freq
WHERE physician_count = (SELECT max(physician_count) FROM freq)""", "freq")

oracle("profile_wide", "SELECT * FROM profile_wide", "profile_wide")
oracle("profile_wide_left", profile_select("base_left", "wide_all", ALL_MEASURES), "base_left", "wide_all")
oracle("profile_core", profile_select("reg_out", "wide_all", ALL_MEASURES, affiliations=False,
                                      activity=False), "reg_out", "wide_all")
oracle("profile_part_d_only", profile_select("base_inner", "wide_d", PART_D_ONLY_MEASURES),
       "base_inner", "wide_d")
oracle("activity_filter", "SELECT npi, total FROM wide_all WHERE total > 0", "wide_all")
oracle("wide_naming", "SELECT * FROM (VALUES " + ", ".join(
    f"({lit(n)}, {lit(d)}, {lit(m)})" for n, d, m in ALL_MEASURES) + ") AS t(name, drug, measure)")
oracle("wide_to_long", """
SELECT w.npi, m.drug, m.measure, w.amount FROM (
  UNPIVOT (SELECT * FROM profile_wide) ON """ + ", ".join(q(n) for n, _, _ in ALL_MEASURES) + """
  INTO NAME name VALUE amount) w
JOIN (VALUES """ + ", ".join(f"({lit(n)}, {lit(d)}, {lit(m)})" for n, d, m in ALL_MEASURES) + """)
  AS m(name, drug, measure) ON w.name = m.name
WHERE w.amount <> 0""", "profile_wide")

ORACLE["view_external"] = ORACLE["wide_to_long"]

# ---- files ----
oracle("scan_csv", "SELECT Code, Classification, Specialization FROM taxonomy", "taxonomy")
oracle("checkpoint_roundtrip", "SELECT * FROM eng_l", "eng_l")
oracle("export_csv", "SELECT * FROM profile_wide", "profile_wide")
oracle("catalog_roundtrip", "SELECT DISTINCT Brnd_Name, Gnrc_Name FROM part_d", "part_d")
oracle("catalog_document", "SELECT DISTINCT Brnd_Name, Gnrc_Name FROM part_d", "part_d")
oracle("export_one_file", "SELECT * FROM profile_wide", "profile_wide")
oracle("quoted_csv", """
SELECT Rndrng_NPI, HCPCS_Cd, HCPCS_Desc || chr(10) || '"second, line"' || chr(10) || chr(10) || HCPCS_Cd AS HCPCS_Desc
FROM part_b""", "part_b")


# ---- viewer ----
def postal_sql(x: str) -> str:
    nine = f"lpad({x}, 9, '0')"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN length({x}) <= 5 THEN lpad({x}, 5, '0') "
            f"WHEN length({x}) <= 9 THEN substr({nine}, 1, 5) || '-' || substr({nine}, 6, 4) ELSE {x} END")


VIEW_MEASURES = [m for m in ALL_MEASURES if m[1] in VIEW_DRUGS]
DESC_COLS = PROVIDER_BLOCK[1:] + AFFILIATION_BLOCK
frag("view_f", "SELECT CAST(npi AS VARCHAR) AS npi, " + ", ".join(DESC_COLS) + ", "
     + ", ".join(q(n) for n, _, _ in VIEW_MEASURES) + " FROM profile_wide", "profile_wide")
frag("ranked", "SELECT *, row_number() OVER (ORDER BY total DESC, npi ASC) AS position FROM ("
     "SELECT *, CAST(" + " + ".join(q(n) for n, _, _ in VIEW_MEASURES) + " AS BIGINT) AS total FROM view_f) "
     "WHERE total > 0", "view_f")
oracle("view_filtered", "SELECT * FROM view_f", "view_f")
oracle("ranked_view", "SELECT npi, total, position FROM ranked", "ranked")
oracle("view_saved", "SELECT * FROM view_f", "view_f")
DOLLARS = [n for n, _, m in VIEW_MEASURES if m not in CLAIM_MEASURES]
oracle("ranked_dollars", "SELECT npi, total FROM (SELECT npi, CAST(" + " + ".join(q(n) for n in DOLLARS)
       + " AS BIGINT) AS total FROM view_f) WHERE total > 0", "view_f")
oracle("ranked_top", "SELECT npi, total FROM ranked ORDER BY position LIMIT 20", "ranked")
oracle("view_display", "SELECT npi, " + ", ".join(
    (f"coalesce({postal_sql('postal_code')}, '') AS postal_code" if c == "postal_code"
     else f"coalesce(CAST({c} AS VARCHAR), '') AS {c}") for c in DESC_COLS) + ", "
    + ", ".join(q(n) for n, _, _ in VIEW_MEASURES) + ", total, position FROM ranked", "ranked")
oracle("postal_format", f"SELECT npi, {postal_sql('postal_code')} AS zip FROM reg_sel", "reg_sel")


def totals_sql(measures, label: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {lit(d)} AS drug, {lit(m)} AS {label}, CAST(coalesce(sum({q(n)}), 0) AS BIGINT) AS amount "
        f"FROM profile_wide" for n, d, m in measures)


oracle("drug_category_totals", "SELECT drug, category, amount, CAST(amount AS DOUBLE) / "
       "NULLIF(CAST(sum(amount) OVER (PARTITION BY drug) AS DOUBLE), 0) AS share FROM ("
       + totals_sql(PAY_MEASURES, "category") + ")", "profile_wide")
ORACLE["saved_category_totals"] = ORACLE["drug_category_totals"]
oracle("drug_measure_totals", "SELECT drug, measure, amount FROM (SELECT *, sum(amount) OVER "
       "(PARTITION BY measure) AS g FROM (" + totals_sql(CLAIM_MEASURE_NAMES, "measure") + ")) WHERE g <> 0",
       "profile_wide")

# ---- catalogues ----
frag("cat_proc", "SELECT DISTINCT HCPCS_Cd, HCPCS_Desc FROM part_b", "part_b")
frag("cat_drug", "SELECT DISTINCT Brnd_Name, Gnrc_Name FROM part_d", "part_d")
frag("labels", """
SELECT 'procedure' AS kind, HCPCS_Cd AS code, HCPCS_Cd || ' - ' || coalesce(HCPCS_Desc, '') AS label FROM cat_proc
UNION ALL
SELECT 'drug' AS kind, Brnd_Name AS code, Brnd_Name || ' - ' || coalesce(Gnrc_Name, '') AS label FROM cat_drug""",
     "cat_proc", "cat_drug")
oracle("catalog_procedures", "SELECT * FROM cat_proc", "cat_proc")
oracle("catalog_drugs", "SELECT * FROM cat_drug", "cat_drug")
oracle("catalog_taxonomy", "SELECT Code, Classification, Specialization FROM taxonomy WHERE Code IS NOT NULL "
       "AND Classification IS NOT NULL AND Specialization IS NOT NULL", "taxonomy")
def categories_sql(source: str) -> str:
    return f"""
SELECT n.Original, coalesce(m.Renamed, '') AS Renamed FROM (
  SELECT DISTINCT Nature_of_Payment_or_Transfer_of_Value AS Original FROM {source}
  WHERE Nature_of_Payment_or_Transfer_of_Value IS NOT NULL) n
LEFT JOIN (VALUES """ + ", ".join(f"({lit(a)}, {lit(b)})" for a, b in DEFAULT_CATEGORY_NAMES) + """)
  AS m(Original, Renamed) ON n.Original = m.Original"""


oracle("catalog_categories", categories_sql("payments"), "payments")
oracle("catalog_categories_public", categories_sql("payments_public"), "payments_public")
oracle("payments_mapped_public", """
SELECT Covered_Recipient_NPI AS npi, s.drug,
       CASE Nature_of_Payment_or_Transfer_of_Value WHEN 'Food and Beverage' THEN 'FOOD&BEVERAGE'
            WHEN 'Consulting Fee' THEN 'CONSULTING' WHEN 'Travel and Lodging' THEN 'TRAVEL'
            WHEN 'Education' THEN 'EDUCATION' ELSE
            CASE WHEN Nature_of_Payment_or_Transfer_of_Value LIKE '%Compensation%' THEN 'SPEAKER'
            ELSE 'OTHERS_GENERAL' END END AS category,
       CAST(trunc(Total_Amount_of_Payment_USDollars) AS BIGINT) AS amount
FROM payments_public p JOIN nsel_drugs s
  ON upper(p.Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1) = s.drug
WHERE Covered_Recipient_NPI IS NOT NULL""", "payments_public", "nsel_drugs")
oracle("catalog_labels", "SELECT * FROM labels", "labels")
oracle("label_split", "SELECT kind, split_part(label, ' - ', 1) AS code, "
       "substr(label, length(split_part(label, ' - ', 1)) + 4) AS rest FROM labels", "labels")
oracle("catalog_search", "SELECT kind, code, label FROM labels WHERE contains(lower(label), 'widget')", "labels")
oracle("drug_list_parse", """
SELECT DISTINCT upper(trim(item)) AS drug FROM (
  SELECT unnest(string_split(' ' || lower(p_brand) || ' , ,' || p_brand || ',', ',')) AS item FROM part)
WHERE trim(item) <> ''""")

# ---- runs ----
frag("run_names", "SELECT 'u' || CAST(o_custkey AS VARCHAR) || '_' || strftime(o_orderdate, '%Y%m%d%H%M%S') "
     "|| '_' || CAST(o_orderkey AS VARCHAR) AS name FROM orders")
frag("ledger", """
SELECT s.run_id, s.username, s.in_time, f.out_time FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id, c_mktsegment AS username, o_orderdate AS in_time
  FROM orders JOIN customer ON o_custkey = c_custkey) s
LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderdate + INTERVAL 1 DAY AS out_time
           FROM orders WHERE o_orderstatus = 'F') f ON s.run_id = f.run_id""")
oracle("parse_run_names", "SELECT split_part(name, '_', 1) AS username, split_part(name, '_', 2) AS ts_text, "
       "split_part(name, '_', 3) AS run_id FROM run_names", "run_names")
oracle("run_ledger", "SELECT * FROM ledger", "ledger")
oracle("run_history", "SELECT *, row_number() OVER (PARTITION BY username ORDER BY in_time DESC, run_id ASC) "
       "AS position FROM ledger", "ledger")

oracle("runs_of_user", "SELECT *, row_number() OVER (ORDER BY in_time DESC, run_id ASC) AS position "
       "FROM ledger WHERE username = 'BUILDING'", "ledger")

# ---- quality ----
VIEW_COLUMNS = {
    "part_b": ("Rndrng_NPI", "HCPCS_Cd", "HCPCS_Desc", "Tot_Benes", "Tot_Srvcs"),
    "part_d": ("Prscrbr_NPI", "Brnd_Name", "Gnrc_Name", "Tot_Clms", "Tot_Benes"),
    "payments": ("Covered_Recipient_NPI", "Total_Amount_of_Payment_USDollars", "Date_of_Payment",
                 "Nature_of_Payment_or_Transfer_of_Value",
                 "Name_of_Drug_or_Biological_or_Device_or_Medical_Supply_1"),
    "providers": ("NPI", "last_name_legal", "first_name", "middle_name", "postal_code",
                  "tax_code_1", "tax_code_2", "tax_code_3"),
    "taxonomy": ("Code", "Classification", "Specialization"),
    "affiliations": ("NPI", "facility_name", "org_pac_id"),
    "sel_b": ("HCPCS_Cd", "BRAND"), "sel_d": ("Brnd_Name", "BRAND"), "sel_drugs": ("Drug_Name",),
    "sel_tax": ("Code",), "sel_map": ("Original", "Renamed"),
}
FLOAT_COLUMNS = {("part_b", "Tot_Srvcs"), ("payments", "Total_Amount_of_Payment_USDollars"), ("affiliations", "org_pac_id")}
NUMBER_COLUMNS = {"Rndrng_NPI", "Tot_Benes", "Tot_Srvcs", "Prscrbr_NPI", "Tot_Clms", "Covered_Recipient_NPI",
                  "Total_Amount_of_Payment_USDollars", "Date_of_Payment", "NPI", "org_pac_id"}
TEXT_COLUMNS = {t: tuple(c for c in cols if c not in NUMBER_COLUMNS) for t, cols in VIEW_COLUMNS.items()}
oracle("table_shape", " UNION ALL ".join(
    f"SELECT {lit(t)} AS table_name, CAST(count(*) AS BIGINT) AS n_rows, CAST({len(cols)} AS BIGINT) AS n_cols "
    f"FROM {t}" for t, cols in VIEW_COLUMNS.items()), *VIEW_COLUMNS)
oracle("null_report", " UNION ALL ".join(
    f"SELECT {lit(t)} AS table_name, {lit(c)} AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL"
    + (f" OR isnan({c})" if (t, c) in FLOAT_COLUMNS else "") + f") AS BIGINT) AS n FROM {t}"
    for t in VIEW_COLUMNS for c in VIEW_COLUMNS[t]), *VIEW_COLUMNS)
oracle("non_numeric_report", " UNION ALL ".join(
    f"SELECT {lit(t)} AS table_name, {lit(c)} AS column_name, CAST(count(*) FILTER (WHERE {c} IS NOT NULL "
    f"AND TRY_CAST({c} AS DOUBLE) IS NULL) AS BIGINT) AS n FROM {t}"
    for t, cols in TEXT_COLUMNS.items() for c in cols), *VIEW_COLUMNS)
oracle("measure_text_report", " UNION ALL ".join(
    f"SELECT 'profile' AS table_name, {lit(n)} AS column_name, CAST(count(*) FILTER (WHERE {q(n)} IS NOT NULL AND "
    f"TRY_CAST(CAST({q(n)} AS VARCHAR) AS DOUBLE) IS NULL) AS BIGINT) AS n FROM profile_wide"
    for n, _, _ in ALL_MEASURES), "profile_wide")
oracle("json_ledger_records", """
SELECT '{"run_id":"' || run_id || '","username":"' || username || '","in_time":"' || strftime(in_time, '%Y-%m-%d %H:%M:%S')
  || '"' || coalesce(',"out_time":"' || strftime(out_time, '%Y-%m-%d %H:%M:%S') || '"', '') || '}' AS json
FROM ledger""", "ledger")

oracle("json_records", "SELECT CAST(to_json(struct_pack(HCPCS_Cd := HCPCS_Cd, HCPCS_Desc := HCPCS_Desc)) AS VARCHAR) AS json "
       "FROM cat_proc", "cat_proc")
