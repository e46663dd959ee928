"""Registered queries: one per operator of the inventory, each reading the
test-data tables of one folder. Keys match ``oracle/sql.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlens.functions.normalise import sql_ident
from provlens.operators import affiliations as A
from provlens.operators import catalog as CT
from provlens.operators import claims as C
from provlens.operators import engagement as E
from provlens.operators import payments as P
from provlens.operators import quality as QL
from provlens.operators import registry as R
from provlens.operators import runs as RN
from provlens.operators import viewer as V
from provlens.plans import profile as PR
from provlens.sources import files as FS
from provlens.sources.results import SavedResult, open_wide, save_result, text_of
from provlens.sources.selections import Selections, stack_selections
from provlens.session import scratch_dir
from provlens.sources.tables import Inputs

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


def _ctx(spark: SparkSession, sf_dir: str, **kw) -> tuple[Inputs, Selections]:
    inputs = Inputs(spark, sf_dir)
    return inputs, Selections.from_inputs(inputs, **kw)


# ---- selections ----------------------------------------------------------

@query("selection_tables")
def q_selection_tables(spark, sf_dir):
    _, sel = _ctx(spark, sf_dir)
    return stack_selections(sel)


# ---- claims ----------------------------------------------------------------

@query("part_b_filtered")
def q_part_b_filtered(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return C.part_b_filtered(i.part_b, sel)


@query("part_d_filtered")
def q_part_d_filtered(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return C.part_d_filtered(i.part_d, sel)


@query("part_b_normalised")
def q_part_b_normalised(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return C.part_b_normalised(i.part_b, sel)


@query("part_d_normalised")
def q_part_d_normalised(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return C.part_d_normalised(i.part_d, sel)


@query("part_b_by_drug")
def q_part_b_by_drug(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return C.by_drug(C.part_b_normalised(i.part_b, sel))


@query("part_d_by_drug")
def q_part_d_by_drug(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return C.by_drug(C.part_d_normalised(i.part_d, sel))


@query("claims_union")
def q_claims_union(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return C.normalised_claims(i.part_b, i.part_d, sel)


@query("claims_by_provider_drug")
def q_claims_by_provider_drug(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return C.claims_by_provider_drug(C.normalised_claims(i.part_b, i.part_d, sel))


@query("claims_wide")
def q_claims_wide(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    union = C.normalised_claims(i.part_b, i.part_d, sel)
    return E.pivot_wide(E.claim_facts(union), E.claim_measures(sel))


# ---- payments --------------------------------------------------------------

@query("payments_filtered")
def q_payments_filtered(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return P.payments_filtered(i.payments, sel)


@query("payments_semi")
def q_payments_semi(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return P.payments_semi(i.payments, sel)


@query("payments_mapped")
def q_payments_mapped(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return P.payments_mapped(i.payments, sel)


@query("payments_mapped_regex")
def q_payments_mapped_regex(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return P.payments_mapped_regex(i.payments, sel)


@query("payments_by_category")
def q_payments_by_category(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return P.payments_by_category(P.payments_mapped(i.payments, sel), sel.categories())


@query("payments_wide")
def q_payments_wide(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return E.pivot_wide(E.payment_facts(P.payments_mapped(i.payments, sel)), E.payment_measures(sel))


@query("engagement_outer")
def q_engagement_outer(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return E.engagement_outer(i.part_b, i.part_d, i.payments, sel)


# ---- registry --------------------------------------------------------------

@query("registry_select")
def q_registry_select(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return R.registry_select(i.providers)


@query("registry_taxonomy")
def q_registry_taxonomy(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return R.registry_taxonomy(i.providers, i.taxonomy, sel)


@query("registry_filtered")
def q_registry_filtered(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return R.registry_filtered(i.providers, i.taxonomy, sel)


# ---- affiliations ----------------------------------------------------------

@query("affiliations_clean")
def q_affiliations_clean(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return A.affiliations_clean(i.affiliations)


@query("affiliations_top4")
def q_affiliations_top4(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return A.affiliations_top(A.affiliations_clean(i.affiliations), 4)


@query("facility_frequency")
def q_facility_frequency(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return A.facility_frequency(A.affiliations_clean(i.affiliations))


@query("facility_weighted_mean")
def q_facility_weighted_mean(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return A.facility_weighted_mean(A.facility_frequency(A.affiliations_clean(i.affiliations)))


@query("facility_mode")
def q_facility_mode(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return A.facility_mode(A.facility_frequency(A.affiliations_clean(i.affiliations)))


# ---- profile ---------------------------------------------------------------

@query("profile_wide")
def q_profile_wide(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return PR.profile(i, sel)


@query("profile_wide_left")
def q_profile_wide_left(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return PR.profile(i, sel, PR.ProfileOptions(affiliation_join="left"))


@query("profile_core")
def q_profile_core(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return PR.profile(i, sel, PR.ProfileOptions(with_affiliations=False, activity_filter=False))


@query("profile_part_d_only")
def q_profile_part_d_only(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir, part_b=False)
    return PR.profile(i, sel, PR.ProfileOptions(part_b=False))


@query("activity_filter")
def q_activity_filter(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    sel.prefetch()
    return E.activity_totals(PR.facts_for(i, sel), PR.measures_for(sel))


@query("wide_naming")
def q_wide_naming(spark, sf_dir):
    _, sel = _ctx(spark, sf_dir)
    return E.measure_table(sel)


@query("wide_to_long")
def q_wide_to_long(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return E.wide_to_long(PR.profile(i, sel), PR.measures_for(sel), spark)


# ---- files -----------------------------------------------------------------


VIEW_DRUGS = ("BRAND#2", "BRAND#3")
TOP_ROWS = 20
CATALOG_QUERY = "widget"


@query("scan_csv")
def q_scan_csv(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return FS.csv_roundtrip(i.taxonomy.select("Code", "Classification", "Specialization"), "scan-csv")


@query("checkpoint_roundtrip")
def q_checkpoint_roundtrip(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return FS.materialise(PR.engagement_for(i, sel), "engagement")


@query("export_csv")
def q_export_csv(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return FS.csv_roundtrip(PR.profile(i, sel), "profile-csv")


@query("catalog_roundtrip")
def q_catalog_roundtrip(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return FS.json_roundtrip(CT.catalog_drugs(i.part_d), "catalog-json")


@query("catalog_document")
def q_catalog_document(spark, sf_dir):
    """The catalogue as one JSON document, written and read by ranges."""
    i, _ = _ctx(spark, sf_dir)
    return FS.document_roundtrip(CT.catalog_drugs(i.part_d), "drugs")


@query("export_one_file")
def q_export_one_file(spark, sf_dir):
    """The profile as one CSV file, put together from its parts."""
    i, sel = _ctx(spark, sf_dir)
    return FS.one_file_roundtrip(PR.profile(i, sel))


@query("quoted_csv")
def q_quoted_csv(spark, sf_dir):
    """A CSV file with line breaks, quotes and commas inside its fields."""
    i, _ = _ctx(spark, sf_dir)
    rough = i.part_b.select("Rndrng_NPI", "HCPCS_Cd", F.concat(
        F.col("HCPCS_Desc"), F.lit("\n\"second, line\"\n\n"), F.col("HCPCS_Cd")).alias("HCPCS_Desc"))
    return FS.one_file_roundtrip(rough, "quoted")


# ---- viewer ----------------------------------------------------------------

def _profile_and_measures(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    return PR.profile(i, sel), PR.measures_for(sel)


@query("view_filtered")
def q_view_filtered(spark, sf_dir):
    prof, ms = _profile_and_measures(spark, sf_dir)
    return V.view_filtered(prof, ms, VIEW_DRUGS)


@query("ranked_view")
def q_ranked_view(spark, sf_dir):
    prof, ms = _profile_and_measures(spark, sf_dir)
    return V.ranked_positions(V.view_filtered(prof, ms, VIEW_DRUGS), ms, VIEW_DRUGS)


@query("ranked_dollars")
def q_ranked_dollars(spark, sf_dir):
    """Ranked by dollars only: the total leaves patients and claims out."""
    prof, ms = _profile_and_measures(spark, sf_dir)
    only = {m.measure for m in ms} - set(E.CLAIM_MEASURES)
    return V.ranked_view(V.view_filtered(prof, ms, VIEW_DRUGS), ms, VIEW_DRUGS, only).select("npi", "total")


@query("ranked_top")
def q_ranked_top(spark, sf_dir):
    """The first rows of the ranked view (a top-k report)."""
    prof, ms = _profile_and_measures(spark, sf_dir)
    return V.ranked_view(V.view_filtered(prof, ms, VIEW_DRUGS), ms, VIEW_DRUGS, top=TOP_ROWS).select("npi", "total")


@query("view_display")
def q_view_display(spark, sf_dir):
    prof, ms = _profile_and_measures(spark, sf_dir)
    return V.view_display(V.positioned_view(V.view_filtered(prof, ms, VIEW_DRUGS), ms, VIEW_DRUGS))


@query("view_saved")
def q_view_saved(spark, sf_dir):
    """A saved result opened again: drugs and measures from the saved list."""
    saved = _saved(spark, sf_dir)
    return V.view_filtered(saved.profile, saved.measures, VIEW_DRUGS)


@query("saved_category_totals")
def q_saved_category_totals(spark, sf_dir):
    saved = _saved(spark, sf_dir)
    return V.drug_category_totals(saved.viewed_facts(), saved.measures, spark)


def _saved(spark, sf_dir) -> SavedResult:
    i, sel = _ctx(spark, sf_dir)
    path = scratch_dir(spark, "result")
    save_result(path, PR.profile(i, sel), PR.engagement_for(i, sel), E.measure_table(sel))
    return SavedResult.open(spark, path)


@query("view_external")
def q_view_external(spark, sf_dir):
    """A wide CSV without its measure list: measures from the header alone."""
    i, sel = _ctx(spark, sf_dir)
    path = scratch_dir(spark, "external")
    FS.write_csv(PR.profile(i, sel), path)
    opened = open_wide(spark, path)
    return opened.engagement


@query("postal_format")
def q_postal_format(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return V.postal_format(R.registry_select(i.providers))


@query("drug_category_totals")
def q_drug_category_totals(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    sel.prefetch()
    return V.drug_category_totals(PR.viewed_facts(i, sel), PR.measures_for(sel), spark)


@query("drug_measure_totals")
def q_drug_measure_totals(spark, sf_dir):
    i, sel = _ctx(spark, sf_dir)
    sel.prefetch()
    return V.drug_measure_totals(PR.viewed_facts(i, sel), PR.measures_for(sel), spark)


# ---- catalogues --------------------------------------------------------------

@query("catalog_procedures")
def q_catalog_procedures(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return CT.catalog_procedures(i.part_b)


@query("catalog_drugs")
def q_catalog_drugs(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return CT.catalog_drugs(i.part_d)


@query("catalog_taxonomy")
def q_catalog_taxonomy(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return CT.catalog_taxonomy(i.taxonomy)


@query("catalog_categories")
def q_catalog_categories(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return CT.catalog_categories(i.payments, spark)


@query("catalog_categories_public")
def q_catalog_categories_public(spark, sf_dir):
    """Natures as the public file spells them: every default name occurs."""
    i, _ = _ctx(spark, sf_dir)
    return CT.catalog_categories(i.payments_public, spark)


@query("payments_mapped_public")
def q_payments_mapped_public(spark, sf_dir):
    """The fixed recode of the public file's natures, every arm taken."""
    i, sel = _ctx(spark, sf_dir)
    return P.payments_mapped_regex(i.payments_public, sel, P.PUBLIC_FILE_EQUAL_ARMS, P.PUBLIC_FILE_PATTERN_ARMS)


def _labels(i: Inputs) -> DataFrame:
    return CT.catalog_labels(CT.catalog_procedures(i.part_b), CT.catalog_drugs(i.part_d))


@query("catalog_labels")
def q_catalog_labels(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return _labels(i)


@query("label_split")
def q_label_split(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return CT.label_split(_labels(i))


@query("catalog_search")
def q_catalog_search(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return CT.catalog_search(_labels(i), CATALOG_QUERY)


@query("drug_list_parse")
def q_drug_list_parse(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return CT.drug_list_parse(i.drug_lists)


# ---- runs --------------------------------------------------------------------

@query("parse_run_names")
def q_parse_run_names(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return RN.parse_run_names(i.run_names)


@query("run_ledger")
def q_run_ledger(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return RN.run_ledger(i.runs_submitted, i.runs_finished)


@query("run_history")
def q_run_history(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return RN.run_history(RN.run_ledger(i.runs_submitted, i.runs_finished))


HISTORY_USER = "BUILDING"


@query("runs_of_user")
def q_runs_of_user(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return RN.user_positions(RN.run_ledger(i.runs_submitted, i.runs_finished), HISTORY_USER)


# ---- quality -----------------------------------------------------------------

VIEW_NAMES = ("part_b", "part_d", "payments", "providers", "taxonomy", "affiliations",
              "sel_b", "sel_d", "sel_drugs", "sel_tax", "sel_map")


@query("table_shape")
def q_table_shape(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return QL.table_shape({n: i.view(n) for n in VIEW_NAMES})


@query("null_report")
def q_null_report(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return QL.null_report({n: i.view(n) for n in VIEW_NAMES})


@query("non_numeric_report")
def q_non_numeric_report(spark, sf_dir):
    i, _ = _ctx(spark, sf_dir)
    return QL.non_numeric_report({n: i.view(n) for n in VIEW_NAMES})


@query("measure_text_report")
def q_measure_text_report(spark, sf_dir):
    """Text in the measure columns of an exported profile, read as text."""
    i, sel = _ctx(spark, sf_dir)
    ms = PR.measures_for(sel)
    path = scratch_dir(spark, "exported")
    FS.write_csv(PR.profile(i, sel), path)
    return QL.non_numeric_report({"profile": text_of(spark, path).select(*[F.col(sql_ident(m.name)) for m in ms])})


@query("json_records")
def q_json_records(spark, sf_dir):
    """Catalogue rows as JSON objects (what the catalogue refresh emits)."""
    i, _ = _ctx(spark, sf_dir)
    return QL.json_records(CT.catalog_procedures(i.part_b))


@query("json_ledger_records")
def q_json_ledger_records(spark, sf_dir):
    """Run-ledger rows as JSON, times as text."""
    i, _ = _ctx(spark, sf_dir)
    return RN.ledger_records(RN.run_ledger(i.runs_submitted, i.runs_finished))
