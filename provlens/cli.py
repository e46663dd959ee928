"""Command-line entry.

    python -m provlens.cli profile --part-b B.csv --part-d D.csv --payments P.csv \\
        --providers N.csv --taxonomy T.csv --affiliations A.csv \\
        --selections SEL_DIR --out OUT_DIR [--format csv|parquet] \\
        [--ledger LEDGER_DIR --user NAME]
    python -m provlens.cli view --result OUT_DIR --out VIEW_DIR [--drugs A,B] \\
        [--dollars] [--top N]
    python -m provlens.cli catalogues --part-b ... (the same files) --out OUT_DIR

``SEL_DIR`` (any file system Spark reads) holds ``part_b.csv``,
``part_d.csv``, ``drugs.csv``, ``taxonomy.csv`` and ``category_map.csv`` (header
CSV; a missing part_b / part_d file means that source is not selected, any
other missing file is an error). ``profile`` writes below ``OUT_DIR``: the wide
table in ``profile.csv`` (or ``.parquet``), the long facts in ``engagement`` and the measure list in
``measures`` (Parquet), which ``view`` reads again. It prints the row counts of
the stages and the numbers that could not be read, observed in the job that
writes the table. ``view`` lists, filters, ranks and totals a saved result;
``catalogues`` writes the four lookup catalogues as JSON lines. With
``--ledger``, a ``submitted`` and a ``finished`` event are appended to the
ledger table.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import uuid

from pyspark.sql import SparkSession

from provlens.operators import catalog as CT
from provlens.operators import engagement as E
from provlens.operators import viewer as V
from provlens.operators.runs import append_run_event
from provlens.plans.bounded import MAX_PIVOT_VALUES, row_count_at_most
from provlens.plans.profile import (ProfileOptions, engagement_for, measure_places, measures_for, profile,
                                    sparse_profile)
from provlens.session import remove_scratch
from provlens.sources.files import write_csv
from provlens.sources.onefile import write_catalog_document
from provlens.sources.public_files import PublicFiles
from provlens.sources.results import SavedResult, save_groups, save_result
from provlens.sources.selections import OPTIONAL, Selections


def run(spark: SparkSession, files: dict, selections_dir: str, out: str, fmt: str = "csv",
        single_file: bool = False, ledger: str | None = None, user: str = "cli",
        affiliation_join: str = "inner", report: dict | None = None) -> str:
    """The profile run; ``report`` receives stage row counts and bad values."""
    run_id = str(uuid.uuid4())
    if ledger:
        append_run_event(spark, ledger, run_id, user, "submitted", dt.datetime.now(), out)
    sel = Selections.from_folder(spark, selections_dir)
    opts = ProfileOptions(part_b=sel.part_b is not None, part_d=sel.part_d is not None,
                          affiliation_join=affiliation_join)
    src = PublicFiles(spark, files)
    shapes: dict = {}
    places = measure_places(sel, opts)
    if not row_count_at_most(places, MAX_PIVOT_VALUES):  # too wide for one table: files of some columns each
        save_groups(out, sparse_profile(src, sel, places, opts), places)
        if ledger:
            append_run_event(spark, ledger, run_id, user, "finished", dt.datetime.now(), out)
        return run_id
    result = profile(src, sel, opts, shapes=shapes)
    save_result(out, result, engagement_for(PublicFiles(spark, files), sel, opts),
                E.measures_frame(spark, measures_for(sel, opts)), fmt, single_file)
    if report is not None:
        report["rows"] = {name: seen.get["n_rows"] for name, seen in shapes.items()}
        skipped = {k for k in OPTIONAL if getattr(sel, k) is None}
        report["bad_values"] = src.bad_value_counts([k for k in files if k not in skipped])
    if ledger:
        append_run_event(spark, ledger, run_id, user, "finished", dt.datetime.now(), out)
    return run_id


def view(spark: SparkSession, result: str, out: str, drugs: list[str], dollars: bool = False,
         top: int | None = None) -> None:
    """Filter, rank and display a saved result, and write its totals."""
    saved = SavedResult.open(spark, result)
    only = {m.measure for m in saved.measures} - set(E.CLAIM_MEASURES) if dollars else None
    chosen = V.view_filtered(saved.profile, saved.measures, drugs)
    write_csv(V.view_display(V.ranked_view(chosen, saved.measures, drugs, only, top)), f"{out}/view")
    facts = saved.viewed_facts()
    write_csv(V.drug_category_totals(facts, saved.measures, spark), f"{out}/category_totals")
    write_csv(V.drug_measure_totals(facts, saved.measures, spark), f"{out}/measure_totals")


def catalogues(spark: SparkSession, files: dict, out: str) -> None:
    """Refresh the four catalogues from the public files: JSON lines, and the
    documents that the selection page reads."""
    src = PublicFiles(spark, files)
    for name, field, df in (("procedures", "drugs", CT.catalog_procedures(src.part_b)),
                            ("drugs", "drugs", CT.catalog_drugs(src.part_d)),
                            ("taxonomy", "codes", CT.catalog_taxonomy(src.taxonomy)),
                            ("categories", "categories", CT.catalog_categories(src.payments, spark))):
        df.write.mode("overwrite").json(f"{out}/{name}")
        write_catalog_document(spark.read.schema(df.schema).json(f"{out}/{name}"), f"{out}/{name}.json", field)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    commands = ap.add_subparsers(dest="command", required=True)
    sources = ("part-b", "part-d", "payments", "providers", "taxonomy", "affiliations")
    prof, cat = commands.add_parser("profile"), commands.add_parser("catalogues")
    show = commands.add_parser("view")
    for name in sources:
        prof.add_argument(f"--{name}", required=True)
        cat.add_argument(f"--{name}", required=name in ("part-b", "part-d", "payments", "taxonomy"))
    for p in (prof, cat, show):
        p.add_argument("--out", required=True)
    prof.add_argument("--selections", required=True)
    prof.add_argument("--format", choices=("csv", "parquet"), default="csv")
    prof.add_argument("--single-file", action="store_true")
    prof.add_argument("--left-affiliations", action="store_true")
    prof.add_argument("--ledger")
    prof.add_argument("--user", default=os.environ.get("USER", "cli"))
    show.add_argument("--result", required=True)
    show.add_argument("--drugs", default=V.ALL)
    show.add_argument("--dollars", action="store_true")
    show.add_argument("--top", type=int)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("provlens").getOrCreate()
    try:
        if a.command == "view":
            view(spark, a.result, a.out, [d.strip() for d in a.drugs.split(",")], a.dollars, a.top)
            return
        files = {k: getattr(a, k) for k in (s.replace("-", "_") for s in sources) if getattr(a, k)}
        if a.command == "catalogues":
            catalogues(spark, files, a.out)
            return
        report: dict = {}
        run_id = run(spark, files, a.selections, a.out, a.format, a.single_file, a.ledger, a.user,
                     "left" if a.left_affiliations else "inner", report)
        print(json.dumps({"run_id": run_id, **report}))
    finally:
        remove_scratch()


if __name__ == "__main__":
    main()
