"""Invariants between operators on the sf0.001 test data."""

from __future__ import annotations

import pytest

import bench
from pyspark.sql import functions as F

from provlens.operators import engagement as E
from provlens.operators import runs as RN
from provlens.operators import viewer as V
from provlens.plans import profile as PR
from provlens.sources.selections import Selections
from provlens.sources.tables import Inputs
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def ctx(spark):
    i = Inputs(spark, SF_SMALL)
    sel = Selections.from_inputs(i)
    return i, sel, PR.measures_for(sel)


def test_wide_cells_sum_to_long_facts(ctx):
    i, sel, ms = ctx
    opts = PR.ProfileOptions(activity_filter=False)
    wide = PR.engagement_wide(i, sel, opts)
    names = [m.name for m in ms]
    wide_sum = wide.select(F.expr(" + ".join(f"`{n}`" for n in names)).alias("s")).agg(F.sum("s")).first()[0]
    long_sum = E.activity_totals(PR.engagement_for(i, sel), ms).agg(F.sum("total")).first()[0]
    neg = PR.engagement_for(i, sel).groupBy("npi").agg(F.sum("amount").alias("t")).where("t <= 0")
    assert wide_sum == long_sum + (neg.agg(F.sum("t")).first()[0] or 0)


def test_profile_one_row_per_provider_and_active(ctx):
    i, sel, ms = ctx
    prof = PR.profile(i, sel, keep_total=True)
    assert prof.count() == prof.select("npi").distinct().count()
    assert prof.where("total <= 0").count() == 0


def test_left_profile_has_at_least_inner_rows(ctx):
    i, sel, _ = ctx
    inner = PR.profile(i, sel).count()
    left = PR.profile(i, sel, PR.ProfileOptions(affiliation_join="left")).count()
    assert left >= inner > 0


def test_wide_long_wide_is_identity(spark, ctx):
    i, sel, ms = ctx
    wide = PR.engagement_wide(i, sel, PR.ProfileOptions())
    back = E.pivot_wide(E.wide_to_long(wide, ms, spark), ms)
    assert wide.exceptAll(back.select(*wide.columns)).count() == 0
    assert back.select(*wide.columns).exceptAll(wide).count() == 0


def test_ranked_positions_are_a_permutation_in_order(ctx):
    i, sel, ms = ctx
    prof = PR.profile(i, sel)
    ranked = V.ranked_positions(V.view_filtered(prof, ms, ["All"]), ms, ["All"])
    got = [(r["position"], r["total"], r["npi"]) for r in ranked.collect()]
    assert got == sorted(got)  # rows come in order
    full = V.ranked_view(V.view_filtered(prof, ms, ["All"]), ms, ["All"]).select("total", "npi").collect()
    assert [(r["total"], r["npi"]) for r in full] == [(t, n) for _, t, n in got]
    top = V.ranked_view(V.view_filtered(prof, ms, ["All"]), ms, ["All"], top=5).select("total", "npi").collect()
    assert top == full[:5]
    assert [p for p, _, _ in got] == list(range(1, len(got) + 1))
    keys = [(-t, n) for _, t, n in got]
    assert keys == sorted(keys)


def test_history_positions_restart_per_user(ctx):
    i, _, _ = ctx
    hist = RN.run_history(RN.run_ledger(i.runs_submitted, i.runs_finished))
    per_user = hist.groupBy("username").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("lo"),
                                            F.max("position").alias("hi"),
                                            F.countDistinct("position").alias("d"))
    for r in per_user.collect():
        assert (r["lo"], r["hi"], r["d"]) == (1, r["n"], r["n"])


def test_pivot_strategies_agree(ctx):
    i, sel, ms = ctx
    long = PR.engagement_for(i, sel)
    a = E.pivot_wide(long, ms, total="total", strategy="conditional")
    b = E.pivot_wide(long, ms, total="total", strategy="two_phase").select(*a.columns)
    assert a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_reference_shaped_run_gives_the_same_rows(spark, ctx):
    i, sel, _ = ctx
    one_plan = PR.profile(i, sel)
    staged = bench.profile_staged(i, sel).select(*[F.col(f"`{c}`") for c in one_plan.columns])
    assert staged.count() == one_plan.count() > 0
    assert one_plan.exceptAll(staged).count() == 0 and staged.exceptAll(one_plan).count() == 0
