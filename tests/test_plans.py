"""Plan shape of the flagship: no Python, broadcast joins for small sides, no
cartesian products, a bounded number of jobs while the plan is built."""

from __future__ import annotations

import contextlib
import io

from provlens.operators import claims as C
from provlens.plans import profile as PR
from provlens.sources.selections import Selections
from provlens.sources.tables import Inputs
from tests.conftest import SF_SMALL


def explain(df, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_flagship_plan_shape(spark):
    i = Inputs(spark, SF_SMALL)
    plan = explain(PR.profile(i, Selections.from_inputs(i)))
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                "BroadcastNestedLoopJoin"):
        assert bad not in plan
    assert "BroadcastHashJoin" in plan
    assert "arrays_overlap" in plan  # taxonomy codes: one scalar array, no join
    # no fact row is doubled before it is aggregated
    assert "Expand" not in plan
    assert "WindowGroupLimit" in plan  # first-k facilities limited before the shuffle
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,O)" in plan


def test_plan_build_runs_few_jobs(spark):
    sc = spark.sparkContext
    i = Inputs(spark, SF_SMALL)
    sel = Selections.from_inputs(i)
    sc.setJobGroup("build-test", "plan build")
    PR.profile(i, sel)
    jobs = sc.statusTracker().getJobIdsForGroup("build-test")
    sc.setLocalProperty("spark.jobGroup.id", None)
    # two collects, sizes and names; AQE submits each of their shuffle and
    # broadcast stages as a job. Nothing scales with the number of
    # selection tables or measures.
    assert 1 <= len(jobs) <= 14


def test_a_query_measures_only_what_it_joins(spark):
    i = Inputs(spark, SF_SMALL)
    sel = Selections.from_inputs(i)
    C.part_b_filtered(i.part_b, sel)
    assert set(sel._sizes) == {"part_b"} and sel._names is None


def test_scans_prune_columns(spark):
    i = Inputs(spark, SF_SMALL)
    plan = explain(PR.profile(i, Selections.from_inputs(i)))
    # lineitem is read with only the columns the adapters use
    reads = [ln for ln in plan.splitlines() if "ReadSchema: struct<l_orderkey" in ln]
    assert reads and all("l_extendedprice" not in ln for ln in reads)


def test_pivot_aggregates_before_the_shuffle(spark):
    i = Inputs(spark, SF_SMALL)
    plan = explain(PR.engagement_wide(i, Selections.from_inputs(i)))
    # map-side partial aggregation, then one exchange on npi, then the final sums
    assert "partial_sum" in plan
    assert plan.count("Arguments: hashpartitioning(npi") == 1
