"""The flagship: one wide activity profile per provider.

Plan shape (one DataFrame, optimised and run once):

1. ``reg``  = registry filtered by the taxonomy selection, then enriched by
   three broadcast left joins with the taxonomy.
2. ``aff``  = affiliations cleaned and cut to the first k per provider.
3. ``base`` = ``reg`` joined with ``aff`` on npi (inner, or left).
4. ``wide`` = facts (claims and payments, each row once) pivoted by npi with an
   explicit column list and an activity total in the same aggregation; rows
   with total <= 0 are dropped here, before the join.
5. result = ``base`` inner ``wide`` on npi, columns in block order.

The aggregation hash-partitions ``wide`` on npi and the affiliation ranking
partitions ``aff`` on npi, so the final joins reuse those partitionings.
Every join to a selection table or the taxonomy is a broadcast hash join
behind a size check; the only large shuffles are on npi after map-side
partial aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlens.functions.normalise import sql_ident
from provlens.operators import affiliations as A
from provlens.operators import engagement as E
from provlens.operators import registry as R
from provlens.operators.quality import observe_rows
from provlens.plans.position import with_position
from provlens.sources.selections import Selections

TOTAL = "total"


@dataclass(frozen=True)
class ProfileOptions:
    part_b: bool = True
    part_d: bool = True
    payments: bool = True
    affiliation_join: str = "inner"  # or "left"
    with_affiliations: bool = True
    activity_filter: bool = True
    top_k: int = A.TOP_K


def measures_for(sel: Selections, opts: ProfileOptions = ProfileOptions()) -> list[E.Measure]:
    claims = (opts.part_b and sel.part_b is not None) or (opts.part_d and sel.part_d is not None)
    return E.all_measures(sel, payments=opts.payments, claims=claims)


def engagement_for(src, sel: Selections, opts: ProfileOptions = ProfileOptions()) -> DataFrame:
    return E.engagement_long(src.part_b if opts.part_b else None,
                             src.part_d if opts.part_d else None,
                             src.payments if opts.payments else None, sel)


def facts_for(src, sel: Selections, opts: ProfileOptions = ProfileOptions()) -> DataFrame:
    """All engagement facts of the chosen sources, not yet unpivoted."""
    return E.facts(src.part_b if opts.part_b else None, src.part_d if opts.part_d else None,
                   src.payments if opts.payments else None, sel)


def viewed_facts(src, sel: Selections, opts: ProfileOptions = ProfileOptions()) -> DataFrame:
    """The facts of the providers that the profile shows, summed by (npi, drug,
    measure). The facts are read and summed once; a provider's activity total
    comes from its sums. Of the provider block only the existence of a provider
    matters: registry rows after the code filter, and any complete affiliation."""
    sums = E.fact_sums(facts_for(src, sel, opts))
    active = E.activity_totals(sums).select("npi")
    shown = R.taxonomy_code_filter(R.registry_select(src.providers), sel).select("npi")
    if opts.with_affiliations and opts.affiliation_join == "inner":
        shown = shown.join(A.affiliated(src.affiliations), "npi", "left_semi")
    return sums.join(active.join(shown, "npi", "left_semi"), "npi", "left_semi")


def engagement_wide(src, sel: Selections, opts: ProfileOptions = ProfileOptions(),
                    keep_total: bool = False) -> DataFrame:
    """npi + one zero-filled column per measure (+ total when asked)."""
    measures = measures_for(sel, opts)
    wide = E.pivot_wide(facts_for(src, sel, opts), measures, total=TOTAL)
    if opts.activity_filter:
        wide = wide.where(F.col(TOTAL) > 0)
    return wide if keep_total else wide.drop(TOTAL)


def measure_places(sel: Selections, opts: ProfileOptions = ProfileOptions()) -> DataFrame:
    """(name, drug, measure, i): the measure list as a table of any length, with
    the place of each measure in it."""
    claims = (opts.part_b and sel.part_b is not None) or (opts.part_d and sel.part_d is not None)
    placed = with_position(E.measure_table(sel, opts.payments, claims), [F.col("drug"), F.col("measure")], "i")
    return placed.withColumn("i", (F.col("i") - 1).cast("int"))


def sparse_profile(src, sel: Selections, places: DataFrame, opts: ProfileOptions = ProfileOptions()) -> DataFrame:
    """The profile with sparse measures: provider block, affiliation block,
    ``total`` and ``cells`` (a measure's place -> its sum). For any number of
    measures; ``sources/results.py`` exports it as files of some columns each."""
    index = places.select("drug", F.col("measure").alias("m"), "i")
    sparse = E.sparse_wide(facts_for(src, sel, opts), index)
    if opts.activity_filter:
        sparse = sparse.where(F.col(TOTAL) > 0)
    base = provider_base(src, sel, opts)
    cols = R.provider_block(base) + (list(A.affiliation_block(opts.top_k)) if opts.with_affiliations else [])
    return base.join(sparse, "npi").select(*cols, TOTAL, "cells")


def provider_base(src, sel: Selections, opts: ProfileOptions = ProfileOptions(),
                  aff: DataFrame | None = None) -> DataFrame:
    reg = R.registry_filtered(src.providers, src.taxonomy, sel)
    if not opts.with_affiliations:
        return reg
    if aff is None:
        aff = A.affiliations_top(A.affiliations_clean(src.affiliations), opts.top_k)
    return reg.join(aff, "npi", opts.affiliation_join)


def profile(src, sel: Selections, opts: ProfileOptions = ProfileOptions(),
            keep_total: bool = False, shapes: dict | None = None) -> DataFrame:
    """Provider block, affiliation block, measure columns.

    With a ``shapes`` dict, the row counts of the stages (``engaged`` providers
    after the activity filter, ``base`` providers, ``result``) are recorded as
    observations of the one job that runs the plan: read them with
    ``shapes[name].get`` after the action.
    """
    sel.lookups.setdefault("taxonomy_table", src.taxonomy)  # measured with the selections
    sel.prefetch()  # sizes and names are asked for while the other parts are built
    aff = A.affiliations_top(A.affiliations_clean(src.affiliations), opts.top_k) \
        if opts.with_affiliations else None
    for name in ("part_b", "part_d", "payments", "providers", "taxonomy"):
        getattr(src, name)
    measures = measures_for(sel, opts)
    wide = engagement_wide(src, sel, opts, keep_total=True)
    base = provider_base(src, sel, opts, aff)
    if shapes is not None:
        wide, shapes["engaged"] = observe_rows(wide, "engaged")
        base, shapes["base"] = observe_rows(base, "base")
    cols = R.provider_block(base)
    if opts.with_affiliations:
        cols += list(A.affiliation_block(opts.top_k))
    cols += [F.col(sql_ident(m.name)) for m in measures]
    if keep_total:
        cols.append(TOTAL)
    out = base.join(wide, "npi", "inner").select(*cols)
    if shapes is not None:
        out, shapes["result"] = observe_rows(out, "result")
    return out
